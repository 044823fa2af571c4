"""Sources, sinks, profiling."""

from __future__ import annotations


from pyspark.sql import functions as F

from fleetpulse.functions.rules import r6
from fleetpulse.operators import cadence, profile, sketches, state, tables
from fleetpulse.params import SENSOR_KEYS
from fleetpulse.plans.shared import table
from fleetpulse.plans.slices import add_slice
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.queries.forecasts import replayed
from fleetpulse.queries.stateful import EDITED_ARRIVAL, PLAN_SQL, VALIDATED, discovered, plan, reason_kind, validated
from fleetpulse.queries.windows import _LAG_COLS, _THIN, PLANNED, thin
from fleetpulse.sources import readings as src
from fleetpulse.sources.binding import readings

ID = ["machine_id", "us"]
K = SENSOR_KEYS

# Readings as text, with unreadable, blank, repeated and backward cells at known ids.
TEXT = """txt AS (SELECT machine_id, ingest_seq, event_id, CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'soon' ELSE 'ok' END AS tk,
  CASE WHEN event_id % 101 = 0 OR event_id % 103 = 0 THEN NULL WHEN event_id % 53 = 0 THEN us - 60000000 WHEN event_id % 59 = 0 THEN us - 90000000 ELSE us END AS us,
  CASE WHEN event_id % 107 = 0 THEN 'blank' WHEN event_id % 109 = 0 THEN 'text' ELSE 'ok' END AS vk, CASE WHEN event_id % 113 = 0 THEN 'odd' WHEN event_id % 127 = 0 THEN '' ELSE health_status END AS label FROM readings)"""


def text_rows(spark, sf):
    e = F.col("event_id")
    us = F.when(e % 53 == 0, F.col("us") - 60_000_000).when(e % 59 == 0, F.col("us") - 90_000_000).otherwise(F.col("us"))
    stamp = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")
    return readings(spark, sf).select(
        "machine_id", "ingest_seq", F.when(e % 101 == 0, "").when(e % 103 == 0, "soon").otherwise(stamp).alias("timestamp"),
        F.when(e % 107 == 0, " ").when(e % 109 == 0, "n/a").otherwise(F.col(K[0]).cast("string")).alias(K[0]),
        *[F.col(k).cast("string").alias(k) for k in K[1:]],
        F.when(e % 113 == 0, "odd").when(e % 127 == 0, "").otherwise(F.upper("health_status")).alias("health_status"))


@query("tolerant_scan", "S1", q.with_readings("""
SELECT machine_id, ingest_seq, us, CASE WHEN tk <> 'ok' THEN 'time' WHEN vk <> 'ok' THEN 'number' ELSE '' END AS problem, nullif(label, '') AS label FROM txt""", TEXT))
def tolerant_scan(spark, sf):
    rows = src.parse_rows(text_rows(spark, sf))
    problem = F.when(F.col("parse_reason").contains("time not"), "time").when(F.col("parse_reason").isNotNull(), "number").otherwise("")
    return rows.select("machine_id", "ingest_seq", "us", problem.alias("problem"), "label")


@query("strict_scan", "S2", q.with_readings("SELECT machine_id, count(*) AS rows, max(us) AS last_us FROM readings GROUP BY machine_id"))
def strict_scan(spark, sf):
    clean = readings(spark, sf).select(
        "machine_id", "ingest_seq", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        *[F.col(k).cast("string").alias(k) for k in K], "health_status")
    return src.strict(src.parse_rows(clean)).groupBy("machine_id").agg(F.count("*").alias("rows"), F.max("us").alias("last_us"))


@query("column_contract", "S3", q.with_readings("""
SELECT code, count, rows_refused FROM (VALUES ('missing_required_columns', 1::BIGINT), ('column_contract_mismatch', 1)) v(code, count),
  (SELECT count(*) AS rows_refused FROM readings)"""))
def column_contract(spark, sf):
    """What is wrong with a table whose label column has another name, and how many rows that refuses."""
    rows = text_rows(spark, sf).withColumnRenamed("health_status", "state")
    total = rows.agg(F.count("*").alias("rows_refused"))
    return src.check_contract(rows).select("code", "count").crossJoin(total)  # one row


@query("lifecycle_metadata", "S4", q.with_readings("SELECT machine_id, lifecycle_id, start_us, end_us, reset_us FROM plan WHERE machine_id <> 'm0'", q.RAW, PLANNED, PLAN_SQL))
def lifecycle_metadata(spark, sf):
    def stamp(c):
        return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    record = F.struct("lifecycle_id", stamp("start_us").alias("start_timestamp"), stamp("end_us").alias("end_timestamp"),
                      stamp("reset_us").alias("maintenance_record_timestamp"))
    text = plan(spark, sf).groupBy("machine_id").agg(F.collect_list(record).alias("lifecycles")).select(F.to_json(F.struct(
        F.when(F.col("machine_id") == "m0", "plant").otherwise("realistic_synthetic").alias("data_domain"), "machine_id", "lifecycles")).alias("j"))
    parsed = text.select(F.from_json("j", src.METADATA).alias("m")).select("m.*")
    return src.lifecycle_records(parsed).select("machine_id", "lifecycle_id", "start_us", "end_us", "reset_us")


@query("narrow_audit_scan", "S6")
def narrow_audit_scan(spark, sf):
    return replayed(spark, sf).select(*ID, "lifecycle_id", "event_status", "probability_warning_12h", "probability_critical_24h")


@query("invalid_rows", "S9", q.with_readings("""
SELECT machine_id, ingest_seq AS row_number, kind, CASE kind WHEN 'duplicate' THEN 'DUPLICATE_TIMESTAMP' WHEN 'order' THEN 'OUT_OF_ORDER_TIMESTAMP'
  WHEN 'jump' THEN 'OUT_OF_RANGE' ELSE 'MALFORMED_VALUE' END AS anomaly_type, false AS training_eligible FROM val WHERE NOT valid""", EDITED_ARRIVAL, VALIDATED))
def invalid_rows(spark, sf):
    return tables.invalid_rows(validated(spark, sf)).select(
        "machine_id", "row_number", reason_kind("validation_reason").alias("kind"), "anomaly_type", "training_eligible")


@query("valid_row_limit", "S12", q.with_readings("""
SELECT machine_id, ingest_seq FROM (SELECT *, coalesce(sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY ingest_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM val) WHERE before < 700""", EDITED_ARRIVAL, VALIDATED))
def valid_row_limit(spark, sf):
    return tables.limit_valid(validated(spark, sf), 700).select("machine_id", "ingest_seq")


# Model records made from orders: an order is a record, its clerk-like key a target.
RECORDS = """rec AS (SELECT o_orderkey, 'target_' || (o_orderkey % 5) AS target, CASE o_orderkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'candidate' ELSE 'archived' END AS stage,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey * 1000 END AS promotion_us FROM orders)"""


def records(spark, sf):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.concat(F.lit("target_"), (k % 5).cast("string")).alias("target"),
        F.when(k % 3 == 0, "production").when(k % 3 == 1, "candidate").otherwise("archived").alias("stage"),
        F.when(k % 6 == 0, k * 1000).alias("promotion_us"))


@query("archived_evidence", "S14", f"""WITH {RECORDS} SELECT o_orderkey, target, CASE WHEN stage = 'production' AND target IN ('target_1', 'target_3') THEN 'archived' ELSE stage END AS stage,
  CASE WHEN stage = 'production' AND target IN ('target_1', 'target_3') THEN coalesce(promotion_us, 77) ELSE promotion_us END AS promotion_us FROM rec""")
def archived_evidence(spark, sf):
    return tables.archive_evidence(records(spark, sf), ["target_1", "target_3"], 77)


@query("replay_rows", "L6", q.with_readings("""
SELECT machine_id, us, interpolated, valid, count(*) AS rows FROM (SELECT machine_id, us, false AS interpolated, true AS valid FROM thin UNION ALL
  SELECT machine_id, p_us + step * 60000000, true, true FROM (SELECT *, unnest(range(1, missing + 1)) AS step FROM g WHERE missing > 0 AND gap <= 300 AND health_status = 'normal' AND p_health_status = 'normal' AND lifecycle_id = p_lifecycle_id)
  UNION ALL SELECT machine_id, us, NULL, false FROM val WHERE NOT valid) GROUP BY ALL""", q.RAW, PLANNED, _THIN, f"""
g0 AS (SELECT *, {_LAG_COLS} FROM thin WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_seq)),
g AS (SELECT *, coalesce((us - p_us) / 1e6::DOUBLE, 0) AS gap, CAST(greatest(coalesce((us - p_us) // 60000000, 0) - 1, 0) AS BIGINT) AS missing FROM g0)""", EDITED_ARRIVAL, VALIDATED))
def replay_rows(spark, sf):
    good = cadence.safe_resample(add_slice(thin(spark, sf)), enabled=True, lifecycle="lifecycle_id").select("machine_id", "us", "interpolated")
    bad = validated(spark, sf).filter("NOT valid").select("machine_id", "us")
    return tables.replay_rows(good, bad).groupBy("machine_id", "us", "interpolated", "valid").agg(F.count("*").alias("rows"))


# ---- profile ------------------------------------------------------------------------

_Q = ", ".join(f"{q.r6(f'quantile_cont(v, {p})', 5)} AS {n}" for p, n in zip(profile.PROBS, profile.NAMES))


@query("percentiles", "Q1", q.with_readings(
    f"SELECT machine_id, variable, {_Q} FROM (SELECT machine_id, unnest([{', '.join(repr(k) for k in K)}, 'interval_s']) AS variable, unnest([{', '.join(K)}, (us - lag(us) OVER (PARTITION BY machine_id ORDER BY ingest_seq)) / 1e6::DOUBLE]) AS v FROM readings) WHERE v IS NOT NULL GROUP BY ALL"))
def percentiles(spark, sf):
    rows = profile.intervals(add_slice(readings(spark, sf), "ingest_seq", 20_000))
    out = profile.percentiles(rows, {**{k: F.col(k) for k in K}, "interval_s": F.col("interval_s")})
    return out.withColumns({n: r6(n, 5) for n in profile.NAMES})


@query("sketched_percentiles", "Q1")
def sketched_percentiles(spark, sf):
    """Percentiles per machine and sensor from stored sketches of its days."""
    days = table(spark, f"daily_sketches:{sf}", lambda: sketches.daily_sketches(readings(spark, sf), {k: F.col(k) for k in K}))
    return sketches.sketched_percentiles(days)


@query("sensor_statistics", "Q2", q.with_readings(f"""
SELECT a.machine_id, a.variable, {", ".join(f"{q.r6(f'quantile_cont(v, {p})', 5)} AS {n}" for p, n in zip(profile.PROBS, profile.NAMES) if n not in ('p25', 'p75'))},
  {q.r6('avg(v)', 5)} AS mean, {q.r6('stddev_pop(v)', 5)} AS standard_deviation, {q.r6('median(abs(d - m)) * 1.4826 / sqrt(2)', 5)} AS measurement_noise_estimate
FROM dif a JOIN (SELECT machine_id, variable, median(d) AS m FROM dif GROUP BY ALL) b USING (machine_id, variable) GROUP BY a.machine_id, a.variable""",
    f"lng AS (SELECT machine_id, ingest_seq, unnest([{', '.join(repr(k) for k in K)}]) AS variable, unnest([{', '.join(K)}]) AS v FROM readings), "
    "dif AS (SELECT *, v - lag(v) OVER (PARTITION BY machine_id, variable ORDER BY ingest_seq) AS d FROM lng)"))
def sensor_statistics(spark, sf):
    out = profile.sensor_statistics(add_slice(readings(spark, sf)))
    return out.withColumns({n: r6(n, 5) for n in out.columns if n not in ("machine_id", "variable")})


@query("quality_counts", "Q3", q.with_readings("""
, st AS (SELECT *, (us - lag(us) OVER (PARTITION BY machine_id ORDER BY ingest_seq)) / 1e6::DOUBLE AS s FROM txt WHERE us IS NOT NULL),
md AS (SELECT machine_id, median(s) FILTER (s > 0) AS m FROM st GROUP BY machine_id)
SELECT c.*, d.* EXCLUDE (machine_id) FROM (SELECT machine_id, count(*) AS row_count, count(*) FILTER (us IS NULL) AS invalid_timestamps,
    count(*) FILTER (us IS NOT NULL AND label IN ('odd', '')) AS invalid_status_values, count(*) FILTER (us IS NOT NULL AND vk = 'blank') AS missing_vibration_mps2, 0::BIGINT AS missing_temperature_c, 0::BIGINT AS missing_current_ampere,
    count(*) FILTER (us IS NOT NULL AND vk = 'text') AS non_numeric_vibration_mps2, 0::BIGINT AS non_numeric_temperature_c, 0::BIGINT AS non_numeric_current_ampere FROM txt GROUP BY machine_id) c
JOIN (SELECT machine_id, count(*) FILTER (s = 0) AS duplicate_timestamps, count(*) FILTER (s < 0) AS out_of_order_timestamps,
    CAST(sum(greatest(round_even(s / m, 0) - 1, 0)) FILTER (s > 0) AS BIGINT) AS missing_timestamps, max(m) AS median_seconds FROM st JOIN md USING (machine_id) GROUP BY machine_id) d USING (machine_id)""", TEXT))
def quality_counts(spark, sf):
    return profile.quality_counts(add_slice(src.parse_rows(text_rows(spark, sf)), "ingest_seq", 20_000))


@query("validation_summary", "Q4", q.with_readings("""
SELECT machine_id, kind, count(*) AS reasons, sum(n)::BIGINT AS rows FROM (SELECT machine_id, kind, reason, count(*) AS n FROM (SELECT *, CASE kind WHEN 'range' THEN
    'Vibration ' || vibration_mps2 WHEN 'jump' THEN printf('%.3f', vibration_mps2) || '-' || ingest_seq ELSE kind END AS reason FROM val WHERE NOT valid AND kind <> 'jump') GROUP BY ALL) GROUP BY ALL""", EDITED_ARRIVAL, VALIDATED))
def validation_summary(spark, sf):
    out = profile.validation_summary(validated(spark, sf)).withColumn("kind", reason_kind())
    return out.filter("kind <> 'jump'").groupBy("machine_id", "kind").agg(F.count("*").alias("reasons"), F.sum("rows").alias("rows"))


@query("validation_examples", "Q4")
def validation_examples(spark, sf):
    return profile.validation_summary(validated(spark, sf)).withColumn("example_rows", F.array_join("example_rows", "|"))


_RUN = """(SELECT machine_id, run, any_value(health_status) AS label, (max(us) - min(us)) / 3.6e9::DOUBLE + 1 / 60.0::DOUBLE AS h FROM (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> health_status THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS run
  FROM (SELECT *, lag(health_status) OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS pl FROM readings)) GROUP BY ALL)"""


@query("timeline_summary", "Q5", q.with_readings(f"""
SELECT s.*, {", ".join(f"{q.r6(f'coalesce(l_{x}, 0)')} AS longest_{x}_hours" for x in ("normal", "warning", "critical"))}, transitions FROM (
  SELECT machine_id, min(us) AS start_us, max(us) AS end_us, {q.r6('(max(us) - min(us)) / 3.6e9::DOUBLE')} AS total_hours, min(us) FILTER (health_status = 'warning') AS first_warning_us,
    min(us) FILTER (health_status = 'critical') AS first_critical_us FROM readings GROUP BY machine_id) s
JOIN (SELECT machine_id, {", ".join(f"max(h) FILTER (label = '{x}') AS l_{x}" for x in ("normal", "warning", "critical"))}, count(*) - 1 AS transitions FROM {_RUN} GROUP BY machine_id) USING (machine_id)"""))
def timeline_summary(spark, sf):
    rows = add_slice(readings(spark, sf).withColumn("label", F.col("health_status")))
    out = profile.timeline_summary(rows)
    return out.withColumns({c: r6(c) for c in ("total_hours", "longest_normal_hours", "longest_warning_hours", "longest_critical_hours")})


@query("suitability", "Q6")
def suitability(spark, sf):
    rows = add_slice(src.parse_rows(text_rows(spark, sf)), "ingest_seq", 20_000)
    return profile.suitability(profile.quality_counts(rows), validated(spark, sf), state.closed_lifecycles(discovered(spark, sf)), [*src.COLUMNS, "extra"])


@query("range_vs_envelope", "Q7", q.with_readings(f"""
SELECT sensor, machine_id, {q.r6('min(v)')} AS observed_minimum, {q.r6('max(v)')} AS observed_maximum, {q.r6('any_value(lo)')} AS p01, {q.r6('any_value(hi)')} AS p99, min(v) < any_value(lo) OR max(v) > any_value(hi) AS outside_training_range
FROM (SELECT machine_id, unnest([{', '.join(repr(k) for k in K)}]) AS sensor, unnest([{', '.join(K)}]) AS v FROM readings)
JOIN (SELECT sensor, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM (SELECT unnest([{', '.join(repr(k) for k in K)}]) AS sensor, unnest([{', '.join(K)}]) AS v FROM readings WHERE machine_id IN ('m0', 'm1')) GROUP BY sensor) USING (sensor) GROUP BY sensor, machine_id"""))
def range_vs_envelope(spark, sf):
    from fleetpulse.operators.training import feature_envelope
    rows = readings(spark, sf)
    train = rows.filter(F.col("machine_id").isin("m0", "m1")).select(*[F.col(k).alias(f"{k}__raw") for k in K])
    out = profile.range_vs_envelope(rows, feature_envelope(train, [f"{k}__raw" for k in K]))
    return out.select("sensor", "machine_id", *[r6(c).alias(c) for c in ("observed_minimum", "observed_maximum", "p01", "p99")], "outside_training_range")


