"""Validation fold, smoothing, lifecycles, baseline, hysteresis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions.rules import r6
from fleetpulse.operators import lifecycles as life, persistence, rules as ops, state
from fleetpulse.params import SENSOR_KEYS, SENSORS
from fleetpulse.plans.shared import table
from fleetpulse.plans.slices import add_slice
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.queries.windows import PLANNED, planned
from fleetpulse.sources.binding import readings

ID = ["machine_id", "us"]
KEY = "machine_id, us"
W = state.FOLD_WIDTH_US

# ---- arrival-order validation ----------------------------------------------

EDITED_ARRIVAL = """vin AS (SELECT machine_id, ingest_seq,
  CASE WHEN event_id % 53 = 0 THEN us - 60000000 WHEN event_id % 59 = 0 THEN us - 90000000 ELSE us END AS us,
  CASE WHEN event_id % 61 = 0 THEN vibration_mps2 + 13.5 WHEN event_id % 67 = 0 THEN vibration_mps2 + 40 ELSE vibration_mps2 END AS vibration_mps2,
  CASE WHEN event_id % 71 = 0 THEN 'NaN'::DOUBLE ELSE temperature_c END AS temperature_c, current_ampere,
  CASE WHEN event_id % 73 = 0 THEN 'odd' ELSE health_status END AS label FROM readings)"""

VALIDATED = """
v0 AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ingest_seq) AS p FROM vin),
v1 AS (SELECT machine_id, 0::BIGINT AS p, NULL::BIGINT AS lu, NULL::DOUBLE AS lv, NULL::DOUBLE AS lt, NULL::DOUBLE AS lc, '' AS verdict
  FROM v0 WHERE p = 1
  UNION ALL
  SELECT machine_id, p, CASE WHEN verdict = '' THEN us ELSE lu END, CASE WHEN verdict = '' THEN vibration_mps2 ELSE lv END,
    CASE WHEN verdict = '' THEN temperature_c ELSE lt END, CASE WHEN verdict = '' THEN current_ampere ELSE lc END, verdict
  FROM (SELECT r.*, s.lu, s.lv, s.lt, s.lc, CASE
    WHEN r.label NOT IN ('normal','warning','critical') THEN 'label'
    WHEN r.us <= s.lu THEN 'time'
    WHEN isnan(r.vibration_mps2) THEN 'finite' WHEN r.vibration_mps2 NOT BETWEEN 0 AND 20 THEN 'range'
    WHEN abs(r.vibration_mps2 - s.lv) > 12 THEN 'jump'
    WHEN isnan(r.temperature_c) THEN 'finite' WHEN r.temperature_c NOT BETWEEN -20 AND 200 THEN 'range'
    WHEN abs(r.temperature_c - s.lt) > 200 THEN 'jump'
    WHEN isnan(r.current_ampere) THEN 'finite' WHEN r.current_ampere NOT BETWEEN 0 AND 50 THEN 'range'
    WHEN abs(r.current_ampere - s.lc) > 16 THEN 'jump' ELSE '' END AS verdict
    FROM v1 s JOIN v0 r ON r.machine_id = s.machine_id AND r.p = s.p + 1)),
val AS (SELECT r.*, s.verdict, s.verdict = '' AS valid, CASE s.verdict WHEN '' THEN '' WHEN 'label' THEN 'label'
    WHEN 'time' THEN CASE WHEN EXISTS (SELECT 1 FROM v0 a JOIN v1 b USING (machine_id, p)
      WHERE b.verdict = '' AND a.machine_id = r.machine_id AND a.us = r.us AND a.p < r.p) THEN 'duplicate' ELSE 'order' END
    ELSE s.verdict END AS kind FROM v0 r JOIN v1 s USING (machine_id, p))"""


def arrival_rows(spark, sf):
    e = F.col("event_id")
    df = readings(spark, sf).withColumns({
        "us": F.when(e % 53 == 0, F.col("us") - 60_000_000).when(
            e % 59 == 0, F.col("us") - 90_000_000).otherwise(F.col("us")),
        "vibration_mps2": F.when(e % 61 == 0, F.col("vibration_mps2") + 13.5).when(
            e % 67 == 0, F.col("vibration_mps2") + 40).otherwise(F.col("vibration_mps2")),
        "temperature_c": F.when(e % 71 == 0, float("nan")).otherwise(F.col("temperature_c")),
        "health_status": F.when(e % 73 == 0, "odd").otherwise(F.col("health_status"))})
    return add_slice(ops.normalize_label(df), "ingest_seq", 20_000)


def validated(spark, sf):
    return table(spark, f"validated:{sf}", lambda: state.validate(arrival_rows(spark, sf)))


def reason_kind(reason="reason"):
    r = F.col(reason)
    return (F.when(r == "", "").when(r.startswith("label not known"), "label")
            .when(r.startswith("duplicate"), "duplicate").when(r.contains("earlier"), "order")
            .when(r.contains("no finite"), "finite").when(r.contains("outside"), "range")
            .otherwise("jump"))


@query("sequential_validation", "P3", q.with_readings(
    "SELECT machine_id, ingest_seq, valid, kind FROM val", EDITED_ARRIVAL, VALIDATED))
def sequential_validation(spark, sf):
    return validated(spark, sf).select("machine_id", "ingest_seq", "valid", reason_kind().alias("kind"))


# ---- smoothing --------------------------------------------------------------

_SENSOR_LIMITS = " ".join(f"WHEN '{s.key}' THEN {{}}" for s in SENSORS)
SMOOTH = f"""
sm0 AS (SELECT machine_id, lifecycle_id, us, event_id % 50 <> 0 AS keep, unnest(['vibration_mps2','temperature_c','current_ampere']) AS sensor,
    unnest([vibration_mps2, temperature_c, current_ampere]) AS v,
    coalesce((us - lag(us) OVER w) / 1e6::DOUBLE, 1) AS dt, row_number() OVER w AS p FROM planned
    WINDOW w AS (PARTITION BY machine_id, lifecycle_id ORDER BY us, ingest_seq)),
sm1 AS (SELECT machine_id, lifecycle_id, sensor, 0::BIGINT AS p, NULL::DOUBLE[] AS buf, NULL::DOUBLE AS f, NULL::DOUBLE AS s, NULL::DOUBLE AS l,
    NULL::DOUBLE AS r, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS om, NULL::DOUBLE AS of_, NULL::DOUBLE AS os,
    NULL::DOUBLE AS ol, NULL::DOUBLE AS orr FROM sm0 WHERE p = 1
  UNION ALL
  SELECT machine_id, lifecycle_id, sensor, p, CASE WHEN keep THEN nb ELSE buf END, CASE WHEN keep THEN nf ELSE f END,
    CASE WHEN keep THEN ns ELSE s END, CASE WHEN keep THEN nl ELSE l END, CASE WHEN keep THEN nr ELSE r END,
    CASE WHEN NOT keep THEN a WHEN l IS NULL THEN 0.1 ELSE (1 - g0) * pa END, CASE WHEN NOT keep THEN b WHEN l IS NULL THEN 0 ELSE (1 - g0) * pb END,
    CASE WHEN NOT keep THEN c WHEN l IS NULL THEN 0.01 ELSE pc - g1 * pb END, med, nf, ns, nl, nr
  FROM (SELECT *, CASE WHEN l IS NULL THEN nf ELSE least(greatest(ahead + g0 * (nf - ahead), lo), hi) END AS nl,
      CASE WHEN l IS NULL THEN 0 ELSE r + g1 * (nf - ahead) END AS nr
    FROM (SELECT *, 0.35::DOUBLE * med + 0.65::DOUBLE * coalesce(f, med) AS nf, 0.1::DOUBLE * med + 0.9::DOUBLE * coalesce(s, med) AS ns,
        pa / (pa + 0.01::DOUBLE) AS g0, pb / (pa + 0.01::DOUBLE) AS g1, l + dt * r AS ahead,
        CASE sensor WHEN 'vibration_mps2' THEN 0 WHEN 'temperature_c' THEN -20 ELSE 0 END::DOUBLE AS lo,
        CASE sensor WHEN 'vibration_mps2' THEN 20 WHEN 'temperature_c' THEN 200 ELSE 50 END::DOUBLE AS hi
      FROM (SELECT t.*, n.dt, n.keep, n.p AS np, list_slice(list_append(coalesce(t.buf, []), n.v), -5, -1) AS nb,
          list_median(list_slice(list_append(coalesce(t.buf, []), n.v), -5, -1)) AS med,
          t.a + n.dt * (2 * t.b + n.dt * t.c) + 5e-5::DOUBLE * n.dt ** 4 / 4 AS pa, t.b + n.dt * t.c + 5e-5::DOUBLE * n.dt ** 3 / 2 AS pb,
          t.c + 5e-5::DOUBLE * n.dt * n.dt AS pc
        FROM (SELECT * EXCLUDE (p), p + 1 AS p FROM sm1) t JOIN sm0 n USING (machine_id, lifecycle_id, sensor, p)))))"""


def committed(spark, sf):
    """Planned lifecycles with one row in fifty held back from the state."""
    return add_slice(planned(spark, sf).withColumn("commit", F.col("event_id") % 50 != 0), width=W)


def smooth(spark, sf):
    return table(spark, f"smoothed:{sf}", lambda: state.smoothed(
        committed(spark, sf), carry=("raw_status", "event_id")))


def _smooth_query(name, covers, parts):
    cols = ", ".join(f"{q.r6(c, dg)} AS {n}" for n, (c, dg, _) in parts.items())

    @query(name, covers, q.with_readings(
        f"SELECT n.machine_id, n.us, n.sensor, {cols} FROM sm0 n JOIN sm1 t USING (machine_id, lifecycle_id, sensor, p)",
        q.RAW, PLANNED, SMOOTH))
    def run(spark, sf):
        rows = smooth(spark, sf)
        stacked = F.explode(F.array(*[F.struct(
            F.lit(k).alias("sensor"), *[r6(f"{k}__{src}", dg).alias(n) for n, (_, dg, src) in parts.items()])
            for k in SENSOR_KEYS])).alias("x")
        return rows.select(*ID, stacked).select(*ID, "x.*")
    return run


_smooth_query("ewma_with_preview", "K1 K4 W1", {
    "rolling_median": ("om", 6, "rolling_median"), "fast": ("of_", 6, "fast_ewma"), "slow": ("os", 6, "slow_ewma")})
_smooth_query("kalman_level_and_rate", "K2 K4", {
    "level": ("ol", 5, "kalman_level"), "rate_per_hour": ("orr * 3600", 3, "kalman_rate_per_hour")})

_SEV = "greatest(" + ", ".join(q.severity(f"l_{s.key}", s) for s in SENSORS) + ")"
DEGRADE = f"""
dg0 AS (SELECT machine_id, lifecycle_id, p, any_value(n.us) AS us, any_value(n.dt) AS dt, """ + ", ".join(
    f"max(t.ol) FILTER (t.sensor = '{s.key}') AS l_{s.key}" for s in SENSORS) + f"""
  FROM sm0 n JOIN sm1 t USING (machine_id, lifecycle_id, sensor, p) GROUP BY ALL),
dg1 AS (SELECT *, {_SEV} AS sev FROM dg0),
dg2 AS (SELECT machine_id, lifecycle_id, p, sev AS l, 0::DOUBLE AS r, 0.1::DOUBLE AS a, 0::DOUBLE AS b, 0.01::DOUBLE AS c FROM dg1 WHERE p = 1
  UNION ALL
  SELECT machine_id, lifecycle_id, p, least(greatest(ahead + pa / (pa + 0.01::DOUBLE) * (sev - ahead), 0), 1.5::DOUBLE),
    r + pb / (pa + 0.01::DOUBLE) * (sev - ahead), (1 - pa / (pa + 0.01::DOUBLE)) * pa, (1 - pa / (pa + 0.01::DOUBLE)) * pb,
    pc - pb / (pa + 0.01::DOUBLE) * pb
  FROM (SELECT n.machine_id, n.lifecycle_id, n.p, n.sev, t.r, t.l + n.dt * t.r AS ahead,
    t.a + n.dt * (2 * t.b + n.dt * t.c) + 5e-5::DOUBLE * n.dt ** 4 / 4 AS pa, t.b + n.dt * t.c + 5e-5::DOUBLE * n.dt ** 3 / 2 AS pb,
    t.c + 5e-5::DOUBLE * n.dt * n.dt AS pc FROM dg2 t JOIN dg1 n
      ON n.machine_id = t.machine_id AND n.lifecycle_id = t.lifecycle_id AND n.p = t.p + 1))"""


@query("degradation_filter", "K3", q.with_readings(
    f"SELECT n.machine_id, n.us, {q.r6('t.l', 5)} AS degradation, {q.r6('t.r * 3600', 3)} AS degradation_rate_per_hour, "
    f"{q.r6(q.health('t.l'), 3)} AS health_percent FROM dg1 n JOIN dg2 t USING (machine_id, lifecycle_id, p)",
    q.RAW, PLANNED, SMOOTH, DEGRADE))
def degradation_filter(spark, sf):
    return smooth(spark, sf).select(
        *ID, r6("degradation", 5).alias("degradation"),
        r6("degradation_rate_per_hour", 3).alias("degradation_rate_per_hour"),
        r6("health_percent", 3).alias("health_percent"))


_BASE = ", ".join(
    f"""CASE WHEN teach AND abs({s.key} - m{i}) / greatest(sqrt(w{i}), {q.d(0.02 * (s.warning - s.baseline))}) <=
      CASE WHEN n{i} < 180 THEN 8 ELSE 2.5 END THEN true ELSE false END AS g{i}""" for i, s in enumerate(SENSORS))
_BASE_NEXT = ", ".join(
    f"""CASE WHEN g{i} THEN 0.998::DOUBLE * m{i} + 0.002::DOUBLE * {s.key} ELSE m{i} END,
    CASE WHEN g{i} THEN greatest({q.d((0.02 * (s.warning - s.baseline)) ** 2)}, 0.998::DOUBLE * w{i} + 0.002::DOUBLE * ({s.key} - m{i}) ** 2) ELSE w{i} END,
    CASE WHEN g{i} THEN n{i} + 1 ELSE n{i} END""" for i, s in enumerate(SENSORS))
BASELINE_FOLD = f"""
bl0 AS (SELECT *, raw_status = 0 AND event_id % 50 <> 0 AS teach, row_number() OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS p FROM raw),
bl1 AS (SELECT machine_id, 0::BIGINT AS p, """ + ", ".join(
    f"{q.d(s.baseline)} AS m{i}, {q.d((0.05 * (s.warning - s.baseline)) ** 2)} AS w{i}, 0::BIGINT AS n{i}" for i, s in enumerate(SENSORS)) + f"""
  FROM bl0 WHERE p = 1
  UNION ALL
  SELECT machine_id, p, {_BASE_NEXT} FROM (SELECT *, {_BASE} FROM (SELECT * EXCLUDE (p), p + 1 AS p FROM bl1) t
    JOIN (SELECT machine_id, p, teach, vibration_mps2, temperature_c, current_ampere FROM bl0) n USING (machine_id, p)))"""


def baseline(spark, sf):
    rows = ops.machine_status(readings(spark, sf)).withColumn(
        "teach", (F.col("raw_status") == 0) & (F.col("event_id") % 50 != 0))
    return table(spark, f"baseline:{sf}", lambda: state.healthy_baseline(rows))


@query("healthy_baseline", "K9", q.with_readings(
    "SELECT r.machine_id, r.us, " + ", ".join(
        f"{q.r6(f't.m{i}')} AS {s.key}__mean, {q.r6(f'sqrt(t.w{i})')} AS {s.key}__std, t.n{i} AS {s.key}__samples"
        for i, s in enumerate(SENSORS)) + " FROM bl0 r JOIN bl1 t USING (machine_id, p)", q.RAW, BASELINE_FOLD))
def healthy_baseline(spark, sf):
    return baseline(spark, sf).select(*ID, *[c for k in SENSOR_KEYS for c in (
        r6(f"{k}__baseline_mean").alias(f"{k}__mean"), r6(f"{k}__baseline_std").alias(f"{k}__std"),
        F.col(f"{k}__baseline_samples").alias(f"{k}__samples"))])


# ---- alert hysteresis -------------------------------------------------------

ALERT_ROWS = """
al0 AS (SELECT machine_id, lifecycle_id, us, ingest_seq, event_id % 401 = 0 AS withheld, 0.5::DOUBLE AS threshold,
    unnest(['probability_warning_12h', 'probability_critical_24h']) AS target,
    unnest([CASE WHEN event_id % 403 = 0 THEN NULL ELSE least((vibration_mps2 - 1) / 3, 1) END,
            least(greatest((temperature_c - 30) / 60, 0), 1)]) AS probability FROM planned),
al1 AS (SELECT *, row_number() OVER (PARTITION BY machine_id, lifecycle_id, target ORDER BY us, ingest_seq) AS p FROM al0),
al2 AS (SELECT machine_id, lifecycle_id, target, 0::BIGINT AS p, false AS on_, NULL::BIGINT AS up, NULL::BIGINT AS down FROM al1 WHERE p = 1
  UNION ALL
  SELECT machine_id, lifecycle_id, target, p,
    CASE WHEN gone THEN false WHEN on_ THEN NOT (nd IS NOT NULL AND us - nd >= 3600000000) ELSE nu IS NOT NULL AND us - nu >= need END,
    CASE WHEN gone OR (on_ AND nd IS NOT NULL AND us - nd >= 3600000000) THEN NULL WHEN on_ THEN up ELSE nu END,
    CASE WHEN gone OR NOT on_ OR us - nd >= 3600000000 THEN NULL ELSE nd END
  FROM (SELECT t.*, n.us, n.withheld OR n.probability IS NULL AS gone,
      CASE WHEN n.probability >= n.threshold THEN coalesce(t.up, n.us) END AS nu,
      CASE WHEN n.probability < n.threshold * 0.7::DOUBLE THEN coalesce(t.down, n.us) END AS nd,
      CASE WHEN t.target LIKE 'probability_warning_%' THEN 600000000 ELSE 1800000000 END AS need
    FROM (SELECT * EXCLUDE (p), p + 1 AS p FROM al2) t JOIN al1 n USING (machine_id, lifecycle_id, target, p)))"""


def alert_rows(spark, sf):
    targets = F.explode(F.array(
        F.struct(F.lit("probability_warning_12h").alias("target"),
                 F.when(F.col("event_id") % 403 != 0, F.least((F.col("vibration_mps2") - 1) / 3, F.lit(1.0)))
                 .alias("probability")),
        F.struct(F.lit("probability_critical_24h").alias("target"),
                 F.least(F.greatest((F.col("temperature_c") - 30) / 60, F.lit(0.0)), F.lit(1.0))
                 .alias("probability")))).alias("x")
    return planned(spark, sf).select(
        "machine_id", "lifecycle_id", "us", "ingest_seq", (F.col("event_id") % 401 == 0).alias("withheld"),
        F.lit(0.5).alias("threshold"), targets).select("*", "x.*").drop("x")


@query("alert_hysteresis", "K10", q.with_readings(
    "SELECT r.machine_id, r.us, r.target, t.on_ AS active FROM al1 r JOIN al2 t USING (machine_id, lifecycle_id, target, p)",
    q.RAW, PLANNED, ALERT_ROWS))
def alert_hysteresis(spark, sf):
    return state.alert_hysteresis(add_slice(alert_rows(spark, sf))).select(*ID, "target", "active")


# ---- lifecycles -------------------------------------------------------------

def discovered(spark, sf):
    return table(spark, f"discovered:{sf}", lambda: state.discover_lifecycles(
        add_slice(readings(spark, sf), width=W)))


def lifecycle_inputs(spark, sf, keys):
    """Smoothed levels and both status layers, all keyed alike."""
    rows = add_slice(planned(spark, sf), width=W)
    sm = state.smoothed(rows, keys=keys, carry=("raw_status", "lifecycle_id"))
    day = add_slice(sm.drop("slice"))
    both = persistence.stabilized_status(persistence.event_status(day, keys), keys)
    return add_slice(both.drop("slice"), width=W)


@query("lifecycle_detection", "K7")
def lifecycle_detection(spark, sf):
    rows = state.detect_lifecycles(lifecycle_inputs(spark, sf, state.MACHINE))
    return rows.select(*ID, "lifecycle_number", "lifecycle_state",
                       r6("elapsed_lifecycle_hours").alias("elapsed_lifecycle_hours"),
                       "reset_confidence", "reset_reason")


@query("lifecycle_discovery", "L1 K7 K8")
def lifecycle_discovery(spark, sf):
    return discovered(spark, sf).select(
        *ID, "lifecycle_number", "lifecycle_state", "stabilized_status", "event_status",
        r6("elapsed_lifecycle_hours").alias("elapsed_lifecycle_hours"), "reset_confidence")


@query("discovered_lifecycles", "L1 S10")
def discovered_lifecycles(spark, sf):
    return life.lifecycle_rows(state.closed_lifecycles(discovered(spark, sf)))


PLAN_SQL = """
bounds AS (SELECT machine_id, lifecycle_id, min(us) AS start_us, lead(min(us)) OVER (PARTITION BY machine_id ORDER BY lifecycle_id) AS end_us
  FROM planned GROUP BY machine_id, lifecycle_id),
plan AS (SELECT machine_id, lifecycle_id, start_us, end_us, end_us + 3600000000 AS reset_us FROM bounds WHERE end_us IS NOT NULL)"""


def plan(spark, sf):
    """The ramp's lifecycles as an explicit plan with an hour of confirmation."""
    starts = planned(spark, sf).groupBy("machine_id", "lifecycle_id").agg(F.min("us").alias("start_us"))
    return life.plan_from_starts(starts, confirm_us=3_600_000_000)


@query("assigned_lifecycle", "L2", q.with_readings("""
SELECT r.machine_id, r.us, 'lifecycle_' || lpad(CAST(1 + count(p.end_us) AS VARCHAR), 4, '0') AS lifecycle_id
FROM planned r LEFT JOIN plan p ON p.machine_id = r.machine_id AND p.end_us <= r.us GROUP BY r.machine_id, r.us""",
    q.RAW, PLANNED, PLAN_SQL))
def assigned_lifecycle(spark, sf):
    rows = add_slice(readings(spark, sf))
    return life.assign_lifecycle(rows, plan(spark, sf)).select(*ID, "lifecycle_id")


@query("lifecycle_state", "L3", q.with_readings("""
SELECT r.machine_id, r.us, CASE WHEN bool_or(r.us >= p.end_us AND r.us < p.reset_us) THEN 'RESET_CANDIDATE'
  WHEN bool_or(r.us = p.reset_us) THEN 'RESET_COMPLETE'
  WHEN r.us = max(m.last_us) THEN 'open_' || any_value(r.health_status) ELSE 'HEALTHY' END AS lifecycle_state
FROM planned r JOIN (SELECT machine_id, max(us) AS last_us FROM planned GROUP BY machine_id) m USING (machine_id)
LEFT JOIN plan p ON p.machine_id = r.machine_id AND r.us BETWEEN p.end_us AND p.reset_us GROUP BY r.machine_id, r.us""",
    q.RAW, PLANNED, PLAN_SQL))
def lifecycle_state(spark, sf):
    rows = ops.machine_status(add_slice(readings(spark, sf)))
    return life.lifecycle_state(rows, plan(spark, sf)).select(*ID, "lifecycle_state")


@query("resolved_lifecycles", "L4 S4")
def resolved_lifecycles(spark, sf):
    explicit = plan(spark, sf).filter("machine_id <> 'm1'").withColumn("confidence", F.lit("EXPLICIT"))
    inferred = state.closed_lifecycles(discovered(spark, sf)).select(
        "machine_id", "lifecycle_id", "start_us", "end_us", "reset_us", "confidence")
    return life.resolve_lifecycles(explicit, inferred)


@query("causal_states", "L5 K8")
def causal_states(spark, sf):
    inputs = lifecycle_inputs(spark, sf, state.LIFE)
    return life.causal_states(inputs).select(*ID, "lifecycle_id", "lifecycle_state")
