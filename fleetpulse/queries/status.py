"""Validation, projections, status layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import rules
from fleetpulse.functions.rules import r6
from fleetpulse.operators import persistence, rules as ops
from fleetpulse.params import SENSORS
from fleetpulse.plans.slices import add_slice
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.sources.binding import readings

ID = ["machine_id", "us"]
KEY = "machine_id, us"


def raw(spark, sf):
    return ops.machine_status(readings(spark, sf))


@query("label_normalisation", "P1", q.with_readings(f"""
SELECT {KEY}, nullif(lower(trim(t)), '') AS label,
  nullif(lower(trim(t)), '') IS NULL OR lower(trim(t)) IN ('normal','warning','critical') AS label_known
FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN '  ' WHEN event_id % 51 = 0 THEN 'odd'
      ELSE ' ' || upper(health_status) || ' ' END AS t FROM readings)"""))
def label_normalisation(spark, sf):
    df = readings(spark, sf).withColumn("t", F.when(F.col("event_id") % 50 == 0, "  ").when(
        F.col("event_id") % 51 == 0, "odd").otherwise(
        F.concat(F.lit(" "), F.upper("health_status"), F.lit(" "))))
    return ops.normalize_label(df, "t").select(*ID, "label", "label_known")


_EDITED_SQL = """ed AS (SELECT machine_id, us,
  CASE WHEN event_id % 31 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 37 = 0 THEN vibration_mps2 + 30 ELSE vibration_mps2 END AS vibration_mps2,
  CASE WHEN event_id % 41 = 0 THEN -25.0::DOUBLE ELSE temperature_c END AS temperature_c,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE current_ampere END AS current_ampere FROM readings)"""


def edited(spark, sf):
    """Readings with missing, infinite and out-of-range cells at known event ids."""
    return readings(spark, sf).withColumns({
        "vibration_mps2": F.when(F.col("event_id") % 31 == 0, float("nan")).when(
            F.col("event_id") % 37 == 0, F.col("vibration_mps2") + 30).otherwise(F.col("vibration_mps2")),
        "temperature_c": F.when(F.col("event_id") % 41 == 0, -25.0).otherwise(F.col("temperature_c")),
        "current_ampere": F.when(F.col("event_id") % 43 == 0, F.lit(None)).otherwise(F.col("current_ampere"))})


@query("range_check", "P2", q.with_readings(
    f"SELECT {KEY}, coalesce(" + q.each(lambda s: (
        f"CASE WHEN {s.key} IS NULL OR isnan({s.key}) OR isinf({s.key}) THEN '{s.key} has no finite value' "
        f"WHEN {s.key} NOT BETWEEN {s.low} AND {s.high} THEN "
        f"'{s.label} ' || {s.key} || ' {s.unit} lies outside [{s.low}, {s.high}]' END")) +
    ") AS range_reason FROM ed", _EDITED_SQL))
def range_check(spark, sf):
    return ops.range_check(edited(spark, sf)).select(*ID, "range_reason")


@query("raw_safety_status", "P4", q.with_readings(
    f"SELECT {KEY}, coalesce(" + q.name("greatest(" + q.each(lambda s: (
        f"CASE WHEN {s.key} IS NOT NULL AND NOT isnan({s.key}) THEN {q.status(s.key, s)} END")) + ")") +
    ", 'UNKNOWN') AS raw_safety_status FROM ed", _EDITED_SQL))
def raw_safety_status(spark, sf):
    return ops.raw_safety_status(edited(spark, sf)).select(*ID, "raw_safety_status")


@query("sensor_status", "P6", q.with_readings(
    f"SELECT {KEY}, " + q.each(lambda s: f"{q.status(s.key, s)} AS {s.key}__status") + ", "
    + q.each(lambda s: f"{q.status(s.key, s, '>=')} AS {s.key}__status_inclusive") + " FROM readings"))
def sensor_status(spark, sf):
    df = ops.sensor_status(readings(spark, sf))
    return df.select(*ID, *[f"{s.key}__status" for s in SENSORS], *[
        rules.status(s.key, s, True).alias(f"{s.key}__status_inclusive") for s in SENSORS])


@query("severity_and_health", "P7 P8", q.with_readings(
    f"SELECT {KEY}, " + q.each(lambda s: f"{q.r6(q.severity(s.key, s))} AS {s.key}__severity, "
                               f"{q.r6(q.health(q.severity(s.key, s)))} AS {s.key}__health")
    + " FROM readings"))
def severity_and_health(spark, sf):
    return readings(spark, sf).select(*ID, *[c for s in SENSORS for c in (
        r6(rules.severity(s.key, s)).alias(f"{s.key}__severity"),
        r6(rules.health_percent(rules.severity(s.key, s))).alias(f"{s.key}__health"))])


@query("critical_margin", "P9", q.with_readings(
    f"SELECT {KEY}, " + q.each(lambda s: f"{q.r6(q.margin(s.key, s))} AS {s.key}__margin") + " FROM readings"))
def critical_margin(spark, sf):
    return readings(spark, sf).select(*ID, *[
        r6(rules.critical_margin(s.key, s)).alias(f"{s.key}__margin") for s in SENSORS])


_WORST_SQL = ("list_max([" + q.each(lambda s: (
    f"{{'a': {q.status(s.key, s)}, 'b': {q.severity(s.key, s)}, "
    f"'c': {-[x.key for x in SENSORS].index(s.key)}, 'n': '{s.key}'}}")) + "]).n")


@query("machine_status_and_worst_sensor", "P10 P11", q.with_readings(
    f"SELECT {KEY}, {q.machine_status()} AS raw_status, {_WORST_SQL} AS worst_sensor FROM readings"))
def machine_status_and_worst_sensor(spark, sf):
    return ops.worst_sensor(raw(spark, sf)).select(*ID, "raw_status", "worst_sensor")


@query("severity_summary", "P12", q.with_readings(
    f"SELECT {KEY}, {q.r6('greatest(' + q.each(lambda s: q.severity(s.key, s)) + ')')} AS maximum_severity, "
    + q.r6("(" + q.each(lambda s: f"({q.severity(s.key, s)}) * {q.d(s.weight)}", " + ") + ") / 1.0::DOUBLE", 8)
    + " AS weighted_severity FROM readings"))
def severity_summary(spark, sf):
    df = ops.severity_summary(readings(spark, sf))
    return df.select(*ID, r6("maximum_severity").alias("maximum_severity"),
                     r6("weighted_severity", 8).alias("weighted_severity"))


# The JVM formatter rounds decimal ties up; printf looks at the binary value, hence + 1e-9.
_REASON_SQL = "list_filter([" + q.each(lambda s: (
    f"CASE WHEN {q.status(s.key, s)} > 0 THEN printf('{s.label} %s: %.3f {s.unit}, limit %.3f {s.unit}', "
    f"{q.name(q.status(s.key, s))}, {s.key} + 1e-9::DOUBLE, CASE WHEN {q.status(s.key, s)} = 2 THEN {q.d(s.critical)} "
    f"ELSE {q.d(s.warning)} END) END")) + "], lambda x: x IS NOT NULL)"


@query("status_reasons", "P13", q.with_readings(
    f"SELECT {KEY}, CASE WHEN len(r) > 0 THEN array_to_string(r, ' | ') ELSE "
    "'Every sensor is below its warning limit.' END || "
    "CASE WHEN stabilized_status <> raw_status THEN ' | Shown as ' || "
    f"{q.name('stabilized_status')} || ' after smoothing over time; this reading alone is ' || {q.name('raw_status')} || '.' ELSE '' END "
    f"AS reasons FROM (SELECT *, {_REASON_SQL} AS r FROM stab)", q.RAW, q.STABILIZED))
def status_reasons(spark, sf):
    df = persistence.stabilized_status(add_slice(raw(spark, sf)))
    return ops.status_reasons(df, "stabilized_status").select(
        *ID, F.array_join("reasons", " | ").alias("reasons"))


@query("domain_stage", "P14", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'mock_test' WHEN 'F' THEN 'realistic_candidate'
  WHEN 'P' THEN 'plant_candidate' END AS stage, CASE o_orderstatus WHEN 'O' THEN 'trained on accelerated_mock: not for plant_production'
  WHEN 'F' THEN 'trained on realistic_synthetic: not for plant_production' END AS refusal FROM orders""")
def domain_stage(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    domain = (F.when(F.col("o_orderstatus") == "O", "accelerated_mock")
              .when(F.col("o_orderstatus") == "F", "realistic_synthetic").otherwise("plant"))
    return orders.select("o_orderkey", ops.domain_stage(domain).alias("stage"),
                         ops.promotion_refusal(domain, F.lit("plant_production")).alias("refusal"))


@query("strict_bool", "P15", """
SELECT event_id, CASE WHEN t IN ('true','1') THEN true WHEN t IN ('false','0') THEN false END AS flag,
  CASE WHEN t IN ('true','1') THEN true ELSE false END AS flag_or_false
FROM (SELECT event_id, lower(trim(CASE event_id % 6 WHEN 0 THEN ' True' WHEN 1 THEN '0' WHEN 2 THEN 'FALSE '
  WHEN 3 THEN '1' WHEN 4 THEN 'yes' ELSE '' END)) AS t FROM events)""")
def strict_bool(spark, sf):
    m = F.col("event_id") % 6
    text = (F.when(m == 0, " True").when(m == 1, "0").when(m == 2, "FALSE ").when(m == 3, "1")
            .when(m == 4, "yes").otherwise(""))
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("t"))
    return df.select("event_id", rules.strict_bool("t").alias("flag"),
                     rules.strict_bool("t", False).alias("flag_or_false"))


@query("event_status", "K6", q.with_readings(
    f"SELECT {KEY}, raw_status, event_status FROM evs", q.RAW, q.EVENT_STATUS))
def event_status(spark, sf):
    return persistence.event_status(add_slice(raw(spark, sf))).select(*ID, "raw_status", "event_status")


@query("stabilized_status", "K5", q.with_readings(
    f"SELECT {KEY}, raw_status, stabilized_status FROM stab", q.RAW, q.STABILIZED))
def stabilized_status(spark, sf):
    return persistence.stabilized_status(add_slice(raw(spark, sf))).select(
        *ID, "raw_status", "stabilized_status")


@query("monitor_status", "P6 P7 P8 P10 P11 K6", q.with_readings(
    f"SELECT {KEY}, raw_status, event_status, {_WORST_SQL} AS worst_sensor, "
    + q.r6(q.health("greatest(" + q.each(lambda s: q.severity(s.key, s)) + ")"))
    + " AS health_percent FROM evs", q.RAW, q.EVENT_STATUS))
def monitor_status(spark, sf):
    df = persistence.event_status(add_slice(raw(spark, sf)))
    df = ops.severity_summary(ops.worst_sensor(df))
    return df.select(*ID, "raw_status", "event_status", "worst_sensor",
                     r6(rules.health_percent("maximum_severity")).alias("health_percent"))


@query("status_runs", "T7", q.with_readings("""
SELECT machine_id, run, any_value(raw_status) AS raw_status, min(us) AS start_us, max(us) AS end_us,
  count(*) AS run_rows FROM (SELECT *, CAST(sum(CASE WHEN ps IS NULL OR ps <> raw_status THEN 1 ELSE 0 END) OVER (
    PARTITION BY machine_id ORDER BY us, ingest_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM (SELECT *, lag(raw_status) OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS ps FROM raw))
GROUP BY machine_id, run""", q.RAW))
def status_runs(spark, sf):
    return persistence.status_runs(add_slice(raw(spark, sf)))


@query("status_changes", "E3", q.with_readings("""
SELECT machine_id, CAST(sum(CASE WHEN ps <> raw_status THEN 1 ELSE 0 END) AS BIGINT) AS changes
FROM (SELECT *, lag(raw_status) OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS ps FROM raw)
GROUP BY machine_id""", q.RAW))
def status_changes(spark, sf):
    return persistence.status_changes(add_slice(raw(spark, sf)))


@query("consecutive_status_hours", "W13", q.with_readings(f"""
SELECT {KEY}, {q.r6("CASE WHEN s >= 1 THEN (us - w) / 3.6e9::DOUBLE ELSE 0 END")} AS consecutive_warning_hours,
  {q.r6("CASE WHEN s >= 2 THEN (us - c) / 3.6e9::DOUBLE ELSE 0 END")} AS consecutive_critical_hours
FROM (SELECT machine_id, us, s, max(CASE WHEN s >= 1 AND coalesce(ps, 0) < 1 THEN us END) OVER w AS w,
  max(CASE WHEN s >= 2 AND coalesce(ps, 0) < 2 THEN us END) OVER w AS c
  FROM (SELECT *, stabilized_status AS s, lag(stabilized_status) OVER (
    PARTITION BY machine_id ORDER BY us, ingest_seq) AS ps FROM stab)
  WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_seq ROWS UNBOUNDED PRECEDING))""",
    q.RAW, q.STABILIZED))
def consecutive_status_hours(spark, sf):
    df = persistence.stabilized_status(add_slice(raw(spark, sf)))
    df = persistence.consecutive_status_hours(df)
    return df.select(*ID, r6("consecutive_warning_hours").alias("consecutive_warning_hours"),
                     r6("consecutive_critical_hours").alias("consecutive_critical_hours"))
