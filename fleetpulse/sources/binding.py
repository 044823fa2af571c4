"""Binding of the event table to the readings contract.

The driver tables hold no sensor table. Readings are derived from ``events``:
four machines, a 60 s cadence with 10 minute gaps, and a saw-tooth ramp that
crosses the warning and the critical limit and falls back every 1000 rows.

Row numbers and gap counts are two-level: counted inside a (machine, minute)
bucket, then offset by the buckets before it, so no task sorts a whole machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import rules
from fleetpulse.params import MINUTE_US, SENSORS
from fleetpulse.plans.shared import table
from fleetpulse.plans.slices import scan, slice_of

EPOCH_US = 1_767_225_600_000_000  # 2026-01-01 00:00:00
MACHINES = 4
RAMP_ROWS = 1000
GAP_EVERY = 97


def derive(events: DataFrame) -> DataFrame:
    base = events.select(
        F.concat(F.lit("m"), (F.col("user_id") % MACHINES).cast("string")).alias("machine_id"),
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"),
        "value", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))
    base = base.withColumn("slice", slice_of("event_us", 10 * MINUTE_US))
    ranked = scan(base, ["machine_id"], order=("event_us", "event_id"), total={
        "rn": F.lit(1).cast("long"),
        "gaps": F.when(F.col("event_id") % GAP_EVERY == 0, 1).otherwise(0).cast("long")})
    ramp = F.col("rn") % RAMP_ROWS
    rows = ranked.select(
        "machine_id", (F.col("rn") + 1).alias("ingest_seq"),
        (F.lit(EPOCH_US) + (F.col("rn") * 60 + F.col("gaps") * 600) * 1_000_000).alias("us"),
        (F.lit(1.0) + F.lit(0.004) * ramp + F.col("value") / 200.0).alias("vibration_mps2"),
        (F.lit(30.0) + F.lit(0.05) * ramp + F.lit(0.05) * F.col("k")).alias("temperature_c"),
        (F.lit(4.0) + F.lit(0.004) * ramp
         + F.lit(0.005) * ((F.col("event_id") * 37) % 100)).alias("current_ampere"),
        "event_id", "rn", "value", "k")
    rows = rows.withColumns({
        s.key: F.round(F.col(s.key), 5) for s in SENSORS})
    return rows.withColumn("health_status", F.lower(rules.status_name(rules.machine_status())))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived readings, written once to the shared folder and then scanned as Parquet."""
    return table(spark, f"readings:{sf_dir}",
                 lambda: derive(spark.read.parquet(f"{sf_dir}/events.parquet")
                                .select("event_id", "ts", "user_id", "value", "props")))


READINGS_SQL = f"""
ev AS (SELECT 'm' || CAST(user_id % {MACHINES} AS VARCHAR) AS machine_id, event_id, ts, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
rk AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS rn,
         CAST(sum(CASE WHEN event_id % {GAP_EVERY} = 0 THEN 1 ELSE 0 END) OVER (
           PARTITION BY machine_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS gaps FROM ev),
rd AS (SELECT machine_id, rn + 1 AS ingest_seq,
         CAST({EPOCH_US} + (rn * 60 + gaps * 600) * 1000000 AS BIGINT) AS us,
         round(1.0::DOUBLE + 0.004::DOUBLE * (rn % {RAMP_ROWS}) + value / 200.0::DOUBLE, 5) AS vibration_mps2,
         round(30.0::DOUBLE + 0.05::DOUBLE * (rn % {RAMP_ROWS}) + 0.05::DOUBLE * k, 5) AS temperature_c,
         round(4.0::DOUBLE + 0.004::DOUBLE * (rn % {RAMP_ROWS})
           + 0.005::DOUBLE * ((event_id * 37) % 100), 5) AS current_ampere,
         event_id, rn, value, k FROM rk),
readings AS (SELECT *, CASE WHEN vibration_mps2 > 4 OR temperature_c > 80 OR current_ampere > 8 THEN 'critical'
         WHEN vibration_mps2 > 3 OR temperature_c > 60 OR current_ampere > 6 THEN 'warning'
         ELSE 'normal' END AS health_status FROM rd)
"""
