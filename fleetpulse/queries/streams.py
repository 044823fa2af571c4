"""Streaming queries, replayed over files until no input is left."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.rules import r6
from fleetpulse.params import DAY_US, DEFAULT, SENSOR_KEYS
from fleetpulse.plans.shared import folder_for_cut, table_path, written_table
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.sources.binding import readings
from fleetpulse.sources.keyed import KeyedTables
from fleetpulse.streaming import intervals
from fleetpulse.streaming import monitor as st

ID = ["machine_id", "us"]
K = SENSOR_KEYS
CHUNK_US = 2 * DAY_US
MONITOR_CHUNK_US = DAY_US // 2  # several micro-batches on every table, so that state is handed on
FILES = 4
BATCHES = 16  # at most this many micro-batches over the whole input


def staged(spark, rows: DataFrame, chunk_us: int = CHUNK_US) -> str:
    """Readings as files in time order: a fixed number of files per stretch of time.

    A stretch is ``chunk_us`` long, or as long as ``BATCHES`` stretches over all rows
    need: every stretch costs a job here and a micro-batch later, whatever it holds.
    """
    folder = folder_for_cut(spark)
    rows = rows.select("machine_id", "ingest_seq", "us", *K, "health_status")
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    width = max(chunk_us, -(-(last - first + 1) // BATCHES))
    start = first if width > chunk_us else first // chunk_us * chunk_us
    for begin in range(start, last + 1, width):
        # Dealt out one by one, so that no file stays empty and a micro-batch is one stretch.
        (rows.filter((F.col("us") >= begin) & (F.col("us") < begin + width)).repartition(FILES)
         .write.mode("append").parquet(folder))
    return folder


def drain_into(sdf: DataFrame, path: str, mode: str = "append") -> None:
    """Run a streaming query over the available input into Parquet files."""
    spark = sdf.sparkSession
    with st.keyed_state_store(spark):
        run = (sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", folder_for_cut(spark))
               .option("path", path).trigger(availableNow=True).start())
        run.awaitTermination()


def drain(sdf: DataFrame, mode: str = "append") -> DataFrame:
    """The same, read back."""
    path = folder_for_cut(sdf.sparkSession)
    drain_into(sdf, path, mode)
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)


def source(spark, rows, chunk_us: int = CHUNK_US):
    return st.read_stream(spark, staged(spark, rows, chunk_us), maxFilesPerTrigger=str(FILES))


def streamed(spark, sf):
    return written_table(spark, f"streamed:{sf}", lambda path: drain_into(
        st.stream_monitor(source(spark, readings(spark, sf), MONITOR_CHUNK_US)), path))


def monitored(spark, sf):
    """The monitor's files as a stream, in the order in which it wrote them; a machine's rows of a batch lie in one file."""
    schema = streamed(spark, sf).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(2 * FILES)).parquet(table_path(spark, f"streamed:{sf}"))


@query("stream_monitor", "R1 R2 R3 R4 R5 R9")
def stream_monitor(spark, sf):
    return streamed(spark, sf).select(*ID, "valid", "reason", "rule", "stabilized_status", "event_status", "lifecycle_number",
                                      "lifecycle_state", *[r6(f"{k}__kalman_level", 4).alias(f"{k}__level") for k in K],
                                      *[r6(f"{k}__w1440m__slope_per_hour", 4).alias(f"{k}__slope_24h") for k in K])


@query("stream_discovery", "R3 R4 K7")
def stream_discovery(spark, sf):
    """Rules only: the same rows the batch discovery gives."""
    off = dataclasses.replace(DEFAULT, anomaly=dataclasses.replace(DEFAULT.anomaly, enabled=False))
    rows = drain(st.stream_monitor(source(spark, readings(spark, sf), MONITOR_CHUNK_US), off))
    return rows.filter("valid").select(*ID, "lifecycle_number", "lifecycle_state", "stabilized_status", "event_status")


@query("stream_alerts", "R3 K10")
def stream_alerts(spark, sf):
    return drain(st.stream_alerts(st.stream_forecast(monitored(spark, sf))))


@query("stream_gap_timeout", "R7")
def stream_gap_timeout(spark, sf):
    return drain(st.gap_timeout(source(spark, readings(spark, sf)), 300))


@query("stream_sensor_state", "R8")
def stream_sensor_state(spark, sf):
    path = folder_for_cut(spark)
    run = (st.sensor_states(monitored(spark, sf)).writeStream.foreachBatch(st.upsert_state(path))
           .option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    run.awaitTermination()
    return st.read_state(spark, path)


def kept_tables(spark, changes: DataFrame) -> KeyedTables:
    """Intervals and state of a stream of changes, taken in epoch by epoch."""
    base = folder_for_cut(spark)
    tables = KeyedTables(spark, f"{base}/tables", intervals.KEYS)
    with st.keyed_state_store(spark):
        run = (changes.writeStream.outputMode("update").foreachBatch(intervals.upsert_changes(tables))
               .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        run.awaitTermination()
    return tables


def interval_changes(spark, sf):
    return intervals.stream_changes(intervals.described(monitored(spark, sf)))


@query("stream_intervals", "R8 A23")
def stream_intervals(spark, sf):
    rows = kept_tables(spark, interval_changes(spark, sf)).read("intervals")
    return rows.withColumns({n: F.array_join(n, "|") for n in ("safety_actions", "model_actions")})


@query("stream_anomaly_state", "R8 A24")
def stream_anomaly_state(spark, sf):
    return kept_tables(spark, interval_changes(spark, sf)).read("state")


@query("stream_without_repeats", "R2", q.with_readings("SELECT machine_id, count(*) AS rows FROM readings GROUP BY machine_id"))
def stream_without_repeats(spark, sf):
    rows = readings(spark, sf)
    doubled = rows.unionByName(rows.filter("event_id % 10 = 0"))
    return drain(st.without_repeats(source(spark, doubled), "30 days")).groupBy("machine_id").agg(F.count("*").alias("rows"))


def _cells(prefix=""):
    return ", ".join(f"{q.r6(f'avg({k})', 5)} AS {k}_mean, {q.r6(f'max({k})', 5)} AS {k}_max" for k in K)


def _rounded(df):
    return df.withColumns({f"{k}_{n}": r6(f"{k}_{n}", 5) for k in K for n in ("mean", "max")})


def timed(spark, sf):
    return readings(spark, sf).withColumn("ts", F.timestamp_micros("us"))


@query("rollup_tumbling", "R6", q.with_readings(f"SELECT machine_id, us // 3600000000 * 3600000000 AS start_us, us // 3600000000 * 3600000000 + 3600000000 AS end_us, count(*) AS rows, {_cells()} FROM readings GROUP BY ALL"))
def rollup_tumbling(spark, sf):
    return _rounded(st.rollup(timed(spark, sf)))


@query("rollup_sliding", "R6", q.with_readings(f"""SELECT machine_id, s AS start_us, s + 3600000000 AS end_us, count(*) AS rows, {_cells()} FROM (
  SELECT *, unnest([us // 1800000000 * 1800000000, us // 1800000000 * 1800000000 - 1800000000]) AS s FROM readings) GROUP BY ALL"""))
def rollup_sliding(spark, sf):
    return _rounded(st.rollup(timed(spark, sf), "1 hour", "30 minutes"))


@query("rollup_sessions", "R6", q.with_readings(f"""SELECT machine_id, min(us) AS start_us, max(us) + 600000000 AS end_us, count(*) AS rows, {_cells()} FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR us - p > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY us) AS g FROM (
    SELECT *, lag(us) OVER (PARTITION BY machine_id ORDER BY us) AS p FROM readings)) GROUP BY machine_id, g"""))
def rollup_sessions(spark, sf):
    return _rounded(st.rollup(timed(spark, sf), gap="10 minutes"))


# Append mode returns the hours that the watermark has passed: ten minutes behind the newest reading.
@query("stream_rollup", "R6 R1", q.with_readings(f"""SELECT * FROM (SELECT machine_id, us // 3600000000 * 3600000000 AS start_us, us // 3600000000 * 3600000000 + 3600000000 AS end_us, count(*) AS rows, {_cells()}
  FROM readings GROUP BY ALL) WHERE end_us <= (SELECT max(us) - 600000000 FROM readings)"""))
def stream_rollup(spark, sf):
    return _rounded(drain(st.rollup(source(spark, readings(spark, sf)), delay="10 minutes")))
