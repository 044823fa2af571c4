"""Reading sources: tolerant and strict scans, lifecycle metadata, scenario manifests, streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.params import SENSOR_KEYS

# The five columns of the input contract, in order.
COLUMNS = ("timestamp", *SENSOR_KEYS, "health_status")

READING = T.StructType(
    [T.StructField("machine_id", T.StringType()), T.StructField("ingest_seq", T.LongType()),
     T.StructField("us", T.LongType())]
    + [T.StructField(k, T.DoubleType()) for k in SENSOR_KEYS]
    + [T.StructField("health_status", T.StringType())])


def contract_violations(columns: Sequence[str], extra_ok: Sequence[str] = ("machine_id", "ingest_seq")) -> list:
    """(code, message, count) rows for a table's column list."""
    given = [c.lstrip("﻿") for c in columns if c not in extra_ok]
    missing = sorted(set(COLUMNS) - set(given))
    out = []
    if missing:
        out.append(("missing_required_columns", f"absent: {missing}", len(missing)))
    if given != list(COLUMNS):
        extra = sorted(set(given) - set(COLUMNS))
        out.append(("column_contract_mismatch",
                    f"other columns or another order; not in the contract: {extra}", max(1, len(extra))))
    return out


def check_contract(df: DataFrame) -> DataFrame:
    """One row per violation; empty when the columns are exactly the contract's."""
    return df.sparkSession.createDataFrame(
        contract_violations(df.columns), "code string, message string, count bigint")


def parse_rows(raw: DataFrame) -> DataFrame:
    """Text cells to typed readings; a row that does not parse is kept with its reason."""
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns])
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"absent columns: {sorted(missing)}")
    ts = F.try_to_timestamp(F.trim("timestamp"))
    numbers = {k: F.expr(f"try_cast(trim({k}) AS double)") for k in SENSOR_KEYS}
    bad = F.when(ts.isNull(), F.concat(F.lit("unreadable row: time not understood: '"),
                                       F.coalesce(F.trim("timestamp"), F.lit("")), F.lit("'")))
    for k in SENSOR_KEYS:
        bad = bad.when(numbers[k].isNull(), F.lit(f"unreadable row: {k} is not a number"))
    label = F.nullif(F.lower(F.trim("health_status")), F.lit(""))
    out = raw.withColumns({
        "parse_reason": bad, "us": F.unix_micros(ts), "label": label,
        "label_known": label.isNull() | label.isin("normal", "warning", "critical"),
        "raw_text": F.struct(*COLUMNS)})
    return out.withColumns(numbers).drop("timestamp")


def numbered(files: DataFrame, name: str = "ingest_seq", *, first: int = 2, across: bool = False) -> DataFrame:
    """Rows of a file scan with their place in the file, from ``first``; ``across`` counts on over files by path.

    Places come from what the scan knows: file, block and order inside the block, which
    one task reads in one go. A table with one row per block turns them into numbers, so
    they don't depend on how files are split, and no row is shuffled. Blank lines and headers don't count.
    """
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
    if across:
        whole = blocks.groupBy("_file").agg(F.sum("_n").alias("_rows"))
        earlier = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
        blocks = blocks.join(whole.select("_file", F.coalesce(earlier, F.lit(0)).alias("_files")), "_file").withColumn(
            "_before", F.col("_before") + F.col("_files"))
    place = F.col("_id") - F.col("_first") + F.col("_before") + first
    return rows.join(blocks.select("_file", "_block", "_first", "_before"), ["_file", "_block"]).select(
        *[F.col(f"`{c}`") for c in files.columns], place.alias(name))


def read_readings(spark: SparkSession, path: str | list[str], fmt: str = "csv", *,
                  mode: str = "tolerant", machine: str | None = None, across: bool = False) -> DataFrame:
    """Readings from CSV, Parquet, ORC or JSON files.

    Text formats are scanned as strings with a header, never inferred. ``strict``
    fails the job at the first row that does not parse. Without ``ingest_seq`` a row's
    number is its place in its file, from 2; see :func:`numbered`.
    """
    if mode not in ("tolerant", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    if fmt == "csv":
        raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
        raw = raw.select(*[F.col(c) if c == "ingest_seq" else F.col(c).cast("string").alias(c) for c in raw.columns])
    if "ingest_seq" not in raw.columns:
        raw = numbered(raw, across=across)
    rows = parse_rows(raw)
    if "machine_id" not in rows.columns:
        rows = rows.withColumn("machine_id", F.lit(machine or "m0"))
    rows = rows.withColumn("ingest_seq", F.col("ingest_seq").cast("long"))
    return strict(rows) if mode == "strict" else rows


def strict(rows: DataFrame) -> DataFrame:
    """Fail on the first unparsable row."""
    failed = F.when(F.col("parse_reason").isNotNull(), F.raise_error(F.concat(
        F.lit("Invalid row "), F.col("ingest_seq").cast("string"), F.lit(": "), F.col("parse_reason"))).cast("bigint"))
    return rows.withColumn("us", F.coalesce(failed, F.col("us")))


# Time fields of a lifecycle record.
LIFECYCLE_TIMES = ("start_timestamp", "end_timestamp", "first_warning_timestamp", "first_critical_timestamp",
                   "first_raw_warning_timestamp", "first_confirmed_warning_timestamp",
                   "first_raw_critical_timestamp", "first_confirmed_critical_timestamp",
                   "maintenance_record_timestamp")
_RECORD = T.StructType([T.StructField(c, T.StringType()) for c in (
    "lifecycle_id", "highest_status", "operating_regime", "degradation_family", *LIFECYCLE_TIMES)]
    + [T.StructField("duration_hours", T.DoubleType()), T.StructField("critical_reached", T.BooleanType())])
METADATA = T.StructType([T.StructField("data_domain", T.StringType()), T.StructField("machine_id", T.StringType()),
                         T.StructField("lifecycles", T.ArrayType(_RECORD))])


def lifecycle_records(metadata: DataFrame) -> DataFrame:
    """Explicit lifecycles; other domains and empty lists give no rows."""
    usable = (F.col("data_domain") == "realistic_synthetic") & (F.size("lifecycles") > 0)
    rows = metadata.filter(usable).select(
        F.coalesce("machine_id", F.lit("m0")).alias("machine_id"), F.explode("lifecycles").alias("l")).select("machine_id", "l.*")

    def us(c):
        return F.unix_micros(F.try_to_timestamp(F.col(c)))
    return rows.select(
        "machine_id", "lifecycle_id", *[us(c).alias(c.replace("_timestamp", "_us")) for c in LIFECYCLE_TIMES if c != "maintenance_record_timestamp"],
        us("maintenance_record_timestamp").alias("reset_us"), "duration_hours", "highest_status",
        F.coalesce("critical_reached", F.lit(False)).alias("critical_reached"),
        F.coalesce("operating_regime", F.lit("unknown")).alias("operating_regime"),
        F.coalesce("degradation_family", F.lit("unknown")).alias("degradation_family"),
        F.lit("EXPLICIT").alias("confidence"))


def read_lifecycles(spark: SparkSession, path: str) -> DataFrame:
    return lifecycle_records(spark.read.schema(METADATA).option("multiLine", True).json(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenario intervals from CSV."""
    raw = spark.read.option("header", True).schema(
        "scenario string, start_timestamp string, end_timestamp string").csv(path)
    return raw.select("scenario", F.unix_micros(F.to_timestamp("start_timestamp")).alias("start_us"),
                      F.unix_micros(F.to_timestamp("end_timestamp")).alias("end_us"))


def read_audit(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Narrow scan of a wide audit table; Parquet reads only these columns."""
    return spark.read.parquet(path).select(*columns)
