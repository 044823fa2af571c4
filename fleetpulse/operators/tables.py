"""Rows for the result tables: rejected readings, lifecycles, model records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.anomaly import classify_invalid
from fleetpulse.operators.rules import raw_safety_status
from fleetpulse.params import SENSOR_KEYS
from fleetpulse.plans.slices import scan


def invalid_rows(df: DataFrame) -> DataFrame:
    """Dead-letter rows: what was read, why it was refused and what that means."""
    out = classify_invalid(raw_safety_status(df.filter(~F.col("valid"))))
    return out.select(
        "machine_id", F.col("ingest_seq").alias("row_number"), F.col("reason").alias("validation_reason"), "us",
        *SENSOR_KEYS, "label", "quality_status", F.col("anomaly_types").alias("anomaly_type"), "model_action",
        "training_eligible", "training_exclusion_reason", "requires_human_review",
        F.to_json("supporting_evidence").alias("supporting_evidence_json"))


def limit_valid(df: DataFrame, n: int | None, keys: Sequence[str] = ("machine_id",)) -> DataFrame:
    """Rows up to and including the n-th valid one per machine; no limit for None or 0."""
    if not n:
        return df
    flag = F.col("valid").cast("long")
    rows = scan(df, keys, order=("ingest_seq",), total={"_upto": flag})
    return rows.filter(F.col("_upto") - flag < n).drop("_upto")


def archive_evidence(history: DataFrame, targets: Sequence[str], promoted_us: int) -> DataFrame:
    """Production records of the promoted targets become archived; first promotion time is kept."""
    hit = (F.col("stage") == "production") & F.col("target").isin(*targets)
    return history.withColumns({
        "promotion_us": F.when(hit, F.coalesce("promotion_us", F.lit(promoted_us))).otherwise(F.col("promotion_us")),
        "stage": F.when(hit, "archived").otherwise(F.col("stage"))})


def replay_rows(valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """Rejected rows and (resampled) valid rows of a replay, sorted within each machine and day."""
    rows = valid.withColumn("valid", F.lit(True)).unionByName(
        invalid.withColumn("valid", F.lit(False)), allowMissingColumns=True)
    return rows.repartition("machine_id", F.floor(F.col("us") / 86_400_000_000)).sortWithinPartitions(
        "machine_id", F.col("us").asc_nulls_first(), F.coalesce(F.col("interpolated"), F.lit(False)))
