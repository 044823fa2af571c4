"""Gaps, resampling and segmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.params import DEFAULT, MINUTE_US, SENSOR_KEYS, Params
from fleetpulse.plans.slices import scan

KEYS = ("machine_id",)


def with_gap(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds since the row before: gap 0 and interval NULL on a machine's first row."""
    seen = scan(df, keys, lag={"_prev_us": "us"})
    interval = (F.col("us") - F.col("_prev_us")) / 1e6
    return seen.withColumns({"gap_s": F.coalesce(interval, F.lit(0.0)),
                             "source_interval_s": interval}).drop("_prev_us")


def missing_samples(gap_s: Column, expected_s: float = 60.0) -> Column:
    """max(0, round-half-even(gap / expected) - 1)."""
    return F.greatest(F.rint(gap_s / expected_s) - 1, F.lit(0.0))


def safe_resample(df: DataFrame, params: Params = DEFAULT, *, enabled: bool | None = None,
                  policy: str | None = None, keys: Sequence[str] = KEYS,
                  label: str | None = "health_status", lifecycle: str | None = None,
                  carry: Sequence[str] = ()) -> DataFrame:
    """Insert rows into short gaps between two normal rows of one lifecycle.

    Inserted values lie at ``step / (missing + 1)`` of the way, inserted times at
    ``previous + step * target``; the two disagree when the gap is no multiple of
    the target. Long gaps are never filled: the row after one is flagged, or the
    job fails when the policy is ``reject``.
    """
    c = params.cadence
    enabled = c.interpolate if enabled is None else enabled
    policy = policy or c.large_gap_policy
    if policy not in ("mark_unavailable", "reject"):
        raise ValueError(f"unknown large-gap policy {policy!r}")
    target_us = int(c.expected_s * 1e6)
    lags = {"_prev_us": "us", **{f"_prev_{k}": k for k in SENSOR_KEYS}}
    if label:
        lags["_prev_label"] = label
    if lifecycle:
        lags["_prev_life"] = lifecycle
    rows = scan(df, keys, lag=lags)
    gap_us = F.coalesce(F.col("us") - F.col("_prev_us"), F.lit(0))
    gap_s = gap_us / 1e6
    missing = F.greatest(F.floor(gap_us / target_us) - 1, F.lit(0)).cast("int")
    short = gap_s <= c.max_gap_s
    safe = F.lit(True)
    if label:
        safe = safe & (F.col("_prev_label") == "normal") & (F.col(label) == "normal")
    if lifecycle:
        safe = safe & (F.col("_prev_life") == F.col(lifecycle))
    available = short
    if policy == "reject":
        refusal = F.raise_error(F.format_string(
            "Sampling gap of %.1f minutes exceeds the configured maximum", gap_s / 60.0))
        available = F.when((missing > 0) & ~short, refusal.cast("boolean")).otherwise(short)
    rows = rows.withColumns({"_gap": gap_s, "_missing": missing, "_available": available})
    base = [*keys, "slice", *carry]
    original = rows.select(
        *base, "us", *SENSOR_KEYS, *([label] if label else []),
        F.lit(False).alias("interpolated"), F.col("_gap").alias("gap_s"),
        F.col("_available").alias("features_available"),
        F.col("_gap").alias("source_interval_s"), F.lit(c.expected_s).alias("effective_interval_s"))
    if not enabled:
        return original
    fill = rows.filter((F.col("_missing") > 0) & short & safe).withColumn(
        "_step", F.explode(F.sequence(F.lit(1), F.col("_missing"))))
    share = F.col("_step") / (F.col("_missing") + 1)
    inserted = fill.select(
        *base, (F.col("_prev_us") + F.col("_step") * target_us).alias("us"),
        *[(F.col(f"_prev_{k}") + share * (F.col(k) - F.col(f"_prev_{k}"))).alias(k)
          for k in SENSOR_KEYS],
        *([F.lit("normal").alias(label)] if label else []),
        F.lit(True).alias("interpolated"), F.lit(c.expected_s).alias("gap_s"),
        F.lit(True).alias("features_available"), F.col("_gap").alias("source_interval_s"),
        F.lit(c.expected_s).alias("effective_interval_s"))
    return original.unionByName(inserted)


TIME_ERRORS = ("missing_timestamp", "invalid_timestamp", "duplicate_timestamp",
               "non_monotonic_timestamp")


def segment(df: DataFrame, max_gap_min: float = 10.0, *, keys: Sequence[str] = KEYS,
            lifecycle: str = "lifecycle_id", text: str | None = None,
            order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Number the continuous stretches of a machine in arrival order.

    ``us`` is null where the time could not be parsed; ``text`` then tells a
    blank time from a malformed one. Adds ``segment`` and ``segment_reason``.
    ``df`` needs a ``slice`` that grows with ``order``.
    """
    bad = F.lit("invalid_timestamp")
    if text:
        shown = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
        bad = F.when(shown.isin("", "nan"), "missing_timestamp").otherwise(bad)
    rows = df.withColumn("_bad", F.when(F.col("us").isNull(), bad))
    life = F.coalesce(F.col(lifecycle), F.lit("unknown"))
    rows = scan(rows, keys, order=order, lag={
        "_has": F.lit(1), "_prev_us": "us", "_prev_life": life, "_prev_bad": "_bad"})
    step = F.col("us") - F.col("_prev_us")
    reason = (F.when(F.col("_bad").isNotNull(), F.col("_bad"))
              .when(F.col("_has").isNull(), F.lit(""))
              .when(F.col("_prev_bad").isNotNull(), F.col("_prev_bad"))
              .when(F.col("_prev_life") != life, "lifecycle_boundary")
              .when(step == 0, "duplicate_timestamp").when(step < 0, "non_monotonic_timestamp")
              .when(step > int(max_gap_min * MINUTE_US), "timestamp_gap").otherwise(""))
    rows = rows.withColumn("segment_reason", reason)
    split = (F.col("segment_reason") != "") & F.col("_has").isNotNull()
    return (scan(rows, keys, order=order, total={"segment": split.cast("long")})
            .withColumn("own_time_error", F.col("_bad"))
            .drop("_bad", "_has", "_prev_us", "_prev_life", "_prev_bad"))


def segment_error_counts(segmented: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    def n(cond):
        return F.sum(cond.cast("long"))
    reason = F.col("segment_reason")
    return segmented.groupBy(*keys).agg(
        n(F.col("own_time_error").eqNullSafe("invalid_timestamp")).alias("invalid_timestamp_rows"),
        n(F.col("own_time_error").eqNullSafe("missing_timestamp")).alias("missing_timestamp_rows"),
        n(reason == "duplicate_timestamp").alias("duplicate_timestamp_rows"),
        n(reason == "non_monotonic_timestamp").alias("non_monotonic_timestamp_rows"),
        n(reason.isin(*TIME_ERRORS)).alias("segments_broken_by_timestamp_errors"))


def segment_hours(segmented: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exposure: last minus first time of each segment."""
    return segmented.groupBy(*keys, "segment").agg(
        ((F.max("us") - F.min("us")) / 3.6e9).alias("hours"), F.count("*").alias("segment_rows"))
