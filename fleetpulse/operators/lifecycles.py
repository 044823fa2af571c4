"""Lifecycle tables: assigning rows to them and describing rows by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions import rules
from fleetpulse.operators import state
from fleetpulse.params import DEFAULT, DURATION_BOUNDS_H, SENSOR_KEYS, Params
from fleetpulse.plans.slices import add_slice, scan

KEYS = ("machine_id",)


def plan_from_starts(starts: DataFrame, confirm_us: int = 0) -> DataFrame:
    """Closed lifecycles from a table of starts: each ends where the next begins."""
    w = Window.partitionBy("machine_id").orderBy("start_us")
    return (starts.withColumn("end_us", F.lead("start_us").over(w))
            .withColumn("reset_us", F.col("end_us") + confirm_us)
            .filter(F.col("end_us").isNotNull()))


def _marked(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Readings plus one marker row per boundary, sorted before readings of equal time.

    Counting markers replaces a range join: nothing is broadcast and no reading
    meets more than its own slice.
    """
    # The slice width of ``df`` is not known here, so markers join by re-slicing both.
    day = add_slice(df.drop("slice")).withColumn("_mark", F.lit(0))
    marks = add_slice(plan.select(
        "machine_id", F.col("end_us").alias("us"), F.lit(-1).cast("long").alias("ingest_seq"),
        F.col("reset_us").alias("_reset_us"), F.col("end_us").alias("_end_us"),
        F.lit(1).alias("_mark")))
    return day.unionByName(marks, allowMissingColumns=True)


def assign_lifecycle(df: DataFrame, plan: DataFrame) -> DataFrame:
    """lifecycle_0001, 0002, ... by the number of boundaries at or before the row."""
    rows = scan(_marked(df, plan), KEYS, total={"_n": F.col("_mark").cast("long")})
    number = F.lpad((F.col("_n") + 1).cast("string"), 4, "0")
    return (rows.filter("_mark = 0").withColumn("lifecycle_id", F.concat(F.lit("lifecycle_"), number))
            .drop("_mark", "_n", "_reset_us", "_end_us"))


def lifecycle_state(df: DataFrame, plan: DataFrame, states: str | None = None) -> DataFrame:
    """RESET_CANDIDATE between end and confirmation, open_* on a machine's last row."""
    marked = _marked(df, plan)
    rows = scan(marked, KEYS, last={"_reset": "_reset_us"}).filter("_mark = 0")
    ends = df.groupBy(*KEYS).agg(F.max("us").alias("_last_us"))
    rows = rows.join(ends, list(KEYS))
    known = F.col(states) if states else F.lit(None).cast("string")
    state_col = (F.when(F.col("us") < F.col("_reset"), "RESET_CANDIDATE")
                 .when(F.col("us") == F.col("_reset"), F.coalesce(known, F.lit("RESET_COMPLETE")))
                 .when(F.col("us") == F.col("_last_us"), F.concat(
                     F.lit("open_"), F.lower(rules.status_name("raw_status"))))
                 .otherwise(F.coalesce(known, F.lit("HEALTHY"))))
    return rows.withColumn("lifecycle_state", state_col).drop(
        "_reset", "_last_us", "_mark", "_reset_us", "_end_us")


def resolve_lifecycles(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """Explicit records win for every machine that has any."""
    rest = inferred.join(explicit.select("machine_id").distinct(), "machine_id", "left_anti")
    return explicit.unionByName(rest, allowMissingColumns=True)


def causal_states(df: DataFrame, params: Params = DEFAULT,
                  keys: Sequence[str] = ("machine_id", "lifecycle_id")) -> DataFrame:
    """Audit-only state per row under fixed boundaries."""
    found = state.detect_lifecycles(df, keys, params).select(
        *keys, "us", "ingest_seq", F.col("lifecycle_state").alias("_phase"))
    first = df.groupBy(*keys).agg(F.min("us").alias("_first"))
    opening = first.join(first.groupBy("machine_id").agg(F.min("_first").alias("_machine_first")),
                         "machine_id")
    rows = df.join(found, [*keys, "us", "ingest_seq"]).join(opening, list(keys))
    at_boundary = (F.col("us") == F.col("_first")) & (F.col("us") != F.col("_machine_first"))
    ladder = (F.when(at_boundary, "RESET_COMPLETE")
              .when(F.col("_phase") == "RESET_CANDIDATE", "RECOVERY_CONFIRMATION")
              .when(F.col("event_status") >= 2, "CRITICAL").when(F.col("event_status") >= 1, "WARNING")
              .when(F.col("_phase") == "DEGRADING", "DEGRADING").otherwise("HEALTHY"))
    return rows.withColumn("lifecycle_state", ladder).drop("_phase", "_first", "_machine_first")


def lifecycle_rows(closed: DataFrame) -> DataFrame:
    """Flat rows for the lifecycle table; one per machine and lifecycle, the last reset wins."""
    w = Window.partitionBy("machine_id", "lifecycle_id").orderBy(F.col("reset_us").desc())
    last = closed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last.select(
        "machine_id", "lifecycle_id", "start_us", "end_us", "reset_us",
        F.bround("duration_hours", 4).alias("duration_hours"),
        rules.status_name("highest_status").alias("highest_status"), "critical_reached",
        "confidence", "reason", "first_raw_warning_us", "first_raw_critical_us",
        "first_confirmed_warning_us", "first_confirmed_critical_us",
        *[F.col("pre")[k].alias(f"pre_reset__{k}") for k in SENSOR_KEYS],
        *[F.col("post")[k].alias(f"post_reset__{k}") for k in SENSOR_KEYS])


def bucket_names(bounds: Sequence[float]) -> list[str]:
    if len(bounds) == 3:
        return ["short", "medium", "long", "very_long"]
    edges = [0, *bounds]
    return [f"[{a:g},{b:g})h" for a, b in zip(edges, bounds)] + [f"[{edges[-1]:g},inf)h"]


def duration_bucket(hours, bounds: Sequence[float] = DURATION_BOUNDS_H):
    """Bucket of a lifecycle length: named for three borders, else ``[a,b)h``."""
    c = F.col(hours) if isinstance(hours, str) else hours
    names = bucket_names(bounds)
    out = F.lit(names[-1])
    for b, n in reversed(list(zip(bounds, names))):
        out = F.when(c < b, n).otherwise(out)
    return F.when(c.isNotNull(), out)


def attach_lifecycle_attrs(df: DataFrame, lifecycles: DataFrame,
                           attrs: Sequence[str] = ("operating_regime", "degradation_family",
                                                   "duration_hours")) -> DataFrame:
    """Lifecycle attributes onto rows. The join side is chosen by Spark from its measured size."""
    return df.join(lifecycles.select("machine_id", "lifecycle_id", *attrs),
                   ["machine_id", "lifecycle_id"], "left")
