"""Status layers that need neighbouring rows: event status, stabilised status, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.params import DEFAULT, MINUTE_US, Params
from fleetpulse.plans.slices import in_slice, scan, with_history

KEYS = ("machine_id",)


def event_status(df: DataFrame, keys: Sequence[str] = KEYS, params: Params = DEFAULT) -> DataFrame:
    """Status confirmed by uninterrupted time at or above a level.

    Runs are islands: a row opens one when the row before is below the level,
    missing, or more than the allowed gap away. No fold is needed.
    """
    p = params.lifecycle
    limit = int(p.max_gap_min * MINUTE_US)
    seen = scan(df, keys, lag={"_prev_us": "us", "_prev_status": "raw_status"})
    broken = F.col("_prev_us").isNull() | (F.col("us") - F.col("_prev_us") > limit)

    def opens(level):
        return F.when((F.col("raw_status") >= level) & (broken | (F.col("_prev_status") < level)),
                      F.col("us"))
    runs = scan(seen, keys, last={"_w_since": opens(1), "_c_since": opens(2)})
    warn = (F.col("raw_status") >= 1) & (
        F.col("us") - F.col("_w_since") >= int(p.warning_confirm_min * MINUTE_US))
    crit = (F.col("raw_status") >= 2) & (
        F.col("us") - F.col("_c_since") >= int(p.critical_confirm_min * MINUTE_US))
    return (runs.withColumn("event_status", F.when(crit, 2).when(warn, 1).otherwise(0))
            .drop("_prev_us", "_prev_status", "_w_since", "_c_since"))


def stabilized_status(df: DataFrame, keys: Sequence[str] = KEYS,
                      params: Params = DEFAULT) -> DataFrame:
    """Operational status as a latch.

    The last few raw statuses decide whether a row sets a new status or keeps
    the old one, so the status is the last non-null "set" event.
    """
    m = params.monitoring
    depth = max(m.critical_recovery_rows, m.vote_rows - 1, m.normal_recovery_rows - 1)
    rows = with_history(df, keys, depth)
    w = in_slice(keys)
    raw = F.col("raw_status")

    def recent(n):
        return w.rowsBetween(-(n - 1), 0)
    votes = F.sum(F.when(raw >= 1, 1).otherwise(0)).over(recent(m.vote_rows))
    critical_near = F.max(raw).over(recent(m.critical_recovery_rows)) == 2
    leaving = F.lag(raw, m.critical_recovery_rows).over(w) == 2
    quiet = ((F.max(raw).over(recent(m.normal_recovery_rows)) == 0)
             & (F.count("*").over(recent(m.normal_recovery_rows)) == m.normal_recovery_rows))
    event = (F.when(raw == 2, 2).when(F.lag(raw).over(w).isNull(), raw)
             .when(critical_near, F.lit(None))
             .when(leaving, F.when(raw == 1, 1).otherwise(0))
             .when(votes >= m.votes, 1).when(quiet, 0))
    events = rows.withColumn("_set", event).filter(~F.col("is_halo")).drop("is_halo")
    return scan(events, keys, last={"stabilized_status": "_set"}).drop("_set")


def status_runs(df: DataFrame, column: str = "raw_status",
                keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per unbroken run of equal status."""
    seen = scan(df, keys, lag={"_prev": column, "_has": F.lit(1)})
    start = F.col("_has").isNull() | ~F.col("_prev").eqNullSafe(F.col(column))
    runs = scan(seen, keys, total={"run": start.cast("long")})
    return runs.groupBy(*keys, "run").agg(
        F.first(column).alias(column), F.min("us").alias("start_us"),
        F.max("us").alias("end_us"), F.count("*").alias("run_rows"))


def status_changes(df: DataFrame, column: str = "raw_status",
                   keys: Sequence[str] = KEYS) -> DataFrame:
    seen = scan(df, keys, lag={"_prev": column})
    return seen.groupBy(*keys).agg(F.sum(
        (F.col("_prev").isNotNull() & (F.col("_prev") != F.col(column))).cast("long"))
        .alias("changes"))


def consecutive_status_hours(df: DataFrame, column: str = "stabilized_status",
                             keys: Sequence[str] = KEYS) -> DataFrame:
    """Hours since the current warning / critical run began (0 outside a run)."""
    seen = scan(df, keys, lag={"_prev": column})

    def opens(level):
        return F.when((F.col(column) >= level)
                      & (F.col("_prev").isNull() | (F.col("_prev") < level)), F.col("us"))
    runs = scan(seen, keys, last={"_w": opens(1), "_c": opens(2)})

    def hours(level, since):
        return F.when(F.col(column) >= level, (F.col("us") - F.col(since)) / 3.6e9).otherwise(0.0)
    return runs.withColumns({"consecutive_warning_hours": hours(1, "_w"),
                             "consecutive_critical_hours": hours(2, "_c")}).drop("_prev", "_w", "_c")


