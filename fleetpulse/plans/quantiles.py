"""Exact quantiles of unbounded groups.

``percentile`` keeps every distinct value of a group in one task. Here a sketch
first gives equal-depth cut points, the rows between them are counted, and in the ranges
that hold a rank asked for distinct values are counted and ranked: same numbers, but a
group of any size is spread over as many ranges as there are shuffle partitions
(64 at least). The cut points are written once: a sketch depends on the order in which
its parts arrive, so two evaluations may cut differently, and ranges would be
counted by one and looked up by the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.shared import cut

CUTS = 64


def range_of(v: Column, cuts: Column, count: int) -> Column:
    """How many of ``count`` ascending cut points lie below a value, by halving."""
    def find(low, high):
        if low == high:
            return F.lit(low).cast("long")
        mid = (low + high) // 2
        return F.when(F.get(cuts, F.lit(mid)) < v, find(mid + 1, high)).otherwise(find(low, mid))
    return find(0, count)


def quantiles(rows: DataFrame, by: Sequence[str], value: Column, probs: Sequence[float],
              name: str = "quantiles") -> DataFrame:
    """One row per group with an array of linearly interpolated quantiles."""
    group = list(by) or ["_one"]
    base = rows if by else rows.withColumn("_one", F.lit(0))
    v = base.select(*group, value.cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    n = max(CUTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = v.groupBy(*group).agg(F.percentile_approx("_v", marks, F.lit(10 * n)).alias("_cuts"),
                                 F.count("*").alias("_total"))
    placed = v.join(cut(cuts), group).withColumn("slice", range_of(F.col("_v"), F.col("_cuts"), n - 1)).drop("_cuts")

    def place(p):
        return F.lit(float(p)) * (F.col("_total") - 1)
    # Values are counted and ranked in those ranges alone that hold a rank asked for.
    sizes = placed.groupBy(*group, "slice", "_total").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("slice"))
    sizes = sizes.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_n"))
    held = F.lit(False)
    for p in probs:
        for rank in (F.floor(place(p)), F.ceil(place(p))):
            held = held | ((F.col("_below") <= rank) & (rank < F.col("_upto")))
    kept = cut(sizes.filter(held).select(*group, "slice", "_below"))
    counts = placed.join(kept, [*group, "slice"]).groupBy(*group, "slice", "_total", "_below", "_v").agg(F.count("*").alias("_cnt"))
    ranked = counts.withColumn("_upto", F.col("_below") + F.sum("_cnt").over(
        Window.partitionBy(*group, "slice").orderBy("_v")))
    cells = []
    for p in probs:
        low = F.min(F.when(F.col("_upto") > F.floor(place(p)), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(place(p)), F.col("_v")))
        share = F.max(place(p) - F.floor(place(p)))
        cells.append(low + (high - low) * share)
    # Without groups there is one row also for an empty input, with a null per quantile.
    return ranked.groupBy(*group if by else ()).agg(F.array(*cells).alias(name))


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two tables with one row per group; without groups both have one row."""
    return left.join(right, list(by), "left") if by else left.crossJoin(right)
