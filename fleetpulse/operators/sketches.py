"""Distributions that are stored per machine and day and merged later, without reading old days again.

A sketch (KLL) has a fixed size, whatever the number of rows: with ``k`` = 400 about 10 KB. The rank
of an estimated percentile is off by less than ``RANK_ERROR`` of the rows in all but about one case in a
hundred. Sketches draw random numbers, so estimates differ a little from run to run;
minimum, maximum and number of rows are exact. Null and NaN values count nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.profile import KEYS, NAMES, PROBS, unpivoted

K = 400
RANK_ERROR = 0.01


def daily_sketches(df: DataFrame, values: dict[str, Column], by: Sequence[str] = KEYS, time: str = "us") -> DataFrame:
    """One row per group, variable and day (UTC): a table to append new days to."""
    long = unpivoted(df.withColumn("day", F.to_date(F.timestamp_micros(time))), values, [*by, "day"])
    there = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return there.groupBy(*by, "variable", "day").agg(
        F.count("*").alias("rows"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.kll_sketch_agg_double("value", F.lit(K)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """One row per group and variable from any set of days; the result can be merged again."""
    return sketches.groupBy(*by, "variable").agg(
        F.sum("rows").alias("rows"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: Sequence[str] = KEYS, probs: Sequence[float] = PROBS,
                         names: Sequence[str] = NAMES) -> DataFrame:
    """Percentiles per group and variable, estimated from merged sketches but for the ends."""
    def cell(p: float) -> Column:
        ends = {0.0: F.col("minimum"), 1.0: F.col("maximum")}
        return ends[p] if p in ends else F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return merged(sketches, by).select(*by, "variable", "rows", *[cell(p).alias(f"_{n}") for p, n in zip(probs, names)]).select(
        *by, "variable", "rows", *[F.col(f"_{n}").alias(n) for n in names])
