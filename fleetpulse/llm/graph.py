"""Connected components of an edge table, by alternating stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.shared import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a, b. Returns (node, component) for every node with an edge to another one;
    the component is its smallest node. Rounds grow with the logarithm of the longest chain.

    Minima are found by aggregation, so a node with very many neighbours is
    summed up before the shuffle; neighbours then get their minimum by a join
    that adaptive execution may split.
    """
    now = cut(edges.filter(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        # Large star: every neighbour above a node goes to the smallest node around it.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        large = (both.filter(F.col("b") > F.col("a")).join(least, "a").filter(F.col("b") != F.col("_m"))
                 .select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct())
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = (large.join(least, "a")
                 .select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("_m").alias("b")),
                                          F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))))
                 .filter(F.col("a") != F.col("b")).distinct())
        now = cut(small)
        after = _state(now)
        if after == before:
            break
        before = after
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(now.select("b", "b")).distinct())
