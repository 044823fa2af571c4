"""Exact top-k by integer inner product: tiles of queries and shards, a selection per tile, lists merged as a tree.

Components become integers, floor(scale * x). Queries are dealt to blocks and
vectors to shards; a task holds one block of queries and streams the vectors of
one shard past it. Every Arrow batch of them is a tile: one matrix product,
from which each query's best are taken before the next tile comes. What
a task returns is one list per query; lists meet in groups of ``fan_in``, and
their best in groups again, until each query has one list.

Products are exact: in doubles while no sum can reach 2^53, else in 64-bit
integers, else in Python's integers.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without identifier; zero vectors do; only vectors of
one length are compared; equal scores are ordered by identifier; rows that share
an identifier are all candidates, but none for their own identifier; of query
rows that share one, the vector that is smallest in component order asks; with
fewer candidates than ``top`` all are returned; scaled components and scores
beyond 64 bits count as the nearest long; an empty table gives no rows. Other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.rows import input_partitions
from fleetpulse.plans.shared import cut

MOST = 2**63 - 1
NONE = -2**63  # the score of no candidate; scores end above it


@dataclass(frozen=True)
class Settings:
    top: int = 10
    scale: int = 1_024
    block_queries: int = 8_192  # held by a task
    tile_queries: int = 512  # of one matrix product
    tile_rows: int = 4_096
    shard_rows: int = 4_096  # at least, on average
    fan_in: int = 16


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dims, v) of the rows that take part, v in whole numbers."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~bad)
            .select("id", F.size("v").cast("long").alias("dims"),
                    F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices' rows: whole numbers in doubles, or longs that end at the largest."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)))
    left, right = np.maximum(left, -MOST), np.maximum(right, -MOST)
    reach = left.shape[1] * int(np.abs(left).max()) * int(np.abs(right).max())
    if reach < 2**53:
        return left.astype(np.float64) @ right.T.astype(np.float64)
    if reach <= MOST:
        return left @ right.T
    exact = left.astype(object) @ right.T.astype(object)
    return np.clip(exact, NONE + 1, MOST).astype(np.int64)


def best_of_tile(queries: np.ndarray, asked: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int) -> tuple:
    """(query place, id, score) of each query's best rows; ``ids`` grow, so an earlier row wins a tie."""
    scores = products(queries, rows)
    low, high = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
    for q in np.flatnonzero(high > low):
        scores[q, low[q]:high[q]] = NONE
    if scores.shape[1] > top:
        edge = np.partition(scores, scores.shape[1] - top, axis=1)[:, -top][:, None]
        above, level = scores > edge, scores == edge
        room = top - above.sum(axis=1, dtype=np.int64)[:, None]
        wanted = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
    else:
        wanted = np.ones(scores.shape, bool)
    q, c = np.nonzero(wanted)
    found = scores[q, c]
    there = found != NONE
    return q[there], ids[c[there]], found[there].astype(np.int64)


class Lists:
    """The best rows seen so far of each query in a block."""

    def __init__(self, asked: np.ndarray, queries: np.ndarray, settings: Settings):
        self.asked, self.queries, self.settings = asked, queries, settings
        self.q, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        step, width = self.settings.tile_queries, self.settings.tile_rows
        parts = [(self.q, self.ids, self.scores)]
        for low in range(0, len(self.asked), step):
            for left in range(0, len(ids), width):
                q, found, scores = best_of_tile(self.queries[low:low + step], self.asked[low:low + step],
                                                ids[left:left + width], rows[left:left + width], self.settings.top)
                parts.append((q + low, found, scores))
        q, found, scores = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((found, ~scores, q))  # ~ turns the order of longs around
        q, found, scores = q[order], found[order], scores[order]
        first = np.searchsorted(q, q, "left")
        wanted = np.arange(len(q)) - first < self.settings.top
        self.q, self.ids, self.scores = q[wanted], found[wanted], scores[wanted]

    def rows(self, shard: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.asked[self.q]), pa.array(np.full(len(self.q), shard, np.int64)), pa.array(self.ids), pa.array(self.scores)],
            names=["query_id", "shard", "vec_id", "score"])


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


TILE = ["dims", "block", "shard"]


def _tiled(settings: Settings):
    """Over rows ordered by tile, queries first and then vectors by identifier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, lists = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                now, dims = tuple(keys[low, :3].tolist()), int(keys[low, 0])
                if now != tile:
                    if lists is not None:
                        yield lists.rows(tile[2])
                    tile, held, lists = now, [], None
                part = batch.slice(low, high - low)
                ids, rows = part.column(4).to_numpy(), _matrix(part.column(5), dims)
                if keys[low, 3] == 0:
                    held.append((ids.copy(), rows.copy()))
                    continue
                if lists is None and held:
                    lists, held = Lists(*(np.concatenate(p) for p in zip(*held)), settings), []
                if lists is not None:
                    lists.add(ids, rows)
        if lists is not None:
            yield lists.rows(tile[2])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``top`` rows of ``vectors`` with the largest products."""
    spark = vectors.sparkSession
    rows = cut(scaled(vectors, id_col, vector_col, settings.scale))
    # Arrays of longs have an order, so repeated identifiers ask with one fixed vector.
    asked = cut(scaled(queries, id_col, vector_col, settings.scale).groupBy("id").agg(F.min(F.struct("dims", "v")).alias("q"))
                .select("id", "q.dims", "q.v"))
    blocks = max(1, -(-asked.count() // settings.block_queries))
    shards = max(1, min(-(-4 * input_partitions(spark) // blocks), rows.count() // settings.shard_rows))
    zero = F.lit(0).cast("long")
    # Dealt by place in the written table, not by content, so that repeated rows spread.
    dealt = (rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
             .withColumn("block", F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))))
             .select(*TILE, F.lit(1).cast("long").alias("asks"), "id", "v"))
    asking = (asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
              .withColumn("shard", F.explode(F.sequence(zero, F.lit(shards - 1).cast("long"))))
              .select(*TILE, zero.alias("asks"), "id", "v"))
    tiles = asking.unionByName(dealt).repartition(*TILE).sortWithinPartitions(*TILE, "asks", "id")
    lists = tiles.mapInArrow(_tiled(settings), "query_id long, shard long, vec_id long, score long")
    while shards > 1:
        shards = -(-shards // settings.fan_in)
        lists = _best(lists.withColumn("shard", F.floor(F.col("shard") / settings.fan_in)), ["query_id", "shard"], settings)
    return (_best(lists, ["query_id"], settings).select("query_id", "rank", "vec_id", "score"))


def _best(lists: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top)
