"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stopping test.

Vectors of about equal norm form a shell with bound M. Divided by M, and with
one more coordinate, sqrt(1 - |x / M|^2), a shell's vectors lie on the unit
sphere, where the largest inner product with q is the smallest distance to
q / |q|. A Gaussian projection to
``projected`` dimensions turns a distance d into d times the root of a
chi-square variable. So once the next point in projected order lies beyond
d_k * sqrt(quantile), with d_k the k-th best distance verified so far, any
better point would have been seen earlier with probability ``sure``: stop.

The first levels of the kd-tree are fitted on a bounded sample
(``Settings.sample_rows`` vectors) and deal all rows out to blocks; every block
builds its own tree over all of its rows. A query first searches the block that
it falls into in each shell, nearest leaves first; its d_k then gives the ball
in projected space, and the blocks whose cells the ball meets are searched in a
second round. Blocks with many rows are split, and blocks with many queries are
searched in several tasks.

Defined results: vectors that are null, empty, zero or hold null, NaN or
infinite components take no part, nor do rows without identifier; only vectors
of one length are compared; equal scores are ordered by identifier; rows that
share an identifier are all candidates, but none for their own identifier;
with fewer candidates than ``top`` all are returned; an empty table gives no
rows. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.plans.shared import cut


@dataclass(frozen=True)
class Settings:
    top: int = 20
    projected: int = 8  # even
    sure: float = 0.95
    sample_rows: int = 20_000
    block_rows: int = 8_192
    most_cells: int = 1_024  # of one shell; larger blocks are split at random
    leaf_rows: int = 64
    block_queries: int = 50_000  # searched by one task
    seed: int = 7


def quantile(sure: float, dimensions: int) -> float:
    """The chi-square quantile for an even number of dimensions."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1_000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


def shell_bound(shell: int) -> float:
    """Norms of a shell lie in (bound / 2, bound]; rounding around a power of two doesn't part vectors."""
    return 2.0 ** (shell + 0.01)


def shells(norms: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(norms) - 0.01).astype(np.int64)


def projection(dimensions: int, settings: Settings) -> np.ndarray:
    """The Gaussian matrix for vectors of so many dimensions and the added coordinate."""
    return np.random.default_rng([settings.seed, dimensions]).normal(size=(dimensions + 1, settings.projected))


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms, without squaring very large or small numbers."""
    scale = np.abs(vectors).max(axis=1)
    return scale * np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1))


def on_sphere(vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Shell and projection of each vector."""
    shell = shells(norms_of(vectors))
    inside = vectors / np.array([shell_bound(int(s)) for s in shell])[:, None]
    added = np.sqrt(np.maximum(1 - (inside ** 2).sum(axis=1), 0))
    return shell, np.concatenate([inside, added[:, None]], axis=1) @ projection(vectors.shape[1], settings)


def unit_projection(queries: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Norm and projected direction of each query."""
    norms = norms_of(queries)
    return norms, (queries / norms[:, None]) @ projection(queries.shape[1], settings)[:-1]


def squared_radius(score: np.ndarray, norms: np.ndarray, bound: float, stop: float) -> np.ndarray:
    """Where, in squared projected distance, a query stops that has ``score`` as its k-th best; infinite for -inf."""
    some = score > -np.inf
    near = np.maximum(2 - 2 * (np.where(some, score, 0) / norms / bound), 0)
    return np.where(some, near * stop * (1 + 1e-9) + 1e-12, np.inf)


class Cells:
    """The top of a kd-tree: a complete binary tree of splits, and the boxes of its leaves."""

    def __init__(self, points: np.ndarray, cells: int):
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        while len(points) < 2 ** depth * 4 and depth:
            depth -= 1
        width = points.shape[1]
        self.depth, self.dim, self.value = depth, np.zeros(2 ** depth - 1, np.int64), np.zeros(2 ** depth - 1)
        self.low = np.full((2 ** depth, width), -np.inf)
        self.high = np.full((2 ** depth, width), np.inf)
        todo = [(0, points, self.low[0].copy(), self.high[0].copy())] if depth else []
        while todo:
            node, own, low, high = todo.pop()
            d = int(np.ptp(own, axis=0).argmax())
            at = float(np.median(own[:, d]))
            self.dim[node], self.value[node] = d, at
            right = own[:, d] > at
            for side, part in ((0, own[~right]), (1, own[right])):
                child, box = 2 * node + 1 + side, (low.copy(), high.copy())
                box[1 - side][d] = at  # the left side ends there, the right one begins
                part = part if len(part) else own
                if child < len(self.dim):
                    todo.append((child, part, *box))
                else:
                    self.low[child - len(self.dim)], self.high[child - len(self.dim)] = box

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.value[node])
        return node - len(self.dim)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell."""
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d][:, None]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


class Block:
    """A kd-tree over the vectors of a block, with buckets as leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, bound: float, settings: Settings):
        self.settings, self.bound = settings, bound
        order, leaves = [], []
        todo = [np.lexsort((ids,))]
        while todo:
            own = todo.pop()
            if len(own) <= settings.leaf_rows:
                leaves.append((len(order), len(order) + len(own)))
                order.extend(own.tolist())
            else:
                part = points[own]
                d = int(np.ptp(part, axis=0).argmax())
                own = own[np.argsort(part[:, d], kind="stable")]
                todo += [own[len(own) // 2:], own[:len(own) // 2]]
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.leaves = leaves
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in leaves])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in leaves])

    def search(self, own: np.ndarray, queries: np.ndarray, unit: np.ndarray, floor: np.ndarray,
               stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the best found for each query, best first; -inf where there are fewer.

        ``floor`` is a score that ``top`` other candidates are known to reach.
        """
        top, n = self.settings.top, len(queries)
        norms = norms_of(queries)
        gaps = box_distances(unit, self.low, self.high)
        turns = np.argsort(gaps, axis=1, kind="stable")
        ids = np.full((n, top), np.iinfo(np.int64).max)
        scores = np.full((n, top), -np.inf)
        live = np.arange(n)
        for turn in range(len(self.leaves)):
            leaf = turns[live, turn]
            # Beyond this squared radius, nothing is nearer than the k-th best with the wanted certainty.
            radius = squared_radius(np.maximum(scores[live, -1], floor[live]), norms[live], self.bound, stop)
            going = gaps[live, leaf] <= radius
            live, leaf, radius = live[going], leaf[going], radius[going]
            if not len(live):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                a, b = self.leaves[leaf[group[0]]]
                q = live[group]
                seen = ((unit[q][:, None, :] - self.points[a:b]) ** 2).sum(axis=2) <= radius[group][:, None]
                seen &= self.ids[a:b] != own[q][:, None]
                # Summed in one order for all pairs, so that equal vectors score equally.
                score = np.where(seen, np.einsum("qd,nd->qn", queries[q], self.vectors[a:b]), -np.inf)
                all_scores = np.concatenate([scores[q], score], axis=1)
                all_ids = np.concatenate([ids[q], np.broadcast_to(self.ids[a:b], score.shape)], axis=1)
                best = np.lexsort((all_ids, -all_scores), axis=1)[:, :top]
                scores[q] = np.take_along_axis(all_scores, best, axis=1)
                ids[q] = np.take_along_axis(all_ids, best, axis=1)
        return ids, scores


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, rows.shape[1] if rows.size else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets if rows.size else np.zeros(len(rows) + 1, np.int32)), pa.array(rows.ravel()))


def _by_dimensions(batch: pa.RecordBatch, place: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    import pyarrow.compute as pc

    sizes = pc.list_value_length(batch.column(place)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield int(n), batch.filter(pa.array(sizes == n))


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .filter(~bad & F.exists("v", lambda x: x != 0)))


def _placed(rows: DataFrame, cells: dict | None, settings: Settings) -> DataFrame:
    """(id, v, dims, shell, y, cell) of each vector; without cells, cell is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dimensions(batch, 1):
                shell, y = on_sphere(_matrix(part.column(1)), settings)
                cell = np.zeros(len(shell), np.int64)
                for s in np.unique(shell) if cells is not None else ():
                    if (dims, int(s)) in cells:
                        cell[shell == s] = cells[dims, int(s)].of(y[shell == s])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(shell), dims, np.int64)), pa.array(shell),
                     _lists(y), pa.array(cell)], names=["id", "v", "dims", "shell", "y", "cell"])

    return rows.mapInArrow(run, "id long, v array<double>, dims long, shell long, y array<double>, cell long")


def _cells(rows: DataFrame, settings: Settings) -> dict[tuple[int, int], Cells]:
    """The splits of each (dimensions, shell), fitted on the sampled rows with the smallest hashes."""
    sample = _placed(rows.orderBy(F.xxhash64("id", F.lit(settings.seed)), "id").limit(settings.sample_rows), None, settings)
    points: dict[tuple[int, int], list] = {}
    for r in sample.select("dims", "shell", "y").collect():
        points.setdefault((r["dims"], r["shell"]), []).append(r["y"])
    total, seen = rows.count(), sum(map(len, points.values()))
    return {k: Cells(np.array(y), min(settings.most_cells, len(y) * total // max(1, seen) // settings.block_rows + 1))
            for k, y in points.items()}


def _visits(queries: DataFrame, cells: dict, settings: Settings, stop: float, first: bool) -> DataFrame:
    """(dims, shell, cell, id, v, y, floor): the blocks that each query searches in a round; y is its unit projection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dimensions(batch, 1):
                v = _matrix(part.column(1))
                floor = part.column(2).to_numpy(zero_copy_only=False)
                norms, unit = unit_projection(v, settings)
                for (d, shell), own in cells.items():
                    if d != dims:
                        continue
                    bound = shell_bound(shell)
                    home = own.of(unit)
                    if first:
                        q, cell = np.arange(len(v)), home
                    else:
                        meets = own.distances(unit) <= squared_radius(floor, norms, bound, stop)[:, None]
                        meets &= (bound * norms * (1 + 1e-9) >= floor)[:, None]  # no vector of the shell scores more
                        meets[np.arange(len(v)), home] = False
                        q, cell = np.nonzero(meets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), dims, np.int64)), pa.array(np.full(len(q), shell, np.int64)), pa.array(cell),
                         part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), _lists(unit[q]), pa.array(floor[q])],
                        names=["dims", "shell", "cell", "id", "v", "y", "floor"])

    return queries.select("id", "v", "floor").mapInArrow(
        run, "dims long, shell long, cell long, id long, v array<double>, y array<double>, floor double")


BLOCK = ["dims", "shell", "cell", "part", "chunk"]


def _searched(placed: DataFrame, visits: DataFrame, settings: Settings, stop: float) -> DataFrame:
    """(query_id, vec_id, score): the best of each block for each query that visits it."""
    visits = cut(visits)
    key = ["dims", "shell", "cell"]
    parts = placed.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (4 * settings.block_rows))).cast("long").alias("_parts"))
    chunks = visits.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / settings.block_queries)).cast("long").alias("_chunks"))
    sizes = cut(parts.join(chunks, key))
    zero = F.lit(0).cast("long")
    data = (placed.join(sizes, key)
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
            .withColumn("chunk", F.explode(F.sequence(zero, F.col("_chunks") - 1)))
            .select(*BLOCK, zero.alias("asks"), "id", "v", "y", F.lit(0.0).alias("floor")))
    asked = (visits.join(sizes, key)
             .withColumn("part", F.explode(F.sequence(zero, F.col("_parts") - 1)))
             .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")))
             .select(*BLOCK, F.lit(1).cast("long").alias("asks"), "id", "v", "y", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # data rows of the block at hand
        key, block = None, None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(6)])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                rows, now = batch.slice(low, high - low), tuple(keys[low, :5].tolist())
                if now != key:
                    key, block, held = now, None, []
                if keys[low, 5] == 0:
                    held.append(rows)
                    continue
                if block is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids, v, y = (table.column(n).chunk(0) for n in ("id", "v", "y"))
                    block, held = Block(ids.to_numpy(), _matrix(v), _matrix(y), shell_bound(key[1]), settings), []
                own = rows.column(6).to_numpy()
                ids, scores = block.search(own, _matrix(rows.column(7)), _matrix(rows.column(8)), rows.column(9).to_numpy(), stop)
                q, k = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q, k]), pa.array(scores[q, k])],
                                                 names=["query_id", "vec_id", "score"])

    # A block has at most a few block_rows rows; they come first, and queries follow batch by batch.
    dealt = data.unionByName(asked).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "asks")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for each query among all rows of ``vectors``."""
    rows = taking_part(vectors, id_col, vector_col)
    stop = quantile(settings.sure, settings.projected)
    cells = _cells(rows, settings)
    # Vectors of shells or lengths outside the sample have one cell.
    groups = _placed(rows, cells, settings)
    placed = cut(groups)
    for r in placed.select("dims", "shell").distinct().collect():
        cells.setdefault((r["dims"], r["shell"]), Cells(np.zeros((1, settings.projected)), 1))
    asked = taking_part(queries, id_col, vector_col).dropDuplicates(["id"])
    start = asked.withColumn("floor", F.lit(float("-inf")))
    found = cut(_searched(placed, _visits(start, cells, settings, stop, True), settings, stop))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = (found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == settings.top)
              .select(F.col("query_id").alias("id"), F.col("score").alias("floor")))
    second = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = _searched(placed, _visits(second, cells, settings, stop, False), settings, stop)
    return (found.unionByName(more).withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= settings.top).select("query_id", "rank", "vec_id", "score"))
