"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's point counts its letters (code points modulo ``LETTERS``). One inserted
letter raises one count by one, a deleted one lowers one, a replaced one does
both, so the L1 distance of near words is at most two. Words of each length have
a k-d tree of their own; a word asks the trees of its length, of one letter less
and of one more, with as many raised and lowered counts as that edit allows, and
skips every subtree whose box of counts lies further away. What is left is
verified letter by letter.

The first levels of a length's tree are fitted on a bounded sample of its words
(``Settings.sample_words`` in all) and deal every word out to cells; each cell
builds the rest of the tree over all of its words. Cells with many words are
split, and cells with many questions are asked in several tasks. A cell answers
with a count and the best word, never with pairs.

Defined results: null texts count as empty; a null identifier counts as an empty
string in the checksum that picks the letters to delete; repeated rows count as
often as they occur; an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.plans.shared import cut

LETTERS = 64
EDITS = ((0, 1, 1), (1, 1, 0), (-1, 0, 1))  # by length: counts that may be higher and lower in the near word
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    least_letters: int = 6
    least_count: int = 5
    ratio: int = 5  # a form occurs at least so many times as often
    typo_every: int = 199
    sample_words: int = 20_000
    cell_words: int = 2_048
    cell_questions: int = 100_000  # of one task
    leaf_words: int = 32


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(word, n): words that are long and frequent enough, after some letters were deleted."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(RUN), 0)).alias("_run"))
    runs = (runs.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
            .withColumn("_size", F.char_length("_run")).filter(F.col("_size") >= settings.least_letters)
            .withColumn("_sum", F.crc32(F.concat_ws(":", "_id", "_run"))))
    place = F.pmod("_sum", "_size").cast("int")
    shorter = F.concat(F.substr("_run", F.lit(1), place), F.substr("_run", place + 2))
    word = F.when(F.col("_sum") % settings.typo_every == 0, shorter).otherwise(F.col("_run"))
    return (runs.select(word.alias("word")).filter(F.char_length("word") >= settings.least_letters)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= settings.least_count))


def points(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length, given as a matrix of code points."""
    out = np.zeros((len(codes), LETTERS), np.int16)
    rows = np.arange(len(codes))
    for column in codes.T:
        letter = column % LETTERS
        out[rows, letter] = np.minimum(out[rows, letter] + 1, 30_000)
    return out


def matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    text = "".join(words).encode("utf-32-le")
    return np.frombuffer(text, np.uint32).reshape(len(words), -1) if words else np.zeros((0, 0), np.uint32)


class Tree:
    """A k-d tree over letter counts. Each node has a box; a leaf has a number and the places of its points."""

    def __init__(self, counts: np.ndarray, leaf: int, open_box: bool):
        """With ``open_box``, boxes only say what the cuts say, so they also hold for points not seen here."""
        self.leaves: list[np.ndarray] = []
        low, high = np.zeros(LETTERS, np.int16), np.full(LETTERS, 30_000, np.int16)
        self.root = self._node(counts, np.arange(len(counts)), leaf, open_box, low, high)

    def _node(self, counts, places, leaf, open_box, low, high):
        own = counts[places]
        if not open_box and len(own):
            low, high = own.min(axis=0), own.max(axis=0)
        letter = int(own.var(axis=0).argmax()) if len(own) else 0
        values = own[:, letter]
        if len(own) <= leaf or values.min() == values.max():
            self.leaves.append(places)
            return low, high, None, len(self.leaves) - 1
        cut_at = min(int(np.median(values)), int(values.max()) - 1)
        left_high, right_low = high.copy(), low.copy()
        left_high[letter], right_low[letter] = cut_at, cut_at + 1
        below = values <= cut_at
        return (low, high, (letter, cut_at),
                (self._node(counts, places[below], leaf, open_box, low, left_high),
                 self._node(counts, places[~below], leaf, open_box, right_low, high)))

    def homes(self, counts: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        out = np.zeros(len(counts), np.int64)

        def down(node, places):
            _, _, split, rest = node
            if split is None:
                out[places] = rest
            else:
                below = counts[places, split[0]] <= split[1]
                down(rest[0], places[below])
                down(rest[1], places[~below])

        down(self.root, np.arange(len(counts)))
        return out

    def search(self, counts: np.ndarray, up: int, down: int, visit: Callable[[int, np.ndarray], None]) -> None:
        """``visit(leaf, places)`` for the points that may have a point of the leaf within reach."""
        def walk(node, places):
            low, high, split, rest = node
            own = counts[places]
            raised = np.maximum(low - own, 0).sum(axis=1)
            lowered = np.maximum(own - high, 0).sum(axis=1)
            places = places[(raised <= up) & (lowered <= down)]
            if not len(places):
                return
            if split is None:
                visit(rest, places)
            else:
                walk(rest[0], places)
                walk(rest[1], places)

        walk(self.root, np.arange(len(counts)))


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one inserted, deleted or replaced one."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(axis=1) == 1
    if left.shape[1] > right.shape[1]:
        left, right = right, left
    size = left.shape[1]
    first = np.argmin(np.column_stack([left == right[:, :size], np.zeros(len(left), bool)]), axis=1)
    # From the first difference on, the longer word must agree one place later.
    after = np.arange(size)[None, :] >= first[:, None]
    return ((left == right[:, 1:]) | ~after).all(axis=1)


def near_within(tree: Tree, counts: np.ndarray, codes: np.ndarray, asked: np.ndarray, asked_codes: np.ndarray,
                up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, word) places of all near pairs, for words of one length and questions of one length."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // max(LETTERS * 32, codes.shape[1] * 32, 1))

    def visit(leaf: int, places: np.ndarray) -> None:
        own = tree.leaves[leaf]
        for low in range(0, len(places), step):
            some = places[low:low + step]
            for first in range(0, len(own), 64):
                members = own[first:first + 64]
                gap = counts[members][None, :, :] - asked[some][:, None, :]
                close = (np.maximum(gap, 0).sum(axis=2) <= up) & (np.maximum(-gap, 0).sum(axis=2) <= down)
                q, m = np.nonzero(close)
                if len(q):
                    q, m = some[q], members[m]
                    right = one_edit(asked_codes[q], codes[m])
                    found.append((q[right], m[right]))

    tree.search(asked, up, down, visit)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def _by_length(strings: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _trees(vocabulary: DataFrame, settings: Settings) -> dict[int, Tree]:
    """The first levels per length, fitted on the words with the smallest hashes."""
    total = vocabulary.count()
    sample = [r["word"] for r in vocabulary.orderBy(F.xxhash64("word"), "word").limit(settings.sample_words)
              .select("word").collect()]
    leaf = max(1, settings.cell_words * len(sample) // max(1, total))
    return {size: Tree(points(matrix([sample[i] for i in places])), leaf, True)
            for size, places in _by_length(sample)}


CELL = ["size", "cell", "part", "chunk"]


def _visits(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(size, cell, asks, word, n): each word in its cell, and at every cell that it asks."""
    whole = Tree(np.zeros((0, LETTERS), np.int16), 1, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(0).to_pylist()
            for size, places in _by_length(strings):
                counts = points(matrix([strings[i] for i in places]))
                rows = [(np.full(len(places), size), trees.get(size, whole).homes(counts), np.zeros(len(places), bool), places)]
                for longer, up, down in EDITS:
                    def visit(leaf: int, some: np.ndarray, other: int = size + longer) -> None:
                        rows.append((np.full(len(some), other), np.full(len(some), leaf), np.ones(len(some), bool), places[some]))
                    trees.get(size + longer, whole).search(counts, up, down, visit)
                sizes, cells, asks, at = (np.concatenate(p) for p in zip(*rows))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes.astype(np.int64)), pa.array(cells.astype(np.int64)), pa.array(asks.astype(np.int64)),
                     batch.column(0).take(at), batch.column(1).take(at)], names=["size", "cell", "asks", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "size long, cell long, asks long, word string, n long")


def _answers(settings: Settings):
    """Over rows ordered by cell, its words first and then the questions: (word, n_near, best_n, best)."""
    edits = {longer: (up, down) for longer, up, down in EDITS}

    def answer(members: list[str], ns: np.ndarray, tree: tuple, asked: list[str]) -> Iterator[pa.RecordBatch]:
        counts, codes, built = tree
        size = codes.shape[1]
        for length, places in _by_length(asked):
            own_codes = matrix([asked[i] for i in places])
            q, m = near_within(built, counts, codes, points(own_codes), own_codes, *edits[size - length])
            if not len(q):
                continue
            order = np.lexsort((m, -ns[m], q))  # members are sorted, so the earlier one wins a tie
            q, m = q[order], m[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            near = np.diff(np.append(first, len(q)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([asked[i] for i in places[q[first]]]), pa.array(near.astype(np.int64)), pa.array(ns[m[first]]),
                 pa.array([members[i] for i in m[first]])], names=["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, ns, tree = None, [], [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(5)])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                now = tuple(keys[low, :4].tolist())
                if now != key:
                    key, members, ns, tree = now, [], [], None
                part = batch.slice(low, high - low)
                if keys[low, 4] == 0:
                    members += part.column(5).to_pylist()
                    ns.append(part.column(6).to_numpy().copy())
                    continue
                if not members:
                    continue
                if tree is None:
                    codes = matrix(members)
                    counts = points(codes)
                    tree, own = (counts, codes, Tree(counts, settings.leaf_words, False)), np.concatenate(ns)
                yield from answer(members, own, tree, part.column(5).to_pylist())

    return run


def near_words(vocabulary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``vocabulary`` (word, n) that has a near word."""
    visits = cut(_visits(vocabulary, _trees(vocabulary, settings)))
    key = ["size", "cell"]

    def pieces(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("long").alias(name))

    members, asked = visits.filter("asks = 0"), visits.filter("asks = 1")
    sizes = cut(pieces(members, 4 * settings.cell_words, "_parts").join(pieces(asked, settings.cell_questions, "_chunks"), key))
    zero, rows = F.lit(0).cast("long"), ["asks", "word", "n"]
    placed = (members.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("word"), F.col("_parts")))
              .withColumn("chunk", F.explode(F.sequence(zero, F.col("_chunks") - 1))).select(*CELL, *rows))
    asking = (asked.join(sizes, key).withColumn("part", F.explode(F.sequence(zero, F.col("_parts") - 1)))
              .withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("_chunks"))).select(*CELL, *rows))
    dealt = placed.unionByName(asking).repartition(*CELL).sortWithinPartitions(*CELL, "asks", "word")
    found = dealt.mapInArrow(_answers(settings), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
            .select("word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.word").alias("best")))


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): where following (word, form) ends. Counts grow ``ratio``-fold a step, so steps are few."""
    steps, top = 0, most
    while top >= ratio:
        steps, top = steps + 1, top // ratio
    jump, reach = forms.select("word", F.col("form").alias("root")), 1
    while reach < steps:
        after = jump.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jump = cut(jump.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        reach *= 2
    return jump


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      settings: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = cut(words(docs, id_col, text_col, settings))
    near = near_words(vocabulary, settings)
    kept = F.col("best_n") >= settings.ratio * F.col("n")
    rows = cut(vocabulary.join(near, "word", "left").select(
        "word", F.when(kept, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(kept, F.col("best_n")).alias("form_n")))
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    ends = roots(rows.filter(F.col("form").isNotNull()), most, settings.ratio)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
