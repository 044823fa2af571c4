"""Packing documents into sequences: reduction by dominance, then best fit for what is left.

Only lengths decide a packing, and there are at most ``capacity`` of them. Spark
tokenizes, cuts and counts lengths; the counts (a table of bounded size) are
solved as a bin-packing instance with multiplicities; Spark then gives every
piece a rank among those of its length and looks up that rank's place.

Reduction (Martello and Toth): for a longest item, a set of one, two or three
items is fixed for good if it provably dominates every other way to fill that
bin. Every fixed set shrinks the instance; passes repeat until none is found.
The remaining items go, longest first, to the fullest bin with room.

Defined results: a null or empty text is one piece, the end token; null and
repeated identifiers are packed row by row; an empty table gives no rows. Only
the identifier and the text are read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetpulse.llm.bpe import HIGH, WHITE_SPACE, byte_symbols, unicode_class
from fleetpulse.llm.rows import with_results
from fleetpulse.plans.shared import cut

CAPACITY = 1024
END_ID = 2
ROWS_PER_BLOCK = 10_000
KNOWN_WORDS = 300_000  # kept per worker


class ByteBpe:
    """Token ids of a byte-level ``tokenizers`` file; ids of known words are kept, in a table of bounded size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        raw = byte_symbols()
        names = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(raw[c] for c in name): i for name, i in spec["model"]["vocab"].items() if name not in names}
        # Ids run in the order of merges here, so they serve as ranks.
        self.words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        per_text = [None if self.special.search(t) else _find(t) for t in texts]
        distinct = set().union(*[w for w in per_text if w])
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = distinct
        one = self.words.encode_ordinary
        self.known.update((w, np.array(one(w), np.uint32).tobytes()) for w in new)
        known = self.known
        return [b"".join([known[w] for w in words]) if words is not None else np.array(
            self.library.encode(t, add_special_tokens=False).ids, np.uint32).tobytes()
            for t, words in zip(texts, per_text)]


@lru_cache(None)
def _pattern(top: int) -> re.Pattern:
    """The byte-level splitting rule, right for texts without characters above ``top``."""
    letters, numbers, space = unicode_class("L", top), unicode_class("N", top), WHITE_SPACE
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+")


def _find(text: str) -> list[str]:
    return _pattern(sys.maxunicode if HIGH.search(text) else 0xFFFF).findall(text)


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut_points(n: int, capacity: int) -> list[int]:
    """Bounds of a document's pieces: all full but the first, which holds the rest."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its tokens as little-endian unsigned 32-bit integers' CRC-32."""
    tail = np.array([end_id], np.uint32).tobytes()

    def make():
        bpe = load(path)

        def apply(texts: list[str]) -> list:
            out = []
            for ids in bpe.encode(texts):
                ids += tail
                bounds = cut_points(len(ids) // 4, capacity)
                out.append([{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a:4 * b])}
                            for k, (a, b) in enumerate(zip(bounds, bounds[1:]))])
            return [out]
        return apply

    rows = with_results(docs, [id_col], text_col,
                        "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>", make, most=2 << 20)
    return rows.select(id_col, F.inline("pieces"))


class Instance:
    """Item lengths with their counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.counts)

    def take(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            self.counts[x] -= times
        for x in set(items):
            if not self.counts[x]:
                del self.counts[x]
                self.lengths.remove(x)

    def most_times(self, items: tuple[int, ...]) -> int:
        return min(self.counts[x] // items.count(x) for x in items)

    def left(self, x: int, used: tuple[int, ...]) -> int:
        return self.counts.get(x, 0) - used.count(x)

    def smallest(self, k: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The k smallest items longer than ``above`` that ``used`` doesn't hold."""
        out: list[int] = []
        for x in self.lengths[bisect_right(self.lengths, above):]:
            out += [x] * min(self.left(x, used), k - len(out))
            if len(out) == k:
                break
        return out

    def largest(self, room: int, used: tuple[int, ...]) -> int:
        """The longest item of at most ``room`` that ``used`` doesn't hold; 0 if there is none."""
        for x in reversed(self.lengths[:bisect_right(self.lengths, room)]):
            if self.left(x, used) > 0:
                return x
        return 0

    def best_pair(self, room: int, used: tuple[int, ...]) -> tuple[int, int]:
        """The fullest pair of at most ``room``, the one with the longest item among equals; (0, 0) if none."""
        best = (0, 0)
        for p in reversed(self.lengths[:bisect_right(self.lengths, room)]):
            if self.left(p, used) <= 0:
                continue
            if 2 * p < sum(best):
                break
            q = self.largest(min(p, room - p), (*used, p))
            if q and p + q > sum(best):
                best = (p, q)
        return best

    def dominant(self, j: int) -> tuple[int, ...] | None:
        """Items that provably may share a bin with the item j; None if no small set dominates."""
        room, used = self.capacity - j, (j,)
        small = self.smallest(3, used)
        if not small or small[0] > room:
            return (j,)
        one = self.largest(room, used)
        if one == room or len(small) == 1 or small[0] + small[1] > room:
            return (j, one)
        if len(small) == 3 and sum(small) <= room:
            return None  # three and more may fit
        p, q = self.best_pair(room, used)
        if one >= p + q:
            return (j, one)
        if p == one:
            # Any other pair has an item of at most q, as no two longer ones fit together.
            longer = self.smallest(2, used, above=q)
            if len(longer) < 2 or sum(longer) > room:
                return (j, p, q)
        return None


Bins = list[tuple[tuple[int, ...], int]]


def reduce(instance: Instance) -> Bins:
    """Fixes dominating sets, longest item first, until a pass finds none; the instance keeps the rest."""
    fixed: Bins = []
    changed = True
    while changed:
        changed = False
        for j in reversed(list(instance.lengths)):
            while instance.counts.get(j) and (items := instance.dominant(j)):
                times = instance.most_times(items)
                instance.take(items, times)
                fixed.append((items, times))
                changed = True
    return fixed


def best_fit(instance: Instance) -> Bins:
    """Longest first into the fullest bin with room; bins with equal contents are held together with their number."""
    open_bins: dict[int, list[list]] = {}  # by room left: [items, number]
    for x in reversed(instance.lengths):
        n = instance.counts[x]
        while n:
            room = min((r for r in open_bins if r >= x), default=None)
            if room is None:
                items, number = (), -(-n // (instance.capacity // x))
                room = instance.capacity
            else:
                items, number = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            fits = room // x
            full = min(number, n // fits)
            parts = [(full, fits)]
            n -= full * fits
            if n and full < number:
                parts.append((1, n))
                full, n = full + 1, 0
            parts.append((number - full, 0))
            for bins, k in parts:
                if bins:
                    open_bins.setdefault(room - k * x, []).append([(*items, *[x] * k), bins])
    return [(items, number) for bins in open_bins.values() for items, number in bins if items]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Bins as (item lengths, number of such bins) that hold all items."""
    instance = Instance(counts, capacity)
    return [*reduce(instance), *best_fit(instance)]


def slots(bins: Bins) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go, by rank: (length, first rank, after, first sequence, per sequence, offset)."""
    out, ranks, sequence = [], {}, 0
    for items, number in bins:
        offset, k = 0, 0
        items = sorted(items, reverse=True)
        while k < len(items):
            x, each = items[k], items.count(items[k])
            first = ranks.get(x, 0)
            ranks[x] = first + number * each
            out.append((x, first, ranks[x], sequence, each, offset))
            offset, k = offset + x * each, k + each
        sequence += number
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, path, capacity, end_id, id_col, text_col))
    blocks = 1 + cut_pieces.count() // ROWS_PER_BLOCK
    # Lengths that many pieces share are ranked block by block.
    keyed = cut_pieces.withColumn("_block", F.pmod(
        F.xxhash64(id_col, "start", "length", "ids_crc32"), F.lit(blocks)).cast("int"))
    counts = keyed.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_block").orderBy(id_col, "piece", "ids_crc32")
    ranked = (keyed.withColumn("_own", F.row_number().over(own) - 1)
              .join(before, ["length", "_block"]).withColumn("_rank", F.col("_own") + F.col("_before")))
    # At most capacity lengths, and few slots for each: the table doesn't grow with the number of documents.
    table = spark.createDataFrame(
        slots(solve(by_length, capacity)),
        "length long, _from long, _to long, _sequence long, _each long, _offset long")
    step = F.col("_rank") - F.col("_from")
    return (ranked.join(F.broadcast(table), "length")
            .filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
            .select(id_col, "piece", "start", "length", "ids_crc32",
                    (F.col("_sequence") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
                    (F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length")).cast("long").alias("offset")))
