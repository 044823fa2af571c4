"""Phrase collocations by best-first branch and bound: prefixes with the best bounds grow first.

Cutting a phrase after its first word gives a score of at most 1000 * n / f(first
word), as f(phrase) <= f(rest). So the count of a first word bounds all phrases
that grow from it, and rare words, which have the highest bounds, are expanded
first. A round expands a batch of first words per language, counts the phrases
below them, settles which survive, and asks for the counts of ends that start
with words not yet expanded. A language is settled when the bound of its next
word is below the score of its last wanted survivor; equal bounds are expanded,
so ties are complete. Each round takes about twice the occurrences of the one
before.

Before that, two passes over the texts shrink what is counted. The first counts
words exactly and pairs of words by hash. The second keeps only runs of words of
which every pair is frequent by that count (which is never too small): all
frequent phrases, their parts and the phrases that could drop them lie inside
such runs. Equal runs are one row with a count, and long ones are cut into
overlapping pieces that own their starts. What decides whether a word is expanded,
a pair is frequent or an end is wanted is a bitmap of fixed size: it lets some
through that needn't be, and exact counts come after it. The more distinct frequent
pairs a corpus has per bit, the more is let through; results don't change.

A phrase is dropped if a longer candidate around it has the same count, that is
if every occurrence has the same word before it or the same word after it.

Defined results: null texts count as empty, null languages as ``und``; identifiers
and other columns don't matter; repeated rows count as often as they occur; an empty
table gives no rows. Counts up to 10^17 words are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.rows import input_partitions, slices, small_batches
from fleetpulse.plans.shared import cut

BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(r"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
BREAK = re.compile(r"[.,;:!?\n-\r]")
NOTHING = ""  # before the first and after the last word of a run


@dataclass(frozen=True)
class Settings:
    least: int = 100
    longest: int = 5
    top: int = 2_000
    slice_chars: int = 4 << 20
    pair_bits: int = 25  # bits of a bitmap, as a power of two
    word_bits: int = 22
    run_starts: int = 256
    first_share: int = 8  # the first round expands words with about this part of all occurrences


# ---- texts to words

def _chunks(text: str, most: int) -> Iterator[str]:
    """A long text in parts that end where a piece ends."""
    start = 0
    while len(text) - start > most:
        found = BREAK.search(text, start + most)
        if not found:
            break
        yield text[start:found.end()]
        start = found.end()
    yield text[start:]


def _coded(text: str) -> tuple[list[str], np.ndarray]:
    """Distinct words and breaks, and the text as their numbers; breaks have the first numbers."""
    codes = {b: i for i, b in enumerate(BREAKS)}
    tokens = TOKEN.findall(text.encode().lower().decode())
    places = np.fromiter((codes.setdefault(t, len(codes)) for t in tokens), np.int64, len(tokens))
    return list(codes), places


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for language and word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words in order."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _parts(batch: pa.RecordBatch, settings: Settings) -> Iterator[tuple[str, str]]:
    """(language, joined texts), about ``slice_chars`` at a time; a break lies between texts."""
    langs = batch.column(0).to_pylist()
    for lang in sorted(set(langs)):
        own = batch.column(1).filter(pa.array([x == lang for x in langs]))
        step = max(1, len(own) * settings.slice_chars // max(1, own.nbytes))
        for low in range(0, len(own), step):
            texts = [c for t in own.slice(low, step).to_pylist() for c in _chunks(t, settings.slice_chars)]
            for start, end in slices(texts, settings.slice_chars):
                yield lang, "\n".join(texts[start:end])


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).alias("text")).filter(F.length("text") > 0)


# ---- first pass: words, and pairs by hash

def first_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """Three kinds of rows: (lang, word, hash, n) of a word, (null, null, hash, n) of a pair, (lang, null, null, n) of all words.

    Words and pairs below ``least`` are left out.
    """
    names = ["lang", "word", "hash", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _parts(batch, settings):
                words, at = _coded(text)
                solid = at >= len(BREAKS)
                if not solid.any():
                    continue
                hashes, counts = _hashes(lang, words), np.bincount(at, minlength=len(words))
                there = np.flatnonzero(counts[len(BREAKS):]) + len(BREAKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(there) + 1)), pa.array([words[i] for i in there] + [None], pa.string()),
                     pa.array([*hashes[there].view(np.int64).tolist(), None], pa.int64()),
                     pa.array([*counts[there].tolist(), int(solid.sum())], pa.int64())], names=names)
                joined = solid[:-1] & solid[1:]
                pairs, n = np.unique(_pairs(hashes[at[:-1][joined]], hashes[at[1:][joined]]), return_counts=True)
                none = pa.nulls(len(pairs), pa.string())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(pairs.view(np.int64)), pa.array(n)], names=names)

    rows = texts.mapInArrow(run, "lang string, word string, hash long, n long")
    whole = F.col("lang").isNotNull() & F.col("word").isNull()
    return rows.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")).filter((F.col("n") >= settings.least) | whole)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the column ``hash``, by its lowest bits: 2^bits / 64 words at most reach the driver."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    found = (hashes.groupBy(F.shiftright(place, 6).alias("at"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")))
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    table = found.toArrow()
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _in(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << bits) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


# ---- second pass: runs

def runs(texts: DataFrame, pairs: np.ndarray, settings: Settings) -> DataFrame:
    """(lang, words, lead, own, n): runs of frequent pairs. Phrases start at the ``own`` words after the first ``lead``."""
    names = ["lang", "words", "lead", "own", "n"]
    ahead = settings.longest  # the last start's phrases and the word after them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _parts(batch, settings):
                words, at = _coded(text)
                hashes, solid = _hashes(lang, words), at >= len(BREAKS)
                joined = np.flatnonzero(solid[:-1] & solid[1:])
                alive = np.zeros(len(at) + 1, bool)
                alive[joined] = _in(pairs, settings.pair_bits, _pairs(hashes[at[joined]], hashes[at[joined + 1]]))
                edges = np.flatnonzero(np.diff(alive.astype(np.int8), prepend=0))
                counts: dict[tuple, int] = {}
                for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):  # starts of pairs
                    run_words = at[start:end + 1].tolist()
                    for low in range(0, end - start, settings.run_starts):
                        own, lead = min(settings.run_starts, end - start - low), int(low > 0)
                        key = (tuple(run_words[low - lead:low + own + ahead]), lead, own)
                        counts[key] = counts.get(key, 0) + 1
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array([" ".join([words[i] for i in k[0]]) for k in keys], pa.string()),
                     pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()),
                     pa.array(list(counts.values()), pa.int64())], names=names)

    found = texts.mapInArrow(run, "lang string, words string, lead long, own long, n long")
    return found.groupBy("lang", "words", "lead", "own").agg(F.sum("n").alias("n"))


# ---- growth

COUNTED = "lang string, phrase string, size long, a long, before_lo string, before_hi string, after_lo string, after_hi string"


def grown(rows: DataFrame, starts: np.ndarray, settings: Settings, wanted: np.ndarray | None = None) -> DataFrame:
    """Counts of the phrases in runs whose first word is in ``starts`` (and which are in ``wanted``, if given).

    Returns (lang, phrase, size, a, and the smallest and largest word before and after it) with a >= least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            step = max(1, batch.num_rows * settings.slice_chars // max(1, batch.nbytes))
            for lang in sorted(set(langs)):
                own = batch.filter(pa.array([x == lang for x in langs]))
                for low in range(0, own.num_rows, step):
                    yield from _phrases(lang, own.slice(low, step), starts, settings, wanted)

    counted = rows.select("lang", "words", "lead", "own", "n").mapInArrow(run, COUNTED)
    return counted.groupBy("lang", "phrase", "size").agg(
        F.sum("a").alias("a"), *[f(c).alias(c) for c, f in (("before_lo", F.min), ("before_hi", F.max),
                                                            ("after_lo", F.min), ("after_hi", F.max))]
    ).filter(F.col("a") >= settings.least)


def _phrases(lang: str, part: pa.RecordBatch, starts: np.ndarray, settings: Settings,
             wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    split = [t.split(" ") for t in part.column(1).to_pylist()]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    # Words in order, so that numbers compare as words do; number 0 stands for no word, at both ends of a row.
    words = [NOTHING, *sorted({w for row in split for w in row})]
    number = {w: i for i, w in enumerate(words)}
    at = np.fromiter((number[w] for row in split for w in (NOTHING, *row, NOTHING)), np.int64, int(sizes.sum()) + 2 * len(split))
    first = np.cumsum(sizes + 2) - (sizes + 2) + 1  # of each row's first word
    hits = _in(starts, settings.word_bits, _hashes(lang, words))
    lead, own, n = (part.column(i).to_numpy() for i in (2, 3, 4))
    row = np.repeat(np.arange(len(split)), own)
    place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first + lead, own)
    chosen = hits[at[place]]
    place, row = place[chosen], row[chosen]
    end = (first + sizes)[row]  # where the row's closing number stands
    prefix = at[place]
    for size in range(2, settings.longest + 1):
        inside = place + size <= end
        place, row, end, prefix = place[inside], row[inside], end[inside], prefix[inside]
        if not len(place):
            return
        # A phrase grows by one word: the number of its prefix and the next word name it.
        _, kept, prefix = np.unique(prefix * len(words) + at[place + size - 1], return_index=True, return_inverse=True)
        phrases = [" ".join([words[i] for i in at[p:p + size].tolist()]) for p in place[kept].tolist()]
        shown = (_in(wanted, settings.pair_bits, _hashes(lang, phrases)) if wanted is not None
                 else np.ones(len(phrases), bool))
        order = np.argsort(prefix, kind="stable")
        bounds = np.flatnonzero(np.diff(prefix[order], prepend=-1))
        before, after = at[place - 1][order], at[place + size][order]
        columns = [np.add.reduceat(n[row][order], bounds)[shown]]
        ends = [f.reduceat(x, bounds)[shown].tolist() for x in (before, after) for f in (np.minimum, np.maximum)]
        named = [p for p, s in zip(phrases, shown.tolist()) if s]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(named), pa.string()), pa.array(named, pa.string()), pa.array(np.full(len(named), size)),
             pa.array(columns[0]), *[pa.array([words[i] for i in e], pa.string()) for e in ends]],
            names=["lang", "phrase", "size", "a", "before_lo", "before_hi", "after_lo", "after_hi"])


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(17,0)")


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)), in decimals."""
    above = (F.lit(1000).cast("decimal(4,0)") * (_exact(a) * _exact(n)).cast("decimal(34,0)")).cast("decimal(38,0)")
    below = (_exact(left) * _exact(right)).cast("decimal(34,0)")
    return F.call_function("div", above, below).cast("long")


def _cuts(rows: DataFrame) -> DataFrame:
    """Each candidate once per place to cut: (lang, phrase, size, a, k, head, tail)."""
    words = F.split("phrase", " ")
    return (rows.select("lang", "phrase", "size", "a", words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"))
            .select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("head"),
                    F.array_join(F.slice("_w", F.col("k") + 1, F.col("size").cast("int") - F.col("k")), " ").alias("tail")))


def _leading(rows: DataFrame, top: int, parts: int) -> DataFrame:
    """The first ``top`` of each language with their rank, by parts first so that no task ranks a whole language."""
    def first(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return df.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)

    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    return first(first(dealt, "lang", "_part").drop("_part", "rank"), "lang")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` surviving phrases of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, lang_col, text_col)
    counts = cut(first_counts(texts, settings))
    totals = counts.filter(F.col("lang").isNotNull() & F.col("word").isNull()).select("lang", F.col("n").alias("n"))
    pairs = bitmap(counts.filter(F.col("lang").isNull()).select("hash"), settings.pair_bits)
    rows = cut(runs(texts, pairs, settings))
    singles = counts.filter(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), "hash", F.col("n").alias("a"))
    # Words of one count have one bound, so batches are sets of counts: a table of counts, not of words.
    levels = singles.groupBy("lang", F.col("a").alias("f")).agg(F.sum("a").alias("uses"))
    upto = Window.partitionBy("lang").orderBy("f")
    share = F.log2(F.col("n") / F.col("uses_upto") / F.lit(float(settings.first_share)))
    levels = cut(levels.join(totals, "lang").withColumn("uses_upto", F.sum("uses").over(upto))
                 .withColumn("turn", F.greatest(F.lit(0), F.ceil(-share)).cast("int")).select("lang", "f", "turn", "n"))
    last = levels.agg(F.max("turn")).first()[0]
    known, scored, turn = None, None, 0
    while last is not None and turn <= last:
        open_levels = levels.filter(F.col("turn") == turn)
        if scored is not None:  # languages whose next bound is below their last wanted score are settled
            least = _leading(scored, settings.top, input_partitions(spark)).filter(F.col("rank") == settings.top)
            due = _unsettled(levels.filter(F.col("turn") >= turn), least)
            open_levels = open_levels.join(due, "lang", "left_semi")
            if due.isEmpty():
                break
        batch = singles.join(open_levels.select("lang", F.col("f").alias("a")), ["lang", "a"], "left_semi")
        found = grown(rows, bitmap(batch.select("hash"), settings.word_bits), settings)
        first_word = F.substring_index("phrase", " ", 1)
        exact = batch.select("lang", F.col("phrase").alias("_first"))
        found = cut(found.withColumn("_first", first_word).join(exact, ["lang", "_first"], "left_semi").drop("_first"))
        known = found if known is None else known.unionByName(found)
        new = _scores(found, known, singles, totals, rows, settings)
        scored = cut(new) if scored is None else cut(scored.unionByName(new))
        turn += 1
    if scored is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return _leading(scored, settings.top, input_partitions(spark)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _unsettled(levels: DataFrame, least: DataFrame) -> DataFrame:
    """Languages with a first word left whose bound reaches the last wanted score, or with too few survivors."""
    ahead = levels.groupBy("lang").agg(F.min("f").alias("f"), F.max("n").alias("n"), F.lit(1).alias("one"))
    bound = cut_score("one", "n", "f", "one")
    return (ahead.join(least.select("lang", "score"), "lang", "left")
            .filter(F.col("score").isNull() | (bound >= F.col("score"))).select("lang"))


def _scores(found: DataFrame, known: DataFrame, singles: DataFrame, totals: DataFrame, rows: DataFrame,
            settings: Settings) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the survivors in ``found``. Heads are in ``known``; missing ends are counted."""
    same_before = (F.col("before_lo") == F.col("before_hi")) & (F.col("before_lo") != NOTHING)
    same_after = (F.col("after_lo") == F.col("after_hi")) & (F.col("after_lo") != NOTHING)
    survivors = found.filter((F.col("size") == settings.longest) | ~(same_before | same_after))
    pieces = cut(_cuts(survivors))
    tails = pieces.filter(F.instr("tail", " ") > 0).select("lang", F.col("tail").alias("phrase")).distinct()
    missing = cut(tails.join(known, ["lang", "phrase"], "left_anti"))
    counts = singles.select("lang", "phrase", "a").unionByName(known.select("lang", "phrase", "a"))
    if not missing.isEmpty():
        hashed = missing.withColumn("hash", F.xxhash64("lang", "phrase"))
        starts = missing.select(F.xxhash64("lang", F.substring_index("phrase", " ", 1)).alias("hash"))
        ends = grown(rows, bitmap(starts, settings.word_bits), settings, bitmap(hashed.select("hash"), settings.pair_bits))
        counts = counts.unionByName(ends.join(missing, ["lang", "phrase"], "left_semi").select("lang", "phrase", "a"))
    heads, ends = (counts.select("lang", F.col("phrase").alias(c), F.col("a").alias(v)) for c, v in (("head", "l"), ("tail", "r")))
    cuts = pieces.join(heads, ["lang", "head"]).join(ends, ["lang", "tail"]).join(totals, "lang")
    cuts = cuts.withColumn("score", cut_score("a", "n", "l", "r"))
    return (cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))
            .select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score"))
