"""Passages that repeat across documents, with a sparse suffix array.

Suffixes are retained only where their first ``PREFIX`` words are the minimiser
of some window of ``LEAST`` words, about one word in sixteen. Any passage of
``LEAST`` words picks its suffix by its own content, so equal passages retain
suffixes at the same place. The order of the array matters only for bringing
equal beginnings together, so suffixes are sorted by the hash of their prefix.

1. Neighbours with equal prefixes in more than one document are matches; all
   other suffixes are dropped.
2. Matches are extended: a retained suffix stands for the windows that it is
   the minimiser of, and its surroundings are all their words, to the left and
   to the right. Suffixes with equal surroundings match over all their windows
   and are one row with their first occurrence from here on. Where one prefix
   has different surroundings (the ends of a passage, an edit), each of their
   windows is compared.
3. A window that occurs in two documents is a repeat; its first occurrence, by
   identifier and place, is kept, all others may be cut. A document's repeated
   windows are united to spans of words.

Words are those of the near-duplicates (ASCII case doesn't matter). Word and
window comparisons go by 64-bit hashes. Defined results: null or empty texts
and texts of fewer than ``LEAST`` words have no spans; rows with the same
identifier are one document, and so are rows without; a passage that repeats
within one document only is no repeat; an empty table gives no rows. Only
identifier and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.near import mixed, word_hashes
from fleetpulse.llm.rows import free_name, slices, words_of
from fleetpulse.plans.shared import cut

LEAST = 50  # words of a passage
PREFIX = 20  # words of a suffix that are compared first
SPREAD = LEAST - PREFIX + 1  # places among which a window picks its suffix
MOST = 1 << 20  # characters handled at a time
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Hashes:
    """Hashes of any run of words of some texts, from running sums."""

    def __init__(self, texts: list[str]):
        words, self.counts = word_hashes([words_of(t) for t in texts])
        self.first = np.cumsum(self.counts) - self.counts
        n = len(words)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:n], dtype=np.uint64)])
        self.n = n

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of ``size`` words from each start."""
        return mixed((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size).astype(np.uint64))

    def suffixes(self) -> tuple[np.ndarray, ...]:
        """Retained suffixes: text, prefix hash, hash of the surroundings, first window and number of windows."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if self.n < LEAST:
            return none
        prefix = self.of(np.arange(self.n - PREFIX + 1), PREFIX)
        windows = np.lib.stride_tricks.sliding_window_view(prefix, SPREAD)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        start = np.arange(self.n - LEAST + 1)
        start = start[start + LEAST <= (self.first + self.counts)[text[start]]]
        if not len(start):
            return none
        place = start + windows[start].argmin(axis=1)
        head = np.ones(len(start), bool)
        head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(head)
        low, size = start[heads], np.diff(np.append(heads, len(start)))
        owner = text[low]
        return owner, prefix[place[heads]].view(np.int64), self.around(low, size), low - self.first[owner], size

    def around(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of all words of ``size`` windows from ``low`` on."""
        return mixed(self.of(low, size + LEAST - 1) + size.astype(np.uint64)).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with the texts of their last column."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        for low, high in slices(texts, MOST):
            yield batch.slice(low, high - low), texts[low:high]


def _document(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")


def suffixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, prefix, around, low, size) of every retained suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            owner, prefix, around, low, size = Hashes(texts).suffixes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(prefix), pa.array(around),
                 pa.array(low.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["doc", "prefix", "around", "low", "size"])

    return docs.select(_document(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, "doc long, prefix long, around long, low int, size int")


def _windows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(prefix, around, k, window): hash of the k-th window of the first occurrence of each wanted suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            hashes = Hashes(texts)
            listed = part.column(0)
            owner = np.repeat(np.arange(len(texts)), pc.list_value_length(listed).to_numpy())
            fields = {f: listed.flatten().field(f).to_numpy() for f in ("prefix", "around", "low", "size")}
            low, size = fields["low"].astype(np.int64), fields["size"].astype(np.int64)
            # Another text with this identifier may be too short or hold other words there.
            fits = low + size + LEAST - 1 <= hashes.counts[owner]
            low = np.where(fits, low + hashes.first[owner], 0)
            fits[fits] = hashes.around(low[fits], size[fits]) == fields["around"][fits]
            low, size = low[fits], size[fits]
            at = np.repeat(np.arange(len(low)), size)
            k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields["prefix"][fits][at]), pa.array(fields["around"][fits][at]), pa.array(k.astype(np.int32)),
                 pa.array(hashes.of(low[at] + k, LEAST).view(np.int64))], names=["prefix", "around", "k", "window"])

    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("prefix", "around", "low", "size")).alias("wanted"))
    texts = docs.select(_document(id_col), F.col(text_col).alias("text"))
    return (texts.join(by_doc, "doc").select("wanted", "text")
            .mapInArrow(run, "prefix long, around long, k int, window long"))


def _bits(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, low, repeats, cuts): bit k of the masks speaks of the window from word ``low + k``."""
    found = suffixes(docs, id_col, text_col)
    # Equal neighbours in more than one document; summed up before the shuffle. Written, so that the join with
    # them has a shuffle on either side and adaptive execution may split a prefix that very many texts share.
    matched = cut(found.groupBy("prefix").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high"))
                  .filter(F.col("_low") < F.col("_high")).select("prefix"))
    shared = cut(found.join(matched, "prefix", "left_semi"))
    classes = cut(shared.groupBy("prefix", "around").agg(
        F.min(F.struct("doc", "low", "size")).alias("first"), F.max("doc").alias("last")))
    several = cut(classes.groupBy("prefix").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("prefix"))
    compared = cut(classes.join(several, "prefix", "left_semi")
                   .select("prefix", "around", "first.doc", "first.low", "first.size", "last"))
    windows = cut(_windows(docs, compared, id_col, text_col).distinct()
                  .join(compared, ["prefix", "around"])
                  .select("prefix", "around", "k", "window", F.struct("doc", (F.col("low") + F.col("k")).alias("at")).alias("own"),
                          "last"))
    by_window = cut(windows.groupBy("window").agg(F.min("own").alias("_first"), F.max("last").alias("_last")))
    judged = (windows.join(by_window, "window").groupBy("prefix", "around").agg(
        F.bit_or(F.when(F.col("_first.doc") < F.col("_last"), _bits(F.col("k"))).otherwise(F.lit(0).cast("long"))).alias("_repeats"),
        F.bit_or(F.when(F.col("_first") == F.col("own"), _bits(F.col("k"))).otherwise(F.lit(0).cast("long"))).alias("_kept")))
    whole = _bits(F.col("first.size")) - 1
    alone = F.when(F.col("first.doc") < F.col("last"), whole).otherwise(F.lit(0).cast("long"))
    masks = (classes.join(judged, ["prefix", "around"], "left")
             .select("prefix", "around", "first", F.coalesce("_repeats", alone).alias("repeats"),
                     F.coalesce("_kept", whole).alias("_kept"))
             .filter(F.col("repeats") != 0))
    is_first = (F.col("doc") == F.col("first.doc")) & (F.col("low") == F.col("first.low"))
    return shared.join(masks, ["prefix", "around"]).select(
        "doc", "low", "repeats",
        F.when(is_first, F.col("repeats").bitwiseAND(F.bitwise_not("_kept"))).otherwise(F.col("repeats")).alias("cuts"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a repeat: ``repeats`` and ``cuts``, spans (start, end) in words.

    ``cuts`` are the repeats less the first occurrence of everything; cutting
    them from all documents leaves one occurrence of each passage.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            columns = [[_merged(rows, f) for rows in batch.column(1).to_pylist()] for f in ("repeats", "cuts")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, span) for c in columns)],
                                             names=["doc", "repeats", "cuts"])

    kind = "array<struct<start:int,end:int>>"
    by_doc = (repeated_windows(docs, id_col, text_col).groupBy("doc")
              .agg(F.collect_set(F.struct("low", "repeats", "cuts")).alias("rows")))
    spans = by_doc.mapInArrow(run, f"doc long, repeats {kind}, cuts {kind}")
    own = F.when(F.col("doc") != NO_ID, F.col("doc")).cast(docs.schema[id_col].dataType)
    return spans.select(own.alias(id_col), "repeats", "cuts")


def _merged(rows: list[dict], field: str) -> list[dict]:
    """Windows whose bits are set, united."""
    starts = sorted({r["low"] + k for r in rows for k in range(SPREAD) if r[field] >> k & 1})
    out: list[dict] = []
    for at in starts:
        if out and at <= out[-1]["end"]:
            out[-1]["end"] = at + LEAST
        else:
            out.append({"start": at, "end": at + LEAST})
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, with the ``cuts`` of :func:`repeated_spans` taken out of the texts.

    Space between the words that stay is kept as it is. Documents of which no
    word stays are left out; documents without cuts are returned unchanged.
    """
    own_id, own_cuts = free_name("_cut_id", docs.columns), free_name("_cuts", docs.columns)
    cuts = (repeated_spans(docs, id_col, text_col).filter(F.size("cuts") > 0)
            .select(F.col(id_col).alias(own_id), F.col("cuts").alias(own_cuts)))
    others = [c for c in docs.columns if c != text_col]
    names = [*others, text_col]
    joined = (docs.join(cuts, docs[id_col].eqNullSafe(cuts[own_id]), "left")
              .select(*[docs[c] for c in others], cuts[own_cuts], docs[text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            spans = batch.column(n - 2).to_pylist()
            texts = [t if s is None else _cut(t or "", s) for t, s in zip(batch.column(n - 1).to_pylist(), spans)]
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n - 2)), pa.array(texts, pa.string())], names=names)
            yield out.filter(pa.array([s is None or WORD.search(t) is not None for t, s in zip(texts, spans)], pa.bool_()))

    return joined.mapInArrow(run, docs.select(*names).schema).select(*docs.columns)


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the words of some spans; another text of this identifier may be shorter than they say."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for span in spans:
        start, end = (min(span[f], len(starts) - 1) for f in ("start", "end"))
        out.append(text[done:starts[start]])
        done = starts[end]
    return "".join(out) + text[done:]
