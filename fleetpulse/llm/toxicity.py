"""Toxicity from a learned lexicon whose trie is intersected with Levenshtein automata.

The lexicon (whole words and stems) is learned from labelled rows: terms that
stand in many different places of toxic texts and in hardly any of other texts.
Its trie and the automata of at most one edit are compiled together into one
deterministic table; all words of a slice of texts walk through it in step, so
misspelled terms cost no more than exact ones. Each hit is then read in its
window: a hit between quotation marks or after a word of reporting counts as
quotation, any other as abuse, and logistic regression weighs both.

Learning uses at most ``Settings.sample_rows`` labelled rows, those with the
smallest hashes; scoring covers whole texts of all rows and never leaves their
partition. Defined results: null or empty text scores as a text without hits;
without both labels to learn from every score is 0; null identifiers pass
through and are never learned from; of repeated labels of one identifier the
largest counts; repeated rows give repeated results; an empty table gives no
rows. Other columns don't matter.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.rows import slices, with_results
from fleetpulse.plans.shared import cut

THRESHOLD = 0.3
WORD, STEM, FUZZY = 1, 2, 3
QUOTES = frozenset("\"'`«»‘’“”„‹›")
# Words that report what others said, in the four languages; a fixed list.
REPORTING = frozenset("said says quote quoted wrote called reported sagte sagt schrieb nannte zitat "
                      "dit disait cite appela dijo dice cita escribió llamó".split())


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    candidates: int = 20_000  # terms whose places are compared
    terms: int = 400
    least_places: int = 4  # different places in toxic texts
    least_gain: float = 24.0  # log-likelihood ratio of a term's places; some 100,000 terms are compared
    misspelled: float = 0.5  # weight of a misspelled term against the term itself
    ratio: float = 6.0  # share of places in toxic texts over the share elsewhere
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)  # letters
    least_letters: int = 4
    fuzzy_letters: int = 5  # shorter terms have too many neighbours
    window: int = 4  # words to either side


def learning_row(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2, F.lit(False))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


@lru_cache(None)
def _word_letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])


class Words:
    """Lower-case words of some texts: letters of all texts in a row, each word's first and last place, its text."""

    def __init__(self, texts: list[str]):
        self.texts = [t.lower() + " " for t in texts]
        self.letters = np.frombuffer("".join(self.texts).encode("utf-32-le", "replace"), np.uint32)
        inside = _word_letters()[self.letters]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.first_letter = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(self.first_letter, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))

    def word(self, k: int) -> str:
        t = self.text[k]
        return self.texts[t][self.start[k] - self.first_letter[t]:self.end[k] - self.first_letter[t]]


class Automaton:
    """Trie x Levenshtein automata as one table: ``move[state, letter]``, and what a word that ends in a state is."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy_letters: int):
        """Terms with their weights."""
        self.words, self.stems = list(words), list(stems)
        self.weights = {WORD: list(words.values()), FUZZY: list(words.values()), STEM: list(stems.values())}
        children: list[dict[str, int]] = [{}, {}]  # roots: 0 takes edits, 1 doesn't
        ends: dict[int, tuple[int, int]] = {}
        for kind, terms in ((WORD, words), (STEM, stems)):
            for i, term in enumerate(terms):
                node = 0 if kind == WORD and len(term) >= fuzzy_letters else 1
                for c in term:
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                    node = children[node][c]
                ends[node] = (kind, i)
        letters = sorted({c for term in (*words, *stems) for c in term})
        takes_edits = self._below(children, 0)
        self.number = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other letter
        start = self._closed({(0, 0), (1, 0)}, children, takes_edits)
        states = {frozenset(): 0, start: 1}
        rows = [[0] * (len(letters) + 1), None]
        todo = [start]
        while todo:
            state = todo.pop()
            row = []
            for c in ("", *letters):
                after = self._after(state, c, children, ends, takes_edits)
                if after not in states:
                    states[after] = len(rows)
                    rows.append(None)
                    todo.append(after)
                row.append(states[after])
            rows[states[state]] = row
        self.move = np.array(rows, np.int32)
        self.kind = np.zeros(len(rows), np.int8)
        self.term = np.zeros(len(rows), np.int32)
        for state, k in states.items():
            found = [(ends[n][0] if e == 0 else FUZZY, ends[n][1]) for n, e in state if n in ends]
            if found:
                self.kind[k], self.term[k] = min(found)
        table = np.zeros(sys.maxunicode + 1, np.int32)
        for c, i in self.number.items():
            table[ord(c)] = i
        self.letter_class = table

    @staticmethod
    def _below(children: list[dict[str, int]], root: int) -> set[int]:
        seen, todo = {root}, [root]
        while todo:
            for child in children[todo.pop()].values():
                seen.add(child)
                todo.append(child)
        return seen

    @staticmethod
    def _closed(places: set[tuple[int, int]], children, takes_edits) -> frozenset:
        """Adds the places reached by leaving a letter of a term out."""
        more = {(child, 1) for node, edits in places if edits == 0 and node in takes_edits
                for child in children[node].values()}
        exact = {node for node, edits in places if edits == 0}
        return frozenset(p for p in places | more if p[1] == 0 or p[0] not in exact)

    def _after(self, state: frozenset, c: str, children, ends, takes_edits) -> frozenset:
        out = set()
        for node, edits in state:
            if node in ends and ends[node][0] == STEM:
                out.add((node, edits))  # whatever follows a stem
            if c in children[node]:
                out.add((children[node][c], edits))
            if edits == 0 and node in takes_edits:
                out.add((node, 1))  # a letter too many
                out.update((child, 1) for child in children[node].values())  # a wrong letter
        return self._closed(out, children, takes_edits)

    def run(self, words: Words) -> np.ndarray:
        """The state in which each word ends; all words take a letter at a time."""
        state = np.ones(len(words.start), np.int32)
        live = np.arange(len(words.start))
        at, end = words.start.copy(), words.end
        while len(live):
            now = self.move[state[live], self.letter_class[words.letters[at[live]]]]
            state[live] = now
            at[live] += 1
            live = live[(now != 0) & (at[live] < end[live])]
        return state


NAMES = ("words", "stems", "quoted", "density", "forms")


class Reader:
    """Turns texts into hits and features."""

    def __init__(self, automaton: Automaton, settings: Settings):
        self.automaton, self.window, self.misspelled = automaton, settings.window, settings.misspelled

    def hits(self, texts: list[str]) -> tuple[Words, list[list[tuple[int, int, int, int, bool]]]]:
        """Per text: (start, end, kind, term, quoted) of each hit, in code points of the lower-case text."""
        words = Words(texts)
        found: list[list[tuple[int, int, int, int, bool]]] = [[] for _ in texts]
        state = self.automaton.run(words)
        kinds = self.automaton.kind[state]
        for k in np.flatnonzero(kinds).tolist():
            t = int(words.text[k])
            a, b = int(words.start[k] - words.first_letter[t]), int(words.end[k] - words.first_letter[t])
            found[t].append((a, b, int(kinds[k]), int(self.automaton.term[state[k]]), self._quoted(words, k, t)))
        return words, found

    def _quoted(self, words: Words, k: int, t: int) -> bool:
        """Quotation marks on both sides in the window, or a reporting word before the hit."""
        first, last = max(0, k - self.window), min(len(words.start) - 1, k + self.window)
        while words.text[first] != t:
            first += 1
        while words.text[last] != t:
            last -= 1
        shift, text = words.first_letter[t], words.texts[t]
        before = text[max(0, words.start[first] - shift - 1):words.start[k] - shift]
        after = text[words.end[k] - shift:words.end[last] - shift + 1]
        if QUOTES.intersection(before) and QUOTES.intersection(after):
            return True
        return any(words.word(i) in REPORTING for i in range(first, k))

    def features(self, texts: list[str]) -> tuple[np.ndarray, list]:
        words, found = self.hits(texts)
        out = np.zeros((len(texts), len(NAMES)))
        for i, hits in enumerate(found):
            if hits:
                # A form counts once, however often the text repeats it.
                text = words.texts[i]
                abuse = {(kind, term, text[a:b]) for a, b, kind, term, quoted in hits if not quoted}
                quoted = {(kind, term, text[a:b]) for a, b, kind, term, quoted in hits if quoted} - abuse
                weight = {WORD: 0.0, STEM: 0.0, FUZZY: 0.0}
                for kind, term, _ in abuse:
                    weight[kind] += self.automaton.weights[kind][term]
                out[i] = (math.log1p(weight[WORD] + self.misspelled * weight[FUZZY]), math.log1p(weight[STEM]),
                          math.log1p(len(quoted)), math.log1p(1000 * len(abuse) / words.count[i]), math.log1p(len(abuse)))
        return out, found


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray  # bias first
    settings: Settings

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings) -> DataFrame:
    """Texts and labels of the learning rows with the smallest hashes, written once."""
    own = (labels.filter(learning_row(id_col) & F.col(label_col).isNotNull())
           .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
           .orderBy(F.xxhash64("_id"), "_id", "_label").limit(settings.sample_rows)
           .groupBy("_id").agg(F.max("_label").alias("_label")))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # At most sample_rows pairs of numbers.
    return cut(texts.join(F.broadcast(own), "_id").select("_text", "_label"))


def _terms_of(word: str, settings: Settings) -> list[str]:
    """The word and its stems, which end in an asterisk."""
    if len(word) < settings.least_letters or not word.isalpha():
        return []
    return [word, *(word[:n] + "*" for n in settings.stems if len(word) > n)]


def _grouped(sample: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of(texts, labels)`` gives one tuple per row; run on a slice of texts at a time."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in slices(texts, 1 << 19):
                columns = list(zip(*rows_of(texts[low:high], labels[low:high]))) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return sample.select("_text", "_label").mapInArrow(run, schema)


def _gain(a: float, b: float, toxic: float, other: float) -> float:
    """Log-likelihood ratio of a term with a of ``toxic`` and b of ``other`` places."""
    total, n = toxic + other, a + b
    parts = ((a, n * toxic / total), (b, n * other / total),
             (toxic - a, (total - n) * toxic / total), (other - b, (total - n) * other / total))
    return 2 * sum(x * math.log(x / e) for x, e in parts if x > 0 and e > 0)


def learn_terms(sample: DataFrame, settings: Settings) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of the lexicon with their weights, the log-odds of their places.

    First by the number of texts; then the candidates by the number of different
    places (the words before and after), so that a text with many copies counts once.
    """
    sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}, {}

    def texts_with(texts, labels):
        seen: Counter = Counter()
        for text, label in zip(texts, labels):
            words = Words([text])
            terms = {t for k in range(len(words.start)) for t in _terms_of(words.word(k), settings)}
            seen.update((t, label) for t in terms)
        return ((t, label, n) for (t, label), n in seen.items())

    by_text = (_grouped(sample, texts_with, "term string, label int, n long").groupBy("term")
               .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
                    F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")))
    likely = by_text.filter((F.col("a") >= settings.least_places)
                            & (F.col("a") * other >= settings.ratio * F.col("b") * toxic))
    wanted = {r["term"] for r in likely.orderBy(F.desc(F.col("a") / (F.col("b") + 1)), F.desc("a"), "term")
              .limit(settings.candidates).collect()}

    def places(texts, labels):
        seen = set()
        for text, label in zip(texts, labels):
            words = Words([text])
            own = [words.word(k) for k in range(len(words.start))]
            for k, word in enumerate(own):
                for term in _terms_of(word, settings):
                    if term in wanted:
                        seen.add((term, word, label, " ".join(own[max(0, k - 1):k] + ["_"] + own[k + 1:k + 2])))
        return seen

    counted = (_grouped(sample, places, "term string, word string, label int, place string").distinct()
               .groupBy("term", "word").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("a"),
                                            F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("b"))
               .groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("a").alias("most"))).collect()
    good = {r["term"]: r for r in counted if r["a"] >= settings.least_places
            and r["a"] * other >= settings.ratio * r["b"] * toxic
            and _gain(r["a"], r["b"], toxic, other) >= settings.least_gain}
    # A stem stands for its words if no single one of them explains it; of nested stems the most telling one.
    def gain(term: str):
        return -round(_gain(good[term]["a"], good[term]["b"], toxic, other), 6), -len(term), term

    stems: list[str] = []
    for term in sorted((t for t, r in good.items() if t.endswith("*") and 2 * r["most"] <= r["a"]), key=gain):
        if not any(term[:-1].startswith(s) or s.startswith(term[:-1]) for s in stems):
            stems.append(term[:-1])
    words = [t for t in good if not t.endswith("*") and not any(t.startswith(s) for s in stems)]
    kept = sorted([*words, *(s + "*" for s in stems)], key=gain)[:settings.terms]
    weight = {t: math.log((good[t]["a"] + 0.5) * other / ((good[t]["b"] + 0.5) * toxic)) for t in kept}
    return ({t: w for t, w in weight.items() if not t.endswith("*")},
            {t[:-1]: w for t, w in weight.items() if t.endswith("*")})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", settings: Settings = Settings()) -> Model | None:
    """Learns lexicon and weights from labelled learning rows; None unless both labels occur."""
    sample = _sample(docs, labels, id_col, text_col, label_col, settings)
    words, stems = learn_terms(sample, settings)
    if not words and not stems:
        return None
    automaton = Automaton(words, stems, settings.fuzzy_letters)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # at most settings.terms terms

    def make():
        reader = Reader(shared.value, settings)
        return lambda texts: [reader.features(texts)[0].tolist()]

    # Rows with equal features are one row with a count: few of them.
    rows = (with_results(sample, ["_label"], "_text", "x array<double>", make)
            .groupBy("_label", "x").count().orderBy("_label", "x").collect())
    x = np.array([r["x"] for r in rows])
    y = np.array([r["_label"] for r in rows], float)
    n = np.array([r["count"] for r in rows], float)
    return Model(automaton, _logistic(x, y, n), settings)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method. The ridge keeps features that never occur at weight 0; no hit may speak for a text."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    used = np.ones(x.shape[1], bool)
    while True:
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = (x.T @ (n * (y - p)) - penalty * w)[used]
            bend = ((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty))[np.ix_(used, used)]
            step = np.linalg.solve(bend, slope)
            w[used] += step
            if np.abs(step).max() < 1e-8:
                break
        wrong = used & (w < 0)
        wrong[0] = False
        if not wrong.any():
            return w
        used &= ~wrong
        w[wrong] = 0.0


RESULTS = "score double, hits array<struct<start:int,end:int,kind:int,term:string,quoted:boolean>>"


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Identifier, columns ``keep``, score and the hits behind it; spans are those of the lower-case text.

    Kinds of hits: 1 word, 2 stem, 3 misspelled word.
    """
    kept = [id_col, *keep]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"),
                           F.array().cast("array<struct<start:int,end:int,kind:int,term:string,quoted:boolean>>").alias("hits"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        reader = Reader(own.automaton, own.settings)
        terms = {WORD: own.automaton.words, FUZZY: own.automaton.words, STEM: own.automaton.stems}

        def apply(texts: list[str]) -> list:
            features, found = reader.features(texts)
            hits = [[{"start": a, "end": b, "kind": kind, "term": terms[kind][term], "quoted": quoted}
                     for a, b, kind, term, quoted in row] for row in found]
            return [own.scores(features).tolist(), hits]
        return apply

    return with_results(docs, kept, text_col, RESULTS, make, most=1 << 20)


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that score below the threshold."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        reader = Reader(own.automaton, own.settings)

        def apply(texts: list[str]) -> list:
            return [(own.scores(reader.features(texts)[0]) < threshold).tolist()]
        return apply

    return with_results(docs, docs.columns, text_col, "", make, drop=True, most=1 << 20)
