"""Language identification by a linear-chain conditional random field over words.

Every word gets a score per language from hashed character n-grams of the
marked word (those with a mark are its affixes) and from a lexicon; learned
transitions join neighbouring words. Forward-backward over the whole text gives
each word's posterior, so a text that changes language is labelled run by run;
the document's language is that with the largest mean posterior.

Learning: the lexicon counts the words of all learning rows in a table of fixed
size (hash buckets x languages). Weights and transitions are fitted on segments
of a bounded sample (``Settings.sample_rows`` rows per language, as many
segments at most), half of them spliced from two languages, so that
transitions see both staying and changing.

Only text and language of the learning rows are learned from. Defined results:
null text or text without a letter, or nothing to learn from: ``und`` with
score 0; null identifiers pass through and are never learned from; repeated
rows give repeated results; an empty table gives no rows. Other columns don't
matter. Rows never leave their partition when they are labelled.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.bpe import HIGH, unicode_class
from fleetpulse.llm.rows import with_results

UNKNOWN = "und"
BLOCK = 64  # words per block of the forward-backward scan
KNOWN_WORDS = 300_000  # kept per worker


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    gram: int = 4  # longest character n-gram of ^word$
    segment: int = 32  # words
    sample_rows: int = 600  # per language
    sample_segments: int = 1500  # per language
    rounds: int = 4
    batch: int = 64
    step: float = 0.3
    seed: int = 11


def learning_row(id_col: str) -> Column:
    """Rows that may be learned from; the others, and rows without identifier, may not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2, F.lit(False))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


@lru_cache(None)
def _letters(top: int) -> re.Pattern:
    return re.compile(f"[{unicode_class('L', top)}]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    low = text.lower()
    return _letters(sys.maxunicode if HIGH.search(low) else 0xFFFF).findall(low)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ^word$, each word's first place among them, and each word's own bucket."""
    marked = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), sizes)
    grams, owners = [], []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, settings.gram + 1):
        if len(codes) < n:
            break
        key = key[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        inside = word[:len(codes) - n + 1] == word[n - 1:]
        grams.append(_mixed(key[inside] + np.uint64(n)) % np.uint64(settings.buckets))
        owners.append(word[:len(codes) - n + 1][inside])
    gram, owner = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    gram, owner = gram[order], owner[order]
    # The whole word: a sum over places of mixed letters.
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.add.reduceat(_mixed(codes + _mixed(place.astype(np.uint64) + np.uint64(77))), np.cumsum(sizes) - sizes)
    return gram, np.searchsorted(owner, np.arange(len(marked))), (_mixed(whole) % np.uint64(settings.buckets)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages): n-grams
    lexicon: np.ndarray  # (buckets, languages): log-odds of whole words
    trust: np.ndarray  # (languages,): weight of the lexicon
    moves: np.ndarray  # (languages, languages): transitions
    settings: Settings

    def emissions(self, words: list[str]) -> np.ndarray:
        gram, starts, whole = features(words, self.settings)
        n = np.diff(np.append(starts, len(gram)))
        sums = np.add.reduceat(self.weights[gram], starts, axis=0)
        return sums / np.sqrt(n)[:, None] + self.trust * self.lexicon[whole]


def posteriors(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Per word the posterior of each language; texts follow one another, ``lengths`` words each.

    Texts are laid out in blocks that all advance together. Transfer matrices of
    whole blocks are chained first, so a long text costs no more per word.
    """
    n_lang = emission.shape[1]
    blocks_of = -(-lengths // BLOCK)
    n_blocks = int(blocks_of.sum())
    first_block = np.cumsum(blocks_of) - blocks_of
    first_word = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(text)) - first_word[text]
    slot = (first_block[text] + inside // BLOCK) * BLOCK + inside % BLOCK
    grid = np.ones((n_blocks * BLOCK, n_lang))
    grid[slot] = np.exp(emission - emission.max(axis=1, keepdims=True))
    used = np.zeros(n_blocks * BLOCK, bool)
    used[slot] = True
    grid, used = grid.reshape(n_blocks, BLOCK, n_lang), used.reshape(n_blocks, BLOCK)
    move = np.exp(moves - moves.max())
    # Transfer through a block: rows are languages of the word before it.
    transfer = np.broadcast_to(np.eye(n_lang), (n_blocks, n_lang, n_lang)).copy()
    for k in range(BLOCK):
        on = used[:, k]
        step = (transfer[on] @ move) * grid[on, k][:, None, :]
        transfer[on] = step / step.sum(axis=(1, 2), keepdims=True)
    enter = np.ones((n_blocks, n_lang)) / n_lang  # forward message into each block
    leave = np.ones((n_blocks, n_lang)) / n_lang  # backward message from behind it
    by_size = np.argsort(-blocks_of, kind="stable")
    for k in range(1, int(blocks_of.max(initial=0))):
        own = by_size[:np.searchsorted(-blocks_of[by_size], -k)]
        b = first_block[own] + k
        x = np.einsum("bi,bij->bj", enter[b - 1], transfer[b - 1])
        enter[b] = x / x.sum(axis=1, keepdims=True)
        b = first_block[own] + blocks_of[own] - 1 - k
        x = np.einsum("bij,bj->bi", transfer[b + 1], leave[b + 1])
        leave[b] = x / x.sum(axis=1, keepdims=True)
    forward = np.empty_like(grid)
    x = enter
    for k in range(BLOCK):
        step = (x @ move) * grid[:, k]
        x = np.where(used[:, k][:, None], step / step.sum(axis=1, keepdims=True), x)
        forward[:, k] = x
    y = leave
    for k in range(BLOCK - 1, -1, -1):
        forward[:, k] *= y
        step = (grid[:, k] * y) @ move.T
        y = np.where(used[:, k][:, None], step / step.sum(axis=1, keepdims=True), y)
    both = forward.reshape(-1, n_lang)[slot]
    return both / both.sum(axis=1, keepdims=True)


def _lexicon(learn: DataFrame, text_col: str, lang_col: str, languages: list[str], settings: Settings) -> np.ndarray:
    """Log-odds of each bucket and language, from counts over all learning rows."""
    place = {name: i for i, name in enumerate(languages)}
    width = settings.buckets

    def count(batches):
        import pyarrow as pa

        seen = np.zeros((len(languages), width), np.int64)
        for batch in batches:
            texts: list[Counter] = [Counter() for _ in languages]
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in place:
                    texts[place[lang]].update(words_of(text or ""))
            for k, words in enumerate(texts):
                if words:
                    _, _, whole = features(list(words), Settings(buckets=width, gram=1))
                    seen[k] += np.bincount(whole, np.fromiter(words.values(), np.int64), width).astype(np.int64)
        lang, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(seen[lang, bucket], pa.int64())],
            names=["lang", "bucket", "n"])

    counts = learn.select(text_col, lang_col).mapInArrow(count, "lang int, bucket int, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((width, len(languages)), 0.5)
    table[rows["bucket"], rows["lang"]] += rows["n"]
    share = table / table.sum(axis=0)
    return np.log(share) - np.log(share).mean(axis=1, keepdims=True)


def _segments(learn: DataFrame, id_col: str, text_col: str, lang_col: str, sizes: dict[str, int],
              settings: Settings) -> dict[str, list[list[str]]]:
    """Segments of a bounded sample of rows, by language; which ones depends on hashes alone."""
    parts = 1 << 30
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, settings.sample_rows / n)).otherwise(share)
    rows = learn.filter(F.pmod(F.xxhash64(id_col, F.lit(settings.seed)), F.lit(parts)) < share * parts)
    n = settings.segment

    def split(texts: list[str]) -> list:
        words = map(words_of, texts)
        return [[[" ".join(ws[i:i + n]) for i in range(0, len(ws), n)] for ws in words]]

    cut_up = with_results(rows, [id_col, lang_col], text_col, "segments array<string>", lambda: split)
    all_segments = cut_up.select(id_col, lang_col, F.explode("segments").alias("segment"))
    out: dict[str, list[list[str]]] = {}
    for row in (all_segments.orderBy(F.xxhash64("segment", id_col), "segment", lang_col)
                .limit(settings.sample_segments * len(sizes)).collect()):
        out.setdefault(row[lang_col], []).append(row["segment"].split(" "))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        settings: Settings = Settings()) -> Model | None:
    """Learns from the learning rows of ``docs`` with a language; None if there are none."""
    learn = docs.filter(learning_row(id_col) & F.col(lang_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in learn.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    lexicon = _lexicon(learn, text_col, lang_col, languages, settings)
    segments = _segments(learn, id_col, text_col, lang_col, sizes, settings)
    model = Model(languages, np.zeros((settings.buckets, len(languages))), lexicon, np.ones(len(languages)) * 0.5,
                  np.eye(len(languages)) * 2.0, settings)
    _train(model, segments)
    return model


def _train(model: Model, segments: dict[str, list[list[str]]]) -> None:
    """Stochastic gradient ascent of the conditional likelihood, with a step size per weight."""
    rng = np.random.default_rng(model.settings.seed)
    s, n_lang = model.settings, len(model.languages)
    place = {name: i for i, name in enumerate(model.languages)}
    pool = [(place[lang], ws) for lang in sorted(segments) for ws in segments[lang]]
    sequences = []
    for i, (lang, ws) in enumerate(pool):
        other, more = pool[rng.integers(len(pool))]
        if rng.random() < 0.5 and len(ws) > 1 and len(more) > 1:
            a, b = rng.integers(1, len(ws) + 1), rng.integers(1, len(more) + 1)
            sequences.append((ws[:a] + more[-b:], [lang] * a + [other] * b))
        else:
            sequences.append((ws, [lang] * len(ws)))
    if not sequences:
        return
    distinct = sorted({w for ws, _ in sequences for w in ws})
    number = {w: i for i, w in enumerate(distinct)}
    gram, starts, whole = features(distinct, s)
    sizes = np.diff(np.append(starts, len(gram)))
    grown = [np.full_like(x, 1e-6) for x in (model.weights, model.trust, model.moves)]
    for _ in range(s.rounds):
        order = rng.permutation(len(sequences))
        for low in range(0, len(order), s.batch):
            part = [sequences[i] for i in order[low:low + s.batch]]
            lengths = np.array([len(ws) for ws, _ in part])
            words = np.array([number[w] for ws, _ in part for w in ws])
            truth = np.array([y for _, ys in part for y in ys])
            # n-grams of all words of the batch, one after another
            n = sizes[words]
            at = np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, scale = np.repeat(np.arange(len(words)), n), 1 / np.sqrt(n)
            sums = np.add.reduceat(model.weights[gram[at]], np.cumsum(n) - n, axis=0)
            emission = sums * scale[:, None] + model.trust * model.lexicon[whole[words]]
            post = posteriors(emission, lengths, model.moves)
            miss = -post
            miss[np.arange(len(words)), truth] += 1
            miss /= len(part)
            by_gram = (miss * scale[:, None])[own]
            touched, back = np.unique(gram[at], return_inverse=True)
            slope = np.stack([np.bincount(back, by_gram[:, k], len(touched)) for k in range(n_lang)], axis=1)
            grown[0][touched] += slope ** 2
            model.weights[touched] += s.step * slope / np.sqrt(grown[0][touched])
            slope = (miss * model.lexicon[whole[words]]).sum(axis=0)
            grown[1] += slope ** 2
            model.trust += s.step * slope / np.sqrt(grown[1])
            ends = np.cumsum(lengths) - 1
            inner = np.ones(len(words), bool)
            inner[ends] = False
            a = np.flatnonzero(inner)
            real = np.zeros((n_lang, n_lang))
            np.add.at(real, (truth[a], truth[a + 1]), 1)
            slope = (real - _pair_counts(post, a, model.moves)) / len(part)
            grown[2] += slope ** 2
            model.moves += s.step * slope / np.sqrt(grown[2])


def _pair_counts(post: np.ndarray, a: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions from words ``a`` to the next, from posteriors of both ends.

    The pair's distribution is the transition scaled so that its margins are the
    posteriors: as both margins are known, a few rounds of scaling give it.
    """
    pair = np.broadcast_to(np.exp(moves - moves.max()), (len(a), *moves.shape)).copy()
    rows, columns = post[a] + 1e-12, post[a + 1] + 1e-12
    for _ in range(8):
        pair *= (rows / pair.sum(axis=2))[:, :, None]
        pair *= (columns / pair.sum(axis=1))[:, None, :]
    return pair.sum(axis=0)


class Labeller:
    """Labels texts; emissions of known words are kept in a table of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def emissions(self, per_text: list[list[str]]) -> np.ndarray:
        distinct = set().union(*per_text)
        new = [w for w in distinct if w not in self.number]
        if len(self.number) + len(new) > KNOWN_WORDS:
            self.number, self.table = {}, self.table[:0]
            new = list(distinct)
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        get = self.number.__getitem__
        return self.table[np.fromiter((i for ws in per_text for i in map(get, ws)), np.int64)]

    def __call__(self, texts: list[str]) -> list:
        per_text = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, per_text), np.int64, len(per_text))
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        runs: list[list[dict]] = [[] for _ in texts]
        some = np.flatnonzero(lengths)
        if len(some):
            post = posteriors(self.emissions(per_text), lengths[some], self.model.moves)
            starts = np.cumsum(lengths[some]) - lengths[some]
            means = np.add.reduceat(post, starts, axis=0) / lengths[some][:, None]
            best = post.argmax(axis=1)
            changes = np.ones(len(best), bool)
            changes[1:] = best[1:] != best[:-1]
            changes[starts] = True
            heads = np.flatnonzero(changes)
            sizes = np.diff(np.append(heads, len(best)))
            owner = np.searchsorted(starts, heads, side="right") - 1
            names = self.model.languages
            for head, size, k in zip(heads.tolist(), sizes.tolist(), owner.tolist()):
                runs[some[k]].append({"lang": names[best[head]], "word": int(head - starts[k]), "words": size})
            for i, mean in zip(some.tolist(), means):
                languages[i], scores[i] = names[int(mean.argmax())], float(min(1.0, mean.max()))
        return [languages, scores, runs]


RESULTS = "lang_pred string, score double, runs array<struct<lang:string,word:int,words:int>>"


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, language, mean posterior and the runs of one language with their first word and size."""
    if model is None:
        return docs.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.array().cast("array<struct<lang:string,word:int,words:int>>").alias("runs"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus
    return with_results(docs, [id_col], text_col, RESULTS, lambda: Labeller(shared.value), most=2 << 20)
