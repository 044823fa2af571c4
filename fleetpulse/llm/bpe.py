"""BPE by speculation: greedy longest matches, checked pair by pair, merged exactly only where a check fails.

A word's tokens are those of BPE exactly if every token is one that BPE makes
of its own characters and no neighbours would have merged across their border
at an earlier rank. Greedy longest match proposes tokens for the distinct words
of a slice; the border check then runs over all neighbours of all words at
once in NumPy. Words with a failing border, and no others, are merged rank by
rank. Known words are kept per Python worker in a table of bounded size.

The vocabulary is a ``tokenizers`` JSON file with byte-level symbols and word
ends; its path is a parameter.

Defined results: null or empty text has no tokens and decodes to the empty
string; null identifiers pass through; repeated rows give repeated results; an
empty table gives no rows; other columns don't matter. Rows never leave their
partition.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from fleetpulse.llm.rows import with_results

WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
KNOWN_WORDS = 300_000  # words kept per worker
NEVER = 1 << 62
END, LETTERS = 256, 257
LONG = 64  # bytes; longer words go through one by one


@lru_cache(None)
def unicode_class(category: str, top: int = sys.maxunicode) -> str:
    """Inside of a character class with all characters up to ``top`` whose category starts so."""
    codes = np.array([unicodedata.category(chr(c))[0] == category for c in range(top + 1)], np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], codes, [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


@lru_cache(None)
def word_pattern(top: int) -> re.Pattern:
    """Contractions, letters, single digits, or other visible characters, as the vocabulary file states them.

    Right for texts without characters above ``top``; classes that end at
    U+FFFF are searched much faster.
    """
    letters, numbers = unicode_class("L", top), unicode_class("N", top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")


HIGH = re.compile("[\U00010000-\U0010ffff]")


def find_words(text: str) -> list[str]:
    return word_pattern(sys.maxunicode if HIGH.search(text) else 0xFFFF).findall(text)


def byte_symbols() -> dict[str, int]:
    """The usual printable character for each byte, and back: visible Latin-1 stands for itself, others follow 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Tables of one vocabulary. Inside, symbols come first and merged tokens follow by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        names, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in merges]
        symbols = sorted(set(names) - set(made), key=names.get)
        order = symbols + made
        place = {name: i for i, name in enumerate(order)}
        self.ids = np.array([names[name] for name in order], np.uint32)
        self.names = {names[name]: name for name in order}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names |= {i: content for content, i in self.special.items()}
        n, first = len(order), len(symbols)
        self.left = np.arange(n)
        self.right = np.arange(n)
        self.left[first:] = [place[a] for a, _ in merges]
        self.right[first:] = [place[b] for _, b in merges]
        self.n = n
        keys = self.left[first:] * n + self.right[first:]
        by_key = np.argsort(keys)
        self.keys, self.merged = keys[by_key], (first + by_key)
        self.pairs = dict(zip(self.keys.tolist(), self.merged.tolist()))
        # A token counts if BPE makes it of its own characters: no border inside it merges too early.
        sound = self.whole(self.left[first:], self.right[first:], np.arange(first, n))
        good = np.concatenate([np.ones(first, bool), sound])
        for k in range(first, n):
            good[k] &= good[self.left[k]] and good[self.right[k]]
        raw = byte_symbols()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for k, name in enumerate(order):
            if good[k]:
                is_final = name.endswith(self.end) and name != self.end
                bare = name[:-len(self.end)] if is_final else name
                if all(c in raw for c in bare):
                    (self.final if is_final else self.inner)[bytes(raw[c] for c in bare)] = k
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._plant()
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # A special token stands among words as its id.
        self.fixed = {i: np.array([i], np.uint32).tobytes() for i in self.special.values()}
        self.known: dict[str | int, bytes] = dict(self.fixed)

    def whole(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For neighbours a, b: whether no merge across their border comes before what they are made of.

        The tokens are undone from the later merge on. Whenever the symbols at the
        border could merge at a rank below the limit, BPE would have done that first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            at = np.minimum(np.searchsorted(self.keys, x * self.n + y), len(self.keys) - 1)
            early = (self.keys[at] == x * self.n + y) & (self.merged[at] < most)
            ok[live[early]] = False
            live, x, y = live[~early], x[~early], y[~early]
            opened_x, opened_y = self.right[x], self.left[y]
            can_x, can_y = opened_x != x, opened_y != y
            # The later of the two goes first; of equals the right one, as BPE merges from the left.
            undo_x = can_x & ((x > y) | ~can_y)
            undo_y = can_y & ~undo_x
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, opened_x, x)
            b[live] = np.where(undo_y, opened_y, y)
            live = live[undo_x | undo_y]
        return ok

    def _plant(self) -> None:
        """A trie over usable tokens as sorted edges; a word's end is one more letter, ``END``."""
        edges: dict[int, int] = {}
        ends = [-1]
        for table, tail in ((self.inner, ()), (self.final, (END,))):
            for name, token in table.items():
                node = 0
                for letter in (*name, *tail):
                    key = node * LETTERS + letter
                    if key not in edges:
                        edges[key] = len(ends)
                        ends.append(-1)
                    node = edges[key]
                ends[node] = token
        self.edges = np.array(sorted(edges), np.int64)
        self.nodes = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words in step: tokens in order, and the number of each one's word.

        An inner token may not take a word's last byte, which only stands with the end.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(sizes) - 1
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        data[last] = END
        live = np.arange(len(words))
        at = last - sizes + 1
        node = np.zeros(len(words), np.int64)
        token, after = np.full(len(words), -1), at.copy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            keys = node * LETTERS + data[np.minimum(at, last[live])]
            edge = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            goes = (self.edges[edge] == keys) & (at <= last[live])
            node = np.where(goes, self.nodes[edge], 0)
            at = at + goes
            ends = self.ends[node]
            better = goes & (ends >= 0) & ((at < last[live]) | (at == last[live] + 1))
            token, after = np.where(better, ends, token), np.where(better, at, after)
            stop = ~goes
            out.append((live[stop], after[stop], token[stop]))
            at = np.where(stop, after, at)
            going = ~(stop & (after > last[live]))
            live, at, node, token, after = live[going], at[going], node[going], token[going], after[going]
        word, place, tokens = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(place, kind="stable")  # places run on from word to word
        return tokens[order], word[order]

    def _proposed_long(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        out, i, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while True:
            if n - i <= longest and (token := final.get(word[i:])) is not None:
                return [*out, token]
            j = min(n - 1, i + longest)
            while (token := inner.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j

    def exact(self, words: list[bytes]) -> list[list[int]]:
        """Merges by rank, leftmost first; all words take a step at a time. A merged token's number is its rank."""
        out: list[list[int]] = [[] for _ in words]
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._exact_long(self._symbols(w))
        if not short:
            return out
        owner = np.repeat(short, [len(words[k]) for k in short])
        tokens = np.array([t for k in short for t in self._symbols(words[k])], np.int64)
        ranks = self._ranks(tokens, owner, np.arange(len(tokens)))
        while len(tokens):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            done = least == NEVER
            if done.any():
                heads = starts[done[starts]]
                for start, size in zip(heads.tolist(), sizes[done[starts]].tolist()):
                    out[owner[start]] = tokens[start:start + size].tolist()
                tokens, owner, ranks, least = tokens[~done], owner[~done], ranks[~done], least[~done]
                if not len(tokens):
                    break
            hits = np.flatnonzero(ranks == least)
            hits = hits[np.concatenate([[True], owner[hits][1:] != owner[hits][:-1]])]  # the leftmost of each word
            tokens[hits] = ranks[hits]
            keep = np.ones(len(tokens), bool)
            keep[hits + 1] = False
            tokens, owner, ranks = tokens[keep], owner[keep], ranks[keep]
            moved = hits - np.arange(len(hits))
            changed = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            ranks[changed] = self._ranks(tokens, owner, changed)
        return out

    def _symbols(self, word: bytes) -> list[int]:
        return [self.inner[word[i:i + 1]] for i in range(len(word) - 1)] + [self.final[word[-1:]]]

    def _ranks(self, tokens: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the merge of each token in ``at`` with the next one of its word."""
        after = np.minimum(at + 1, len(tokens) - 1)
        keys = tokens[at] * self.n + tokens[after]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        holds = (self.keys[found] == keys) & (owner[after] == owner[at]) & (after > at)
        return np.where(holds, self.merged[found], NEVER)

    def _exact_long(self, tokens: list[int]) -> list[int]:
        """The same for one word of any length, with a heap over neighbours."""
        after = [*range(1, len(tokens)), -1]
        before = [*range(-1, len(tokens) - 1)]
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:]))
                if (m := self.pairs.get(a * self.n + b)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = m, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (k := self.pairs.get(m * self.n + tokens[after[i]])) is not None:
                    heapq.heappush(heap, (k, i, m, tokens[after[i]]))
            if (p := before[i]) >= 0 and (k := self.pairs.get(tokens[p] * self.n + m)) is not None:
                heapq.heappush(heap, (k, p, tokens[p], m))
        return [t for t in tokens if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        raw = [w.encode("utf-8", "replace") for w in words]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]) > LONG)  # long words last
        words, raw = [words[k] for k in order], [raw[k] for k in order]
        n_short = sum(len(w) <= LONG for w in raw)
        flat, owner = self.proposed(raw[:n_short])
        for k in range(n_short, len(raw)):
            tokens = self._proposed_long(raw[k])
            flat, owner = np.append(flat, tokens), np.append(owner, np.full(len(tokens), k))
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inside] * self.n + flat[1:][inside], return_inverse=True)
        holds = self.whole(pairs // self.n, pairs % self.n)[back]
        packed = self.ids[flat].tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(raw)))
        ids = [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        failing = np.unique(owner[1:][inside][~holds]).tolist()
        for k, tokens in zip(failing, self.exact([raw[k] for k in failing])):
            ids[k] = self.ids[tokens].tobytes()
        self.known.update(zip(words, ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        per_text: list[list[str | int]] = []
        for text in texts:
            words: list[str | int] = []
            for part in (self.split.split(text) if self.split else [text]):
                if part in self.special:
                    words.append(self.special[part])
                elif part:
                    if not part.isascii():
                        part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")  # one lower case for sigma
                    words += find_words(part.lower())
            per_text.append(words)
        distinct = set().union(*per_text)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = dict(self.fixed)
            new = distinct.difference(self.known)
        if new:
            self.learn(list(new))
        known = self.known
        return [b"".join([known[w] for w in words]) for words in per_text]

    def decode(self, ids: bytes) -> str:
        """Token names in order, a space between them: the file names no other decoder."""
        name = self.names
        return " ".join([name[i] for i in np.frombuffer(ids, np.uint32).tolist()])


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


SLICE = 2 << 20


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and ``ids``: each whole text's token ids as little-endian unsigned 32-bit integers."""
    return with_results(docs, [id_col], text_col, "ids binary", lambda: lambda texts: [load(path).encode(texts)],
                        most=SLICE)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Identifier, ``ids`` and ``text``, the decoded ids; null ids decode to the empty string."""
    def make():
        bpe = load(path)
        return lambda column: [[bpe.decode(ids) for ids in column]]

    return with_results(encoded, [id_col, ids_col], ids_col, "text string", make, most=SLICE, empty=b"")
