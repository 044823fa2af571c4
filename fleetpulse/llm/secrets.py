"""Secret scan with a trigram inverted index over segments of rows.

Each rule's regular expression is turned into a Boolean query over trigrams of
ASCII-lower-cased text that every match must satisfy. An index segment covers
a few megabytes of rows inside a task: it holds, for the trigrams that any
query names, the rows in which they occur. Rules intersect and unite postings,
and only the rows left are searched by the expression itself. A rule without
a mandatory trigram searches every row. No row leaves its partition, so a lost
executor costs only its own tasks.

Defined results: null or empty text has no spans; null identifiers pass
through; repeated rows give repeated results; an empty table gives no rows.
Only the identifier and the text are read. Offsets count code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as op  # the parse tree of the expressions
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.rows import slices, with_results

SEGMENT_CHARS = 1 << 20
MAX_STRINGS = 256  # exact strings held while a query is derived; beyond it they become a query


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group is at least ``least`` characters long."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        object.__setattr__(self, "compiled", re.compile(self.pattern, flags))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# Hex: a run is maximal either way, so asking for 32 characters at once finds the same runs as [0-9a-f]+ and a filter.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least=8, group=2, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", least=32, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._-]{20,}"),
    Rule("url_login", r"://[^/\s:@]{1,64}:[^/\s:@]{1,64}@"),
)

# A query is True (all rows), a trigram, or ("and" | "or", [queries]).


def _join(kind: str, parts: list):
    """Simplified conjunction or disjunction."""
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    unique = []
    for p in parts:
        if p not in unique:
            unique.append(p)
    return unique[0] if len(unique) == 1 else (kind, unique)


def _strings_query(strings: set[str]):
    """What holds if one of the strings occurs."""
    raw = sorted(s.encode().decode("latin-1") for s in strings)  # a character per UTF-8 byte
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in raw])


class _Walk:
    """Goes through a parse tree, holding the exact strings that may end at the present place."""

    def __init__(self):
        self.parts: list = []
        self.strings = {""}

    def flush(self) -> None:
        self.parts.append(_strings_query(self.strings))
        self.strings = {""}

    def add(self, choices: set[str]) -> None:
        if len(self.strings) * len(choices) > MAX_STRINGS:
            self.flush()
        self.strings = {a + b for a in self.strings for b in choices}

    def query(self):
        self.flush()
        return _join("and", self.parts)

    def walk(self, tree) -> None:
        for kind, value in tree:
            if kind is op.LITERAL:
                self.add({_fold(chr(value))})
            elif kind is op.IN and (chars := _small_class(value)):
                self.add(chars)
            elif kind is op.SUBPATTERN:
                self.walk(value[3])
            elif kind is op.BRANCH:
                exact = [_exact(b) for b in value[1]]
                if all(exact):
                    self.add(set().union(*exact))
                else:
                    self.flush()
                    self.parts.append(_join("or", [trigram_query_of(b) for b in value[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, sub = value
                exact = _exact(sub)
                if exact and (low, high) == (0, 1):
                    self.add(exact | {""})
                elif exact and low == high and low <= 4:
                    for _ in range(low):
                        self.add(exact)
                elif low:
                    if exact:
                        self.add(exact)
                        self.flush()
                        self.strings = set(exact)  # the last copy, which what follows stands next to
                    else:
                        self.flush()
                        self.parts.append(trigram_query_of(sub))
                else:
                    self.flush()
            elif kind is not op.AT:
                self.flush()


def _fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def _small_class(items, most: int = 8) -> set[str] | None:
    """Characters of a class, if they are few."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(_fold(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < most:
            chars.update(_fold(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return None
    return chars if len(chars) <= most else None


def _exact(tree) -> set[str] | None:
    """The strings of a part without repeats, if they are few."""
    walk = _Walk()
    for kind, _ in tree:
        if kind not in (op.LITERAL, op.IN, op.SUBPATTERN, op.BRANCH):
            return None
    walk.walk(tree)
    return walk.strings if not walk.parts else None


def trigram_query_of(tree):
    walk = _Walk()
    walk.walk(tree)
    return walk.query()


def trigram_query(rule: Rule):
    """The query of a rule; True if nothing is mandatory."""
    return trigram_query_of(_parser.parse(rule.pattern))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams, query[1]))


class Segment:
    """Postings of the named trigrams over some texts."""

    def __init__(self, texts: list[str], table: np.ndarray, number: dict[str, int]):
        self.rows = np.arange(len(texts))
        self.number = number
        raw = [t.encode("utf-8", "replace").lower() for t in texts]  # bytes.lower() folds A-Z alone
        ends = np.cumsum([len(r) + 2 for r in raw])
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
        codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        which = table[codes]
        at = np.flatnonzero(which)
        pairs = np.unique(which[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        self.starts = np.searchsorted(pairs, np.arange(len(number) + 2) * len(texts))
        self.pairs = pairs

    def rows_of(self, query) -> np.ndarray:
        if query is True:
            return self.rows
        if isinstance(query, str):
            k = self.number[query]
            return self.pairs[self.starts[k]:self.starts[k + 1]] - k * len(self.rows)
        meet = np.intersect1d if query[0] == "and" else np.union1d
        rows = self.rows_of(query[1][0])
        for part in query[1][1:]:
            if query[0] == "and" and not len(rows):
                break
            rows = meet(rows, self.rows_of(part))
        return rows


def scan(texts: list[str], rules: tuple[Rule, ...], queries: list, table: np.ndarray,
         number: dict[str, int]) -> list[list[tuple[int, int, int]]]:
    """Per text its spans as (start, number of the rule, end), in that order."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in _segments(texts):
        segment = Segment(texts[low:high], table, number)
        for k, rule in enumerate(rules):
            for row in segment.rows_of(queries[k]):
                text = texts[low + row]
                found[low + row].extend((a, k, b) for a, b in rule.spans(text))
    for spans in found:
        spans.sort()
    return found


class Scanner:
    """Rules with their queries and the lookup table of trigrams; made once per task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        names = sorted(set().union(*map(trigrams, self.queries)))
        self.number = {name: i + 1 for i, name in enumerate(names)}
        self.table = np.zeros(1 << 24, np.uint16)
        for name, i in self.number.items():
            a, b, c = name.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = i

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans as (start, number of the rule, end), in that order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for low, high in slices(texts, SEGMENT_CHARS):
            segment = Segment(texts[low:high], self.table, self.number)
            for k, rule in enumerate(self.rules):
                for row in segment.rows_of(self.queries[k]):
                    found[low + row].extend((a, k, b) for a, b in rule.spans(texts[low + row]))
        for spans in found:
            spans.sort()
        return found


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Identifier, the columns named in ``keep``, and ``spans`` by start, then by rule."""
    def make():
        scanner = Scanner(rules)

        def apply(texts: list[str]) -> list:
            return [[[{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in s]
                     for s in scanner.spans(texts)]]
        return apply

    return with_results(docs, [id_col, *keep], text_col,
                        "spans array<struct<kind:string,start:int,end:int,base:boolean>>", make)


def joined(spans) -> object:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns in their order, each stretch of secret spans replaced by ``mark``; null texts become empty.

    Overlapping spans are replaced once, as their union.
    """
    def make():
        scanner = Scanner(rules)

        def apply(texts: list[str]) -> list:
            return [[t if not s else _without(t, s, mark) for t, s in zip(texts, scanner.spans(texts))]]
        return apply

    others = [c for c in docs.columns if c != text_col]
    return with_results(docs, others, text_col, f"`{text_col}` string", make).select(*docs.columns)


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
            done = end
        else:
            done = max(done, end)
    return "".join(out) + text[done:]
