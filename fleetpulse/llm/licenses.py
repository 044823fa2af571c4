"""Licence scan with a positional index of rare licence words, in built-in expressions only.

1. Document frequencies of the words that occur in any template are counted
   over all documents; there are as many counts as template words.
2. The templates' key words have postings (template, place in its key). A file's
   licence words of high IDF are looked up there; words that are not among the two
   rarest of any key are never needed. Every posting, moved by the word's place in the
   file, names a template and a start.
3. Postings are intersected by sorting these: only what at least two words of a
   file agree on stays, whatever the number of templates.
4. At each such start the mandatory key phrase is compared word by word, and
   the IDF share of the template's other words found in place is the score.

A key phrase always holds its template's two rarest key words, so the lookup
loses no place. Rows never leave their partition, but for the counts.

Defined results: null or empty text has no words, no labels and score 0; null
identifiers pass through; repeated rows give repeated results; an empty table
gives no rows. Only the identifier and the text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``text`` is the usual notice, ``key`` the phrase in it that must stand word by word."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key_words
        return next(i for i in range(len(words)) if words[i:i + len(key)] == key)


# Names, notices and two whole texts of common licences; fixed values.
TEMPLATES = (
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license", True),
    Template("apache", "licensed under the apache license version 2 0", "apache license", True),
    Template("cc-by", "licensed under cc by 4 0", "cc by", True),
    Template("mit", "released under the mit license", "mit license", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including without "
             "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
             "and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
             "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
             "software the software is provided as is without warranty of any kind express or implied including but not "
             "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
             "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
             "of contract tort or otherwise arising from out of or in connection with the software or the use or other "
             "dealings in the software",
             "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
             "software is provided as is and the author disclaims all warranties with regard to this software including all "
             "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
             "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
             "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
             "performance of this software",
             "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software released into the public domain"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
)


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier and the whole text's words."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(id_col), F.array_remove(F.split(low, NOT_WORD), "").alias("_words"))


def word_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES,
             id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """IDF of each template word over all documents: a table of as many rows as there are template words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = with_words(docs, id_col, text_col).select(F.explode(F.concat(
        F.array(F.lit("")),  # counts the documents
        F.array_distinct(F.filter("_words", lambda w: w.isin(*vocabulary))))).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: round(math.log((total + 1) / (counts.get(w, 0) + 1)) + 1, 9) for w in vocabulary}


def rarest(template: Template, idf: dict[str, float]) -> list[tuple[int, str]]:
    """The two rarest key words with their places in the key, ties by place."""
    order = sorted(enumerate(template.key_words), key=lambda x: (-idf[x[1]], x[0]))
    return order[:2]


class _Index:
    """Postings and templates as literals; a candidate is ``start * number of templates + template``."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]):
        self.count = len(templates)
        self.rare = sorted({word for t in templates for _, word in rarest(t, idf)})
        self.postings = F.create_map(*[c for w in self.rare for c in (F.lit(w), F.array(*[
            F.lit(k - at * self.count).cast("long") for k, t in enumerate(templates)
            for at, word in enumerate(t.key_words) if word == w]))])
        self.short = [k for k, t in enumerate(templates) if len(t.key_words) == 1]
        self.keys = F.lit([t.key_words for t in templates])
        self.notices = F.lit([t.words for t in templates])
        self.weights = F.lit([[idf[w] for w in t.words] for t in templates])
        self.wholes = F.lit([sum(idf[w] for w in t.words) for t in templates])
        self.firsts = F.lit([t.key_at for t in templates])
        self.labels = F.lit([t.label for t in templates])
        self.base = F.lit([t.base for t in templates])

    def which(self, candidate: Column) -> Column:
        return (candidate % self.count).cast("int")

    def start(self, candidate: Column) -> Column:
        return F.floor(candidate / self.count).cast("int")

    def looked_up(self, hit: Column) -> Column:
        return F.transform(F.element_at(self.postings, hit["word"]), lambda moved: hit["place"] * self.count + moved)

    def agreed(self, sorted_codes: Column) -> Column:
        """Candidates that two words of the file name, or one where the key has no second."""
        def stays(code: Column, i: Column) -> Column:
            twice = F.get(sorted_codes, i - 1) == code
            alone = self.which(code).isin(*self.short) if self.short else F.lit(False)
            return (code >= 0) & F.coalesce(twice | alone, F.lit(False))
        return F.array_distinct(F.filter(sorted_codes, stays))

    def verified(self, candidate: Column) -> Column:
        key = F.get(self.keys, self.which(candidate))
        return F.slice("_words", self.start(candidate) + 1, F.size(key)) == key

    def share(self, candidate: Column) -> Column:
        """IDF share of the template that stands around a start of its key."""
        k = self.which(candidate)
        first = self.start(candidate) - F.get(self.firsts, k)

        def add(found: Column, i: Column) -> Column:
            there = (first + i >= 0) & (F.get("_words", first + i) == F.get(F.get(self.notices, k), i))
            return found + F.when(there, F.get(F.get(self.weights, k), i)).otherwise(0.0)
        found = F.aggregate(F.sequence(F.lit(0), F.size(F.get(self.notices, k)) - 1), F.lit(0.0), add)
        return F.round(found / F.get(self.wholes, k), 6)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: number of words, places of base phrases, all labels and the best template's score.

    ``places`` holds a struct (label, start) per place of any template's key.
    """
    idf = word_idf(docs, templates, id_col, text_col)
    index = _Index(templates, idf)
    rows = with_words(docs, id_col, text_col).withColumn("_codes", F.when(
        F.exists("_words", lambda w: w.isin(*index.rare)),
        F.array_sort(F.flatten(F.transform(
            F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("place"))),
                     lambda h: h["word"].isin(*index.rare)),
            index.looked_up)))).otherwise(F.array().cast("array<bigint>")))
    found = rows.withColumn("_found", F.filter(index.agreed(F.col("_codes")), index.verified)).withColumn("_places", F.transform(
        "_found", lambda c: F.struct(F.get(index.labels, index.which(c)).alias("label"), index.start(c).alias("start"),
                                     F.get(index.base, index.which(c)).alias("base"))))
    base = F.filter("_places", lambda p: p["base"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")
    return found.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).cast("long").alias("first_word"),
        F.array_max(base["start"]).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("_places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", index.share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.transform("_places", lambda p: F.struct(p["label"].alias("label"), p["start"].alias("start")))).alias("places"))
