"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over one row, so the scan needs no
shuffle and no user function. A rule names a measure and the range it must lie
in; :func:`verdict` turns the table into one Boolean expression.

Defined results: a null or empty text has no words and zero measures and fails
``min_words``; null identifiers pass through; repeated rows give repeated
results; an empty table gives no rows. Only the identifier and the text are
read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8

# Frequent function words of the four languages; a fixed list.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "at",
              "der", "die", "das", "und", "ist", "von", "den", "mit", "ein", "eine", "nicht", "zu", "für", "auf",
              "le", "la", "les", "de", "et", "des", "un", "une", "est", "que", "pour", "dans", "en", "pas", "du",
              "el", "los", "las", "y", "del", "se", "por", "con", "para", "su", "al", "lo", "una")


@dataclass(frozen=True)
class Rule:
    """``100 * numerator / denominator`` must lie in ``[low, high]``; no denominator stands for 1.

    Limits are whole hundredths, so a comparison is exact. A rule whose
    denominator is zero holds: the length rules judge such texts.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: int | None = None
    high: int | None = None


BASE_RULES = (
    Rule("min_words", "n_words", low=2000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30),
)
RULES = BASE_RULES + (
    Rule("word_length", "word_chars", "n_words", low=200, high=1600),
    Rule("symbols", "n_symbols", "n_words", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("upper_case", "n_upper", "word_chars", high=60),
)


def rule_holds(rule: Rule) -> Column:
    """Multiplied out where there is a denominator, so that no row divides by zero."""
    size = F.col(rule.denominator) if rule.denominator else F.lit(1)
    holds = F.lit(True)
    if rule.low is not None:
        holds = holds & (100 * F.col(rule.numerator) >= rule.low * size)
    if rule.high is not None:
        holds = holds & (100 * F.col(rule.numerator) <= rule.high * size)
    return holds


def verdict(rules: tuple[Rule, ...]) -> Column:
    """All rules of a table as one expression."""
    holds = F.lit(True)
    for rule in rules:
        holds = holds & rule_holds(rule)
    return holds


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that stand twice or more; ``windows`` is sorted by hash, then place."""
    def twin(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(windows, i - 1)["hash"])
        after = F.get(windows, i + 1)["hash"]
        return F.coalesce(before == x["hash"], F.lit(False)) | F.coalesce(after == x["hash"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(windows, twin), lambda x: x["place"]))
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))
    return F.aggregate(
        places, start,
        lambda acc, place: F.struct((acc["words"] + place + WINDOW - F.greatest(acc["end"], place)).alias("words"),
                                    (place + WINDOW).alias("end")),
        lambda acc: acc["words"])


def _joined(values: str, step: int) -> Column:
    """Hash of each element with the one ``step`` places on."""
    return F.transform(values, lambda x, i: F.xxhash64(x, F.get(values, i + step)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts that rules speak of."""
    bare = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    parts = bare.select(
        id_col, "_text",
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    # Hashes of 2, 4 and 8 words, each from two of the step before: three short passes over the array.
    hashed = parts.withColumn("_hashes", _joined("_words", 1))
    for step in (2, 4):
        hashed = hashed.withColumn("_hashes", _joined("_hashes", step))
    hashed = hashed.withColumn("_hashes", F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))))
    placed = hashed.withColumn("_windows", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))))
    return placed.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_windows").isNull(), F.lit(0).cast("long")).otherwise(
            _repeat_words(F.col("_windows"))).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS, *(s.capitalize() for s in STOP_WORDS)))
               ).cast("long").alias("n_stop_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))).cast("long").alias("n_upper"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the names of the rules that a document breaks."""
    broken = F.array_compact(F.array(*[F.when(~rule_holds(r), F.lit(r.name)) for r in rules]))
    # All of the base rules and all of the table; each document is judged from its own row.
    return measures(docs, id_col, text_col).withColumns({
        "base_failed": ~verdict(BASE_RULES),
        "kept": verdict(BASE_RULES) & verdict(rules),
        "broken": F.concat_ws(",", broken),
    })
