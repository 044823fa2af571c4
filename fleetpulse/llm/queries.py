"""One registered query per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import bpe, language, oracles, toxicity
from fleetpulse.llm.collocations import collocations
from fleetpulse.llm.licenses import license_scan
from fleetpulse.llm.near import near_duplicates
from fleetpulse.llm.nearest import nearest
from fleetpulse.llm.packing import pack
from fleetpulse.llm.quality import quality
from fleetpulse.llm.repeats import repeated_spans
from fleetpulse.llm.secrets import joined, secret_scan
from fleetpulse.llm.topk import top_k
from fleetpulse.llm.variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("places")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secret_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return (language.identify(docs, language.fit(docs))
            .select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated span: its words, and how many of them are not the first occurrence."""
    spans = repeated_spans(_table(spark, sf_dir, "documents"))
    cut = F.aggregate(
        F.filter("cuts", lambda c: (c["start"] < F.col("span.end")) & (c["end"] > F.col("span.start"))), F.lit(0),
        lambda n, c: n + F.least(c["end"], F.col("span.end")) - F.greatest(c["start"], F.col("span.start")))
    return spans.select("doc_id", "cuts", F.explode("repeats").alias("span")).select(
        "doc_id", F.col("span.start").cast("long").alias("start_word"), F.col("span.end").cast("long").alias("end_word"),
        cut.cast("long").alias("cut_words"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return (toxicity.toxicity(docs, model)
            .select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_nearest": op2_nearest,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_bpe": op5_bpe,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_topk": op11_topk,
    "op12_variants": op12_variants,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_licenses": oracles.OP1,
    "op4_near_duplicates": oracles.OP4,
    "op8_quality": oracles.OP8,
    "op9_suffix_dedup": oracles.OP9,
    "op11_topk": oracles.OP11,
    "op12_variants": oracles.OP12,
    "op13_collocations": oracles.OP13,
}
