"""A training corpus from raw documents, in five stages, each over all that the one before kept.

1. toxicity: documents that score as toxic go.
2. near_duplicates: of each group of near copies the document with the smallest
   identifier stays.
3. repeats: passages of 50 words or more that occur in several documents stay
   where they occur first and are cut elsewhere; a document of which no word is
   left goes.
4. secrets: secrets are replaced by a mark; every document stays.
5. packing: the documents' tokens, packed into sequences.

Every row is a document of its own, also without identifier or with one that
another row has: stages 2 and 3 number the rows by identifier (those without
last) and work on that number.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``, with ``n_chars``, where there is such a column,
following the text. Stages limit the session's Arrow batches to 4 MB: workers
are reused from stage to stage, and what a large batch took is rarely given back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import near, packing, repeats, secrets, toxicity
from fleetpulse.llm.rows import free_name, small_batches
from fleetpulse.plans.shared import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows, number = _numbered(docs)
    copies = near.near_duplicates(rows, number).filter(~F.col("kept")).select(number)
    return rows.join(copies, number, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows, number = _numbered(docs)
    return _with_length(repeats.without_repeats(rows, number).drop(number))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _with_length(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number that is their own and grows with the identifier, and its column's name."""
    number = free_name("_row", docs.columns)
    ordered = (docs.withColumn(number, F.monotonically_increasing_id())
               .orderBy(F.col("doc_id").asc_nulls_last(), number))
    return cut(ordered.withColumn(number, F.monotonically_increasing_id())), number


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats),
          ("secrets", redact_secrets), ("packing", pack_sequences)]

# The learned model, similarity over shared shingles and the tokenizer have no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
