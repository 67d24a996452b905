"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. toxicity         documents predicted to be toxic go
2. near duplicates  of each group of linked documents the one with the least doc_id stays
3. decontamination  documents contaminated by ``benchmark`` go
4. secrets          reported spans are replaced in the texts
5. pieces           the remaining texts as SentencePiece ids, with the decoded text's digest

No stage can be told in SQL as a whole (the first is a fitted model, the last a library's encoding), so
there is no ORACLE_SQL; tests hold the pipeline against its stages' plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, ngram_join, pieces, secrets, toxicity
from graphloom.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs)
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encoded.select(*kept, F.size("pieces.ids").cast("long").alias("n_tokens"), F.col("pieces.ids").alias("ids"), F.sha2("pieces.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", as_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next.

    Null and empty texts go through every stage (they are neither toxic nor contaminated, near no other text,
    and have no pieces).  Of rows with one doc_id all stay if it is its group's, so repeated rows do; rows
    without a doc_id are no one's copies.  An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
