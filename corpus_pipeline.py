"""The corpus pipeline: five stages over documents, each written and read again before the next.

Stages 1 to 4 return the columns of documents; the last adds each text's token count and digests.
Each stage works on all rows that the one before it kept.

Edge cases: a null text passes the filters as empty; rows whose id is null are no copies of anything
and stay, unless they are toxic or hold a benchmark item; rows that repeat an
id are judged by their own texts, but by the second stage together: they stay if one of them does;
columns beyond those of documents are left behind; empty tables give an empty table,
but without labels of both classes the first stage raises ValueError.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm import bpe, decontaminate, jaccard, langid, secrets, toxicity
from lumenspark.llm.arrow import shared_folder
from lumenspark.llm.queries import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more. The model learns from the labelled documents of the input."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), langid.fold("doc_id", 5) != 0)
    return toxicity.keep_ordinary(docs, model, 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id; texts without words stay."""
    groups = jaccard.join(docs.select("doc_id", "text"), count=False)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.select(*COLUMNS)
    return named.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(named.where("doc_id IS NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark of its kind; no document goes."""
    masked = secrets.mask_table(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    return bpe.digest_table(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("bpe", tokenize),
]

#: The stages can't be written in SQL; tests hold the result against a plain form of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet in the shared folder and read again."""
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
