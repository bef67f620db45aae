"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, langid, near_dedup, quality, secrets, toxicity, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(read(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved_pages(read(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_probe(read(spark, sf_dir, "conversations")))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), langid.fold("doc_id", 5) != 0)
    return _scored(quality.score_table(docs, model), 0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), langid.fold("doc_id", 5) != 0)
    return _scored(toxicity.score_table(docs, model), 0.5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_table(read(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.fold("doc_id", 4) != 2)
    out = langid.predict_table(docs, model)
    return out.select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "mixture")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_dedup, op2_decontaminate, op3_warc_revisits, op4_bpe, op5_chat, op6_quality, op7_toxicity, op8_jaccard_join, op9_secrets, op10_langid)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisits": warc.SQL}
