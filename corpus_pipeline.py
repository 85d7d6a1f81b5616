"""A corpus from raw documents to packed sequences: each stage reads what the one before it wrote.

toxicity rejects documents; near_duplicates keeps the smallest doc_id of each group; decontamination cuts benchmark
passages out and drops documents that consist of them; secrets are masked; packing deals the token ids of what is left
into sequences. SQL cannot express the classifier and the tokenizer, so ORACLE_SQL is None and the tests hold the
stages against brute force.

Each stage keeps all columns of documents, and others whatever they are called; null and empty texts pass through all
stages (they are neither toxic nor copies), very long texts are read whole, and empty tables stay empty. Of documents
that tie as copies the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_path, table, written
from quarry.llm.decontam import decontaminate
from quarry.llm.near_dup import BROADCAST_ROWS, near_duplicates
from quarry.llm.packing import pack
from quarry.llm.secret_scan import redact
from quarry.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without doc_id stay; of rows that repeat a doc_id and its text one stays, that with the smallest values in
    the other columns."""
    groups = near_duplicates(docs, words=5, percent=80)
    gone = groups.where(~F.col("kept")).select("doc_id")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where(F.col("doc_id").isNotNull()).count() > groups.count():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        once = left.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("rest"))
        once = once.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))
        left = once.unionByName(left.where(F.col("doc_id").isNull()))
    return left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dup", near_dup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
