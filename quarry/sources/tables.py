"""Corpus, index and event views over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, size: documents as addressed files."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.col("n_chars").alias("size"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, component_type."""
    kind = F.concat(F.lit("label_"), F.col("label").cast("string"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", kind.alias("component_type"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, search_text: what the document of a vector adds."""
    return corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), "path", F.col("content").alias("search_text"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, as the driver-side literal of a search."""
    row = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise LookupError(f"no vector {vec_id}")
    return [float(x) for x in row[0]]


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts, tool: the event log as tool calls; a view is a search."""
    tool = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "find_plugin").when(F.col("event_type") == "purchase", "trace_flow").when(F.col("event_type") == "signup", "find_class")
    return read(spark, sf_dir, "events").select("user_id", "event_id", "ts", tool.alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("k"))
