"""Keeping an index current: change sets, tombstones, compaction, latest rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import is_valid
from quarry.operators.learning import numbered
from quarry.session import checkpointed

COMPACT_ABOVE = 0.20


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted) between two snapshots (path, size, mtime)."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.lit(True).alias("o"))
    n = new.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.lit(True).alias("n"))
    differs = ~(F.col("o_size").eqNullSafe(F.col("n_size")) & F.col("o_mtime").eqNullSafe(F.col("n_mtime")))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(differs, "modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def tombstoned(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index with is_deleted set for changed and deleted paths."""
    gone = changes.where(F.col("change").isin("modified", "deleted")).select("path", F.lit(True).alias("__gone"))
    return index.join(gone, "path", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def tombstone_ratio(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n_vectors"), F.count_if("is_deleted").alias("n_deleted"), F.round(F.coalesce(F.count_if("is_deleted") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("ratio"))


def compacted(index: DataFrame, above: float = COMPACT_ABOVE) -> DataFrame:
    """Live rows where more than a share of all is dead; else all rows. The index is computed once."""
    once = checkpointed(index)
    dead, every = once.agg(F.count_if("is_deleted"), F.count("*")).first()
    return once.where(~F.col("is_deleted")) if every and dead / every > above else once


def inserted(index: DataFrame | None, rows: DataFrame, dim: int, order: str = "path", vector: str = "embedding") -> DataFrame:
    """The index with new rows behind it: ids go on from the greatest one in an order, dealt by ranges; rows whose vector is
    not valid are dead from the start."""
    last = -1 if index is None else index.agg(F.max("id")).first()[0]
    last = -1 if last is None else last
    fresh = numbered(rows.withColumn("all_", F.lit(0)), "all_", [order]).withColumn("id", F.col("n") + F.lit(last)).drop("all_", "n")
    fresh = fresh.withColumn("is_deleted", ~is_valid(F.col(vector), dim))
    return fresh if index is None else index.unionByName(fresh)


def removed(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index with the rows of these paths dead."""
    gone = paths.select("path").distinct().withColumn("gone_", F.lit(True))
    return index.join(gone, "path", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone_", F.lit(False))).select(*index.columns)


def pending(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that no indexed path names."""
    return files.join(indexed.select("path").distinct(), "path", "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: an upsert."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def described(files: DataFrame, descriptions: DataFrame, force: bool = False) -> DataFrame:
    """path, content_hash, stale: whether a file needs a new description, by the hash of its content, or by force."""
    now = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    return now.join(descriptions.select("path", F.col("hash").alias("__h")), "path", "left").select("path", "content_hash", (F.lit(force) | ~F.col("__h").eqNullSafe(F.col("content_hash"))).alias("stale"))


def index_counters(files: DataFrame, index: DataFrame, kind: Column) -> DataFrame:
    """kind, n_found, n_indexed, n_skipped, n_invalid: files by a class of theirs, and what became of them."""
    own = index.groupBy("path").agg(F.max("is_deleted").alias("dead_"))
    rows = files.select("path", kind.alias("kind")).join(own, "path", "left")
    known = F.col("dead_").isNotNull()
    return rows.groupBy("kind").agg(F.count("*").alias("n_found"), F.count_if(known & ~F.col("dead_")).alias("n_indexed"), F.count_if(~known).alias("n_skipped"), F.count_if(known & F.col("dead_")).alias("n_invalid"))


def redescribed(files: DataFrame, descriptions: DataFrame, describe: Callable[[DataFrame], DataFrame], now: Column, force: bool = False) -> DataFrame:
    """descriptions (path, hash, description, ts) with new rows for stale files; describe adds a column description to
    (path, content) and may call what it likes. The newest row of a path counts."""
    stale = described(files, descriptions, force).where("stale").select("path", F.col("content_hash").alias("hash"))
    fresh = describe(files.join(stale.select("path"), "path", "left_semi").select("path", "content")).join(stale, "path")
    rows = descriptions.select("path", "hash", "description", "ts").unionByName(fresh.select("path", "hash", "description", now.alias("ts")))
    return latest(rows, ["path"], [F.desc("ts")])
