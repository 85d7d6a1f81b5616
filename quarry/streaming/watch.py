"""An index that follows a tree: micro-batches compare a scan with the stored manifest.

A file source sees added files only, so each trigger scans the whole tree, and foreachBatch applies the change set: new
version of the manifest and the index together, a compaction where too much is dead. A repeated batch finds nothing changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.maintenance import COMPACT_ABOVE, change_set, compacted, removed
from quarry.sources import store


def apply_changes(spark: SparkSession, files: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], compact_above: float = COMPACT_ABOVE, force: bool = False, parts: int = 1) -> dict[str, int]:
    """Bring manifest and index below root up to date with files (path, content, size, mtime); counts by change.

    build: files to index rows (path and more). is_deleted marks rows of files that changed or went. Manifest and index are
    one version, so that a crash leaves the one before. force builds everything anew. parts: a first or forced build commits
    after each so many-th part of the files (by a hash of the path), and a build that was stopped goes on from there.
    """
    known = store.versions(spark, root)
    now = files.select("path", "size", "mtime")
    if force or not known:
        for k in range(parts):
            some = files if parts == 1 else files.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k)
            index, manifest = build(some).withColumn("is_deleted", F.lit(False)), some.select("path", "size", "mtime")
            if k:
                index, manifest = store.load(spark, root, name="index").unionByName(index), store.load(spark, root, name="manifest").unionByName(manifest)
            store.save_all({"index": index, "manifest": manifest}, root)
        return {"added": now.count()}
    changes = change_set(store.load(spark, root, name="manifest"), now).persist()
    counts = dict(changes.groupBy("change").count().collect())
    if counts:
        old = store.load(spark, root, name="index")
        kept = removed(old, changes.where("change <> 'added'"))
        fresh = build(files.join(changes.where("change <> 'deleted'"), "path", "left_semi")).withColumn("is_deleted", F.lit(False)).select(*old.columns)
        new = compacted(kept.unionByName(fresh), compact_above)
        store.save_all({"index": new, "manifest": now}, root)
    changes.unpersist()
    return counts


def watch(spark: SparkSession, scan: Callable[[], DataFrame], root: str, build: Callable[[DataFrame], DataFrame], every: str = "60 seconds", checkpoint: str | None = None):
    """Start a streaming query that applies changes at each trigger; a rate source is its clock."""

    def batch(_: DataFrame, number: int) -> None:
        apply_changes(spark, scan(), root, build)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(batch).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def status(query) -> dict[str, object]:
    """Whether a watcher runs, and its last batch."""
    last = query.lastProgress or {}
    return {"active": query.isActive, "batch": last.get("batchId"), "rows": last.get("numInputRows")}
