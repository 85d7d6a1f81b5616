"""Versioned Parquet tables: a write is a new version folder of one or more tables, which counts once it is whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Whole versions: those whose last step, the mark, was made."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{root}/{n}/_SUCCESS")))


def _claimed(spark: SparkSession, root: str) -> int:
    """The next version, claimed by a file that only one writer can create."""
    fs, path = _fs(spark, root)
    fs.mkdirs(path(root))
    version = max([0, *versions(spark, root)]) + 1
    while True:
        try:
            fs.create(path(f"{root}/claim-{version}"), False).close()
            return version
        except Exception as e:  # noqa: BLE001  another writer has it
            if "exist" not in str(e).lower():
                raise
            version += 1


def save_all(tables: dict[str, DataFrame], root: str) -> int:
    """Write the next version of several tables; readers see all of them or none."""
    spark = next(iter(tables.values())).sparkSession
    version = _claimed(spark, root)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}" if name else f"{root}/v={version}")
    if "" not in tables:
        fs, path = _fs(spark, root)
        fs.create(path(f"{root}/v={version}/_SUCCESS"), True).close()
    return version


def save(df: DataFrame, root: str) -> int:
    """Write the next version of a single table."""
    return save_all({"": df}, root)


def load(spark: SparkSession, root: str, version: int | None = None, schema=None, name: str = "") -> DataFrame:
    """A table of a version, by default the last whole one. A schema that differs raises ValueError: the caller reindexes."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(root)
    df = spark.read.parquet(f"{root}/v={version or known[-1]}/{name}".rstrip("/"))
    if schema is not None and {(f.name, f.dataType.simpleString()) for f in df.schema} != {(f.name, f.dataType.simpleString()) for f in schema}:
        raise ValueError("the stored table has another schema")
    return df


def load_or_rebuild(spark: SparkSession, root: str, schema, rebuild: Callable[[], DataFrame]) -> DataFrame:
    """The stored table; where there is none, or one of another schema, a new version of it is built beside the old one,
    which stays until prune()."""
    try:
        return load(spark, root, schema=schema)
    except (FileNotFoundError, ValueError):
        save(rebuild(), root)
        return load(spark, root, schema=schema)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the last whole versions; gives those deleted."""
    fs, path = _fs(spark, root)
    gone = versions(spark, root)[: -max(1, keep)]
    for v in gone:
        fs.delete(path(f"{root}/v={v}"), True)
        fs.delete(path(f"{root}/claim-{v}"), False)
    return gone


def upsert(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """current with rows put in by key."""
    return current.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def remove(current: DataFrame, keys: DataFrame) -> DataFrame:
    return current.join(keys, keys.columns, "left_anti")


def stats(index: DataFrame) -> DataFrame:
    """Live vectors and files."""
    dead = F.col("is_deleted") if "is_deleted" in index.columns else F.lit(False)
    return index.agg(F.count_if(~dead).alias("n_live"), F.count_if(dead).alias("n_deleted"), F.countDistinct(F.when(~dead, F.col("path"))).alias("n_files"))
