"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(name: str = "quarry", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="quarry-package-")
    path = os.path.join(folder, "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in [*sorted((ROOT / "quarry").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(path)
    context._quarry_shipped = True
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint, which cuts the lineage; in the cluster's shared folder where it names one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()
