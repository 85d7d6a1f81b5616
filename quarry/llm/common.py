"""What the operators share: the shared folder, Arrow batch sizes, table access."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches between the JVM and Python hold so many rows and bytes at most, so that a worker's memory does not
#: depend on how long the texts are (one row longer than this makes a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of its own where none is set and all runs on one machine (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(set_dir)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


_temporary: list[list[str]] = []


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """The frame as a table of the shared folder, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _temporary:
        _temporary[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end all tables written inside, but for those whose paths are added to the list it gives."""
    keep: list[str] = []
    _temporary.append([])
    try:
        yield keep
    finally:
        for path in _temporary.pop():
            if path not in keep:
                delete(spark, path)
            elif _temporary:
                _temporary[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_caches: dict[str, Callable[[], None]] = {}
_owner = ""


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Tell how to clear what a module's functions keep in a worker from task to task."""
    _caches[owner] = clear


def lean(run: Callable, owner: str) -> Callable:
    """The function for mapInArrow, in workers that serve many stages: it clears what other modules keep, and gives free
    memory back to the system at the end of a task."""

    def wrapped(batches):
        global _owner
        if _owner != owner:
            _owner = owner
            for name, clear in _caches.items():
                if name != owner:
                    clear()
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every system's library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
