"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to numpy at once; larger single texts form a piece of their own.
PIECE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark runs on one
    machine a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not base:
        base = f"file://{tempfile.gettempdir()}/lodestar-shared"
    return f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


#: What ``staged`` wrote and nobody has removed: results that are read later need it until the driver ends.
_left: dict[str, SparkSession] = {}


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    Removed by ``unstage``, or else when the driver ends."""
    path = shared_folder(df.sparkSession)
    if not _left:
        atexit.register(_remove_left)
    _left[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_left() -> None:
    while _left:
        path, spark = _left.popitem()
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _remove(spark, path)


def unstage(df: DataFrame) -> None:
    """Remove what ``staged`` wrote, once nothing reads it any more."""
    _left.pop(df.staged_path, None)
    _remove(df.sparkSession, df.staged_path)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bucket_count(docs: DataFrame, text_col: str, bytes_per_bucket: int, least: int) -> int:
    """Buckets for which no bucket holds much more than ``bytes_per_bucket``: grows with the data, at least ``least``."""
    total = docs.agg(F.sum(text_bytes(F.col(text_col)))).first()[0] or 0
    return max(least, -(-total // bytes_per_bucket))


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches again, cut so that each piece holds at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(text_col)).to_pylist()


def release() -> None:
    """Give back to the system what this worker has freed: Spark keeps workers, and one executor's share the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory once its partition is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def tidy_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same of a function of one group (or two, side by side)."""
    if run.__code__.co_argcount == 2:
        return lambda one, other: (run(one, other), release())[0]
    return lambda table: (run(table), release())[0]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts come to Python in batches of so many rows, where the session has Spark's default of 10,000.

    A batch stands in memory several times, in the executor and in its workers. Stays set: Spark reads it when it plans.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
