"""Materialised intermediates in the folder that all machines of a cluster share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # folders made for local sessions, by application


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder (spark.checkpoint.dir).

    Where none is set, a session on this machine alone (local master) gets a
    folder of its own; on a cluster that is an error, as machines don't share
    their disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spanlab-')}")


#: Bytes of rows that are sent to a Python worker together (Spark's default is 64 MB, in the JVM and the worker alike).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends its rows to Python in batches of about BATCH_BYTES; the session's setting comes back after it."""
    old = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if old is None else spark.conf.set(_BATCH, old)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function for mapInArrow, after which an idle worker doesn't keep what the task had."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def put(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a reader of it: lineage ends here."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove what put() wrote; df must not be read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def tasks(df: DataFrame) -> int:
    """Number of shuffle partitions that suits df: follows the input's splits, never under the session's setting."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
