"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import spatial

#: Rows in one Arrow batch: a batch of the longest texts must still fit a worker; and where rows are packed blobs.
ARROW_ROWS, BLOB_ROWS = 256, 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ``ARROW_ROWS``, for results that run after they are returned."""
    if not 0 < int(spark.conf.get(_ROWS)) <= ARROW_ROWS:
        spark.conf.set(_ROWS, str(ARROW_ROWS))


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def released() -> None:
    """Give memory that a Python worker no longer uses back to the system: idle workers stay, and count for their executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_waiting: dict[Callable, threading.Timer] = {}


@contextmanager
def lent(make: Callable, *given: object, idle: float = 1.5) -> Iterator:
    """What ``make``, an ``lru_cache`` of one, has for this worker process, so that a task finds what earlier ones have learned.

    It is given up once no task has asked for it for ``idle`` seconds: workers outlive the job, and later ones need their memory.
    """
    if before := _waiting.pop(make, None):
        before.cancel()
    try:
        yield make(*given)
    finally:
        _waiting[make] = timer = threading.Timer(idle, _given_up, [make])
        timer.daemon = True
        timer.start()


def _given_up(make: Callable) -> None:
    make.cache_clear()
    released()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder, which all executors reach."""
    return f"{spatial.shared(spark)}/wayfold/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, rows: int = ARROW_ROWS, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Arrow batches of the job have ``rows`` rows at most; tables of packed blobs, of about a megabyte a row, ask for few.
    With ``by``, the table's last column, rows of different values lie apart, and filters on it leave out whole files.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    with batches_of(spark, rows):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def parts(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
