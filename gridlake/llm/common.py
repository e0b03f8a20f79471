"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows a batch handed to Python; texts average a few kB, so a batch stays in the tens of MB.
ARROW_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "gridlake-shared")
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df below the shared folder and read it back.

    Lost executors cost a re-read of the files and not a second run of what made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridlake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows an Arrow batch holds; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def _release() -> None:
    """Give freed memory back: Python workers live on after their tasks, and so would what they held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """run, a function of batches for mapInArrow, with its memory released after each task."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied


def tidy_group(run):
    """The same for a function of one table for applyInArrow."""

    @functools.wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _release()

    return tidied


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Add a gapless number from 0 within each value of keys, without gathering a key in one task.

    Rows of a key are dealt over hash buckets of the order columns; a number is the place within the
    bucket plus the sizes of the buckets before it, so a key with a third of all rows is still split.
    Both halves read one exchange. Repeated rows get different numbers; which one is which is open.
    """
    n = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [*keys, "__bucket"]
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")).repartition(*at)
    sizes = dealt.groupBy(*at).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*at, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    return (
        dealt.withColumn("__place", place)
        .join(starts, at)
        .withColumn(out, F.col("__start") + F.col("__place") - 1)
        .drop("__bucket", "__place", "__start")
    )


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
        column = column if pa.types.is_string(column.type) else column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between offsets; 0 for an empty stretch."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text stands alone."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            out.append((start, i))
            start, held = i, 0
        held += size
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
