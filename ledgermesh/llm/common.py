"""Shared helpers: table access, Arrow batch handling, memory of workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import materialize, shared_dir

__all__ = ["free_name", "map_arrow", "materialize", "numbered", "release_memory", "shared_dir", "table", "text_batches", "utf8_buffers", "worker_cache"]

#: Bytes in one Arrow batch; keeps a batch of long documents within a worker's memory.
TEXT_BATCH_BYTES = 4 << 20
#: What drops the caches that workers keep for an operator.
_CACHES: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def worker_cache(drop: Callable[[], None]) -> None:
    """Registers how to drop a cache that outlives a task, so that other operators do not carry it along."""
    _CACHES.append(drop)


def release_memory(keep_caches: bool = False) -> None:
    """Gives freed memory of this worker back to the system; workers wait for further tasks with what they hold."""
    import ctypes
    import gc

    if not keep_caches:
        for drop in _CACHES:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, keep_caches: bool = False) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(keep_caches)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
        release_memory(keep_caches)

    return df.mapInArrow(run, schema)


def utf8_buffers(column: pa.Array):
    """(bytes of all values, offsets) of a string or binary array as numpy arrays, nulls as empty values."""
    import numpy as np

    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or one like it that no column has."""
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """``docs(doc_id, text, ...)`` -> all its columns and ``name``, a unique number that orders the rows as doc_id does.

    It is doc_id itself where that is unique and never null. Otherwise rows are sorted by doc_id (nulls
    first), text and the other columns and numbered: a row that repeats another is then a document of its
    own, after it.
    """
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    doubtful = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if doubtful.isEmpty():
        return rows.withColumn(name, F.col("doc_id"))
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    return materialize(rows.orderBy("doc_id", "text", *others).withColumn(name, F.monotonically_increasing_id()), "numbered")
