"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import checkpointed, shared_checkpoint_dir

__all__ = ["checkpointed", "documents", "input_bytes", "parts_for", "shared_checkpoint_dir", "ship_package", "small_batches", "text_bytes"]

#: Sizes from Catalyst's statistics above this are defaults, not measurements.
_UNKNOWN_BYTES = 1 << 50


def ship_package(spark: SparkSession) -> None:
    """The package for the Python workers, and batches of bounded bytes for its texts."""
    runtime.ship_package(spark)
    runtime.bound_batches(spark)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; only ever used to choose a number of parts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < _UNKNOWN_BYTES else 0


def parts_for(df: DataFrame, bytes_per_part: int, least: int = 8) -> int:
    """How many parts of about ``bytes_per_part`` stored bytes a table needs.

    The result steers distribution alone: operators return the same rows for any value.
    """
    size = input_bytes(df)
    if not size:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // bytes_per_part))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names, with null texts as empty ones."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in extra],
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches: Iterator[pa.RecordBatch], text_index: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` text bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(text_bytes(batch.column(text_index))[1]))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
