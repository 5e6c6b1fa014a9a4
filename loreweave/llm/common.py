"""What the corpus operators share: inputs made safe, shared tables, Arrow text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources.shared import shared_dir, stored  # noqa: F401 - what the operators write is theirs to share

#: A null doc_id takes part as this one and is given back as null.
NO_ID = 2**63 - 1
#: Bytes of text that a task works on at a time.
BLOCK_BYTES = 1 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def real_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text) with no nulls; every other column is left behind, whatever its name."""
    return docs.select(doc_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def byte_rows(column: pa.Array) -> Iterator[bytes]:
    """Row by row, the bytes of a string column (null: empty)."""
    body, at = utf8(column)
    whole = body.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield whole[a:b]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts have most bytes together; a longer text is a slice of its own."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        low, n = 0, batch.num_rows
        while low < n:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def packed(values: np.ndarray) -> bytes:
    """64-bit values as bytes, byte planes apart, so that shared high bytes compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()
