"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at once (one longer text is held alone).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (null: empty)."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields plain columns; ``schema`` gives their types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, parsed)


def append_columns(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """All columns of ``df`` and those that ``function`` computes for a slice of rows.

    A column of ``df`` that has the name of a new one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    taken = {n.lower() for n in new.names}
    df = df.select([f"`{c}`" for c in df.columns if c.lower() not in taken])
    whole = StructType([*df.schema, *new])
    arrow = to_arrow_schema(whole)
    added = list(arrow)[len(df.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column):
            found = function(batch)
            own = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[f.name], f.type) for f in added)], schema=arrow)

    return df.mapInArrow(run, whole)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now.

    It does so when the driver's garbage collector has found their plans unused, which may be long after; between
    two large steps that would keep the files of both on the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def thinned(rows: DataFrame, wanted: int) -> DataFrame:
    """About four times ``wanted`` rows by a hash of their values, or all if there are fewer.

    Before a sorted sample of ``wanted`` rows: else every task would send the driver so many.
    """
    total = rows.count()
    if total <= 4 * wanted:
        return rows
    hashed = F.pmod(F.xxhash64(*(f"`{c}`" for c in rows.columns)), F.lit(1 << 40))
    return rows.where(hashed < F.lit((1 << 40) * 4 * wanted // total))
