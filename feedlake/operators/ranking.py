"""Positions within a group that may be larger than any one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from feedlake.session import materialise


def _sorted(df: DataFrame, group: str, order: list[Column], keep: list[str]) -> DataFrame:
    """Range-partitioned and sorted rows, with their task and a number that rises within it."""
    keys = [F.col(group), *order]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        group, *keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")
    )


def _before(group: str) -> WindowSpec:
    """All earlier tasks of a group: at most one row per task and group stands in such a window."""
    return Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def rank_within(df: DataFrame, group: str, order: list[Column], keep: list[str], name: str = "rank") -> DataFrame:
    """``group``, ``keep`` and the 1-based position of each row within its group.

    A window over ``group`` would put a feed with a third of all rows into one task.
    Here the rows are range-partitioned by (group, order), so a large group spreads over
    many tasks; the sorted rows are written once, and the only thing added up afterwards
    is one count per (task, group). ``order`` must be a total order within the group.
    """
    placed = materialise(_sorted(df, group, order, keep), "rank")
    starts = (
        placed.groupBy(group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select(group, "_part", "_first", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)).alias("_before"))
    )
    return placed.join(starts, [group, "_part"]).select(
        group,
        *keep,
        (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(name),
    )


def _summed(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Adds ``_sum``: what the earlier rows of the same group and task add up to. Rows must be sorted by group."""
    schema = StructType([*rows.schema, StructField("_sum", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0  # the group of the row before, as a list of one, and its sum so far
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(group)
            codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            begins = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
            sizes = batch.column(size).to_numpy()
            upto = np.cumsum(sizes)
            lengths = np.diff(np.append(begins, len(codes)))
            base = upto[begins] - sizes[begins]
            if last == names[:1].to_pylist():
                base[0] -= total
            sums = upto - sizes - np.repeat(base, lengths)
            last, total = names[-1:].to_pylist(), int(sums[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "_sum"])

    return rows.mapInArrow(run, schema)


def measured_within(df: DataFrame, group: str, order: list[Column], keep: list[str], size: str) -> DataFrame:
    """``group``, ``keep``, ``rank`` (from 1) and ``before``: the sum of ``size`` over the earlier rows of the group.

    A prefix sum in two steps, as in ``rank_within``: every task adds up its own sorted rows as they pass, then one total per
    (task, group) is added up over the tasks. Rows travel once, and no window holds a group's rows.
    """
    placed = _sorted(df, group, order, [*keep, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size")])
    placed = materialise(_summed(placed, group, "_size"), "rank")
    starts = (
        placed.groupBy(group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.sum("_size").alias("_all"))
        .select(
            group,
            "_part",
            "_first",
            F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)).alias("_rows"),
            F.coalesce(F.sum("_all").over(_before(group)), F.lit(0)).alias("_base"),
        )
    )
    return placed.join(starts, [group, "_part"]).select(
        group,
        *keep,
        (F.col("_rows") + F.col("_row") - F.col("_first") + 1).alias("rank"),
        (F.col("_base") + F.col("_sum")).alias("before"),
    )
