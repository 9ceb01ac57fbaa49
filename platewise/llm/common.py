"""Column helpers, shared tables and orderings used by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import write_and_read

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points for str.translate, bytes for bytes.translate: A-Z only.
FOLD = str.maketrans(UPPER, LOWER)
FOLD_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: a lineage cut that outlives executors."""
    return write_and_read(df, name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batches(it: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that very long texts do not add up in a worker."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows dealt into ranges of `order`, with `__range` (ranges ascend) and sorted inside each range.

    The assignment is written down once: a range partitioning samples its input, and a second evaluation
    need not choose the same bounds.
    """
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    return shared(dealt.sortWithinPartitions(*order), name)


def numbered_by_range(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """Positions 0, 1, ... along `order` over the whole frame, counted in two levels: rows within each range,
    then offsets over one row per range."""
    rows = ranged(df, order, name)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_total(sizes, "__range", "__n", "__before").select("__range", "__before")
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return (rows.withColumn("__at", within).join(F.broadcast(offsets), "__range")
            .withColumn(out, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before"))


def running_total(totals: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over smaller keys.  For frames with one row per partition or range of a job only: these
    are counted in thousands however long the table is, which also bounds their broadcast."""
    before = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column without copying single texts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data
