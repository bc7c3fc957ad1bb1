"""Helpers shared by the corpus operators: global ranks, text splitting, batches as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafoot.session import materialised as cut

#: White space that separates words: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def local(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """A few rows of the driver as a table, sent by Arrow: no task starts a Python worker for them."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Adds the row's 0-based place in the global order, without sorting in one task.

    The sort deals ranges out over partitions; only the partitions' row counts, one row each, are
    summed up in one place.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", place), "ranked")
    parts = rows.groupBy("__part").agg((F.max("__place") + 1).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(parts, "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and UTF-8 bytes of a string column; a null has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and at[-1] > at[0] else np.zeros(int(at[-1]), np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def pieces(at: np.ndarray, most: int):
    """Runs (first, end) of rows with about ``most`` bytes in all; a longer row stands alone."""
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end
        first = end
