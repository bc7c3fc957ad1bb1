"""Exposure tables in and out as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafoot.session import materialised

#: Escape and quote rules that write what CSV readers read back.
CSV = {"header": True, "quote": '"', "escape": '"'}
#: Holds a line that doesn't fit its columns.
BAD = "__bad"


def read_exposures(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Every column as text, as in the file; lines inside quotes stay together."""
    return spark.read.options(**CSV).option("encoding", encoding).option("multiLine", multi_line).csv(path)


def read_exposures_typed(spark: SparkSession, path: str, ratio: float = 1.0, encoding: str = "UTF-8") -> DataFrame:
    """Column types inferred from a share of the rows; malformed rows are dropped."""
    return spark.read.options(**CSV).option("encoding", encoding).option("inferSchema", True).option("samplingRatio", ratio).option("mode", "DROPMALFORMED").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_number (from 1) and line of all text files below ``path``, without a global sort: only counts of file blocks are summed up."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    rows = materialised(rows.withColumn("__at", F.monotonically_increasing_id()), "lines")
    blocks = rows.groupBy("file_path", "file_block_start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    number = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return rows.join(blocks, ["file_path", "file_block_start"]).select(F.col("file_path").alias("file"), number.alias("line_number"), F.col("value").alias("line"))


def read_exposures_checked(spark: SparkSession, path: str, ratio: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): typed rows, and file, line_number and line of what :func:`read_exposures_typed` would drop.

    Every line but the first of each file, its header, and blank ones, is in one of both. Files are
    UTF-8, all with the same columns, and a record is a line. A line is rejected for too many or too
    few fields, or a value that is not of its column's type.
    """
    schema = read_exposures_typed(spark, path, ratio).schema
    lines = materialised(numbered_lines(spark, path).where((F.col("line_number") > 1) & (F.trim("line") != "")), "lines")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {BAD} string"
    rules = {k: v for k, v in CSV.items() if k != "header"} | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = lines.withColumn("row", F.from_csv("line", ddl, rules))
    accepted = parsed.where(F.col(f"row.{BAD}").isNull()).select(*[F.col("row").getField(f.name).alias(f.name) for f in schema])
    return accepted, parsed.where(F.col(f"row.{BAD}").isNotNull()).select("file", "line_number", "line")


def write_exposures(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV parts, each with a header; null and empty text are told apart."""
    df.write.mode(mode).options(**CSV).option("emptyValue", '""').csv(path)
