"""Exposure files enriched as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrafoot.operators.matching import Buildings, enrich
from terrafoot.operators.profile import match_summary, merged_summaries
from terrafoot.session import deleted
from terrafoot.sources.footprints import existing


def enrich_stream(stream: DataFrame, lookup: Buildings, output: str, summaries: str, checkpoint: str, lat: str = "lat", lon: str = "lon", mode: str = "inside_nearest", radius: float = 50.0, key: str | None = None) -> StreamingQuery:
    """Starts a query over what is there: each micro-batch is enriched and written, and the summary of all so far with it.

    A batch's results go to a folder of its number and replace what an earlier try left there, so a
    restarted query neither loses nor doubles rows. The running summary of batch n is that of batch
    n - 1 merged with the batch's own, one row; older ones are deleted, since no batch before the last
    is ever tried again. ``lookup`` may be a stored one, whose buildings then stay where they lie.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = enrich(rows, lookup, lat, lon, mode, radius, key)
        done.write.mode("overwrite").parquet(f"{output}/batch={number}")
        total = match_summary(spark.read.parquet(f"{output}/batch={number}"))
        if number and existing(spark, [f"{summaries}/batch={number - 1}"]):
            total = merged_summaries(total.unionByName(spark.read.parquet(f"{summaries}/batch={number - 1}")))
        total.write.mode("overwrite").parquet(f"{summaries}/batch={number}")
        deleted(spark, f"{summaries}/batch={number - 2}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_results(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).drop("batch")


def stream_summary(spark: SparkSession, summaries: str) -> DataFrame:
    """The summary of all batches so far: the last running one."""
    states = spark.read.parquet(summaries)
    last = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == last).drop("batch")
