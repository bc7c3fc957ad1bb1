"""A quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of texts labelled good and one of all texts, give
each document the logarithm of its likelihood ratio. Documents are drawn without replacement in
proportion to that ratio: Gumbel noise is added and the largest keys are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafoot.llm.common import buffers, cut, pieces, ranked
from terrafoot.llm.words import PIECE, mixed, word_hashes

BUCKETS = 10_000
#: Labelled texts of which the target model is made, at most (by a hash of the id).
TARGET_ROWS = 16_384


def ngram_buckets(at: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and bucket of each word and each pair of neighbouring words."""
    firsts, words = word_hashes(at, data)
    n = len(words)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(firsts))
    with np.errstate(over="ignore"):
        pair = mixed(words[:-1] * np.uint64(3) + words[1:]) if n else words
    inside = doc[:-1] == doc[1:]
    docs = np.concatenate([doc, doc[:-1][inside]])
    return docs, (np.concatenate([words, pair[inside]]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            at, data = buffers(batch.column("text"))
            good = np.array(batch.column("good").to_pylist(), bool)
            for s, e in pieces(at, PIECE):
                doc, bucket = ngram_buckets(at[s : e + 1] - at[s], data[at[s] : at[e]], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[s:e][doc]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    return run


def _weights(ratio, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column("text"))
            for s, e in pieces(at, PIECE):
                doc, bucket = ngram_buckets(at[s : e + 1] - at[s], data[at[s] : at[e]], buckets)
                n = e - s
                total = np.zeros(n)
                order = np.argsort(doc, kind="stable")  # sums in the text's own order, whatever else is in the batch
                count = np.bincount(doc, minlength=n)
                has = np.flatnonzero(count)
                if len(has):
                    total[has] = np.add.reduceat(ratio.value[bucket[order]], (np.cumsum(count) - count)[has])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s:e], pa.array(count.astype(np.int64)), pa.array(total)], ["doc_id", "n_grams", "log_weight"])

    return run


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, n_grams, log_weight, gumbel_key, place, kept.

    Kept are the ``share`` of all rows with the largest keys; by default the share of good labels
    (all rows where there are no labels). A text without words, or null, has weight 0 and takes part
    with its noise alone. Noise depends on the id and ``seed``, so runs agree; rows that share an
    id share their noise, ties go to the smaller id, and null ids come last. With no good label the
    target model is uniform. An empty table gives no rows.

    Both models have a fixed size: every task sends one count per bucket. The target's ids that are
    broadcast number ``target_rows`` at most. The cut by place is exact, without a global sort in
    one task.
    """
    spark = docs.sparkSession
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("__good")).where("__good IS NOT NULL").distinct()
    good = good.orderBy(F.xxhash64("__good", F.lit(seed)), "__good").limit(target_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left").select("text", F.col("__good").isNotNull().alias("good"))
    counts = marked.mapInArrow(_counts(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).orderBy("bucket").collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:  # one row for each bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    found = rows.mapInArrow(_weights(spark.sparkContext.broadcast(ratio), buckets), "doc_id long, n_grams long, log_weight double")
    noise = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    found = cut(found.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(noise))), "weights")
    if share is None:
        known = labels.where(F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
        share = 1.0 if known is None else known
    most = round(found.count() * share)
    placed = ranked(found, F.desc("gumbel_key"), F.col("doc_id").asc_nulls_last(), name="place")
    return placed.select("doc_id", "n_grams", "log_weight", "gumbel_key", "place", (F.col("place") < most).alias("kept"))
