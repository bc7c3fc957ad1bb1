"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by their first bytes, then by the next ones, until each group is a single
document or has no bytes left. What ends together is equal byte by byte, so no digest decides.
A digit is a run of bytes and each round's is wider than the last, so few rounds are needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.llm.common import SPACE_CLASS, cut

ALL = 2_147_483_647


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 32, growth: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; a null text counts as empty, and all empty
    texts are one group. The longest original (in code points), then the smallest id stays; a null
    id comes after all others. Of rows that agree in both, one stays. Empty input gives no rows.

    The first round deals every text out once by its leading bytes; later rounds hold only texts
    that still share all bytes so far with another. Class sizes are counted with map-side partial
    sums, classes of one row are never written, and the join with them is one that adaptive
    execution splits when a class is hot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("chars"), text.alias("text"))
    head = _squeezed(F.substring("text", 1, 4 * width))
    enough = F.octet_length(head) > width
    whole = _squeezed(F.col("text"))
    rows = rows.select(
        "id", "chars", F.lit(0).cast("long").alias("grp"), F.sha2(whole.cast("binary"), 256).alias("sha"), whole.cast("binary").alias("rest"),
        F.when(enough, F.substring(head.cast("binary"), 1, width)).otherwise(F.substring(whole.cast("binary"), 1, width)).alias("digit"),
        F.when(enough, F.lit(False)).otherwise(F.octet_length(whole) <= width).alias("ended"),
    )
    settled: list[DataFrame] = []
    key = ["grp", "digit", "ended"]
    while True:
        classes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        classes = cut(classes.withColumn("name", F.monotonically_increasing_id()), "radix-classes")
        step = rows.join(classes.hint("merge"), key, "left").select(
            "id", "chars", "sha", "n", F.coalesce(F.col("n").isNull() | F.col("ended"), F.lit(True)).alias("done"), F.col("name").alias("grp"),
            F.when(F.col("n").isNotNull() & ~F.col("ended"), F.substring("rest", width + 1, ALL)).alias("rest"),
            F.monotonically_increasing_id().alias("row"), F.lit(len(settled)).alias("round"),
        )
        step = cut(step, "radix-rows")
        settled.append(step.where("done").drop("rest", "done"))
        rows = step.where("NOT done")
        if rows.isEmpty():
            break
        width *= growth
        rows = rows.select("id", "chars", "sha", "grp", "rest", F.substring("rest", 1, width).alias("digit"), (F.octet_length("rest") <= width).alias("ended"))
    found = reduce(DataFrame.unionAll, settled)
    alone = found.where("n IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    members = found.where("n IS NOT NULL")
    best = F.max(F.struct("chars", F.col("id").isNotNull().alias("has"), (-F.col("id")).alias("neg"), F.col("row"), F.col("id")))
    keepers = cut(members.groupBy("round", "grp").agg(best.alias("best")), "radix-keepers")
    shared = members.join(keepers.hint("merge"), ["round", "grp"]).select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionAll(shared)
