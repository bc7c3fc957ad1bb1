"""From raw documents to token ids in five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafoot.llm.common import cut, table
from terrafoot.llm.language_id import fit, held_out, recognised
from terrafoot.llm.line_dedup import line_dedup
from terrafoot.llm.mixing import mix
from terrafoot.llm.near_dedup import keep_one
from terrafoot.llm.queries import SENTENCEPIECE_MODEL
from terrafoot.llm.sentencepiece_codec import encode


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those whose language is recognised with a score below 0.5.

    Learns from rows that have a language and an id outside the held-out fifth; without any, every
    document is rejected, as none can be recognised. A null or empty text is rejected. Rows with a
    null id are judged like all others, repeated rows one by one. An empty table stays empty.
    """
    return recognised(docs, fit(docs, ~held_out() & F.col("doc_id").isNotNull()))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that recur in three documents or more, but where the largest id holds them.

    Documents that lost all their words go; n_chars is counted anew for those that lost lines. A null
    or empty text loses nothing and stays as it is. Rows that share an id are one document to the
    count, a null id is the smallest. An empty table stays empty.
    """
    rows = line_dedup(docs)
    lost = F.col("__n_dropped") > 0
    text = F.when(lost, F.col("__kept")).otherwise(F.col("text"))
    changed = {"text": text, **({"n_chars": F.when(lost, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})}
    return rows.where(~lost | F.col("__kept").rlike(r"[^\x20\x09-\x0D]")).withColumns(changed).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate group: shingles of five words, similarity 0.8.

    Null, empty and blank texts are in no group and stay. Of rows with equal id and text one stays;
    rows with a null id stay where their whole group has none. An empty table stays empty.
    """
    return keep_one(docs, k=5, similarity=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document goes out as often as its rate was rounded to.

    A document without words, a null text too, weighs nothing and is taken no time; a null source is a
    source of its own. Repeated rows are separate documents. An empty table stays empty.
    """
    rows = mix(docs, carry=True)
    copies = F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return rows.select(*docs.columns, F.explode(copies).alias("__copy")).drop("__copy")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids, round_trip.

    A null or empty text has no ids. Repeated rows stay repeated; an empty table gives no rows.
    """
    return encode(docs, SENTENCEPIECE_MODEL)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Training, sketches and tokens are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
