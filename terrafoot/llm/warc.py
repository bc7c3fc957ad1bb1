"""A content-addressed WARC archive.

Each payload is stored once under its SHA-256; the records' header blocks are kept apart, byte for
byte, and records are put together again by joining the two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafoot.session import shared_dir

CRLF = "\r\n"


def _record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _field(headers: Column, name: str) -> Column:
    found = F.regexp_extract(headers, f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``path/payloads`` (digest, payload, bytes, holder) and ``path/records`` (headers, digest).

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest id is the
    response and the others revisit it; smaller payloads are stored once as well, but all their
    records are responses. A null payload is empty, a null id comes last, a null URL is left out of
    the header (line breaks in URLs are encoded). Rows that repeat the smallest id are responses.

    Payload copies meet in map-side aggregates first, so one payload in very many pages is not
    shuffled row by row; the records themselves never carry a payload.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("holder")).withColumn("bytes", F.octet_length("payload").cast("long")).write.parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "holder", "bytes")
    rows = rows.select("page_id", "url", "digest").join(stored, "digest")
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    headers = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_uri(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Refers-To", F.when(revisit, _record_uri(F.col("holder")))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    rows.select(headers.cast("binary").alias("headers"), "digest").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archived records again: page_id, url, record_type, refers_to, payload, payload_digest, record.

    ``payload`` is the full payload, a revisit's too; ``record`` holds the exact bytes of the WARC
    record. Every payload's digest is computed anew, and a payload that is missing, or has another
    digest or length than its record says, raises an error.
    """
    headers = F.decode(F.col("headers"), "UTF-8")
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    stored = stored.withColumn("proved", F.sha2("payload", 256))
    rows = spark.read.parquet(f"{path}/records").withColumn("text", headers).join(stored, "digest", "left")
    said = F.regexp_replace(_field(F.col("text"), "WARC-Payload-Digest"), "^sha256:", "")
    kind = _field(F.col("text"), "WARC-Type")
    block = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    sound = F.col("proved").eqNullSafe(said) & (F.octet_length(block) == _field(F.col("text"), "Content-Length").cast("long"))
    return rows.select(
        F.regexp_extract(_field(F.col("text"), "WARC-Record-ID"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"),
        _field(F.col("text"), "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        F.regexp_extract(_field(F.col("text"), "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
        F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("archive is damaged at payload "), "digest")).cast("binary")).alias("payload"),
        F.col("proved").alias("payload_digest"),
        F.concat("headers", block, F.lit((CRLF * 2).encode())).alias("record"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Writes records of :func:`read_archive` as plain ``.warc`` text parts, one after another."""
    body = F.decode(F.col("record"), "UTF-8")
    records.select(F.substring(body, F.lit(1), F.char_length(body) - 4).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages in the shared folder and reads the archive back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
