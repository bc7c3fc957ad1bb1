"""Removal of lines that recur across documents.

Hashes of line keys are dealt out by range and sorted by (hash, document, position), so one pass over
each range sees a key's documents from the largest id on and streams out the lines to drop. A key
that fills whole ranges is cut by document as well; ranges pass on a summary of their first and last
key, and only those keys are settled in a second step. The result is a compressed keep bitmap per
document that loses lines; texts are not moved to find it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.llm.common import buffers, cut, pieces

BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DROP, OPEN, SEEN = 0, 1, 2
#: Bytes of texts that are split at a time.
CHUNK = 1 << 20


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _line_hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = buffers(batch.column("text"))
            for s, e in pieces(at, CHUNK):
                ids, places, hashes = [], [], []
                for i, text in enumerate(batch.column("text")[s:e].to_pylist(), s):
                    for pos, line in enumerate((text or "").encode().split(b"\n")):
                        if len(line) < least:
                            continue
                        line = line.strip(BLANKS).translate(LOWER)
                        if len(line) >= least and (len(line) >= 4 * least or len(line.decode()) >= least):
                            ids.append(i), places.append(pos), hashes.append(hashlib.blake2b(line, digest_size=16).digest())
                rows = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("key").take(rows), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())], ["id", "key", "pos", "hash"])

    return run


def _worth_a_look(hashes: pa.Array, docs: int) -> np.ndarray:
    """The rows of a sorted batch whose key has ``docs`` lines or more, or may go on in another batch."""
    flat = np.frombuffer(hashes.cast(pa.binary(16)).buffers()[1], np.uint64).reshape(-1, 2)[hashes.offset : hashes.offset + len(hashes)]
    starts = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]).any(1)]))
    lens = np.diff(np.append(starts, len(flat)))
    chosen = lens >= docs
    chosen[[0, -1]] = True
    return np.flatnonzero(np.repeat(chosen, lens))


def _stream(docs: int):
    """Rows of a sorted range in; lines to drop, lines of keys that may go on elsewhere, and summaries out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first_run, seen, pending = None, True, [], []
        names = ["id", "key", "pos", "hash", "kind"]

        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names)

        for part in batches:
            if not part.num_rows:
                continue
            out, part = [], part.take(pa.array(_worth_a_look(part.column("hash"), docs)))
            for doc, key, pos, h in zip(*(part.column(c).to_pylist() for c in ("id", "key", "pos", "hash")), strict=True):
                if h != now:
                    if now is not None and first_run:
                        out += [(d, None, None, now, SEEN) for d in seen]
                        first_run = False
                    now, seen, pending = h, [], []
                if doc not in seen and len(seen) < docs:
                    seen.append(doc)
                    if len(seen) == docs and not first_run:
                        out += pending
                        pending = []
                if first_run:
                    out.append((doc, key, pos, h, OPEN))
                elif doc != seen[0]:
                    (out if len(seen) == docs else pending).append((doc, key, pos, h, DROP))
            yield batch(out)
        if now is not None:
            yield batch([(d, None, None, now, SEEN) for d in seen] + [(*x[:4], OPEN) for x in pending])

    return run


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """(id, key, bitmap, dropped) for each document that loses lines; others have no row.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``least`` code points that occur in ``documents`` documents or more lose all their lines but
    those of the largest id (a null id is the smallest). Rows that share an id are one document to
    the count; ``key`` tells their texts apart. The bitmap (zlib over packed bits, 1 = keep) ends
    with the last dropped line.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    lines = cut(rows.mapInArrow(_line_hashes(least), "id long, key long, pos int, hash binary"), "line-hashes")
    order = [F.col("hash"), F.col("id").desc_nulls_last(), F.col("key"), F.col("pos")]
    found = cut(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(documents), "id long, key long, pos int, hash binary, kind int"), "line-runs")
    spanning = found.where(F.col("kind") == SEEN).groupBy("hash").agg(F.max("id").alias("last"), F.count_distinct(F.struct("id")).alias("n")).where(F.col("n") >= documents)
    # at most two keys for each range of the shuffle
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(spanning), "hash").where(~F.col("id").eqNullSafe(F.col("last")))
    drops = found.where(F.col("kind") == DROP).select("id", "key", "pos").unionAll(late.select("id", "key", "pos"))
    drops = drops.groupBy("id", "key").agg(F.collect_set("pos").alias("at"))

    @F.arrow_udf("binary")
    def bitmap(at: pa.Array) -> pa.Array:
        def packed(lines):
            bits = np.ones(-(-(max(lines) + 1) // 8) * 8, np.uint8)
            bits[lines] = 0
            return zlib.compress(np.packbits(bits).tobytes(), 1)

        return pa.array([packed(x.values.to_numpy()) for x in at], pa.binary())

    return cut(drops.select("id", "key", F.size("at").cast("long").alias("dropped"), bitmap("at").alias("bitmap")), "line-bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with __n_lines, __n_dropped and __kept (the lines that stay, joined by line feeds).

    A null or empty text is one empty line and is kept as an empty text. Only texts that lose lines
    go through Python.
    """
    text = F.col(text_col)
    rows = docs.withColumn("__key", text_key(text))
    marks = bitmaps.select(F.col("id").alias("__id"), F.col("key").alias("__mark"), F.col("dropped").alias("__dropped"), F.col("bitmap").alias("__bitmap"))
    rows = rows.join(marks.hint("merge"), (F.col("__key") == F.col("__mark")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")

    @F.arrow_udf("string")
    def kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
        def one(text, bits):
            if text is None or bits is None:
                return None
            lines = text.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)]
            return "\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])

        return pa.array((one(a.as_py(), b.as_py()) for a, b in zip(text, bitmap, strict=True)), pa.string())

    kept = kept.asNondeterministic()  # a later filter on the kept text then doesn't run it a second time
    changed = kept(F.when(F.col("__bitmap").isNotNull(), text), "__bitmap")
    lines = F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1, F.lit(1)).cast("long")
    rows = rows.withColumns({"__n_lines": lines, "__n_dropped": F.coalesce("__dropped", F.lit(0).cast("long")), "__kept": F.coalesce(changed, text, F.lit(""))})
    return rows.drop("__key", "__id", "__mark", "__dropped", "__bitmap")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """All rows of ``docs`` with __n_lines, __n_dropped and __kept; see the two functions above.

    Texts of any length are read whole. Repeated rows stay repeated; an empty table gives no rows.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, least, documents), id_col, text_col)
