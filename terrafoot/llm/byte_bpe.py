"""Byte-level BPE with a rank queue.

The tokens of a pre-token are a doubly linked list. Each pair that is in the vocabulary waits in the
bucket of its rank; a bitmap of two levels marks the buckets that hold something, so the next rank is
found by two find-first-set steps. A merge changes the list and adds at most two pairs; what a bucket
still holds of pairs that are gone is skipped when it comes up. The work of a pre-token grows with
its length times the logarithm of a bucket, however long it is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word of the bitmap's lower level has 2 ** WORD bits.
WORD, LOW = 8, 255
#: Characters of a text that are split at a time; pre-tokens that are remembered in each of two generations, and the longest of them.
SLICE, KNOWN, SHORT = 1 << 18, 1 << 19, 48
#: A place between pre-tokens of the byte-level pattern: white space after something else. Pre-tokens hold white space at their start only.
BOUND = regex.compile(r"(?<=\S)\s")


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, dict(zip(ranks.values(), ranks, strict=True))
        if missing := [x for x in range(256) if bytes([x]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.single = [ranks[bytes([x])] for x in range(256)]
        self.pair = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.memo = _Memo(self)
        sizes = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            sizes[rank + 1] = len(token)
        self.at = np.cumsum(sizes)
        self.flat = np.frombuffer(b"".join(self.bytes[r] for r in sorted(self.bytes)), np.uint8)

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank is merged, the leftmost first, until none is left."""
        ranks, name, n = self.ranks, self.bytes, len(data)
        if (whole := ranks.get(data)) is not None:
            return [whole]
        ids = [self.single[x] for x in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [self.pair[a * 256 + b] for a, b in pairwise(data)]
        rank_at.append(-1)  # the rank of the pair that begins at a position, -1 where there is none
        # the queue: positions by rank, the bits of ranks that have some, and the bits of words of such bits
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i, rank in enumerate(rank_at):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # in order, so a heap
                else:
                    buckets[rank] = [i]
                    w = rank >> WORD
                    words[w] = words.get(w, 0) | 1 << (rank & LOW)
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            bit = bits & -bits
            rank = (w << WORD) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                if bits := bits ^ bit:
                    words[w] = bits
                else:
                    del words[w]
                    top ^= 1 << w
            if rank_at[i] != rank:  # a stale entry
                continue
            j = after[i]
            k = after[j]
            ids[i], rank_at[j], after[i] = rank, -1, k
            own, changed = name[rank], []
            if k < n:
                before[k] = i
                rank_at[i] = new = ranks.get(own + name[ids[k]], -1)
                if new >= 0:
                    changed.append((new, i))
            else:
                rank_at[i] = -1
            if (h := before[i]) >= 0:
                rank_at[h] = new = ranks.get(name[ids[h]] + own, -1)
                if new >= 0:
                    changed.append((new, h))
            for new, h in changed:
                if new in buckets:
                    heappush(buckets[new], h)
                else:
                    buckets[new] = [h]
                    w = new >> WORD
                    words[w] = words.get(w, 0) | 1 << (new & LOW)
                    top |= 1 << w
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str, pattern: regex.Pattern) -> np.ndarray:
        """Ids of a text, each match of the pattern for itself."""
        return np.frombuffer(b"".join(b"".join(map(self.memo.__getitem__, pattern.findall(part))) for part in parts(text)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered SLICE ids at a time."""
        out = []
        for s in range(0, len(ids), SLICE):
            own = ids[s : s + SLICE]
            start, size = self.at[own], self.at[own + 1] - self.at[own]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class _Memo(dict):
    """Ids of pre-tokens as bytes of int32. Short ones are remembered in two generations: what a full one held is looked up once more before it goes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, token: str) -> bytes:
        if (found := self.old.get(token)) is None:
            found = array("i", self.vocabulary.merged(token.encode())).tobytes()
        if len(token) <= SHORT:
            if len(self) >= KNOWN:
                self.old = dict(self)
                self.clear()
            self[token] = found
        return found


def parts(text: str) -> Iterator[str]:
    """The text in parts that end between pre-tokens, of about SLICE characters; a longer pre-token stays whole."""
    at = 0
    while len(text) - at > 2 * SLICE:
        found = BOUND.search(text, at + SLICE)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file: lines of a base64 token and its rank."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a})


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and, with ``decoded``, the bytes that the ids give back.

    ``path`` is a rank file that every machine can read, ``pattern`` splits a text before the merges.
    White space may stand at the start of a match only, or a match is white space only. There are no
    special tokens: their strings are text like any other. A null or empty text has no ids and empty
    bytes. Repeated rows stay repeated, a null id stays null, an empty table gives no rows. Texts are
    read whole, one at a time, however long a pre-token is. No shuffle.
    """
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = vocabulary(path), regex.compile(pattern)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            size = 0
            held: list[np.ndarray] = []
            first = 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                held.append(words.encode(text, split))
                size += len(text)
                if size >= SLICE or i == len(texts) - 1:
                    yield _batch(words, ids[first : i + 1], held, names)
                    first, size, held = i + 1, 0, []

    schema = "doc_id long, n_tokens long, ids array<int>" + (", decoded binary" if decoded else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _batch(words: Vocabulary, ids: pa.Array, held: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in held], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(held)))
    made = {"doc_id": ids, "n_tokens": pa.array(sizes), "ids": lists}
    if "decoded" in names:
        made["decoded"] = pa.array([words.decode(x) for x in held], pa.binary())
    return pa.RecordBatch.from_arrays([made[c] for c in names], names)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the bytes of the ids; null gives null, ids beyond the vocabulary are an error."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        words = vocabulary(path)
        return pa.array([None if x is None else words.decode(np.array(x, np.int32)) for x in ids.to_pylist()], pa.binary())

    return rows.withColumn("decoded", run(ids_col))
