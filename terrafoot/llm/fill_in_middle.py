"""Fill-in-the-middle as edits of piece tables.

A document is a row of descriptors (buffer, start, length) over two buffers that never change: its
text and the sentinels. Cutting splits a descriptor, arranging permutes descriptors, the inverse
permutation restores; digests and outputs stream the bytes that the descriptors name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafoot.llm.common import buffers, pieces
from terrafoot.llm.words import SPACE

#: The sentinels before prefix, suffix and middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Where each of (P, prefix, M, middle, S, suffix) goes: the order in which a form writes them.
ORDERS = {"psm": (0, 1, 4, 5, 2, 3), "spm": (4, 5, 0, 1, 2, 3)}
#: Bytes of texts in hand at a time; a longer text stands alone.
CHUNK = 1 << 20
TEXT, SENTINEL = 0, 1
COLUMNS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string(), "output": pa.string()}


class PieceTable:
    """Descriptors of several documents, one document after the other."""

    def __init__(self, doc: np.ndarray, buffer: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.doc, self.buffer, self.start, self.length = doc, buffer, start, length

    @classmethod
    def of(cls, at: np.ndarray) -> PieceTable:
        """Each document one descriptor of its text, which runs from ``at[i]`` to ``at[i + 1]``."""
        n = len(at) - 1
        return cls(np.arange(n), np.full(n, TEXT), at[:-1], np.diff(at))

    def taken(self, order: np.ndarray) -> PieceTable:
        return PieceTable(self.doc[order], self.buffer[order], self.start[order], self.length[order])

    def cut(self, doc: np.ndarray, place: np.ndarray) -> PieceTable:
        """Splits text descriptors at places of the buffer; a cut at an end leaves an empty piece, so k cuts give k more."""
        owner = np.concatenate([self.doc, doc])
        start = np.concatenate([self.start, place])
        order = np.lexsort((np.arange(len(owner)), start, owner))
        owner, start = owner[order], start[order]
        end = np.zeros(self.doc.max(initial=-1) + 1, np.int64)
        np.maximum.at(end, self.doc, self.start + self.length)
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        until = np.where(last, end[owner], np.append(start[1:], 0)) if len(owner) else start
        return PieceTable(owner, np.full(len(owner), TEXT), start, until - start)

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        """Permutes each document's descriptors; all have ``len(order)`` of them."""
        return self.taken((np.arange(len(self.doc)).reshape(-1, len(order))[:, list(order)]).ravel())

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        return self.arranged(tuple(np.argsort(order).tolist()))

    def marked(self) -> PieceTable:
        """Of (prefix, middle, suffix) makes (P, prefix, M, middle, S, suffix)."""
        n = len(self.doc)
        where = np.cumsum([0, *map(len, SENTINELS)])
        kind = np.tile([0, 2, 1], n // 3)
        mark = PieceTable(self.doc, np.full(n, SENTINEL), where[kind], where[kind + 1] - where[kind])
        both = lambda a, b: np.column_stack([a, b]).ravel()
        return PieceTable(both(mark.doc, self.doc), both(mark.buffer, self.buffer), both(mark.start, self.start), both(mark.length, self.length))

    def unmarked(self) -> PieceTable:
        return self.taken(np.flatnonzero(self.buffer == TEXT))

    def streams(self, text: memoryview, n: int) -> list[list[memoryview]]:
        """For each of ``n`` documents the slices of the buffers, in order."""
        held = (text, memoryview(b"".join(SENTINELS)))
        out: list[list[memoryview]] = [[] for _ in range(n)]
        for d, b, s, k in zip(self.doc.tolist(), self.buffer.tolist(), self.start.tolist(), self.length.tolist(), strict=True):
            out[d].append(held[b][s : s + k])
        return out


def _digest(stream: list[memoryview]) -> str:
    h = hashlib.sha256()
    for part in stream:
        h.update(part)
    return h.hexdigest()


def token_ends(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each text and the end, end of each token): words with the white space before them, then white space that ends a text."""
    space, edge = SPACE[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    after = np.append(space[1:], True) if len(data) else space
    ends = np.flatnonzero((~space & after) | edge[1:]) + 1  # the last byte of a text ends its last token, of either kind
    return np.searchsorted(ends, at, "right"), ends


def draws(seed: int, doc_id) -> tuple[int, ...]:
    """The document's four numbers; a null id counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def _written(at: np.ndarray, data: np.ndarray, ids: list, seed: int, rate: int, spm: int):
    """(n, form, prefix_chars, middle_chars, streams of the outputs) of a slice of texts."""
    n_docs = len(ids)
    first, ends = token_ends(at, data)
    n = np.diff(first)
    h = np.array([draws(seed, i) for i in ids], np.int64).reshape(n_docs, 4)
    units = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    place = np.where(units == 0, at[:-1, None], ends[np.minimum(first[:-1, None] + units - 1, max(len(ends) - 1, 0))] if len(ends) else 0)
    raw = data.tobytes()
    holds = np.array([any(raw.find(s, a, b) >= 0 for s in SENTINELS) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
    plain = (n == 0) | holds | (h[:, 2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    table = PieceTable.of(at)
    streams: list[list[memoryview]] = table.taken(np.flatnonzero(plain)).streams(memoryview(raw), n_docs)
    for name, order in ORDERS.items():
        own = np.flatnonzero(form == name)
        if len(own):
            cut = table.taken(own).cut(np.repeat(own, 2), place[own].ravel())
            for i, parts in zip(own.tolist(), [x for x in cut.marked().arranged(order).streams(memoryview(raw), n_docs) if x], strict=True):
                streams[i] = parts
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    prefix, middle = chars[place[:, 0]] - chars[at[:-1]], chars[place[:, 1]] - chars[place[:, 0]]
    return n, form, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), streams


def _rebuilt(outputs: list[bytes], forms) -> list[list[memoryview]]:
    """Streams of the original texts, read from outputs and forms alone: sentinels give the cuts, the inverse permutation the order."""
    out = [[memoryview(x)] for x in outputs]
    for name, order in ORDERS.items():
        own = [i for i, f in enumerate(forms) if f == name]
        if not own:
            continue
        at = np.concatenate([[0], np.cumsum([len(outputs[i]) for i in own])])
        found = np.array([sorted(outputs[i].find(s) + int(a) for s in SENTINELS) for i, a in zip(own, at, strict=False)])
        size = len(SENTINELS[0])
        bounds = np.stack([found, found + size], 2).reshape(len(own), 6)
        start, end = bounds, np.column_stack([bounds[:, 1:], at[1:]])
        doc = np.repeat(np.arange(len(own)), 6)
        kind = np.tile([SENTINEL, TEXT], len(own) * 3)
        table = PieceTable(doc, kind, start.ravel(), (end - start).ravel()).restored(order).unmarked()
        joined = memoryview(b"".join(outputs[i] for i in own))
        for i, parts in zip(own, table.streams(joined, len(own)), strict=True):
            out[i] = parts
    return out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``texts``, output.

    ``rate`` of 100 documents are cut at two token bounds and written with sentinels, ``spm`` of 100
    of these with the suffix first; which, and where, hangs on ``seed`` and the id alone. An empty
    or null text, and one that holds a sentinel, stays plain, with null counts of characters.
    restored_sha256 is of the text rebuilt from output and form. Rows with a null id are drawn as
    one with an empty id; repeated rows give equal rows; an empty table gives none. Texts are read
    whole: about 1 MB of them at a time, a longer text alone. No shuffle.
    """
    names = [c for c in COLUMNS if texts or c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_at, all_data = buffers(batch.column("text"))
            all_ids = batch.column("doc_id").to_pylist()
            for s, e in pieces(all_at, CHUNK):
                at = all_at[s : e + 1] - all_at[s]
                ids = all_ids[s:e]
                n, form, prefix, middle, streams = _written(at, all_data[all_at[s] : all_at[e]], ids, seed, rate, spm)
                outputs = [b"".join(x) for x in streams]
                made = {
                    "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n), "form": pa.array(form.tolist(), pa.string()), "prefix_chars": prefix, "middle_chars": middle,
                    "output_sha256": pa.array(map(_digest, streams), pa.string()), "restored_sha256": pa.array(map(_digest, _rebuilt(outputs, form)), pa.string()),
                }
                if texts:
                    made["output"] = pa.array(outputs, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([made[c] for c in names], names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + (", output string" if texts else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@F.arrow_udf(T.StringType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The original text of an output and its form; null for a null output."""
    there = [x is not None for x in output.to_pylist()]
    outputs = [(x or "").encode() for x in output.to_pylist()]
    found = [b"".join(x).decode() for x in _rebuilt(outputs, form.to_pylist())]
    return pa.array([x if ok else None for x, ok in zip(found, there, strict=True)], pa.string())
