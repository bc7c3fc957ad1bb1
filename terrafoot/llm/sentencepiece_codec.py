"""SentencePiece encoding and decoding in batches of numpy arrays.

Texts fall into units that no piece crosses. Distinct units of equal length advance together: hashes
of all their substrings probe the sorted keys of the pieces, and vectorised maxima choose. For a
unigram model that is Viterbi's recursion with back pointers; for a BPE model, whose ids no best
path gives, each step merges every unit's best pair.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafoot.llm.common import buffers, pieces

SPACE = "▁"
#: Fixed values of the model file: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Bytes of texts that are encoded together; entries of a table of substrings.
CHUNK, TABLE = 1 << 19, 1 << 20
#: Units beyond this length are cut where no piece can reach across, what stays longer goes alone; units remembered by a task.
LONG, REMEMBERED = 48, 1 << 18
U = np.uint64
PRIME = U(0x100000001B3)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _charsmap(blob: bytes) -> dict[str, str]:
    """The rules of a model's character map: a double array over UTF-8 bytes whose leaves point at replacements."""
    size = struct.unpack_from("<I", blob)[0]
    cells = np.frombuffer(blob, np.uint32, size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]
    reach = (cells >> 10) << ((cells & 512) >> 6)
    rules, labels, todo = {}, np.arange(1, 256), [(b"", int(reach[0]))]
    while todo:
        prefix, at = todo.pop()
        spots = at ^ labels
        spots, own = spots[spots < len(cells)], labels[spots < len(cells)]
        hit = (cells[spots] & 0x800000FF) == own
        for spot, label in zip(spots[hit].tolist(), own[hit].tolist(), strict=True):
            key, after = prefix + bytes([label]), int(spot ^ reach[spot])
            if cells[spot] >> 8 & 1:
                start = int(cells[after] & 0x7FFFFFFF)
                rules[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((key, after))
    return rules


def _one_of(characters) -> str:
    return "[" + "".join(map(re.escape, sorted(characters))) + "]"


@dataclass
class Pieces:
    """A model's pieces with their scores and kinds, and how it treats characters and white space."""

    names: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = False
    rules: dict[str, str] = field(default_factory=dict)
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self):
        normal, given = self.kinds == NORMAL, self.kinds == USER
        self.scores = np.asarray(self.scores, np.float32).copy()
        self.worst = np.float32((self.scores[normal].min() if normal.any() else 0) - 10)
        best = max(0.0, self.scores[normal].max() if normal.any() else 0.0)
        self.lengths = np.array([len(x) for x in self.names])
        if self.model == UNIGRAM:  # a given piece beats any other way through its own characters
            self.scores[given] = [len(self.names[i].encode()) * best - 0.1 for i in np.flatnonzero(given)]
        users = sorted((self.names[i] for i in np.flatnonzero(given)), key=len, reverse=True)
        self.given = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users else None
        own = np.flatnonzero(normal | given) if self.model == UNIGRAM else np.flatnonzero(normal)
        keys = np.array([_key(self.names[i]) for i in own], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], own[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.longest = int(max((self.lengths[i] for i in own), default=1))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> U(44)).astype(np.int64)] = True
        self.bytes = {int(x[1:-1], 16): i for i, x in enumerate(self.names) if self.kinds[i] == BYTE}
        self.unknown = next((i for i in range(len(self.names)) if self.kinds[i] == UNKNOWN), 0)
        many = [self.names[i] for i in own if len(self.names[i]) > 1]
        inner = any(SPACE in x.lstrip(SPACE) for x in many)
        lines = any("\n" in x for x in many)
        stop = SPACE if lines else SPACE + "\n"
        self.unit = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{stop}]+|{SPACE}+" + ("" if lines else "|\n"))
        self.ruled = None
        if self.rules:  # where a rule may start: a character that has one alone, or before a second one that goes on
            several = [k for k in self.rules if len(k) > 1]
            parts = [_one_of({k for k in self.rules if len(k) == 1})] if len(several) < len(self.rules) else []
            parts += [_one_of({k[0] for k in several}) + "(?=" + _one_of({k[1] for k in several}) + ")"] if several else []
            self.ruled, self.rule_length = re.compile("|".join(parts)), max(map(len, self.rules))
        raw = [bytes([int(x[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else x.replace(SPACE, " ").encode() for x, k in zip(self.names, self.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    def find(self, keys: np.ndarray, length: int) -> np.ndarray:
        """The piece of each substring hash, or -1."""
        out = np.full(keys.shape, -1, np.int64)
        maybe = np.flatnonzero(self.sieve[(keys >> U(44)).astype(np.int64)])
        if len(maybe):
            spot = np.minimum(np.searchsorted(self.keys, keys.flat[maybe]), len(self.keys) - 1)
            hit = (self.keys[spot] == keys.flat[maybe]) & (self.lengths[self.ids[spot]] == length)
            out.flat[maybe[hit]] = self.ids[spot[hit]]
        return out

    def _mapped(self, text: str) -> str:
        """``text`` after the character map: at each place the longest rule."""
        out, done = [], 0
        for hit in self.ruled.finditer(text):
            at = hit.start()
            if at < done:
                continue
            for n in range(min(self.rule_length, len(text) - at), 0, -1):
                if (new := self.rules.get(text[at : at + n])) is not None:
                    out += [text[done:at], new]
                    done = at + n
                    break
        return "".join([*out, text[done:]])

    def normalised(self, text: str | None) -> str:
        if not text:
            return ""
        if self.ruled:  # given pieces stay as they are
            text = "".join(x if i % 2 else self._mapped(x) for i, x in enumerate(self.given.split(text))) if self.given else self._mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def units(self, text: str | None) -> list[str]:
        """What the text is encoded by: runs that no piece crosses."""
        text = self.normalised(text)
        parts = self.given.split(text) if self.given and self.model == BPE else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)  # a given piece, which nothing merges with
                continue
            for unit in self.unit.findall(part):
                out += [unit] if len(unit) <= LONG else self._split(unit)
        return out

    def _split(self, unit: str) -> list[str]:
        """A long unit, cut where no piece of the model that occurs in it reaches across."""
        points = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        window = max(1, TABLE // (self.longest + 1))
        turn = np.zeros(len(points) + 2, np.int64)
        for at in range(0, len(points), window):
            table = _substrings(points[None, at : at + window + self.longest], self)[0, :window]
            start, length = np.nonzero(table[:, 2:] >= 0)
            np.add.at(turn, at + start + 1, 1)
            np.add.at(turn, at + start + length + 2, -1)
        cuts = np.flatnonzero(np.cumsum(turn)[1 : len(points)] == 0) + 1
        return [unit[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)], strict=True)]


def _spread(h: np.ndarray) -> np.ndarray:
    return h * U(0x9E3779B97F4A7C15)


def _key(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(PRIME) + ord(c) + 1) % (1 << 64)
    return h * 0x9E3779B97F4A7C15 % (1 << 64)


def read_model(path: str) -> Pieces:
    """Pieces of a ``.model`` file of the unigram or BPE kind, with its character map and given pieces."""
    with open(path, "rb") as f:
        return parse_model(f.read())


def parse_model(data: bytes) -> Pieces:
    names, scores, kinds, extra = [], [], [], {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            names.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(_fields(value))
            if own.get(3, UNIGRAM) not in (UNIGRAM, BPE) or own.get(24):
                raise ValueError("only unigram and BPE models with space before words are supported")
            extra["model"] = own.get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
            extra |= {"dummy_prefix": bool(rules.get(3, 1)), "squeeze": bool(rules.get(4, 1)), "rules": _charsmap(rules[2]) if rules.get(2) else {}}
    return Pieces(names, np.array(scores), np.array(kinds), **extra)


def _substrings(units: np.ndarray, p: Pieces) -> np.ndarray:
    """found[u, i, k]: the piece that is units[u, i : i + k], or -1."""
    n, size = units.shape
    most = min(size, p.longest)
    found = np.full((n, size, most + 1), -1, np.int32)
    h = np.zeros((n, size), U)
    with np.errstate(over="ignore"):
        for k in range(1, most + 1):
            h = h[:, : size - k + 1] * PRIME + units[:, k - 1 :] + U(1)
            found[:, : size - k + 1, k] = p.find(_spread(h), k)
    return found


def viterbi(found: np.ndarray, p: Pieces) -> np.ndarray:
    """cuts[u, i]: where the piece of the best path that starts at i ends, or 0 where none starts.

    Sums are in single precision and of equal paths the longer last piece wins, as in the library. The library
    sums over a whole text, so paths whose sums are equal but for rounding may differ.
    """
    n, size = found.shape[:2]
    best = np.full((n, size + 1), -np.inf, np.float32)
    best[:, 0] = 0
    back = np.ones((n, size + 1), np.int32)
    for end in range(1, size + 1):
        lens = np.arange(min(end, found.shape[2] - 1), 0, -1)
        piece = found[:, end - lens, lens]
        score = best[:, end - lens] + np.where(piece >= 0, p.scores[piece], np.where(lens == 1, p.worst, np.float32(-np.inf)))
        at = score.argmax(1)
        back[:, end], best[:, end] = lens[at], score[np.arange(n), at]
    return _traced(back)


def _traced(back: np.ndarray) -> np.ndarray:
    n, size = back.shape[0], back.shape[1] - 1
    cuts, end = np.zeros((n, size), np.int64), np.full(n, size)
    while (live := np.flatnonzero(end > 0)).size:
        start = end[live] - back[live, end[live]]
        cuts[live, start] = end[live]
        end[live] = start
    return cuts


def _viterbi_long(points: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(start of each piece of one long unit, its id or -1): the same recursion, with the table in windows."""
    size, most = len(points), p.longest
    best, back, step = np.zeros(size + 1, np.float32), np.ones((1, size + 1), np.int32), max(1, TABLE // (most + 1))
    which = np.full(size + 1, -1, np.int32)
    for at in range(0, size, step):
        low = max(0, at - most)
        table = _substrings(points[None, low : at + step], p)[0]
        for end in range(at + 1, min(at + step, size) + 1):
            lens = np.arange(min(end, most, table.shape[1] - 1), 0, -1)
            piece = table[end - lens - low, lens]
            score = best[end - lens] + np.where(piece >= 0, p.scores[piece], np.where(lens == 1, p.worst, np.float32(-np.inf)))
            k = int(score.argmax())
            best[end], back[0, end], which[end] = score[k], lens[k], piece[k]
    cuts = _traced(back)[0]
    start = np.flatnonzero(cuts)
    return start, which[cuts[start]].astype(np.int64)


def merges(found: np.ndarray, p: Pieces) -> np.ndarray:
    """The same for a BPE model: each unit's best-scored pair, the leftmost of equals, is joined until none is left."""
    n, size = found.shape[:2]
    most = found.shape[2] - 1

    def score(u, start, end):
        fits = (end <= size) & (end - start <= most)
        piece = found[u, start, np.where(fits, end - start, 0)]
        return np.where(fits & (piece >= 0), p.scores[piece], -np.inf)

    ends = np.tile(np.arange(1, size + 2), (n, 1))  # end of the symbol that starts here; one slot behind the last
    ends[:, size] = size + most + 1
    before = np.tile(np.arange(-1, size), (n, 1))
    gain = np.full((n, size), -np.inf)
    if size > 1 and most > 1:
        gain[:, :-1] = np.where(found[:, :-1, 2] >= 0, p.scores[found[:, :-1, 2]], -np.inf)
    live = np.arange(n)
    while True:
        at = gain[live].argmax(1)
        good = gain[live, at] > -np.inf
        live, at = live[good], at[good]
        if not len(live):
            break
        middle = ends[live, at]
        end = ends[live, middle]
        ends[live, at] = end
        gain[live, middle] = -np.inf
        before[live, end] = at
        gain[live, at] = score(live, at, ends[live, end])
        left = before[live, at]
        has = left >= 0
        gain[live[has], left[has]] = score(live[has], left[has], end[has])
        ends[live, middle] = 0
    return np.where(ends[:, :size] > 0, ends[:, :size], 0)


def _merge_long(text: str, p: Pieces, ids: dict[str, int], rank: np.ndarray) -> list[str]:
    """BPE of one long unit, with a heap of pairs; a pair is one whole number: rank, place, and two lengths."""
    end, before = array("q", range(1, len(text) + 2)), array("q", range(-1, len(text)))

    def pair(i):
        if 0 <= i and end[i] < len(text) and (k := ids.get(text[i : end[end[i]]])) is not None:
            return ((int(rank[k]) << 40 | i) << 40) | end[i] - i << 20 | end[end[i]] - i

    heap = [x for x in map(pair, range(len(text) - 1)) if x is not None]
    heapq.heapify(heap)
    low = (1 << 20) - 1
    while heap:
        x = heapq.heappop(heap)
        i = x >> 40 & (1 << 40) - 1
        middle, last = i + (x >> 20 & low), i + (x & low)
        if end[i] != middle or end[middle] != last:
            continue
        end[i], before[last], end[middle] = last, i, 0
        for near in (i, before[i]):
            if (x := pair(near)) is not None:
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < len(text):
        out.append(text[i : end[i]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one model; remembers the units that it has met, up to a bound."""

    def __init__(self, p: Pieces):
        self.p = p
        self.known = {p.names[i]: int(i) for i in range(len(p.names)) if p.kinds[i] in (NORMAL, USER)}
        self.rank = np.unique(-p.scores, return_inverse=True)[1]  # equal scores have equal ranks
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ids(self, piece: str) -> list[int]:
        if (k := self.known.get(piece)) is not None:
            return [k]
        return [self.p.bytes.get(b, self.p.unknown) for b in piece.encode()] if self.p.bytes else [self.p.unknown]

    def _filled(self, ids: np.ndarray, whose: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` and ``whose`` with each -1 replaced by the ids of the bytes of its character."""
        bad = np.flatnonzero(ids < 0)
        if not len(bad):
            return ids, whose
        kinds, kind = np.unique(points[bad], return_inverse=True)
        own = [self._ids(chr(c)) for c in kinds]
        flat, lens = np.concatenate(own), np.array([len(x) for x in own])
        counts = np.ones(len(ids), np.int64)
        counts[bad] = lens[kind]
        first = np.cumsum(counts) - counts
        out = np.repeat(ids, counts)
        inner = np.arange(lens[kind].sum()) - np.repeat(np.cumsum(lens[kind]) - lens[kind], lens[kind])
        out[np.repeat(first[bad], lens[kind]) + inner] = flat[np.repeat((np.cumsum(lens) - lens)[kind], lens[kind]) + inner]
        return out, np.repeat(whose, counts)

    def _learn(self, units: list[str]) -> None:
        by_length: dict[int, list[int]] = {}
        owner, found = [], []  # the unit and the id of each token, in order within a unit
        for i, u in enumerate(units):
            if self.p.given and self.p.model == BPE and self.p.kinds[self.known.get(u, self.p.unknown)] == USER:
                owner.append(np.array([i])), found.append(np.array([self.known[u]]))
            else:
                by_length.setdefault(len(u), []).append(i)
        for size, same in by_length.items():
            if size > LONG and self.p.model == BPE:
                for i in same:
                    ids = [k for x in _merge_long(units[i], self.p, self.known, self.rank) for k in self._ids(x)]
                    owner.append(np.full(len(ids), i)), found.append(np.array(ids, np.int64))
                continue
            step = max(1, TABLE // (size * min(size, self.p.longest)))
            for first in range(0, len(same), step):
                part = same[first : first + step]
                points = np.frombuffer("".join([units[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size).astype(U)
                if size * self.p.longest > TABLE:  # one unit a step
                    start, ids = _viterbi_long(points[0], self.p)
                    unit = np.zeros(len(start), np.int64)
                else:
                    table = _substrings(points, self.p)
                    cuts = (merges if self.p.model == BPE else viterbi)(table, self.p)
                    unit, start = np.nonzero(cuts)
                    ids = table[unit, start, cuts[unit, start] - start].astype(np.int64)
                ids, whose = self._filled(ids, np.array(part)[unit], points[unit, start])
                owner.append(whose), found.append(ids)
        owner, found = np.concatenate(owner), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        lens = np.bincount(owner, minlength=len(units))
        self.index.update(zip(units, range(len(self.at) - 1, len(self.at) - 1 + len(units)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])
        self.flat = np.concatenate([self.flat, found[order].astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each text and the end, the ids of all texts)."""
        units = [self.p.units(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self._forget()
        new = list(dict.fromkeys(u for own in units for u in own if u not in self.index))
        if new:
            self._learn(new)
        which = np.fromiter((self.index[u] for own in units for u in own), np.int64)
        lens = self.at[which + 1] - self.at[which]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.at[which] - total[:-1], lens) + np.arange(total[-1])]
        first = total[np.concatenate([[0], np.cumsum([len(own) for own in units], dtype=np.int64)])]
        if not self.p.bytes and len(ids):  # a run of unknown characters is one token
            again = np.concatenate([[False], (ids[1:] == self.p.unknown) & (ids[:-1] == self.p.unknown)])
            again[first[first < len(ids)]] = False
            first = first - np.concatenate([[0], np.cumsum(again)])[first]
            ids = ids[~again]
        return first, ids

    def decode(self, at: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become replacement characters."""
        start = self.p.raw_at[ids]
        lens = self.p.raw_at[ids.astype(np.int64) + 1] - start
        total = np.concatenate([[0], np.cumsum(lens)])
        data = self.p.raw[np.repeat(start - total[:-1], lens) + np.arange(total[-1])].tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(total[at[:-1]].tolist(), total[at[1:]].tolist(), strict=True)]
        return [t[1:] if self.p.dummy_prefix and t.startswith(" ") else t for t in texts]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, round_trip (whether the ids decode to the text).

    A null or empty text has no ids and decodes to the empty text. A text that holds the model's own
    space sign decodes to one with spaces, so its ``round_trip`` is false, as it is after white space
    was squeezed, or characters were mapped, by a model that does so. Repeated rows stay repeated; an empty table gives no rows.
    The model is read once on the driver and sent out; its size is fixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            at, _ = buffers(batch.column("text"))
            for s, e in pieces(at, CHUNK):
                texts = batch.column("text")[s:e].to_pylist()
                first, ids = codec.encode(texts)
                same = [a == (b or "") for a, b in zip(codec.decode(first, ids), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[s:e], pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and text; null or empty ids give an empty text, unknown ids an error."""
    sent = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                own = [np.array(x or [], np.int64) for x in batch.column("ids")[s : s + 256].to_pylist()]
                texts = codec.decode(np.cumsum([0, *(len(x) for x in own)]), np.concatenate(own))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s : s + 256], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
