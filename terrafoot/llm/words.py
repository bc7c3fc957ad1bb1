"""Vectorised word hashes, shingles and sketches over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Bytes of texts in hand at a time.
PIECE = 1 << 18
#: Elements that are hashed at a time, where rounds are small enough to go together.
ITEMS = 1 << 16
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A strong mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 1
    up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(at: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text and the end, hash of each word), words being runs without white space.

    A long run of bytes is hashed in pieces of at most 256 KB, so memory stays a small multiple of the
    input whatever the length of a text or word.
    """
    space = SPACE[data]
    solid = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    up, down = _powers()
    out = np.zeros(len(starts), U)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
            lo, hi = starts[first], ends[last - 1]
            if hi - lo > PIECE:  # a single word of more than a piece
                h = U(0)
                for i in range(lo, hi, PIECE):
                    part = data[i : min(i + PIECE, hi)]
                    part = LOWER[part] if lower else part
                    h = mixed(np.array([h + (up[: len(part)] * (part.astype(U) + U(1))).sum()], U))[0]
                out[first] = h
            else:
                part = data[lo:hi]
                part = LOWER[part] if lower else part
                total = np.zeros(hi - lo + 1, U)
                np.cumsum(up[: hi - lo] * (part.astype(U) + U(1)), out=total[1:])
                s, e = starts[first:last] - lo, ends[first:last] - lo
                out[first:last] = (total[e] - total[s]) * down[s]
            first = last
        out = mixed(out ^ ((ends - starts).astype(U) << U(40)))
    return np.searchsorted(starts, at), out


def shingle_sets(at: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle."""
    firsts, words = word_hashes(at, data)
    n = len(words)
    with np.errstate(over="ignore"):
        grams = words.copy()
        for j in range(1, k):
            grams[: n - j] = mixed(grams[: n - j] * U(3) + words[j:])
        out = []
        for s, e in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            elif e == s:
                out.append(np.zeros(0, U))
            else:
                h = U(e - s)
                for w in words[s:e]:
                    h = mixed(np.array([h * U(5) + w], U))[0]
                out.append(np.array([h], U))
    return out


def fast_sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches with ``t`` coordinates, one row per set; an empty set's row is all ones.

    Round i places each element in one hashed bin and gives it a value whose leading part is i, so an
    earlier round always wins a bin. From round t on, round i puts all elements into bin i - t, hence
    every coordinate is full after 2t rounds; sets leave as soon as their bins are full.
    """
    n = len(sets)
    full = U(0xFFFFFFFFFFFFFFFF)
    flat = np.full(n * t, full, U)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.concatenate(sets) if n else np.zeros(0, U)

    def place(first, end, spot=None):
        rounds = np.arange(first, end, dtype=U)[:, None]
        h = mixed(x[None] + (rounds + U(1)) * U(0xD1342543DE82EF95))
        spot = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if spot is None else spot
        np.minimum.at(flat, (doc * t + spot).ravel(), ((h & U(0xFFFFFFFF)) | (rounds << U(32))).ravel())

    i = 0
    with np.errstate(over="ignore"):
        while i < t and len(x):
            end = min(t, i + max(1, ITEMS // len(x)))  # several rounds at once where few elements are left
            place(i, end)
            i = end
            stay = ((flat.reshape(n, t) == full).any(1))[doc]
            if not stay.all():
                x, doc = x[stay], doc[stay]
        for i in range(0, t, step := max(1, ITEMS // max(1, len(x)))):
            if len(x):
                place(t + i, min(2 * t, t + i + step), np.arange(i, min(t, i + step))[:, None])
    return flat.reshape(n, t)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    bands = sketches.reshape(len(sketches), -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands.shape[1], dtype=U) + U(1), bands.shape[:2]).copy()
        for j in range(rows):
            key = mixed(key * U(7) + bands[:, :, j])
    return key.view(np.int64)
