"""Runs of repeated words, by longest common extensions on suffix trees.

Each maximal run has a Lyndon root. For every place the longest Lyndon words of both orders of the
alphabet are candidates for that root; they are extended to both sides by longest common extensions,
which are lowest common ancestors in the Ukkonen suffix trees of the words and of their reversal,
answered in constant time on the trees' Euler tours.

A stretch whose n-grams don't recur in it can't hold a run that is long enough, so trees are built of
the other stretches only. That leaves out no run: see :func:`stretches`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.llm.common import WORD, buffers, pieces
from terrafoot.llm.words import mixed

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of texts in hand at a time (a longer text stands alone), candidates that are extended at a time.
CHUNK, ITEMS = 1 << 19, 1 << 18
#: Rounds in which stretches shrink; what is left after them goes to the trees as it is.
ROUNDS = 8
#: Entries of an Euler tour in one block of the range-minimum table.
BLOCK = 16
WORDS = re.compile(WORD)
U = np.uint64


class RangeMin:
    """Minima of ranges in constant time: running minima inside blocks, a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        grid = padded.reshape(blocks, BLOCK)
        self.values = padded
        self.from_left = np.minimum.accumulate(grid, 1).ravel()
        self.from_right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [grid.min(1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def ask(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minima of a[k] to b[k], both included; a <= b."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.from_right[a], self.from_left[b])
        one = first == last
        if one.any():
            near, far = a[one], b[one]
            low = self.values[near]
            for step in range(1, BLOCK):
                low = np.minimum(low, self.values[np.minimum(near + step, far)])
            out[one] = low
        between = last - first - 1
        for level, table in enumerate(self.levels):
            own = (between >= 1 << level) & (between < 2 << level)
            if own.any():
                out[own] = np.minimum(out[own], np.minimum(table[first[own] + 1], table[last[own] - (1 << level)]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers from 1, with an end mark 0, and its Euler tour."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        n, width = len(s), max(s) + 1
        first, last, link, leaves = [0], [0], [0], []
        children: dict[int, int] = {}
        active = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            waiting = 0  # an inner node without its suffix link yet
            while rest:
                if not length:
                    edge = i
                key = active * width + s[edge]
                child = children.get(key)
                if child is None:
                    children[key] = leaf = len(first)
                    first.append(i), last.append(n), link.append(0)
                    leaves.append(leaf)
                    if waiting:
                        link[waiting] = active
                        waiting = 0
                else:
                    span = last[child] - first[child]
                    if length >= span:
                        edge, length, active = edge + span, length - span, child
                        continue
                    if s[first[child] + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = active
                        break
                    children[key] = inner = len(first)
                    first.append(first[child]), last.append(first[child] + length), link.append(0)
                    leaf = inner + 1
                    first.append(i), last.append(n), link.append(0)
                    leaves.append(leaf)
                    first[child] += length
                    children[inner * width + c] = leaf
                    children[inner * width + s[first[child]]] = child
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                rest -= 1
                if active:
                    active = link[active]
                elif length:
                    length, edge = length - 1, i - rest + 1
        self._tour(np.fromiter(children.keys(), np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)), width, np.array(last) - np.array(first), np.array(leaves))

    def _tour(self, keys: np.ndarray, nodes: np.ndarray, width: int, span: np.ndarray, leaves: np.ndarray) -> None:
        """Walks the tree in the order of its words; the tour holds the depth, in symbols, of each node that it passes."""
        order = np.argsort(keys)
        at = np.searchsorted(keys[order] // width, np.arange(len(span) + 1)).tolist()
        kids, spans = nodes[order].tolist(), span.tolist()
        depths, place = [], [0] * len(spans)
        stack, depth = [(0, at[0], 0)], 0
        place[0] = 0
        depths.append(0)
        while stack:
            node, k, depth = stack.pop()
            if k < at[node + 1]:
                stack.append((node, k + 1, depth))
                child = kids[k]
                below = depth + spans[child]
                place[child] = len(depths)
                depths.append(below)
                if at[child] < at[child + 1]:
                    stack.append((child, at[child], below))
                else:
                    depths.append(depth)
            elif stack:
                depths.append(stack[-1][2])
        self.place = np.array(place)[leaves]  # leaves are made in the order of their suffixes
        self.minima = RangeMin(np.array(depths, np.int32))

    def ranks(self) -> np.ndarray:
        """The rank of each suffix among all, the end mark's included."""
        out = np.empty(len(self.place), np.int64)
        out[np.argsort(self.place)] = np.arange(len(self.place))
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions of different suffixes i[k] and j[k]: depths of their lowest common ancestors."""
        a, b = self.place[i], self.place[j]
        return self.minima.ask(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def lyndon_ends(ranks: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next suffix of smaller and of greater rank: the ends of the longest Lyndon words of both orders."""
    n = len(ranks)
    smaller, greater = [n] * n, [n] * n
    for ends, sign in ((smaller, 1), (greater, -1)):
        open_: list[int] = []
        for i, r in enumerate(ranks):
            while open_ and sign * ranks[open_[-1]] > sign * r:
                ends[open_.pop()] = i
            open_.append(i)
    return smaller, greater


def runs_of(symbols: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of numbers from 1, by start and period."""
    n = len(symbols)
    if n < max(least, periods):
        return []
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found: set[tuple[int, int, int]] = set()
    for ends in lyndon_ends(ahead.ranks().tolist()):
        ends = np.array(ends[:n])
        for s in range(0, n, ITEMS):
            i = np.arange(s, min(n, s + ITEMS))
            j = ends[i]
            i, j = i[j < n], j[j < n]
            period = j - i
            right = ahead.common(i, j)
            left = np.zeros_like(right)
            inner = i > 0
            left[inner] = back.common(n - i[inner], n - j[inner])
            length = left + period + right
            long = (length >= least) & (length >= periods * period)
            found.update(zip((i - left)[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Stretches (first, end) of texts, which end at ``bounds``, that hold every run.

    Of a run of length n >= max(least, periods * p) every gram of k words occurs twice in the run, p
    words apart, if n - k + 1 >= 2 * p; k = least * (periods - 2) / periods + 1 makes that so. So
    places whose gram occurs once in its stretch cut it, and parts of too few places go; again with
    what is left. A hash that two grams share can only leave more.
    """
    k = least * (periods - 2) // periods + 1
    n = len(ids) - k + 1
    if n <= 0:
        return []
    with np.errstate(over="ignore"):
        words = mixed(ids.astype(U) + U(1))
        grams = words[:n].copy()
        for j in range(1, k):
            grams = mixed(grams * U(3) + words[j : n + j])
    owner = np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    part = owner[at]
    for _ in range(ROUNDS):
        if not len(at):
            return []
        with np.errstate(over="ignore"):
            key = mixed(grams[at] + (part.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        left, old = at[twice], part[twice]
        new = np.cumsum(np.append(True, (np.diff(left) != 1) | (np.diff(old) != 0))) - 1 if len(left) else left
        keep = np.bincount(new)[new] >= least - k + 1 if len(left) else np.zeros(0, bool)
        left, new = left[keep], new[keep]
        done = len(left) == len(at)
        at, part = left, new
        if done:
            break
    first = np.flatnonzero(np.diff(part, prepend=-1)) if len(at) else at
    ends = np.append(first[1:], len(at)) if len(at) else at
    return [(int(at[s]), int(at[e - 1]) + k) for s, e in zip(first.tolist(), ends.tolist(), strict=True)]


def runs_of_texts(texts: list[list[str]], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    code = defaultdict(count().__next__)
    sizes = [len(x) for x in texts]
    bounds = np.cumsum(sizes)
    ids = np.fromiter((code[w] for x in texts for w in x), np.int64, int(bounds[-1]) if len(bounds) else 0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e in stretches(ids, bounds, least, periods):
        own = int(np.searchsorted(bounds, s, "right"))
        base = s - int(bounds[own] - sizes[own])
        _, dense = np.unique(ids[s:e], return_inverse=True)
        out[own] += [(base + start, length, period) for start, length, period in runs_of((dense + 1).tolist(), least, periods)]
    return out


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if runs else words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per document: doc_id, runs (an array of start, length, period, by start and period), collapsed.

    A run is a stretch of consecutive words with smallest period ``period`` that no neighbour extends,
    of at least ``least`` words and ``periods`` periods (2 or more). ``collapsed`` is the words joined
    by one space, without those that any run holds after its first period. Null, empty and blank texts
    have no runs and an empty ``collapsed``. Ids play no part: null ids stay null, repeated rows give
    equal rows, an empty table gives none. Texts are read whole, about 512 KB of them at a time, a
    longer one alone; trees take about 1 KB a word of the longest stretch that repeats itself. No shuffle.
    """
    if periods < 2 or least < periods:
        raise ValueError("a run has at least two periods and as many words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = buffers(batch.column("text"))
            for s, e in pieces(at, CHUNK):
                words = [WORDS.findall(t or "") for t in batch.column("text")[s:e].to_pylist()]
                found = runs_of_texts(words, least, periods)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), items)
                collapsed = pa.array([_collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s:e], lists, collapsed], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period, at a tie the first by start and period; null without any."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, F.lit(2), F.size(runs)), runs[0], lambda best, r: F.when(ahead(r, best), r).otherwise(best)))
