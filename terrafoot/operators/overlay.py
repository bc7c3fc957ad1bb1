"""The union of boundary features, cell by cell.

Features are cut into grid cells. In a cell, vertical slabs between all vertices and crossings hold
edges that don't cross, so a pass from bottom to top gives the covered intervals of each slab. What
bounds them are directed pieces with the covered side on their left; pieces along slab and cell bounds
cancel where both sides are covered. The pieces that are left, those of the outline, are chained into
rings: first in blocks of cells, where most rings close; only those that reach a block's bounds go on to
larger blocks. A group of few points is worked on as one cell.

Before that, polygons whose boxes hang together with no others are settled in blocks of the grid: one that is
alone and simple is its own outline, a few that meet are one cell. Only the others are cut. The union comes in
parts of bounded size, so that no task holds a group.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.functions.geometry import Shapes, _meeting, encode_multipolygon, encode_polygon, inside_ring, parsed
from terrafoot.operators.cells import DEEPEST, Cell, cut, grid_level
from terrafoot.session import materialised

#: Cells of all features together at most beyond those for each, where the least level does not have more, and points for each on average.
MOST_CELLS, CELL_POINTS = 1 << 18, 32
#: Points of a group that is worked on as one cell; levels of the grid that blocks of cells take together.
WHOLE_POINTS, BLOCKS = 1536, (4, 8)
#: Polygons and bytes of a block of polygons at most; copies for each polygon, on average, where blocks share some.
BLOCK_ROWS, BLOCK_BYTES, COPIES = 1 << 14, 1 << 24, 1.05
#: Rounds of blocks, as levels above the first and shares of a block by which they are moved: what lies on bounds of one is within blocks of the other.
ROUNDS = ((0, 0.0), (4, 0.5))
#: Bytes of a part of the union, where it isn't one polygon; pieces that one task chains at the end, if larger blocks are of use.
PART_BYTES, LAST_PIECES = 1 << 12, 1 << 18
#: Vertices closer than this (in degrees) are one.
GRAIN = 1e-9
PIECES = "x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double"
CELL = "cx long, cy long, inside boolean, xref double, base boolean, edges binary"
BOX = ("x0", "y0", "x1", "y1")
POLYGON = "g string, x0 double, y0 double, x1 double, y1 double, geom_wkb binary"


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of all points in which edges cross, in slices of bounded size."""
    found = []
    n = len(a)
    step = max(1, (1 << 18) // max(1, n))
    d = b - a
    for s in range(0, n, step):
        p, u = a[s : s + step, None], d[s : s + step, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = u[..., 0] * d[None, :, 1] - u[..., 1] * d[None, :, 0]
            w = a[None] - p
            t = (w[..., 0] * d[None, :, 1] - w[..., 1] * d[None, :, 0]) / turn
            r = (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / turn
            met = (turn != 0) & (t >= 0) & (t <= 1) & (r >= 0) & (r <= 1)
            found.append((p[..., 0] + t * u[..., 0])[met])
    return np.concatenate(found) if found else np.zeros(0)


def _height(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y of edges at x, exact at their ends."""
    with np.errstate(divide="ignore", invalid="ignore"):
        y = a[:, 1] + (x - a[:, 0]) / (b[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])
    return np.where(x == a[:, 0], a[:, 1], np.where(x == b[:, 0], b[:, 1], y))


def _left_over(line: np.ndarray, low: np.ndarray, high: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Of signed intervals on lines the parts (line, low, high, sign) in which signs don't cancel."""
    if not len(line):
        return np.zeros((0, 4))
    at = np.concatenate([low, high])
    own = np.concatenate([line, line])
    step = np.concatenate([sign, -sign])
    order = np.lexsort((at, own))
    at, own, total = at[order], own[order], np.cumsum(step[order])  # each line's steps sum up to nothing
    keep = (own[1:] == own[:-1]) & (at[1:] > at[:-1]) & (total[:-1] != 0)
    return np.column_stack([own[:-1], at[:-1], at[1:], np.sign(total[:-1])])[keep]


def cell_outline(parts: list[Cell], full: int, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Directed pieces (:data:`PIECES`) of the union's outline in one cell, its own bounds included; pieces of an edge name its ends."""
    if full or not parts:
        a = b = np.zeros((0, 2))
        feature = np.zeros(0, np.int64)
    else:
        a, b = np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts])
        feature = np.repeat(np.arange(len(parts)), [len(p.a) for p in parts])
    # where edges pass the bottom and the top bound
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = [np.where((a[:, 1] <= y) != (b[:, 1] <= y), a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]), np.nan) for y in (y0, y1)]
    marks = np.concatenate([a[:, 0], b[:, 0], _crossings(a, b), *bound, [x0, x1]])
    marks = np.unique(marks[(marks >= x0) & (marks <= x1)])
    left, right = marks[:-1], marks[1:]
    middle = (left + right) / 2

    first, last = np.searchsorted(marks, np.clip(a[:, 0], x0, x1)), np.searchsorted(marks, np.clip(b[:, 0], x0, x1))
    n = np.maximum(0, last - first)
    e = np.repeat(np.arange(len(a)), n)
    slab = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    y = _height(a[e], b[e], middle[slab])
    within = (y > y0) & (y < y1)
    e, slab, y = e[within], slab[within], y[within]

    # which features cover the bottom of each slab: from what is known at their own places, along the bottom
    opens = np.zeros((max(1, len(parts)), len(left)), bool)
    for k, p in enumerate([] if full else parts):
        own = feature == k
        reached = np.count_nonzero(p.over & ((p.b[:, 0] - p.a[:, 0]) * (y0 - p.a[:, 1]) - (p.b[:, 1] - p.a[:, 1]) * (p.xref - p.a[:, 0]) >= 0))
        passed = np.sort(bound[0][own & ~np.isnan(bound[0])])
        count = np.searchsorted(passed, middle) - np.searchsorted(passed, p.xref)
        opens[k] = p.base ^ (reached % 2 == 1) ^ (count % 2 == 1)
    order = np.lexsort((y, feature[e], slab))
    group = slab[order] * max(1, len(parts)) + feature[e][order]
    start = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    sign = np.empty(len(e), np.int64)
    sign[order] = np.where((opens[feature[e][order], slab[order]] + rank) % 2 == 0, 1, -1)

    # covered intervals of each slab: -1 and -2 stand for the cell's bottom and top
    order = np.lexsort((y, slab))
    e, slab, sign = e[order], slab[order], sign[order]
    begin = opens.sum(0) + full if parts and not full else np.full(len(left), full)
    run = np.cumsum(sign)
    start = np.searchsorted(slab, np.arange(len(left)))
    before_slab = np.where(start > 0, run[np.maximum(start - 1, 0)] if len(run) else 0, 0)
    after = begin[slab] + run - before_slab[slab]
    before = after - sign
    lows = np.flatnonzero((before <= 0) & (after > 0))
    highs = np.flatnonzero((before > 0) & (after <= 0))
    low_open = np.flatnonzero(begin > 0)
    end = np.searchsorted(slab, np.arange(len(left)), "right")
    final = begin + np.where(end > start, (run[np.maximum(end - 1, 0)] if len(run) else 0) - before_slab, 0)
    high_open = np.flatnonzero(final > 0)
    low_slab = np.concatenate([slab[lows], low_open])
    low_edge = np.concatenate([e[lows], np.full(len(low_open), -1)])
    low_key = np.concatenate([lows, start[low_open] - 0.5])
    high_slab = np.concatenate([slab[highs], high_open])
    high_edge = np.concatenate([e[highs], np.full(len(high_open), -2)])
    high_key = np.concatenate([highs, end[high_open] - 0.5])
    low_order, high_order = np.lexsort((low_key, low_slab)), np.lexsort((high_key, high_slab))
    s, low_edge, high_edge = low_slab[low_order], low_edge[low_order], high_edge[high_order]

    def ends(edge, x):
        real = np.maximum(edge, 0)
        return np.where(edge == -1, y0, np.where(edge == -2, y1, _height(a[real], b[real], x) if len(a) else 0.0))

    ll, lr, hl, hr = ends(low_edge, left[s]), ends(low_edge, right[s]), ends(high_edge, left[s]), ends(high_edge, right[s])
    out = []
    for edge, u, v, w, z in ((low_edge, left[s], ll, right[s], lr), (high_edge, right[s], hr, left[s], hl)):
        real = edge >= 0
        tag = np.column_stack([a[edge[real]], b[edge[real]]]) if real.any() else np.zeros((0, 4))
        out.append(np.column_stack([u[real], v[real], w[real], z[real], tag]))
        flat = np.column_stack([u, v, w, z, np.full((len(u), 4), np.nan)])[~real]
        out.append(flat)
    sides = _left_over(np.concatenate([right[s], left[s]]), np.concatenate([lr, ll]), np.concatenate([hr, hl]), np.concatenate([np.ones(len(s)), -np.ones(len(s))]))
    up = sides[:, 3] > 0
    out.append(np.column_stack([sides[:, 0], np.where(up, sides[:, 1], sides[:, 2]), sides[:, 0], np.where(up, sides[:, 2], sides[:, 1]), np.full((len(sides), 4), np.nan)]))
    return np.concatenate(out)


def _rings(pieces: np.ndarray) -> tuple[list[list[tuple[int, int]]], dict]:
    """Closed rings of an outline's pieces, in units of the grain, and what the pieces are parts of; pieces along cell bounds cancel first."""
    free = np.isnan(pieces[:, 4])
    kept = [pieces[~free]]
    for axis in (0, 1):  # pieces along x = const, then along y = const
        own = pieces[free & (pieces[:, axis] == pieces[:, axis + 2])]
        other = 1 - axis
        low, high = np.minimum(own[:, other], own[:, other + 2]), np.maximum(own[:, other], own[:, other + 2])
        rest = _left_over(own[:, axis], low, high, np.sign(own[:, other + 2] - own[:, other]))
        out = np.full((len(rest), 8), np.nan)
        out[:, axis] = out[:, axis + 2] = rest[:, 0]
        out[:, other], out[:, other + 2] = np.where(rest[:, 3] > 0, rest[:, 1], rest[:, 2]), np.where(rest[:, 3] > 0, rest[:, 2], rest[:, 1])
        kept.append(out)
    pieces = np.concatenate(kept)
    ends = np.rint(pieces[:, :4] / GRAIN).astype(np.int64)
    tags = [None if t[0] != t[0] else tuple(t) for t in pieces[:, 4:].tolist()]
    net: dict[tuple, int] = defaultdict(int)
    tag_of = {}
    for (u, v, w, z), tag in zip(ends.tolist(), tags, strict=True):
        if (u, v) != (w, z):
            net[u, v, w, z] += 1
            net[w, z, u, v] -= 1
            tag_of[u, v, w, z] = tag
    follow: dict[tuple[int, int], list] = defaultdict(list)
    for (u, v, w, z), n in net.items():
        follow[u, v].extend([(w, z)] * max(0, n))
    rings = []
    for begin in list(follow):
        while follow[begin]:
            path, seen, here = [begin], {begin: 0}, begin
            while True:
                here = follow[here].pop()
                if here in seen:  # a loop is complete: it becomes a ring of its own
                    k = seen[here]
                    rings.append([*path[k:], here])
                    for p in path[k + 1 :]:
                        del seen[p]
                    del path[k + 1 :]
                    if not k and not follow[here]:
                        break
                    if here == begin:
                        break
                else:
                    seen[here] = len(path)
                    path.append(here)
                    if not follow[here]:
                        raise ValueError("an outline doesn't close")
    return rings, tag_of


def chained(pieces: np.ndarray, level: int) -> list[list[np.ndarray]]:
    """Polygons (a shell, then its holes) of an outline's pieces."""
    rings, tag_of = _rings(pieces)
    return _assembled([_straightened(r, tag_of) for r in rings])[0]


def _turn(pts: np.ndarray) -> float:
    q = pts - pts[0]
    return float((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum())


def _assembled(rings: list[np.ndarray]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Polygons (a shell, then its holes), and the holes that no shell holds.

    A shell is kept in the squares of its own size, of powers of two, that its box touches: a hole is
    compared with shells around one of its points only.
    """
    shells, holes = [], []
    for pts in rings:
        if len(pts) > 3 and (turn := _turn(pts)):
            (shells if turn > 0 else holes).append((abs(turn), pts))
    if not holes:
        return [[pts] for _, pts in shells], []
    shells.sort(key=lambda x: x[0])
    polygons = [[pts] for _, pts in shells]
    boxes = [(pts.min(0), pts.max(0)) for _, pts in shells]
    near: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    for k, (low, high) in enumerate(boxes):
        size = int(np.ceil(np.log2((high - low).max())))
        (x0, y0), (x1, y1) = (np.floor(v * 2.0**-size).astype(int).tolist() for v in (low, high))
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                near[size, x, y].append(k)
    sizes = {k[0] for k in near}
    loose = []
    for size, hole in holes:
        low, high = hole.min(0), hole.max(0)
        x, y = hole[0].tolist()
        for k in sorted(k for s in sizes for k in near.get((s, int(np.floor(x * 2.0**-s)), int(np.floor(y * 2.0**-s))), ())):
            of, shell = shells[k]
            if of > size and (boxes[k][0] <= low).all() and (boxes[k][1] >= high).all() and inside_ring(shell, hole).all():
                polygons[k].append(hole)
                break
        else:
            loose.append(hole)
    return polygons, loose


def _settled(pieces: np.ndarray, holes: list[np.ndarray], box: tuple[float, ...] | None) -> tuple[list[list[np.ndarray]], list[np.ndarray], np.ndarray]:
    """(polygons, holes without a shell, pieces) of a block of cells: pieces are those of the rings that reach its ``box``.

    Outlines don't cross, so a shell that lies within the block has all its holes there.
    """
    rings, tag_of = _rings(pieces)
    inner, rest = [], []
    if box is not None:
        x0, y0, x1, y1 = (round(v / GRAIN) for v in box)
    for ring in rings:
        if box is not None and any(u <= x0 + 2 or v <= y0 + 2 or u >= x1 - 2 or v >= y1 - 2 for u, v in ring):
            rest += [(*p, *q, *(tag_of.get((*p, *q)) or (np.nan,) * 4)) for p, q in zip(ring, ring[1:], strict=False)]
        else:
            inner.append(_straightened(ring, tag_of))
    polygons, loose = _assembled(inner + holes)
    left = np.array(rest, float).reshape(-1, 8)
    left[:, :4] *= GRAIN
    return polygons, loose, left


def _straightened(ring: list[tuple[int, int]], tag_of: dict) -> np.ndarray:
    """A ring's points in degrees, without those inside a piece of one edge or one upright or level line."""

    def way(p, q):
        tag = tag_of.get((*p, *q))
        return tag if tag is not None else (("x", p[0], q[1] > p[1]) if p[0] == q[0] else ("y", p[1], q[0] > p[0]) if p[1] == q[1] else None)

    ways = [way(p, q) for p, q in zip(ring, ring[1:], strict=False)]
    kept = [p for i, p in enumerate(ring[:-1]) if ways[i] is None or ways[i] != ways[i - 1]]
    return np.array([*kept, kept[0]], float) * GRAIN if len(kept) > 2 else np.zeros((0, 2))


def _polygons(wkb: pa.Array) -> list[list[tuple[int, bool, np.ndarray]]]:
    """Polygons of all shapes as lists of rings, their vertices rounded to the grain."""
    polygons: dict[tuple[int, int], list] = defaultdict(list)
    for i, shape in enumerate(wkb):
        found = parsed(shape.as_py())
        for p, hole, r in found[1] if found and found[0] in ("POLYGON", "MULTIPOLYGON") else ():
            if len(r) > 3:
                polygons[i, p].append((p, hole, np.rint(r / GRAIN) * GRAIN))
    return list(polygons.values())


def _boxed(g: pa.Array, wkb: pa.Array) -> pa.RecordBatch:
    """The polygons of a batch of shapes as rows of :data:`POLYGON`, rounded as in :func:`_polygons`; rings without any number are left out."""
    shapes = Shapes(wkb)
    size = np.diff(shapes.ring_at)
    numbers = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isnan(shapes.pts).all(1), len(size))
    kept = np.flatnonzero(np.isin(shapes.kinds.astype(str), ("POLYGON", "MULTIPOLYGON"))[shapes.ring_row] & (size > 3) & (numbers > 0))
    if not len(kept):
        return pa.RecordBatch.from_pylist([], pa.schema([("g", pa.string()), *[(c, pa.float64()) for c in BOX], ("geom_wkb", pa.binary())]))
    held = np.zeros(len(size), bool)
    held[kept] = True
    pts = np.rint(shapes.pts[np.repeat(held, size)] / GRAIN) * GRAIN
    if not np.isfinite(pts).all():
        raise ValueError("a polygon's coordinates aren't finite")
    size, row = size[kept], shapes.ring_row[kept]
    ring_at = np.concatenate([[0], np.cumsum(size)])
    first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(shapes.poly[kept]) != 0)))
    data, at, size = memoryview(np.ascontiguousarray(pts, "<f8").tobytes()), (16 * ring_at).tolist(), size.tolist()
    made = [struct.pack("<BII", 1, 3, b - a) + b"".join(struct.pack("<I", size[r]) + data[at[r] : at[r + 1]] for r in range(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(kept)], strict=True)]
    box = np.column_stack([np.minimum.reduceat(pts, ring_at[first]), np.maximum.reduceat(pts, ring_at[first])])
    return pa.RecordBatch.from_arrays([g.take(pa.array(row[first])), *[pa.array(box[:, k]) for k in range(4)], pa.array(made, pa.binary())], ["g", *BOX, "geom_wkb"])


def _together(box: np.ndarray) -> np.ndarray:
    """For each box the least number of a box that it hangs together with; boxes that touch do."""
    label = np.arange(len(box))
    tried = []
    for k in (0, 1):  # along the axis in which fewer of them meet
        order = np.argsort(box[:, k], kind="stable")
        tried.append((order, np.searchsorted(box[order, k], box[order, k + 2], "right") - np.arange(len(box)) - 1, 1 - k))
    order, later, other = min(tried, key=lambda t: t[1].sum())
    step, at = np.cumsum(later), 0
    while at < len(box):
        end = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + (1 << 18), "right")))
        n = later[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = order[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        i = order[i]
        met = (box[i, other] <= box[j, other + 2]) & (box[j, other] <= box[i, other + 2])
        i, j = i[met], j[met]
        while (apart := (u := label[i]) != (v := label[j])).any():
            np.minimum.at(label, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
            while ((up := label[label]) != label).any():
                label = up
        at = end
    return label


def _alone(shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Which polygons are their own outline, and all points with shells turned to the left and holes to the right.

    Their rings, of which at most one is a hole, meet neither themselves nor each other, and have no
    points that :func:`_straightened` would leave out.
    """
    pts, start, end = shapes.pts, shapes.ring_at[:-1], shapes.ring_at[1:]
    size, rings = end - start, np.diff(shapes.row_at)
    ring = np.repeat(np.arange(len(size)), size)
    edge = np.flatnonzero(ring[1:] == ring[:-1])
    after = np.where(edge + 2 < end[ring[edge]], edge + 1, start[ring[edge]])
    upright, level = (pts[1:] == pts[:-1]).T
    bad = (upright[edge] & upright[after]) | (level[edge] & level[after]) | (upright[edge] & level[edge])
    good = (rings == 1) | (rings == 2)
    _, turn, _ = shapes._turns(pts)
    good[shapes.ring_row[ring[edge[bad]]]] = False
    good[shapes.ring_row[turn == 0]] = False
    holed = np.flatnonzero(good & (rings == 2))
    shell = shapes.row_at[holed]
    pairs = np.column_stack([size[shell], size[shell + 1]])
    good[holed[pairs.sum(1) > 64]] = False
    good = shapes.valid(good)
    for m, n in np.unique(pairs[good[holed]], axis=0).tolist():
        own = holed[good[holed] & (pairs == (m, n)).all(1)]
        s, h = (pts[start[shapes.row_at[own] + k][:, None] + np.arange(c)] for k, c in ((0, m), (1, n)))
        step = max(1, (1 << 18) // (m * n))
        for at in range(0, len(own), step):
            a, b = s[at : at + step, :, None], h[at : at + step, None]
            good[own[at : at + step]] &= ~_meeting(a[:, :-1], a[:, 1:], b[:, :, :-1], b[:, :, 1:], True).any((1, 2))
    place = np.arange(len(pts))
    back = (turn > 0) == shapes.hole
    return good, pts[np.where(back[ring], start[ring] + end[ring] - 1 - place, place)]


def _united(polygons: list[list[tuple[int, bool, np.ndarray]]]) -> list[bytes]:
    """The union of a few polygons: one cell around them, whose bounds nothing reaches."""
    parts = []
    for rings in polygons:
        a, b = np.concatenate([r[:-1] for _, _, r in rings]), np.concatenate([r[1:] for _, _, r in rings])
        moves = (a != b).any(1)
        a, b = a[moves], b[moves]
        left = ((a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] <= b[:, 1])))[:, None]
        if len(a):
            parts.append(np.column_stack([np.where(left, a, b), np.where(left, b, a)]))
    if not parts:
        return []
    ends = np.concatenate(parts)
    (x0, y0), (x1, y1) = np.minimum(ends[:, :2], ends[:, 2:]).min(0) - 1, np.maximum(ends[:, :2], ends[:, 2:]).max(0) + 1
    pieces = cell_outline([Cell(e.tobytes(), b"", x0, False) for e in parts], 0, x0, y0, x1, y1)
    return [encode_polygon([r.tolist() for r in p]) for p in chained(pieces, 0)]


def _packed(polygons: list[bytes]) -> list[bytes]:
    """Multipolygons of all polygons, each of at most PART_BYTES or of one polygon."""
    out, own, size = [], [], 0
    for p in polygons:
        if own and size + len(p) > PART_BYTES:
            out.append(encode_multipolygon(own))
            own, size = [], 0
        own.append(p)
        size += len(p)
    return [*out, encode_multipolygon(own)] if own else out


def _block_of(box: np.ndarray, wkb: pa.Array, at: np.ndarray, x: int, y: int) -> tuple[list[bytes], np.ndarray]:
    """Polygons of the union that block (x, y) settles, and which rows go on: those that hang together with something beyond it, or are too many.

    ``at`` are the blocks of the boxes' corners. A row goes on from the block of its lower left corner.
    """
    label = _together(box)
    points = np.bincount(label, np.asarray(pc.binary_length(wkb)) // 16, len(box))
    lone = np.bincount(label, minlength=len(box)) == 1
    loose = (points > WHOLE_POINTS) & ~lone
    loose[label[(at[:, :2] != at[:, 2:]).any(1)]] = True
    rest = loose[label]
    single = np.flatnonzero(~rest & lone[label])
    made, shapes = [], Shapes(wkb.take(pa.array(single)))
    if len(single):
        good, turned = _alone(shapes)
        made = shapes.encoded(turned).filter(pa.array(good)).to_pylist()
        single = single[~good]
    rest[single[points[label[single]] > WHOLE_POINTS]] = True
    several = np.setdiff1d(np.flatnonzero(~rest), np.flatnonzero(lone[label]))
    several = np.concatenate([several, single[~rest[single]]])
    several = several[np.argsort(label[several], kind="stable")]
    for own in np.split(several, np.flatnonzero(np.diff(label[several])) + 1) if len(several) else ():
        made += _united(_polygons(wkb.take(pa.array(own))))
    return made, np.flatnonzero(rest & (at[:, 0] == x) & (at[:, 1] == y))


def _settling(level: int, shift: float):
    """Reads the polygons of a block; gives parts of the union (``made``), and the polygons that go on."""
    names = [c.split()[0] for c in POLYGON.split(", ")]

    def rows(g: str, made: list[bytes], rest: pa.Table) -> pa.RecordBatch:
        n = len(made)
        columns = [pa.concat_arrays([pa.nulls(n, rest[c].type), rest[c].combine_chunks()]) for c in names[1:]]
        return pa.RecordBatch.from_arrays([pa.array([g] * (n + len(rest)), pa.string()), *columns, pa.array(made + [None] * len(rest), pa.binary())], [*names, "made"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, x, y = (k.as_py() for k in key)
        held, n, size = [], 0, 0

        def table(found: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
            own = pa.Table.from_batches(found).select(names)
            box = np.column_stack([np.asarray(own[c], float) for c in BOX])
            return own, box, np.floor(box * 2.0**level + shift)

        for batch in batches:
            held.append(batch)
            n, size = n + len(batch), size + batch.nbytes
            if n > BLOCK_ROWS or size > BLOCK_BYTES:  # all that are yet to come go on, too
                own, _, at = table(held)
                yield rows(g, [], own.filter(pa.array((at[:, :2] == (x, y)).all(1))))
                held = []
        if held and n <= BLOCK_ROWS and size <= BLOCK_BYTES:
            own, box, at = table(held)
            made, rest = _block_of(box, own["geom_wkb"].combine_chunks(), at, x, y)
            yield rows(g, _packed(made), own.take(pa.array(rest)))

    return run


def _blocks_level(polygons: DataFrame) -> int | None:
    """The deepest level at which polygons touch COPIES blocks each, on average; none where they are too large for that."""

    def touched(level: int) -> Column:
        at = lambda c: F.floor(F.col(c) * 2.0**level)
        return F.sum((at("x1") - at("x0") + 1) * (at("y1") - at("y0") + 1))

    levels = range(-6, DEEPEST + 7)
    sums = polygons.agg(F.count("*").alias("n"), *[touched(k).alias(str(k)) for k in levels]).first()
    return max((k for k in levels if sums["n"] and sums[str(k)] <= COPIES * sums["n"] + 64), default=None)


def _grouped(boundary: DataFrame, group: str | None, most: int | None) -> tuple[DataFrame, DataFrame]:
    """All groups (g, ``group``), and the union of each in parts (g, geom_wkb); a group without polygons has none."""
    spark = boundary.sparkSession
    key = F.col(group).cast("string") if group else F.lit("")
    rows = materialised(boundary.select(F.coalesce(F.concat(F.lit("="), key), F.lit("null")).alias("g"), *([F.col(group)] if group else []), "geom_wkb"), "features")
    shapes = rows.where("geom_wkb IS NOT NULL").select("g", "geom_wkb").distinct()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # small rows, much work: not to be coalesced
    names = ["g", *[c.split()[0] for c in CELL.split(", ")]]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_(), pa.binary()]
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def parts(g: str, made: list[bytes]) -> pa.Table:
        return pa.table({"g": pa.array([g] * len(made), pa.string()), "geom_wkb": pa.array(made, pa.binary())})

    def whole(key: tuple, found: pa.Table) -> pa.Table:
        return parts(key[0].as_py(), _packed(_united(_polygons(found["geom_wkb"]))))

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _boxed(batch.column("g"), batch.column("geom_wkb"))

    made = []
    if most is None:
        points = shapes.groupBy("g").agg(F.sum(F.octet_length("geom_wkb") / 16).alias("points"))
        small = materialised(points.where(F.col("points") <= WHOLE_POINTS).select("g"), "small")
        made.append(materialised(shapes.join(small, "g", "left_semi").repartition(tasks, "g").groupBy("g").applyInArrow(whole, "g string, geom_wkb binary"), "parts"))
        shapes = materialised(shapes.join(small, "g", "left_anti").mapInArrow(boxed, POLYGON), "polygons")
        if (level := _blocks_level(shapes)) is not None:
            for up, shift in ROUNDS:
                at = lambda c, k=level - up, by=shift: F.floor(F.col(c) * 2.0**k + by).cast("long")
                dealt = shapes.withColumn("bx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("by", F.explode(F.sequence(at("y0"), at("y1"))))
                done = materialised(dealt.repartition(tasks, "g", "bx", "by").groupBy("g", "bx", "by").applyInArrow(_settling(level - up, shift), f"{POLYGON}, made binary"), "settled")
                made.append(done.where("made IS NOT NULL").select("g", F.col("made").alias("geom_wkb")))
                shapes = done.where("made IS NULL").drop("made")
    if most is not None or not shapes.isEmpty():
        if most is None:  # a cell for some points
            count, octets = shapes.agg(F.count("*"), F.sum(F.octet_length("geom_wkb"))).first()
            most = int(1.5 * count + min(MOST_CELLS, max(64, octets // 16 // CELL_POINTS)))  # each feature touches a cell at least
        level = grid_level(shapes, most, DEEPEST + 6)
        scale = 2.0**level

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = {n: [] for n in names}
                for g, shape in zip(batch.column("g").to_pylist(), batch.column("geom_wkb"), strict=True):
                    for rings in _polygons([shape]):
                        part = cut(rings, level) | {"g": None}
                        part["g"] = [g] * len(part["cx"])
                        for n in names:
                            own[n].extend(part[n])
                        if len(own["cx"]) > 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(own[c], t) for c, t in zip(names, types, strict=True)], names)
                            own = {n: [] for n in names}
                yield pa.RecordBatch.from_arrays([pa.array(own[c], t) for c, t in zip(names, types, strict=True)], names)

        def outlines(key: tuple, found: pa.Table) -> pa.Table:
            g, cx, cy = (k.as_py() for k in key)
            full = sum(found["inside"].to_pylist())
            own = [] if full else [Cell(e, b"", x, b) for e, x, b in zip(found["edges"].to_pylist(), found["xref"].to_pylist(), found["base"].to_pylist(), strict=True)]
            return block(g, cx, cy, cell_outline(own, int(full > 0), cx / scale, cy / scale, (cx + 1) / scale, (cy + 1) / scale))

        def block(g: str, cx: int, cy: int, pieces: np.ndarray, holes: list = (), made: list = ()) -> pa.Table:
            """Rows of a block: its pieces, then its holes, then its parts of the union."""
            n, more = len(pieces), len(holes) + len(made)
            values = {c: pa.array(np.append(pieces[:, k], np.full(more, np.nan)), pa.float64()) for k, c in enumerate(columns)}
            binary = {"hole": [None] * n + [h.tobytes() for h in holes] + [None] * len(made), "made": [None] * (n + len(holes)) + list(made)}
            return pa.table({"g": pa.array([g] * (n + more), pa.string()), "cx": pa.array([cx] * (n + more), pa.int64()), "cy": pa.array([cy] * (n + more), pa.int64()), **values, **{c: pa.array(v, pa.binary()) for c, v in binary.items()}})

        def closed(found: pa.Table, box: tuple[float, ...] | None) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
            """Parts of the union, holes without a shell, and pieces."""
            holes = [np.frombuffer(h).reshape(-1, 2) for h in found["hole"].drop_null().to_pylist()]
            pieces = np.column_stack([np.asarray(found[c], float) for c in columns])[np.asarray(found["hole"].is_null())]
            polygons, holes, rest = _settled(pieces, holes, box)
            return _packed([encode_polygon([r.tolist() for r in p]) for p in polygons]), holes, rest

        def blocks(up: int):
            def run(key: tuple, found: pa.Table) -> pa.Table:
                g, x, y = (k.as_py() for k in key)
                side = (1 << up) / scale
                made, holes, rest = closed(found, (x * side, y * side, (x + 1) * side, (y + 1) * side))
                return block(g, x << up, y << up, rest, holes, made)

            return run

        def last(key: tuple, found: pa.Table) -> pa.Table:
            return parts(key[0].as_py(), closed(found, None)[0])

        kind = f"g string, cx long, cy long, {PIECES}, hole binary, made binary"
        pieces = materialised(shapes.repartition(tasks, "geom_wkb").mapInArrow(cells, f"g string, {CELL}").repartition(tasks, "g", "cx", "cy").groupBy("g", "cx", "cy").applyInArrow(outlines, kind), "outline")
        up = 0
        while (up := up + 4) < level + 9 and (up in BLOCKS and up < level or pieces.count() > LAST_PIECES):  # up to blocks of 256 degrees
            at = [F.shiftright(c, up).alias(f"b{c}") for c in ("cx", "cy")]
            done = materialised(pieces.select("*", *at).repartition(tasks, "g", "bcx", "bcy").groupBy("g", "bcx", "bcy").applyInArrow(blocks(up), kind), "blocks")
            made.append(done.where("made IS NOT NULL").select("g", F.col("made").alias("geom_wkb")))
            pieces = done.where("made IS NULL")
        made.append(materialised(pieces.groupBy("g").applyInArrow(last, "g string, geom_wkb binary"), "parts"))
    groups = rows.select("g", *([group] if group else [])).distinct() if group else spark.range(1).select(F.lit("=").alias("g"))
    return materialised(groups, "groups"), reduce(DataFrame.unionAll, made)


def union(boundary: DataFrame, group: str | None = None, most: int | None = None) -> DataFrame:
    """One row (per ``group``) with the union of the polygons as a WKB multipolygon: what several cover counts once.

    Points and lines add nothing, as do null, damaged and empty shapes; a group without polygons has a
    null value, a null group is a group. Each polygon is taken by the even-odd rule. Vertices are rounded
    to a billionth of a degree. Equal features count once; polygons that meet few others are settled in
    blocks, the rest is dealt to cells and each cell is worked on by itself, in time quadratic in its
    edges; the outline is chained in blocks of cells. The value is put together in one task a group:
    :func:`union_parts` gives the union of a large group.
    """

    def joined(key: tuple, found: pa.Table) -> pa.Table:
        made = found["geom_wkb"].to_pylist()
        value = struct.pack("<BII", 1, 6, sum(struct.unpack_from("<I", m, 5)[0] for m in made)) + b"".join(m[9:] for m in made)
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "geom_wkb": pa.array([value], pa.binary())})

    groups, parts = _grouped(boundary, group, most)
    return groups.join(parts.groupBy("g").applyInArrow(joined, "g string, geom_wkb binary"), "g", "left").select(*([group] if group else []), "geom_wkb", F.lit(4326).alias("srid"))


def union_parts(boundary: DataFrame, group: str | None = None, most: int | None = None) -> DataFrame:
    """The polygons of :func:`union` as multipolygons of at most PART_BYTES or of one polygon, in as many rows as there are.

    A group without polygons has one row with a null value. No task holds a group: only what reaches
    beyond the largest blocks, and each single polygon, is in one task.
    """
    groups, parts = _grouped(boundary, group, most)
    found = parts.join(groups, "g").select(*groups.columns, "geom_wkb")
    none = groups.join(parts.select("g").distinct(), "g", "left_anti").select("*", F.lit(None).cast("binary").alias("geom_wkb"))
    return found.unionAll(none).select(*([group] if group else []), "geom_wkb", F.lit(4326).alias("srid"))
