"""Geometry without a spatial library.

WKB is decoded in Arrow batches into flat arrays of points, and what depends on a shape alone
(validity, area, centroid, bounds, projection) is computed for the whole batch at once. Predicates
of points and rings are Column expressions. Odd shapes, of several rings or another byte order, are
read together where they have the same structure, else one by one, into the same flat arrays.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafoot.functions.crs import EUROPE, Metric, laea, laea_arrays, to_degrees

#: Types as objects: Python workers import this module, and they have no session to parse text with.
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.StructType([T.StructField("poly", T.IntegerType()), T.StructField("hole", T.BooleanType()), T.StructField("pts", T.ArrayType(POINT))]))
SHAPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rings", RINGS)])
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def layout(data: bytes) -> tuple[str, list[tuple[int, bool, int, int, int, str]]]:
    """(kind, [(polygon number, is a hole, place of its points, number of them, their dimensions, byte order)])."""
    at, polygons, rings = 0, 0, []

    def take(fmt: str):
        nonlocal at
        values = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return values[0] if len(values) == 1 else values

    def points(hole: bool, order: str, n: int, dims: int) -> None:
        nonlocal at
        if at + n * dims * 8 > len(data):
            raise ValueError("points are missing")
        rings.append((polygons, hole, at, n, dims, order))
        at += n * dims * 8

    def geometry() -> str:
        nonlocal at, polygons
        order = "<" if take("B") else ">"
        code = take(order + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = KINDS[code % 1000]
        if kind == "POINT":
            points(False, order, 1, dims)
            polygons += 1
        elif kind == "LINESTRING":
            points(False, order, take(order + "I"), dims)
            polygons += 1
        elif kind == "POLYGON":
            for i in range(take(order + "I")):
                points(i > 0, order, take(order + "I"), dims)
            polygons += 1
        else:
            for _ in range(take(order + "I")):
                geometry()
        return kind

    return geometry(), rings


def parse_wkb(data: bytes) -> tuple[str, list[tuple[int, bool, np.ndarray]]]:
    """(kind, [(polygon number, is a hole, points)]); Z and M are left out, points and lines are kept as one ring."""
    kind, rings = layout(data)
    return kind, [(p, hole, np.frombuffer(data, f"{order}f8", n * dims, at).reshape(n, dims)[:, :2].astype(float)) for p, hole, at, n, dims, order in rings]


def parsed(data) -> tuple[str, list] | None:
    """:func:`parse_wkb`, or None for a null or what is no WKB."""
    if data is None:
        return None
    try:
        return parse_wkb(bytes(data))
    except (struct.error, KeyError, ValueError):
        return None


def encode_polygon(rings: list[list[tuple[float, float]]], little: bool = True) -> bytes:
    """WKB of a polygon: the shell, then its holes."""
    order = "<" if little else ">"
    out = struct.pack(order + "BII", little, 3, len(rings))
    for ring in rings:
        out += struct.pack(f"{order}I{2 * len(ring)}d", len(ring), *(v for p in ring for v in p))
    return out


class Shapes:
    """A batch of shapes as flat arrays.

    ``pts`` holds all points, ring r those from ``ring_at[r]`` to ``ring_at[r + 1]``, shape i the rings
    from ``row_at[i]`` to ``row_at[i + 1]``. ``kinds`` is null for a null or damaged value.
    """

    def __init__(self, wkb: pa.Array):
        wkb = (wkb.combine_chunks() if isinstance(wkb, pa.ChunkedArray) else wkb).cast(pa.large_binary())
        n = len(wkb)
        _, offsets, data = wkb.buffers()
        at = np.frombuffer(offsets, np.int64)[wkb.offset : wkb.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        size, start = np.diff(at), at[:-1]
        there = np.asarray(wkb.is_valid()) if n else np.zeros(0, bool)
        # the usual shape: a little-endian polygon of one ring
        fits = np.flatnonzero(there & (size >= 13) & ((size - 13) % 16 == 0))
        head = data[start[fits, None] + np.arange(13)] if len(fits) else np.zeros((0, 13), np.uint8)
        usual = (head[:, :9] == np.frombuffer(struct.pack("<BII", 1, 3, 1), np.uint8)).all(1) & (np.ascontiguousarray(head[:, 9:]).view("<u4").ravel() == (size[fits] - 13) // 16)
        plain = fits[usual]
        alike = list(self._alike(data, start, size, np.setdiff1d(np.flatnonzero(there), plain)))
        self.kinds = np.full(n, None, object)
        self.kinds[plain] = "POLYGON"
        rings = np.zeros(n, np.int64)
        rings[plain] = 1
        for own, (kind, found) in alike:
            self.kinds[own] = kind
            rings[own] = len(found)
        self.row_at = np.concatenate([[0], np.cumsum(rings)])
        count, self.poly, self.hole = np.zeros(self.row_at[-1], np.int64), np.zeros(self.row_at[-1], np.int32), np.zeros(self.row_at[-1], bool)
        count[self.row_at[plain]] = (size[plain] - 13) // 16
        for own, (_, found) in alike:
            for k, (p, h, _, n_pts, _, _) in enumerate(found):
                r = self.row_at[own] + k
                count[r], self.poly[r], self.hole[r] = n_pts, p, h
        self.ring_at = np.concatenate([[0], np.cumsum(count)])
        self.pts = np.zeros((self.ring_at[-1], 2))
        for length in np.unique(size[plain]).tolist():  # shapes of one length are read together
            own = plain[size[plain] == length]
            k = (length - 13) // 16
            if k:
                values = data[start[own, None] + np.arange(13, length)].view("<f8").reshape(-1, k, 2)
                self.pts[self.ring_at[self.row_at[own]][:, None] + np.arange(k)] = values
        for own, (_, found) in alike:
            for k, (_, _, place, n_pts, dims, order) in enumerate(found):
                r, long = self.ring_at[self.row_at[own] + k], n_pts * dims * 8
                if len(own) == 1:  # may be very long
                    values = data[start[own[0]] + place : start[own[0]] + place + long].view(f"{order}f8")
                else:
                    values = data[start[own, None] + np.arange(place, place + long)].view(f"{order}f8")
                self.pts[r[:, None] + np.arange(n_pts)] = values.reshape(len(own), n_pts, dims)[:, :, :2]
        self.ring_row = np.repeat(np.arange(n), rings)
        self.pt_row = np.repeat(self.ring_row, count)

    @staticmethod
    def _alike(data: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray):
        """(rows, :func:`layout`) of values whose bytes other than points are the same; damaged ones are left out."""
        for length in np.unique(size[rows]).tolist():
            rest, lonely = rows[size[rows] == length], 0
            while len(rest):
                sample = data[start[rest[0]] : start[rest[0]] + length].tobytes()
                same = np.arange(len(rest)) == 0
                try:
                    found = layout(sample)
                except (struct.error, KeyError, ValueError):
                    found = None
                if found and len(rest) > 1 and lonely < 64:  # else nearly every one has a structure of its own
                    fixed = np.ones(length, bool)
                    for _, _, at, n, dims, _ in found[1]:
                        fixed[at : at + n * dims * 8] = False
                    head = data[start[rest, None] + np.flatnonzero(fixed)]
                    same = (head == head[0]).all(1)
                    lonely += same.sum() == 1
                if found:
                    yield rest[same], found
                rest = rest[~same]

    def __len__(self):
        return len(self.kinds)

    def encoded(self, pts: np.ndarray | None = None) -> pa.Array:
        """WKB polygons or multipolygons of the rings, with ``pts`` in place of the points; null without rings."""
        data = memoryview(np.ascontiguousarray(self.pts if pts is None else pts, "<f8").tobytes())
        count, at = np.diff(self.ring_at).tolist(), (16 * self.ring_at).tolist()
        poly, row_at, out = self.poly.tolist(), self.row_at.tolist(), []
        for first, last in zip(row_at[:-1], row_at[1:], strict=True):
            parts: dict[int, list] = {}
            for r in range(first, last):
                parts.setdefault(poly[r], []).append(struct.pack("<I", count[r]) + data[at[r] : at[r + 1]])
            made = [struct.pack("<BII", 1, 3, len(rings)) + b"".join(rings) for rings in parts.values()]
            out.append(encode_multipolygon(made) if len(made) > 1 else made[0] if made else None)
        return pa.array(out, pa.binary())

    def rings(self, i: int) -> list:
        """Shape i as :func:`parse_wkb` gives it."""
        return [(int(self.poly[r]), bool(self.hole[r]), self.pts[self.ring_at[r] : self.ring_at[r + 1]]) for r in range(self.row_at[i], self.row_at[i + 1])]

    def bounds(self, pts: np.ndarray | None = None) -> np.ndarray:
        """xmin, ymin, xmax, ymax of each shape; not a number for one without points."""
        pts = self.pts if pts is None else pts
        out = np.full((len(self), 4), np.nan)
        first = np.flatnonzero(np.diff(self.pt_row, prepend=-1)) if len(pts) else np.zeros(0, int)
        if len(first):
            rows = self.pt_row[first]
            out[rows, :2], out[rows, 2:] = np.minimum.reduceat(pts, first), np.maximum.reduceat(pts, first)
        return out

    def projected(self, arrays=laea_arrays) -> np.ndarray:
        return np.column_stack(arrays(self.pts[:, 0], self.pts[:, 1]))

    def _turns(self, pts: np.ndarray):
        """Points about their ring's first one, which keeps digits, and twice the signed area and the moments of each ring."""
        rings = len(self.ring_at) - 1
        some = np.flatnonzero(np.diff(self.ring_at) > 0)
        origin = np.zeros((rings, 2))
        origin[some] = pts[self.ring_at[some]]
        ring = np.repeat(np.arange(rings), np.diff(self.ring_at))
        p = pts - origin[ring]
        same = ring[1:] == ring[:-1]
        a, b, own = p[:-1][same], p[1:][same], ring[1:][same]
        cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
        doubled = np.bincount(own, cross, rings)
        return origin, doubled, [np.bincount(own, (a[:, k] + b[:, k]) * cross, rings) for k in (0, 1)]

    def area(self, pts: np.ndarray | None = None) -> np.ndarray:
        """Shoelace area of the shells less the holes."""
        _, doubled, _ = self._turns(self.pts if pts is None else pts)
        return np.bincount(self.ring_row, np.abs(doubled) / 2 * np.where(self.hole, -1, 1), len(self))

    def centroid(self) -> np.ndarray:
        """Area-weighted centroid; the mean of the points where the area is zero; not a number without points."""
        origin, doubled, moments = self._turns(self.pts)
        weight = np.abs(doubled) * np.where(self.hole, -1, 1)
        total = np.bincount(self.ring_row, weight, len(self))
        points = np.bincount(self.pt_row, minlength=len(self))
        out = np.empty((len(self), 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in (0, 1):
                about = np.where(self.hole, -1, 1) * np.sign(doubled) * moments[k] / 3
                moment = np.bincount(self.ring_row, weight * origin[:, k] + about, len(self))
                mean = np.bincount(self.pt_row, self.pts[:, k], len(self)) / points
                out[:, k] = np.where(total != 0, moment / total, mean)
        return out

    def valid(self, asked: np.ndarray | None = None) -> np.ndarray:
        """Validity of each shape, see :func:`valid`; of those that ``asked`` marks only."""
        out = np.array([k is not None for k in self.kinds], bool) & (np.diff(self.row_at) > 0)
        if asked is not None:
            out &= asked
        areal = np.isin(self.kinds.astype(str), ("POLYGON", "MULTIPOLYGON"))
        count = np.diff(self.ring_at)
        single = out & areal & (np.diff(self.row_at) == 1)
        first = self.row_at[:-1]
        for k in np.unique(count[first[single]]).tolist():
            own = np.flatnonzero(single)[count[first[single]] == k]
            if k < 4:
                out[own] = False
            elif k <= 64:
                pts = self.pts[self.ring_at[first[own]][:, None] + np.arange(k)]
                same = (pts[:, 1:] == pts[:, :-1]).all(2).any(1)  # repeated points: the general way
                out[own] = _simple(pts)
                for i in own[same].tolist():
                    out[i] = valid(self.rings(i))
            else:
                for i in own.tolist():
                    out[i] = valid(self.rings(i))
        several = np.flatnonzero(out & areal & (np.diff(self.row_at) > 1))
        edges = np.add.reduceat(np.append(count, 0), self.row_at[:-1]) if len(self) else count
        for n in np.unique(np.diff(self.row_at)[several]).tolist():
            own = several[np.diff(self.row_at)[several] == n]
            small = edges[own] <= 64
            for i in own[~small].tolist():
                out[i] = valid(self.rings(i))
            own = own[small]
            at = self.row_at[own][:, None] + np.arange(n)
            forms, form = np.unique(np.hstack([count[at], self.poly[at], self.hole[at]]), axis=0, return_inverse=True)
            for k, (counts, poly, hole) in enumerate(forms.reshape(-1, 3, n).tolist()):
                rows = own[form.ravel() == k]
                if min(counts) < 4:
                    out[rows] = False
                    continue
                pts = self.pts[self.ring_at[self.row_at[rows]][:, None] + np.arange(sum(counts))]
                ring = np.repeat(np.arange(n), counts)
                same = ((pts[:, 1:] == pts[:, :-1]).all(2) & (ring[1:] == ring[:-1])).any(1)  # repeated points: the general way
                out[rows] = _simple_rings(pts, counts, poly, hole)
                for i in rows[same].tolist():
                    out[i] = valid(self.rings(i))
        return out

    def nested(self, pts: np.ndarray | None = None) -> pa.Array:
        """The rings as an Arrow array of Spark's type RINGS; null where the shape is."""
        pts = self.pts if pts is None else pts
        points = pa.StructArray.from_arrays([pa.array(pts[:, 0]), pa.array(pts[:, 1])], ["x", "y"])
        lists = pa.ListArray.from_arrays(pa.array(self.ring_at, pa.int32()), points)
        rings = pa.StructArray.from_arrays([pa.array(self.poly), pa.array(self.hole), lists], ["poly", "hole", "pts"])
        gone = np.array([k is None for k in self.kinds], bool)
        return pa.ListArray.from_arrays(pa.array(self.row_at, pa.int32()), rings, mask=pa.array(gone))


def _simple(pts: np.ndarray) -> np.ndarray:
    """Whether rings of equal length (rows, points, 2) without repeated points are closed, finite and don't meet themselves."""
    k = pts.shape[1] - 1
    good = np.isfinite(pts).all((1, 2)) & (pts[:, 0] == pts[:, -1]).all(1)
    i, j = np.triu_indices(k, 2)
    i, j = (x[~((i == 0) & (j == k - 1))] for x in (i, j))  # all pairs of segments that share no end
    step = max(1, (1 << 18) // max(1, len(i)))
    for at in range(0, len(pts) if len(i) else 0, step):
        part = pts[at : at + step]
        with np.errstate(invalid="ignore"):
            good[at : at + step] &= ~_meeting(part[:, i], part[:, i + 1], part[:, j], part[:, j + 1], True).any(1)
    return good


def _simple_rings(pts: np.ndarray, counts: list[int], poly: list[int], hole: list[int]) -> np.ndarray:
    """:func:`valid` of shapes of one form (rows, points of all rings, 2) without repeated points."""
    ends = np.cumsum(counts)
    first = ends - counts
    good = np.isfinite(pts).all((1, 2)) & (pts[:, first] == pts[:, ends - 1]).all((1, 2))
    seg = np.setdiff1d(np.arange(ends[-1]), ends - 1)
    ring = np.repeat(np.arange(len(counts)), counts)[seg]
    i, j = np.triu_indices(len(seg), 1)
    same, gap = ring[i] == ring[j], seg[j] - seg[i]
    far = same & (gap > 1) & (gap < np.array(counts)[ring[i]] - 2)  # pairs of segments of a ring that share no end
    step = max(1, (1 << 18) // max(1, len(i)))
    shells = {p: k for k, (p, h) in enumerate(zip(poly, hole, strict=True)) if not h}
    for at in range(0, len(pts), step):
        part = pts[at : at + step]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for u, v, touch in ((seg[i[far]], seg[j[far]], True), (seg[i[~same]], seg[j[~same]], False)):
                good[at : at + step] &= ~_meeting(part[:, u], part[:, u + 1], part[:, v], part[:, v + 1], touch).any(1)
            for k in np.flatnonzero(hole).tolist():
                shell, own = shells[poly[k]], part[:, first[k] : ends[k], None]
                a, b = part[:, None, first[shell] : ends[shell] - 1], part[:, None, first[shell] + 1 : ends[shell]]
                (dx, dy), (ux, uy) = np.moveaxis(b - a, 3, 0), np.moveaxis(own - a, 3, 0)
                on = (dx * uy - dy * ux == 0) & (np.minimum(a, b) <= own).all(3) & (own <= np.maximum(a, b)).all(3)
                passed = ((a[..., 1] > own[..., 1]) != (b[..., 1] > own[..., 1])) & (own[..., 0] < a[..., 0] + uy / dy * dx)
                good[at : at + step] &= (on.any(2) | (passed.sum(2) % 2 == 1)).all(1)
    return good


@F.arrow_udf(SHAPE)
def decode_wkb(wkb: pa.Array) -> pa.Array:
    """kind and rings; both null for a null or damaged value."""
    shapes = Shapes(wkb)
    return pa.StructArray.from_arrays([pa.array(shapes.kinds, pa.string()), shapes.nested()], ["kind", "rings"])


def reproject_wkb(srid: int):
    """A UDF from WKB in ``srid`` to WKB polygons in degrees, for boundary features."""
    to_degrees(np.zeros(1), np.zeros(1), srid)

    @F.arrow_udf(T.BinaryType())
    def run(wkb: pa.Array) -> pa.Array:
        shapes = Shapes(wkb)
        return shapes.encoded(np.column_stack(to_degrees(shapes.pts[:, 0], shapes.pts[:, 1], srid)))

    return run


def encode_multipolygon(polygons: list[bytes]) -> bytes:
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(polygons)


@F.arrow_udf(T.BinaryType())
def multipolygon(polygons: pa.Array) -> pa.Array:
    """WKB of a multipolygon of WKB polygons; null without any."""
    return pa.array([encode_multipolygon(x) if x else None for x in polygons.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def polygons_of(wkb: pa.Array) -> pa.Array:
    """The polygons of a shape, each as little-endian WKB; points and lines have none."""

    def parts(data):
        found = parsed(data)
        shells: dict[int, list] = {}
        for poly, _, pts in found[1] if found and found[0] in ("POLYGON", "MULTIPOLYGON") else ():
            shells.setdefault(poly, []).append(pts.tolist())
        return [encode_polygon(r) for r in shells.values()]

    return pa.array([parts(x.as_py()) for x in wkb], pa.list_(pa.binary()))


def _meeting(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, touch: bool) -> np.ndarray:
    """Whether the segments p-q and r-s meet; ``touch``: meeting in an end counts."""

    def side(p, q, r):
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    def on(d, u, v, w):
        return (d == 0) & (np.minimum(u, v) <= w).all(-1) & (w <= np.maximum(u, v)).all(-1)

    d1, d2, d3, d4 = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
    found = (d1 * d2 < 0) & (d3 * d4 < 0)
    return found | on(d1, p, q, r) | on(d2, p, q, s) | on(d3, r, s, p) | on(d4, r, s, q) if touch else found


def _crossings(a: np.ndarray, b: np.ndarray, touch: bool) -> bool:
    """Whether a segment of path ``a`` meets one of path ``b``, in slices of bounded size."""
    if len(a) < 2 or len(b) < 2:
        return False
    step = max(1, (1 << 18) // len(b))
    return any(_meeting(a[i : i + step + 1][:-1, None], a[i : i + step + 1][1:, None], b[None, :-1], b[None, 1:], touch).any() for i in range(0, len(a) - 1, step))


def inside(rings: list, x: float, y: float) -> bool:
    """Even-odd over all rings, given as points or as edges (n, 2, 2); a point on an edge or vertex is inside."""
    odd = False
    for _, _, pts in rings:
        a, b = (pts[:-1], pts[1:]) if pts.ndim == 2 else (pts[:, 0], pts[:, 1])
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        if ((cross == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))).any():
            return True
        up = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= bool((up & (x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))).sum() % 2)
    return odd


def edge_rows(a: np.ndarray, b: np.ndarray, origin: np.ndarray, scale: np.ndarray, margin: float) -> tuple[np.ndarray, ...]:
    """(edge, row, first column, last column): the grid cells that edges pass, row by row; ``a`` is each edge's left end.

    Edges reach ``margin`` beyond themselves, so cells that meet one in a rounded point are among them.
    """
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    row0, row1 = (np.floor((v - origin[1]) * scale[1]).astype(np.int64) for v in (low - margin, high + margin))
    n = row1 - row0 + 1
    edge = np.repeat(np.arange(len(a)), n)
    row = row0[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
    y0, y1 = np.maximum(row / scale[1] + origin[1] - margin, low[edge]), np.minimum((row + 1) / scale[1] + origin[1] + margin, high[edge])
    rise = b[edge, 1] - a[edge, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = [np.clip(a[edge, 0] + (y - a[edge, 1]) / rise * (b[edge, 0] - a[edge, 0]), a[edge, 0], b[edge, 0]) for y in (y0, y1)]
    flat = rise == 0
    col0 = np.floor((np.where(flat, a[edge, 0], np.minimum(*at)) - margin - origin[0]) * scale[0]).astype(np.int64)
    col1 = np.floor((np.where(flat, b[edge, 0], np.maximum(*at)) + margin - origin[0]) * scale[0]).astype(np.int64)
    return edge, row, col0, col1


def edge_cells(edge: np.ndarray, row: np.ndarray, col0: np.ndarray, col1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the given rows, column) of each cell."""
    n = col1 - col0 + 1
    own = np.repeat(np.arange(len(edge)), n)
    return own, col0[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def _conflict(a: np.ndarray, b: np.ndarray, ring: np.ndarray, place: np.ndarray, size: np.ndarray) -> bool:
    """Whether segments of one ring that share no end meet, or segments of two rings cross.

    Segments are dealt to the cells of a grid with at most about as many cells as segments; only those of
    one cell are compared, in slices of bounded size.
    """
    left = (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] <= b[:, 1]))
    p, q = np.where(left[:, None], a, b), np.where(left[:, None], b, a)
    low, high = np.minimum(a, b).min(0), np.maximum(a, b).max(0)
    wide = float((high - low).max())
    margin = wide * 1e-12
    extent = np.maximum(high - low + 4 * margin, max(wide, 1e-300) * 1e-9)
    sides = np.clip(extent / np.maximum(np.abs(b - a).mean(0), extent / len(a)), 1, len(a))  # cells as long as the segments are on average
    sides = np.maximum(1, np.floor(sides * min(1.0, np.sqrt(len(a) / sides.prod()))))
    scale = sides / extent
    rows = edge_rows(p, q, low - 2 * margin, scale, margin)
    own, col = edge_cells(*rows)
    cell, seg = rows[1][own] * (int(sides[0]) + 4) + col, rows[0][own]
    order = np.argsort(cell, kind="stable")
    cell, seg = cell[order], seg[order]
    until = np.searchsorted(cell, cell, "right")
    later = until - np.arange(len(cell)) - 1  # so many segments follow in the same cell
    step = np.cumsum(later)
    at = 0
    while at < len(cell):
        end = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + (1 << 18), "right")))
        n = later[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = seg[i], seg[j]
        same = ring[i] == ring[j]
        gap = np.abs(place[i] - place[j])
        met = same & (gap > 1) & (gap < size[i] - 1)
        if _meeting(a[i[met]], b[i[met]], a[j[met]], b[j[met]], True).any() or _meeting(a[i[~same]], b[i[~same]], a[j[~same]], b[j[~same]], False).any():
            return True
        at = end
    return False


def inside_ring(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """:func:`inside` of one ring for many points: edges are looked up by bands of y."""
    a, b = ring[:-1], ring[1:]
    low, high = ring[:, 1].min(), ring[:, 1].max()
    bands = max(1, len(a) // 4)
    scale = bands / max(high - low, 1e-300)
    of = lambda y: np.clip(np.floor((y - low) * scale), 0, bands - 1).astype(np.int64)
    first, last = of(np.minimum(a[:, 1], b[:, 1])), of(np.maximum(a[:, 1], b[:, 1]))
    own, band = edge_cells(np.arange(len(a)), first, first, last)
    order = np.argsort(band, kind="stable")
    own, at = own[order], np.searchsorted(band[order], np.arange(bands + 1))
    mine = of(points[:, 1])
    return np.array([inside([(0, False, np.stack([a[e], b[e]], 1))], x, y) for e, (x, y) in ((own[at[k] : at[k + 1]], p) for k, p in zip(mine.tolist(), points.tolist(), strict=True))], bool)


def valid(rings: list) -> bool:
    """Closed rings of four points or more that don't cross themselves or each other, holes inside their shell."""
    parts = []
    for _, _, pts in rings:
        if len(pts) < 4 or not np.isfinite(pts).all() or (pts[0] != pts[-1]).any():
            return False
        own = pts[np.concatenate([[True], (pts[1:] != pts[:-1]).any(1)])]
        if len(own) < 4:
            return False
        parts.append(own)
    count = np.array([len(r) - 1 for r in parts])
    ring = np.repeat(np.arange(len(parts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if _conflict(np.concatenate([r[:-1] for r in parts]), np.concatenate([r[1:] for r in parts]), ring, place, count[ring]):
        return False
    shells = {p: r for p, h, r in rings if not h}
    return all(inside_ring(shells[p], r).all() for p, h, r in rings if h)


def shapes_meet(a: list, b: list) -> bool:
    """Whether two polygon shapes have a point in common."""
    a, b = ([r for r in s if len(r[2])] for s in (a, b))  # a ring without points holds nothing
    if not a or not b:
        return False
    (ax, ay), (bx, by) = (np.concatenate([r for _, _, r in s]).T for s in (a, b))
    if ax.min() > bx.max() or bx.min() > ax.max() or ay.min() > by.max() or by.min() > ay.max():
        return False
    if any(inside(b, *r[0]) for _, h, r in a if not h) or any(inside(a, *r[0]) for _, h, r in b if not h):
        return True
    return any(_crossings(r, s, True) for _, _, r in a for _, _, s in b)


@F.arrow_udf(T.BooleanType())
def is_valid(wkb: pa.Array) -> pa.Array:
    """Validity of the shape; false for a null, damaged or empty one."""
    return pa.array(Shapes(wkb).valid())


@F.arrow_udf(T.StructType([T.StructField("geom_type", T.StringType()), T.StructField("is_valid", T.BooleanType())]))
def kind_and_validity(wkb: pa.Array) -> pa.Array:
    """The shape's kind and validity, from one parse."""
    shapes = Shapes(wkb)
    return pa.StructArray.from_arrays([pa.array(shapes.kinds, pa.string()), pa.array(shapes.valid())], ["geom_type", "is_valid"])


#: What the lookup table holds of a shape: kind, rings in degrees and in metres, and the metric box.
LOOKUP = T.StructType([*SHAPE.fields, T.StructField("rings_3035", RINGS), *[T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]])


def doubles(values: np.ndarray) -> pa.Array:
    """An Arrow column in which what is not a number is null."""
    return pa.array(values, mask=np.isnan(values))


def lookup_shape(metric: Metric = EUROPE):
    """A UDF from WKB to everything that :data:`LOOKUP` names, from one parse; null for a null or damaged value."""
    arrays = metric.arrays

    @F.arrow_udf(LOOKUP)
    def run(wkb: pa.Array) -> pa.Array:
        shapes = Shapes(wkb)
        pts = shapes.projected(arrays)
        box = shapes.bounds(pts)
        return pa.StructArray.from_arrays([pa.array(shapes.kinds, pa.string()), shapes.nested(), shapes.nested(pts), *[doubles(box[:, k]) for k in range(4)]], [f.name for f in LOOKUP])

    return run


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]))
def wkb_bounds(wkb: pa.Array) -> pa.Array:
    """The box of a shape; null bounds for one without points."""
    box = Shapes(wkb).bounds()
    return pa.StructArray.from_arrays([doubles(box[:, k]) for k in range(4)], ["xmin", "ymin", "xmax", "ymax"])


MEASURES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("area", "x", "y", "xmin", "ymin", "xmax", "ymax")])


@F.arrow_udf(MEASURES)
def measures(wkb: pa.Array) -> pa.Array:
    """Area, centroid and box of a shape in its own plane, from one parse; null for one without points."""
    shapes = Shapes(wkb)
    box = shapes.bounds()
    values = np.column_stack([np.where(np.isnan(box[:, 0]), np.nan, shapes.area()), shapes.centroid(), box])
    return pa.StructArray.from_arrays([doubles(values[:, k]) for k in range(7)], [f.name for f in MEASURES])


@F.arrow_udf(T.BooleanType())
def intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two WKB shapes meet."""
    known: dict[bytes, list] = {}

    def rings(data):
        if data is None:
            return []
        if data not in known:
            if len(known) > 1000:
                known.clear()
            found = parsed(data)
            known[data] = found[1] if found else []
        return known[data]

    return pa.array([shapes_meet(rings(x.as_py()), rings(y.as_py())) for x, y in zip(a, b, strict=True)], pa.bool_())


def plain_polygon(wkb: Column) -> Column:
    """Whether WKB is, by its head and length, a whole little-endian polygon of one ring of four points or more: known without a parse."""
    byte = lambda i: F.hex(F.substring(wkb, i, 1))
    points = F.conv(F.concat(*[byte(i) for i in (13, 12, 11, 10)]), 16, 10).cast("long")
    return (F.substring(wkb, 1, 9) == F.lit(struct.pack("<BII", 1, 3, 1))) & (points >= 4) & (F.octet_length(wkb) == 13 + 16 * points)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _edges(pts: Column, value) -> Column:
    """``value(p, q)`` for each edge of a ring."""
    n = F.size(pts)
    return F.zip_with(F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))), value)


def projected(rings: Column) -> Column:
    """Rings in the European equal-area grid."""

    def point(p):
        x, y = laea(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.struct(r["poly"].alias("poly"), r["hole"].alias("hole"), F.transform(r["pts"], point).alias("pts")))


def _cross(p, q):
    return p["x"] * q["y"] - q["x"] * p["y"]


def area(rings: Column) -> Column:
    """Shoelace area of the shells less the holes, about each ring's first point to keep digits."""

    def of_ring(r):
        o = r["pts"][0]
        turn = _edges(r["pts"], lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]))
        return F.abs(_sum(turn)) / 2.0 * F.when(r["hole"], -1.0).otherwise(1.0)

    return _sum(F.transform(rings, of_ring))


def centroid(rings: Column) -> tuple[Column, Column]:
    """Area-weighted centroid; the mean of the points where the area is zero."""

    def moment(axis):
        def of_ring(r):
            origin = r["pts"][0]

            def moved(p):
                return F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))

            pts = F.transform(r["pts"], moved)
            doubled = _sum(_edges(pts, _cross))
            about = _sum(_edges(pts, lambda p, q: (p[axis] + q[axis]) * _cross(p, q)))
            sign = F.when(r["hole"], -1.0).otherwise(1.0)
            return F.struct((sign * F.abs(doubled)).alias("a"), (sign * (F.abs(doubled) * origin[axis] + F.signum(doubled) * about / 3.0)).alias("m"))

        parts = F.transform(rings, of_ring)
        total = _sum(F.transform(parts, lambda v: v["a"]))
        points = F.flatten(F.transform(rings, lambda r: F.transform(r["pts"], lambda p: p[axis])))
        return F.when(total != 0, _sum(F.transform(parts, lambda v: v["m"])) / total).when(F.size(points) > 0, _sum(points) / F.size(points))

    return moment("x"), moment("y")


def bounds(rings: Column) -> dict[str, Column]:
    """xmin, ymin, xmax and ymax over all points."""
    axis = lambda a: F.flatten(F.transform(rings, lambda r: F.transform(r["pts"], lambda p: p[a])))
    return {"xmin": F.array_min(axis("x")), "ymin": F.array_min(axis("y")), "xmax": F.array_max(axis("x")), "ymax": F.array_max(axis("y"))}


def covers(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd point in polygon over all rings; edges and vertices count as inside."""

    def on_edge(p, q):
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    def passed(p, q):
        right = x < p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & right, 1.0).otherwise(0.0)

    on = F.exists(rings, lambda r: F.exists(_edges(r["pts"], on_edge), lambda v: v))
    return F.coalesce(on | (_sum(F.transform(rings, lambda r: _sum(_edges(r["pts"], passed)))) % 2 == 1), F.lit(False))


def distance(rings: Column, x: Column, y: Column) -> Column:
    """Planar distance from a point to the shape: 0 inside, else to the nearest edge."""

    def to_edge(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = ((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
        ex, ey = x - p["x"] - t * dx, y - p["y"] - t * dy
        return F.sqrt(ex * ex + ey * ey)

    nearest = F.array_min(F.flatten(F.transform(rings, lambda r: _edges(r["pts"], to_edge))))
    return F.when(covers(rings, x, y), 0.0).otherwise(nearest)


class Pairs:
    """A batch of (rings, point) pairs as flat arrays: the edges of all rings, the pair of each, and its point."""

    def __init__(self, rings: pa.Array, x: pa.Array, y: pa.Array):
        rings = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
        self.n = len(rings)
        inner = rings.flatten()
        lists = inner.field("pts")
        points = lists.flatten()
        sizes = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.repeat(np.arange(self.n), np.diff(np.asarray(rings.offsets))), sizes)
        p = np.column_stack([np.asarray(points.field(c), float) for c in ("x", "y")])
        last = np.zeros(len(p), bool)
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        edge = np.flatnonzero(~last)
        self.pair = row[edge]
        self.a, self.b = p[edge], p[edge + 1]
        self.q = np.column_stack([np.asarray(x, float), np.asarray(y, float)])[self.pair]

    def covered(self) -> np.ndarray:
        """Even-odd over all rings; edges and vertices count as inside."""
        a, b, q = self.a, self.b, self.q
        (dx, dy), (ux, uy) = (b - a).T, (q - a).T
        on = (dx * uy - dy * ux == 0) & (np.minimum(a, b) <= q).all(1) & (q <= np.maximum(a, b)).all(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            passed = ((a[:, 1] > q[:, 1]) != (b[:, 1] > q[:, 1])) & (q[:, 0] < a[:, 0] + uy / dy * dx)
        return (np.bincount(self.pair, on, self.n) > 0) | (np.bincount(self.pair, passed, self.n) % 2 == 1)

    def distance(self) -> np.ndarray:
        """0 inside, else the distance to the nearest edge; not a number without edges."""
        dx, dy = (self.b - self.a).T
        ux, uy = (self.q - self.a).T
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ux * dx + uy * dy) / (dx * dx + dy * dy)
        t = np.clip(np.where(np.isnan(t), 0.0, t), 0.0, 1.0)
        ex, ey = ux - t * dx, uy - t * dy
        out = np.full(self.n, np.nan)
        first = np.flatnonzero(np.diff(self.pair, prepend=-1))
        if len(first):
            out[self.pair[first]] = np.minimum.reduceat(np.sqrt(ex * ex + ey * ey), first)
        out[self.covered()] = 0.0
        return out


@F.arrow_udf(T.BooleanType())
def pair_covers(rings: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """:func:`covers` of very many pairs, in Arrow batches; false for null rings."""
    return pa.array(Pairs(rings, x, y).covered())


@F.arrow_udf(T.DoubleType())
def pair_distance(rings: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """:func:`distance` of very many pairs, in Arrow batches; null for rings that are null or have no edges."""
    return doubles(Pairs(rings, x, y).distance())


def geojson(kind: Column, rings: Column) -> Column:
    """GeoJSON text of polygons and multipolygons."""
    shell = lambda p: F.transform(F.filter(rings, lambda r: r["poly"] == p), lambda r: F.transform(r["pts"], lambda v: F.array(v["x"], v["y"])))
    parts = F.transform(F.sequence(F.lit(0), F.array_max(F.transform(rings, lambda r: r["poly"]))), shell)
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), parts[0].alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")))
    return F.when(kind == "POLYGON", one).when(kind == "MULTIPOLYGON", many)
