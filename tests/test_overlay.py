"""The union of polygons, against the polygons themselves."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafoot import queries_shapes
from terrafoot.functions import geometry
from terrafoot.operators import overlay
from terrafoot.operators.cells import Cell, cut
from terrafoot.operators.overlay import GRAIN, cell_outline, chained, union
from terrafoot.session import shared_dir

square = lambda x, y, w, h: geometry.encode_polygon([[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])


def merged(polygons, level):
    cells = {}
    for rings in polygons:
        c = cut(rings, level)
        for x, y, full, q, b, e in zip(*(c[n] for n in ("cx", "cy", "inside", "xref", "base", "edges")), strict=True):
            cells.setdefault((int(x), int(y)), []).append(None if full else Cell(e, b"", q, b))
    side, out = 2.0**-level, []
    for (x, y), parts in cells.items():
        full = any(p is None for p in parts)
        out.append(cell_outline([] if full else parts, int(full), x * side, y * side, (x + 1) * side, (y + 1) * side))
    return [(k, i > 0, r) for k, p in enumerate(chained(np.concatenate(out), level)) for i, r in enumerate(p)]


@pytest.mark.parametrize("snap", [0, 4, 32])
def test_union_holds_what_any_polygon_holds(snap):
    """Stars with holes, and rectangles that share edges and corners, at several cell sizes; the result is a valid shape."""
    rng = np.random.default_rng(snap)
    done = 0
    for trial in range(80):
        polygons = []
        for _ in range(int(rng.integers(1, 7))):
            x, y = rng.uniform(8, 12), rng.uniform(48, 51)

            def star(r, n, x=x, y=y):
                t = np.sort(rng.uniform(0, 2 * np.pi, n))
                p = np.array([x, y]) + r * rng.uniform(0.6, 1, (n, 1)) * np.column_stack([np.cos(t), np.sin(t)])
                p = np.round(p * snap) / snap if snap else p
                return np.rint(np.vstack([p, p[:1]]) / GRAIN) * GRAIN

            if trial % 3 == 0:
                u, v, w, h = rng.integers(0, 6, 4) / 2
                rings = [(0, False, np.array([(u, v), (u + w + 0.5, v), (u + w + 0.5, v + h + 0.5), (u, v + h + 0.5), (u, v)]) + [8, 48])]
            else:
                rings = [(0, False, star(rng.uniform(0.3, 2), int(rng.integers(5, 25))))] + [(0, True, star(0.1, 6))] * (rng.random() < 0.4)
            if geometry.valid(rings):
                polygons.append(rings)
        if not polygons:
            continue
        found = merged(polygons, int(rng.integers(0, 5)))
        assert geometry.valid(found)
        for x, y in rng.uniform([5, 45], [15, 55], (150, 2)):
            assert geometry.inside(found, x, y) == any(geometry.inside(p, x, y) for p in polygons)
        done += 1
    assert done > 50


def shapes_of(df):
    return {r[0]: None if r.geom_wkb is None else geometry.parse_wkb(bytes(r.geom_wkb)) for r in df.collect()}


def area(rings):
    return sum((-1 if h else 1) * abs(float(((q := r - r[0])[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum())) / 2 for _, h, r in rings)


def test_union_of_groups(spark):
    frame = [square(0, 0, 3, 1), square(0, 2, 3, 1), square(0, 0, 1, 3), square(2, 0, 1, 3)]  # around a hole
    rows = [("over", square(10, 50, 2, 2)), ("over", square(11, 51, 2, 2)), ("over", square(10, 50, 2, 2)), ("touch", square(0, 0, 1, 1)), ("touch", square(1, 0, 1, 1)), ("corner", square(0, 0, 1, 1)), ("corner", square(1, 1, 1, 1))]
    rows += [("frame", f) for f in frame] + [("apart", geometry.encode_multipolygon([square(0, 0, 1, 1), square(5, 5, 1, 1)])), ("within", square(0, 0, 4, 4)), ("within", square(1, 1, 1, 1))]
    rows += [(None, square(7, 7, 1, 1)), ("none", None), ("none", b"x"), ("none", geometry.encode_polygon([[]])), ("wide", square(-20, -20, 40.5, 30.25))]
    df = spark.createDataFrame([(g, None if w is None else bytearray(w)) for g, w in rows], "name string, geom_wkb binary")
    for most in (16, None):
        found = shapes_of(union(df, "name", most))
        assert set(found) == {g for g, _ in rows} and found.pop("none") is None
        facts = {g: (round(area(r), 9), sum(not h for _, h, _ in r), sum(h for _, h, _ in r), sum(len(p) for _, _, p in r)) for g, (_, r) in found.items()}
        assert facts == {"over": (7.0, 1, 0, 9), "touch": (2.0, 1, 0, facts["touch"][3]), "corner": (2.0, 2, 0, 10), "frame": (8.0, 1, 1, facts["frame"][3]), "apart": (2.0, 2, 0, 10), "within": (16.0, 1, 0, 5), None: (1.0, 1, 0, 5), "wide": (1225.125, 1, 0, 5)}
        assert all(k == "MULTIPOLYGON" and geometry.valid(r) for k, r in found.values())
    whole = union(df.where("name IN ('over', 'touch')")).collect()
    assert len(whole) == 1 and whole[0].srid == 4326 and round(area(geometry.parse_wkb(bytes(whole[0].geom_wkb))[1]), 9) == 9.0
    assert union(df.limit(0)).collect()[0].geom_wkb is None and union(df.limit(0), "name").count() == 0


def scattered(rng, n, far):
    """Stars, holed and self-crossing ones, rectangles that share edges or have points to spare, some of them meeting others."""

    def star(x, y, r, k):
        t = np.sort(rng.uniform(0, 2 * np.pi, k))
        p = np.array([x, y]) + r * rng.uniform(0.6, 1, (k, 1)) * np.column_stack([np.cos(t), np.sin(t)])
        return np.vstack([p, p[:1]])

    shapes = []
    for kind in rng.integers(0, 5, n).tolist():
        x, y = rng.uniform(0.1, far, 2)
        if kind == 0:
            rings = [star(x, y, 0.03, int(rng.integers(3, 9)))]
        elif kind == 1:
            rings = [star(x, y, 0.03, 12), star(x, y, 0.004, 5)[:: int(rng.choice([1, -1]))]]
        elif kind == 2:
            (x, y), (w, h) = np.round([x, y], 2), rng.integers(1, 6, 2) / 100
            rings = [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])]
        elif kind == 3:
            rings = [np.array([(x, y), (x + 0.04, y + 0.04), (x + 0.04, y), (x, y + 0.04), (x, y)])]
        else:
            rings = [np.array([(x, y), (x + 0.01, y), (x + 0.02, y), (x + 0.02, y + 0.02), (x, y + 0.02), (x, y)])[::-1]]
        shapes.append(geometry.encode_polygon([r.tolist() for r in rings]))
    return shapes


def polygons_of(values):
    """Polygons of WKB values as sorted tuples of (is a hole, points in units of the grain)."""
    found = []
    for value in values:
        parts = {}
        for k, hole, r in geometry.parse_wkb(bytes(value))[1]:
            parts.setdefault(k, []).append((hole, *sorted(map(tuple, np.rint(r[:-1] / GRAIN).astype(int).tolist()))))
        found += [tuple(sorted(p)) for p in parts.values()]
    return sorted(found)


def test_a_block_settles_what_hangs_together_within_it():
    rng = np.random.default_rng(5)
    for _ in range(5):
        shapes = pa.array(scattered(rng, 200, 1.5))
        rows = overlay._boxed(pa.array(["a"] * len(shapes)), shapes)
        box = np.column_stack([np.asarray(rows[c]) for c in overlay.BOX])
        meet = (box[:, None, :2] <= box[None, :, 2:]).all(2) & (box[None, :, :2] <= box[:, None, 2:]).all(2)
        label = np.arange(len(box))
        while (label != (label := np.where(meet, label[None], len(box)).min(1))).any():
            pass
        assert (overlay._together(box) == label).all() and len(np.unique(label)) < len(label)
        made, rest = overlay._block_of(box, rows["geom_wkb"], np.floor(box / 64), 0, 0)
        want = overlay._united(overlay._polygons(shapes))
        if len(rest):  # more hang together than one task unites
            made += overlay._united(overlay._polygons(rows["geom_wkb"].take(pa.array(rest))))
        assert polygons_of(made) == polygons_of(want)
        half = np.floor(box + 0.25)  # blocks that cut through them: those of a block that stay are in no other, and each other goes on once
        seen = [(overlay._block_of(box[own], rows["geom_wkb"].take(pa.array(own)), half[own], x, y), own) for x in range(3) for y in range(3) if len(own := np.flatnonzero((half[:, :2] <= (x, y)).all(1) & (half[:, 2:] >= (x, y)).all(1)))]
        gone = np.concatenate([own[r] for (_, r), own in seen])
        assert len(gone) == len(np.unique(gone)) > 0
        left = overlay._united(overlay._polygons(rows["geom_wkb"].take(pa.array(gone))))
        assert polygons_of([p for (m, _), _ in seen for p in m] + left) == polygons_of(want)


def test_touching_and_nested_rings_are_no_outline_of_their_own():
    outer, ring = [(0, 0), (8, 0), (7, 7), (0, 8), (0, 0)], [(1, 1), (3, 2), (2, 3), (1, 1)]
    touching, bow = [(0, 0), (3, 2), (2, 3), (0, 0)], [(0, 0), (4, 4), (4, 0), (0, 5), (0, 0)]
    flat = [(0, 0), (4, 0), (2, 0), (0, 0)]
    polygons = [[outer], [outer, ring], [outer[::-1], ring[::-1]], [outer, touching], [outer, ring, ring], [bow], [flat], [outer, [(9, 9), (11, 10), (10, 11), (9, 9)]]]
    good, turned = overlay._alone(geometry.Shapes(pa.array([geometry.encode_polygon(p) for p in polygons])))
    assert good.tolist() == [True, True, True, False, False, False, False, False]
    shapes = geometry.Shapes(pa.array([geometry.encode_polygon(p) for p in polygons[:3]]))
    _, turn, _ = shapes._turns(turned[: len(shapes.pts)])
    assert ((turn > 0) != shapes.hole).all()


def test_polygons_of_odd_shapes():
    nan, flat = float("nan"), [(0, 0), (1, 0), (0, 0)]
    one, other = square(0, 0, 1, 1), square(5, 5, 1, 2)
    shapes = [None, b"x", geometry.encode_polygon([[]]), geometry.encode_polygon([flat]), geometry.encode_polygon([[(nan, nan)] * 5]), geometry.encode_multipolygon([one, other]), geometry.encode_polygon([flat, [(0, 0), (1, 0), (1, 1), (0, 0)]], little=False)]
    rows = overlay._boxed(pa.array([str(k) for k in range(len(shapes))]), pa.array(shapes, pa.binary()))
    assert rows.column("g").to_pylist() == ["5", "5", "6"] and rows.column("y1").to_pylist() == [1, 7, 1]
    assert [len(r) for p in overlay._polygons(rows["geom_wkb"]) for _, _, r in p] == [5, 5, 4]
    assert len(overlay._boxed(pa.array(["a"]), pa.array([None], pa.binary()))) == 0
    with pytest.raises(ValueError, match="finite"):
        overlay._boxed(pa.array(["a"]), pa.array([geometry.encode_polygon([[(0, 0), (1, 0), (nan, 1), (0, 0)]])]))


@pytest.mark.parametrize("rows", [1 << 14, 40])
def test_union_in_parts(spark, monkeypatch, rows):
    """Parts are small, however large the group, and are the polygons of the union; blocks that are too full pass all their polygons on."""
    monkeypatch.setattr(overlay, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(8)
    shapes = scattered(rng, 300, 4.5)
    df = spark.createDataFrame([("a", bytearray(s)) for s in shapes] + [("a", bytearray(shapes[0])), ("b", bytearray(square(0, 0, 1, 1))), ("none", None)], "name string, geom_wkb binary")
    found = overlay.union_parts(df, "name").collect()
    assert {r.srid for r in found} == {4326} and [r.geom_wkb for r in found if r.name == "none"] == [None]
    parts = [r.geom_wkb for r in found if r.name == "a"]
    assert len(parts) > 10 and max(map(len, parts)) < 2 * overlay.PART_BYTES
    want = overlay._united(overlay._polygons(pa.array(shapes)))
    total = lambda values: sum(area(geometry.parse_wkb(bytes(v))[1]) for v in values)
    assert len(polygons_of(parts)) == len(polygons_of(want)) > 200 and total(parts) == pytest.approx(total(want), rel=1e-9)
    assert polygons_of([r.geom_wkb for r in found if r.name == "b"]) == polygons_of([square(0, 0, 1, 1)])
    if rows == 40:
        value = union(df, "name").where("name = 'a'").first().geom_wkb
        assert polygons_of([value]) == polygons_of(parts)
    else:
        assert [r.geom_wkb for r in overlay.union_parts(df.limit(0)).collect()] == [None] and overlay.union_parts(df.limit(0), "name").count() == 0


def test_no_task_of_the_dissolve_holds_a_group(spark):
    """The query sums over parts: no step puts a kind's shapes into one value, nor does a table hold one."""
    tables = lambda: set(Path(shared_dir(spark).removeprefix("file://")).glob("*"))
    before = tables()
    df = queries_shapes.QUERIES["boundary_dissolve"](spark, "/root/testdata/sf0.01")
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().toString()
    assert sorted((r.kind, r.polygons) for r in df.collect()) == [(0, 500), (1, 500), (2, 1000)]
    written = [spark.read.parquet(str(p)) for p in tables() - before]
    sizes = [t.select(F.max(F.octet_length(c))).first()[0] or 0 for t in written for c, kind in t.dtypes if kind == "binary"]
    assert 0 < max(sizes) < 2 * overlay.PART_BYTES
