"""A boundary cut into cells, against the shapes themselves."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafoot.functions import geometry
from terrafoot.operators.cells import Cell, boundary_cells, clip_by_cells, cut, grid_level
from terrafoot.operators.joins import clip

ring = lambda x, y, r, n, turn, dent=0.3: [(x + r * (1 + dent * (i % 2)) * math.cos(turn + 2 * math.pi * (i % n) / n), y + r * (1 + dent * (i % 2)) * math.sin(turn + 2 * math.pi * (i % n) / n)) for i in [*range(n), 0]]


@pytest.mark.parametrize("snap", [0, 8, 64])
def test_every_point_is_decided_by_its_cell(snap):
    """Points on vertices, edges and cell bounds too; rings cross themselves and each other."""
    rng = np.random.default_rng(snap)
    for trial in range(40):
        rings = []
        for part in range(1 + trial % 3):
            t = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 40)))
            p = np.array([10, 50]) + rng.uniform(0, 1, 2) * part + rng.uniform(0.1, 3) * rng.uniform(0.3, 1, (len(t), 1)) * np.column_stack([np.cos(t), np.sin(t)])
            p = np.round(p * snap) / snap if snap else p
            rings.append((part, part == 1, np.vstack([p, p[:1]])))
        level = int(rng.integers(0, 6))
        columns = cut(rings, level)
        cells = {(int(x), int(y)): None if full else Cell(e, s, q, b) for x, y, full, q, b, e, s in zip(*(columns[c] for c in ("cx", "cy", "inside", "xref", "base", "edges", "starts")), strict=True)}
        middles = (rings[0][2][1:] + rings[0][2][:-1]) / 2 if snap else np.zeros((0, 2))  # exact in binary, so on their edges
        pts = np.vstack([rng.uniform([6, 46], [14, 54], (60, 2)), rings[0][2], middles])
        pts = np.vstack([pts, np.round(pts * 2**level) / 2**level])
        for x, y in pts:
            at = (math.floor(x * 2**level), math.floor(y * 2**level))
            found = at in cells and (cells[at] is None or bool(cells[at].holds(np.array([[x, y]]))[0]))
            assert found == geometry.inside(rings, x, y)


def shapes(spark, rows):
    df = spark.createDataFrame([(i, None if w is None else bytearray(w)) for i, w in rows], "id long, geom_wkb binary")
    return df.withColumn("b", geometry.wkb_bounds("geom_wkb")).select("id", "geom_wkb", *[F.col(f"b.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])


@pytest.mark.parametrize("level", [None, 0, 2, 5])
def test_clip_is_brute_force(spark, level, monkeypatch):
    from terrafoot.operators import cells

    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    pick = random.Random(4)
    country = geometry.encode_polygon([ring(0.1, 0.2, 10, 40, 0.1), ring(1, 1, 3, 12, 0.2)[::-1]])
    island, dot = geometry.encode_polygon([ring(16, 0, 1, 8, 0)]), geometry.encode_polygon([ring(-14.5, 9, 0.01, 6, 0)])
    boundary = spark.createDataFrame([(0, bytearray(country)), (1, bytearray(geometry.encode_multipolygon([island, dot]))), (2, None), (3, bytearray(b"x"))], "feature_id int, geom_wkb binary")
    data = [geometry.encode_polygon([ring(pick.uniform(-15, 19), pick.uniform(-15, 15), pick.choice([0.02, 0.4, 3, 30]), pick.randint(3, 8), pick.random())]) for _ in range(400)]
    data += [geometry.encode_polygon([ring(-14.5, 9, 0.5, 8, 0)]), geometry.encode_polygon([ring(1, 1, 0.5, 8, 0)]), data[0], data[0]]  # around a feature, in the hole, twice
    data += [geometry.encode_multipolygon([data[1], data[2]]), struct.pack("<BIdd", 1, 1, 5.0, 0.0), struct.pack(">BIdd", 0, 1, 1.0, 1.0)]
    odd = [None, b"", country[:-3], geometry.encode_polygon([[]])]
    rows = list(enumerate(data + odd))
    features = [geometry.parse_wkb(f)[1] for f in (country, geometry.encode_multipolygon([island, dot]))]
    want = [i for i, d in enumerate(data) if any(geometry.shapes_meet(geometry.parse_wkb(d)[1], f) for f in features)]
    table = shapes(spark, rows)
    found = clip_by_cells(table, boundary, level=level)
    assert sorted(r.id for r in found.select("id").collect()) == want and found.columns == table.columns
    assert clip_by_cells(table.limit(0), boundary, level=level).count() == clip_by_cells(table, boundary.where("feature_id > 1"), level=level or 0).count() == 0


def test_level_bounds_the_cells(spark):
    rows = [(0, bytearray(geometry.encode_polygon([ring(10, 50, 2, 60, 0)])))]
    boundary = spark.createDataFrame(rows, "feature_id int, geom_wkb binary")
    for most in (50, 1000, 50_000):
        level = grid_level(boundary, most)
        assert boundary_cells(boundary, level).count() <= most and (level == 14 or boundary_cells(boundary, level + 1).count() > most / 8)
    assert grid_level(boundary.limit(0)) == 14


def test_plain_polygons(spark):
    square = geometry.encode_polygon([ring(0, 0, 1, 4, 0)])
    rows = [square, square[:-1], square[:9] + struct.pack("<I", 6) + square[13:], geometry.encode_polygon([ring(0, 0, 1, 4, 0)], False), geometry.encode_polygon([[]]), b"", geometry.encode_multipolygon([square]), square + bytes(16), geometry.encode_polygon([ring(0, 0, 1, 300, 0)])]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, w binary")
    assert [r.i for r in df.where(geometry.plain_polygon(F.col("w"))).collect()] == [0, 8]


def test_large_boundary_takes_the_cells(spark):
    """The form for large boundaries gives the rows of the broadcast form, and its plan sends no geometry of the boundary to the buildings."""
    pick = random.Random(8)
    boundary = spark.createDataFrame([(0, bytearray(geometry.encode_polygon([ring(10, 50, 3, 20_000, 0, 0.02)])))], "feature_id int, geom_wkb binary")
    table = shapes(spark, [(i, geometry.encode_polygon([ring(pick.uniform(6, 14), pick.uniform(46, 54), pick.choice([0.001, 0.05]), 5, pick.random())])) for i in range(2000)])
    want = sorted(r.id for r in clip(table, boundary).select("id").collect())
    assert sorted(r.id for r in clip(table, boundary, most_bytes=1000).select("id").collect()) == want and 500 < len(want) < 1500
