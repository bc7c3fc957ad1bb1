import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafoot.functions import attributes, crs, geometry, parsing, tiles

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_quadkeys(spark):
    assert one(spark, tiles.quadkey(F.lit(3), F.lit(5), 3))[0] == "213"
    assert tiles.quadkeys_of_box(5.5, 47.0, 15.5, 55.3) == "120200 120201 120202 120203 120210 120212 120220 120221 120230".split()
    assert tiles.quadkeys_of_box(-78.5, 17.6, -76.0, 18.7) == ["032210"]
    box = spark.createDataFrame([(5.5, 47.0, 15.5, 55.3)], "xmin double, ymin double, xmax double, ymax double")
    assert sorted(r.quadkey for r in tiles.tile_cover(box, 6).collect()) == tiles.quadkeys_of_box(5.5, 47.0, 15.5, 55.3)


def test_projection_and_distance(spark):
    x, y = one(spark, *crs.laea(F.lit(5.0), F.lit(50.0)))
    assert (round(x, 2), round(y, 2)) == (3962799.45, 2999718.85)
    assert [round(v, 2) for v in one(spark, *crs.laea(F.lit(10.0), F.lit(52.0)))] == [4321000.0, 3210000.0]
    at = [F.lit(v) for v in (13.405, 52.52, 13.406, 52.52)]
    assert round(one(spark, crs.haversine(*at))[0], 3) == 67.660
    assert [round(v, 9) for v in one(spark, *crs.window(F.lit(51.0), 50))] == [0.000713715, 0.000449156]
    assert round(one(spark, *crs.window(F.lit(89.0), 50))[0], 9) == 0.002245778
    lon, lat = crs.to_degrees(np.array([3962799.451]), np.array([2999718.853]), 3035)
    assert abs(lon[0] - 5) < 1e-7 and abs(lat[0] - 50) < 1e-7
    lon, lat = crs.to_degrees(np.array([500000.0]), np.array([5538630.7]), 25832)
    assert abs(lon[0] - 9) < 1e-9 and abs(lat[0] - 50) < 1e-4
    with pytest.raises(ValueError):
        crs.to_degrees(np.zeros(1), np.zeros(1), 9999)


@pytest.mark.parametrize(
    ("height", "kind", "metres"),
    [("H:3", "estimated_from_exact_storeys", 9.0), ("HHT:3.4+H:1", "exact_height_m", 3.4), ("H:2+HHT:5", "exact_height_m", 5.0), ("HBET:1-3", "estimated_from_storey_range", 6.0), ("HBET:2-3+H:2", "estimated_from_storey_range", 7.5), ("HHT:1.2.3", "other", None), (None, "unknown", None), ("", "unknown", None), ("ROOF:flat", "other", None), ("HHT:", "other", None)],
)
def test_heights(spark, height, kind, metres):
    found = attributes.height_columns(F.lit(height).cast("string"))
    row = one(spark, found["height_source_type"], found["height_m"], found["stories_exact"])
    assert row[0] == kind and (row[1] == metres if metres is None else math.isclose(row[1], metres))
    if height == "HHT:3.4+H:1":
        assert row[2] is None
        assert one(spark, attributes.height_columns(F.lit(height), lenient_storeys=True)["stories_exact"])[0] == 1


@pytest.mark.parametrize(
    ("text", "row"),
    [("RES1", ("RES", "Residential", "available")), ("com3", ("COM", "Commercial", "available")), ("R", ("R", "Unknown", "low")), ("XYZ", ("XYZ", "Unknown", "available")), ("", ("UNK", "Unknown", "none")), (None, ("UNK", "Unknown", "none"))],
)
def test_occupancy(spark, text, row):
    assert tuple(one(spark, *attributes.occupancy_columns(F.lit(text).cast("string")).values())) == row


def test_numbers(spark):
    texts = ["1.5", " -2e3 ", "5d", "1_000", "NaN", "", None, ".5", "abc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(parsing.safe_double(F.col("t"))).collect()] == [1.5, -2000.0, None, None, None, None, None, 0.5, None]
    assert one(spark, parsing.coordinate_valid(F.lit(None).cast("double"), F.lit(1.0)))[0] is False


@pytest.mark.parametrize("little", [True, False])
def test_shapes(spark, little):
    wkb = geometry.encode_polygon([SQUARE, HOLE], little)
    rows = spark.createDataFrame([(bytearray(wkb),)], "w binary").select("w", geometry.decode_wkb("w").alias("s"))
    shape = F.col("s.rings")
    at = lambda x, y: (geometry.covers(shape, F.lit(x), F.lit(y)), geometry.distance(shape, F.lit(x), F.lit(y)))
    row = rows.select(geometry.area(shape), *geometry.centroid(shape), *at(2.0, 2.0), *at(1.0, 2.0), *at(0.0, 0.0), *at(0.5, 3.5), *at(7.0, 8.0), geometry.is_valid("w"), F.col("s.kind"), geometry.geojson(F.col("s.kind"), shape)).first()
    assert row[0] == 12 and (row[1], row[2]) == (2.0, 2.0)
    assert list(row[3:13]) == [False, 1.0, True, 0.0, True, 0.0, True, 0.0, False, 5.0]
    assert row[13] is True and row[14] == "POLYGON" and row[15].startswith('{"type":"Polygon","coordinates":[[[0.0,0.0],[4.0,0.0]')


def test_validity_and_meeting(spark):
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    cases = {"bow-tie": [bow], "open": [SQUARE[:-1]], "hole outside": [SQUARE, [(x + 10, y) for x, y in HOLE]], "line": [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]]}
    assert not any(geometry.valid(geometry.parse_wkb(geometry.encode_polygon(r))[1]) for r in cases.values())
    rotated = [(0.0, 2.0), (2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)]
    assert geometry.valid(geometry.parse_wkb(geometry.encode_polygon([rotated]))[1])
    shapes = {k: geometry.parse_wkb(geometry.encode_polygon(v))[1] for k, v in {"ring": [SQUARE, HOLE], "in hole": [[(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 1.5)]], "beside": [[(4.0, 0.0), (6.0, 0.0), (6.0, 1.0), (4.0, 0.0)]], "across": [[(-1.0, 1.5), (5.0, 1.5), (5.0, 2.0), (-1.0, 1.5)]]}.items()}
    assert not geometry.shapes_meet(shapes["ring"], shapes["in hole"])
    assert geometry.shapes_meet(shapes["ring"], shapes["beside"]) and geometry.shapes_meet(shapes["ring"], shapes["across"])
    damaged = spark.createDataFrame([(bytearray(b"\x01\x03"),), (None,)], "w binary")
    assert [tuple(r) for r in damaged.select(geometry.decode_wkb("w")["kind"], geometry.is_valid("w")).collect()] == [(None, False), (None, False)]


def test_damaged_and_odd_shapes_in_one_batch():
    """The batch decoder against the parser of single shapes: other byte orders, heights, several parts, empty and damaged values."""
    import struct

    import pyarrow as pa

    square, hole = geometry.encode_polygon([SQUARE]), geometry.encode_polygon([SQUARE, HOLE])
    tall = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I15d", 5, *[v for x, y in SQUARE for v in (x, y, 9.0)])
    flagged = struct.pack("<BIII", 1, 0x20000003, 4326, 1) + struct.pack("<I10d", 5, *[v for p in SQUARE for v in p])
    point, line = struct.pack("<BIdd", 1, 1, 3.0, 4.0), struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 1.0, 1.0)
    odd = [None, b"", b"\x01\x03", square[:-3], geometry.encode_polygon([[]]), struct.pack("<BII", 1, 6, 0), geometry.encode_polygon([SQUARE], False), hole, tall, flagged, point, line, geometry.encode_multipolygon([hole, square]), geometry.encode_polygon([SQUARE[:-1]]), geometry.encode_polygon([[*SQUARE[:2], *SQUARE[1:]]])]
    for data in (odd, odd + [square] * 3, [square], []):
        shapes = geometry.Shapes(pa.array(data, pa.binary()))
        assert len(shapes) == len(data)
        for i, value in enumerate(data):
            found = geometry.parsed(value)
            assert shapes.kinds[i] == (found[0] if found else None)
            assert [(p, h, r.tolist()) for p, h, r in shapes.rings(i)] == ([(p, h, r.tolist()) for p, h, r in found[1]] if found else [])
            assert shapes.valid()[i] == bool(found and found[1] and (found[0] not in ("POLYGON", "MULTIPOLYGON") or geometry.valid(found[1]))), i
        sliced = geometry.Shapes(pa.array(data, pa.binary())[len(data) // 2 :])
        assert sliced.kinds.tolist() == shapes.kinds[len(data) // 2 :].tolist() and sliced.area().tolist() == shapes.area()[len(data) // 2 :].tolist()
    assert geometry.shapes_meet([(0, False, np.zeros((0, 2)))], geometry.parse_wkb(square)[1]) is False


def test_prepared_boundary_is_brute_force():
    """Random small shapes against a boundary with a hole and an island, by grid and pair by pair."""
    import random

    import pyarrow as pa

    from terrafoot.operators.boundary import Prepared

    pick = random.Random(2)
    ring = lambda x, y, r, n, turn: [(x + r * (1 + 0.3 * (i % 2)) * math.cos(turn + 2 * math.pi * i / n), y + r * (1 + 0.3 * (i % 2)) * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]
    closed = lambda r: [*r, r[0]]
    country = [closed(ring(0, 0, 10, 40, 0.1)), closed(ring(1, 1, 3, 12, 0.2))[::-1]]
    features = [geometry.parse_wkb(geometry.encode_polygon(country))[1], geometry.parse_wkb(geometry.encode_polygon([closed(ring(16, 0, 1, 8, 0))]))[1]]
    data = [geometry.encode_polygon([closed(ring(pick.uniform(-15, 19), pick.uniform(-15, 15), pick.choice([0.02, 0.4, 3, 30]), pick.randint(3, 8), pick.random()))]) for _ in range(400)]
    found = Prepared(features, 16).meets(geometry.Shapes(pa.array([*data, None, b"x"], pa.binary())))
    want = [any(geometry.shapes_meet(geometry.parse_wkb(d)[1], f) for f in features) for d in data]
    assert found.tolist() == [*want, False, False] and 50 < sum(want) < 350


def test_other_metrics(spark):
    """Near Kingston the local metric gives the sphere's distances, for columns and arrays alike."""
    metric = crs.azimuthal(-76.8, 18.0)
    at = [(-76.8, 18.0), (-76.79, 18.01), (-77.5, 18.3)]
    rows = spark.createDataFrame(at, "lon double, lat double")
    x, y = metric.columns(F.col("lon"), F.col("lat"))
    found = [tuple(r) for r in rows.select(x, y).collect()]
    assert np.allclose(found, np.column_stack(metric.arrays(*np.array(at).T)), atol=1e-6) and np.allclose(found[0], 0, atol=1e-6)
    step = [tuple(r) for r in rows.select(crs.haversine(F.col("lon"), F.col("lat"), F.col("lon") + 0.001, F.col("lat") + 0.001)).collect()]
    moved = [tuple(r) for r in rows.select(*metric.columns(F.col("lon") + 0.001, F.col("lat") + 0.001)).collect()]
    assert np.allclose([math.dist(a, b) for a, b in zip(found, moved, strict=True)], [s for (s,) in step], rtol=2e-3)


def test_geometry_column_kinds(spark):
    """Binary, hexadecimal and geometry columns give the same WKB; a missing one is an error."""
    from terrafoot.sources.footprints import geometry_wkb

    wkb = bytearray(geometry.encode_polygon([SQUARE]))
    binary = spark.createDataFrame([(wkb,), (None,)], "geometry binary")
    spark.conf.set("spark.sql.geospatial.enabled", "true")
    try:
        for df in (binary, binary.select(F.hex("geometry").alias("geometry")), binary.select(F.expr("st_geomfromwkb(geometry)").alias("geometry"))):
            assert [r[0] for r in df.select(geometry_wkb(df)).collect()] == [wkb, None]
    finally:
        spark.conf.unset("spark.sql.geospatial.enabled")
    with pytest.raises(ValueError):
        geometry_wkb(spark.range(1))


def test_validity_is_all_pairs():
    """Rings of every kind against the plain rule: each segment against all later ones that share no end with it."""
    import random

    def plain(rings):
        for _, _, pts in rings:
            own = pts[np.concatenate([[True], (pts[1:] != pts[:-1]).any(1)])]
            n = len(own) - 1
            if len(pts) < 4 or (pts[0] != pts[-1]).any() or n < 3:
                return False
            for i in range(n - 2):
                last = n - 1 if i == 0 else n
                if i + 2 < last and geometry._crossings(own[i : i + 2], own[i + 2 : last + 1], True):
                    return False
        shells = {p: r for p, h, r in rings if not h}
        for i, (p, h, r) in enumerate(rings):
            if any(geometry._crossings(r, other, False) for _, _, other in rings[i + 1 :]) or (h and not all(geometry.inside([(p, False, shells[p])], x, y) for x, y in r.tolist())):
                return False
        return True

    pick, verdicts = random.Random(31), []
    for k in range(700):
        n, snap = pick.randint(3, 120), pick.choice([None, 2, 8])

        def ring(x, y, r, wild, n=n, snap=snap):
            p = np.array([(x + r * pick.uniform(1 - wild, 1) * math.cos(2 * math.pi * i / n), y + r * pick.uniform(1 - wild, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)])
            p = np.round(p * snap) / snap if snap else p
            return np.vstack([p, p[:1]])

        rings = [(0, False, ring(0, 0, 10, pick.choice([0, 0, 0.02, 0.9])))]
        rings += [(0, True, ring(pick.uniform(-6, 6), pick.uniform(-6, 6), pick.choice([1, 3]), 0)) for _ in range(k % 3)]
        if k % 5 == 0:
            rings.append((1, False, ring(pick.choice([5, 25]), 0, 3, 0)))
        verdicts.append(geometry.valid(rings))
        assert verdicts[-1] == plain(rings), k
    assert 100 < sum(verdicts) < 600


def test_validity_of_long_rings_is_quick():
    import time

    turn = 2 * math.pi * np.arange(100_000) / 100_000
    p = np.column_stack([np.cos(turn), np.sin(turn)]) * (1 + 0.01 * np.sin(1500 * turn))[:, None]
    long = np.vstack([p, p[:1]])
    comb = np.array([(i // 2, (i // 2 + i) % 2 * 1000.0) for i in range(60_000)] + [(30_000.0, -1.0), (0.0, -1.0), (0.0, 0.0)])
    crossed = long.copy()
    crossed[50_000] *= -1.5
    hole = np.vstack([0.5 * p[::50], 0.5 * p[:1]])
    began = time.time()
    assert [geometry.valid([(0, False, r)]) for r in (long, comb, crossed)] == [True, True, False]
    assert geometry.valid([(0, False, long), (0, True, hole)]) and not geometry.valid([(0, False, long), (0, True, hole + 0.9)])
    assert time.time() - began < 15  # about 2 s alone


def test_pairs_in_batches_are_the_expressions(spark):
    """Holes, several parts, points on edges and vertices, empty rings, points and nulls: both forms agree, in small batches too."""
    import random
    import struct

    pick = random.Random(12)
    square, hole = geometry.encode_polygon([SQUARE]), geometry.encode_polygon([SQUARE, HOLE])
    moved = geometry.encode_polygon([[(x + 20, y) for x, y in SQUARE]])
    shapes = [square, hole, geometry.encode_multipolygon([hole, moved]), geometry.encode_polygon([[]]), geometry.encode_polygon([[], SQUARE]), struct.pack("<BIdd", 1, 1, 3.0, 4.0), None, b"x"]
    shapes += [geometry.encode_polygon([[(pick.gauss(0, 5), pick.gauss(0, 5)) for _ in range(n)]]) for n in (1, 2, 3, 7, 50)]
    at = [(float(x), float(y)) for x in range(-1, 6) for y in range(-1, 6)] + [(pick.gauss(0, 8), pick.gauss(0, 8)) for _ in range(30)]
    rows = [(i, None if s is None else bytearray(s), x, y) for i, s in enumerate(shapes) for x, y in at]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, w binary, x double, y double").withColumn("rings", geometry.decode_wkb("w")["rings"])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        inside = geometry.covers(F.col("rings"), F.col("x"), F.col("y"))
        away = geometry.distance(F.col("rings"), F.col("x"), F.col("y"))
        found = df.select(inside.alias("a"), geometry.pair_covers("rings", "x", "y").alias("b"), away.alias("c"), geometry.pair_distance("rings", "x", "y").alias("d"))
        for r in found.collect():
            assert bool(r.a) == bool(r.b) and (r.c == r.d or r.c == pytest.approx(r.d, abs=1e-12))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
