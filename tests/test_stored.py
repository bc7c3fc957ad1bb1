"""Matching against a lookup stored by tile, and searches with growing windows, against the plain forms."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from terrafoot.fixtures import rectangle
from terrafoot.functions import crs
from terrafoot.operators import matching, stored
from terrafoot.operators.matching import ROW, candidate_centroids, enrich, lookup_points, nearest_centroids, nearest_polygons
from terrafoot.operators.stored import open_lookup, store_lookup, stored_pairs
from terrafoot.plans.country import BuildConfig, build_country
from terrafoot.plans.lookup import prepare_lookup
from terrafoot.session import materialised

RAW = "id long, xmin double, ymin double, xmax double, ymax double"


def buildings(spark, boxes):
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], RAW)
    raw = df.select("id", F.lit("H:2").alias("height"), F.lit("RES1").alias("occupancy"), F.lit(None).cast("string").alias("floorspace"), F.lit("OSM").alias("source"), F.lit("120210").alias("quadkey"), F.lit(None).cast("timestamp").alias("last_update"), rectangle("xmin", "ymin", "xmax", "ymax").alias("geometry"), F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox"))
    return materialised(prepare_lookup(build_country(raw, None, BuildConfig((-180.0, -90.0, 180.0, 90.0)))))


@pytest.fixture(scope="module")
def lookup(spark):
    """Dense and sparse parts on both sides of a region's bound, and two buildings of very many tiles."""
    pick = random.Random(5)
    boxes = []
    for _ in range(260):
        x, y = pick.choice([11.25, 10.0, 10.05]) + pick.gauss(0, 0.01), 52.0 + pick.gauss(0, 0.01)
        boxes.append((x, y, x + pick.choice([1e-4, 4e-4, 8e-3]), y + pick.choice([1e-4, 3e-4])))
    return buildings(spark, [*boxes, (11.0, 51.5, 11.4, 51.7), (9.0, 52.3, 9.2, 52.6)])


@pytest.fixture(scope="module")
def tiled(spark, lookup):
    return store_lookup(lookup, f"stored_{uuid.uuid4().hex}", buckets=3)


@pytest.fixture(scope="module")
def points(spark):
    pick = random.Random(6)
    rows = [(i, str(pick.choice([11.25, 10.0, 10.05, 10.6]) + pick.gauss(0, 0.03)), str(52.0 + pick.gauss(0, 0.03))) for i in range(300)]
    return spark.createDataFrame([*rows, (900, "11.1", "51.6"), (901, "x", "52"), (902, "-170.0", "10.0"), (903, None, None)], "k int, lon string, lat string")


@pytest.mark.parametrize("mode, candidates, radius", [("inside_nearest", "window", 60.0), ("inside_nearest", "window", 3000.0), ("inside_nearest", "centroid", 300.0), ("centroid", "window", 900.0), ("inside", "window", 50.0)])
def test_stored_matches_are_the_tables(spark, lookup, tiled, points, mode, candidates, radius):
    rows = lambda b: sorted(map(tuple, enrich(points, b, mode=mode, radius=radius, key="k", candidates=candidates).collect()), key=repr)
    assert rows(tiled) == rows(lookup)


def test_stored_lookup_of_points(spark, lookup, tiled, points, monkeypatch):
    rows = lambda b: sorted(((r.k, r.match_type, r.distance_m, r.building and r.building.building_id) for r in lookup_points(points, b, radius=500.0, key="k").collect()), key=repr)
    want = rows(lookup)
    assert rows(tiled) == want and len({r[1] for r in want}) == 3
    monkeypatch.setattr(stored, "TILE_POINTS", 2)  # most tiles are joined in parts
    assert rows(open_lookup(spark, tiled.table)) == want
    monkeypatch.setattr(stored, "MOST_REGIONS", 0)  # no pruning
    assert rows(tiled) == want


def test_each_building_has_one_home(spark, lookup, tiled):
    assert tiled.wide and tiled.wide_rows().count() == 2
    ids = lambda df: sorted(r.building_id for r in df.select("building_id").collect())
    assert ids(tiled.buildings()) == ids(lookup) and tiled.buildings().columns == lookup.columns
    assert tiled.tiles().where("centre").count() == lookup.count() - 2
    with pytest.raises(ValueError):
        store_lookup(lookup, "nowhere", zoom=4, region_zoom=6)
    empty = store_lookup(lookup.limit(0), f"stored_{uuid.uuid4().hex}")
    assert empty.buildings().count() == 0 and not empty.wide


def test_buildings_stay_where_they_lie(spark, lookup, tiled, points):
    """The plan of a tile join has no exchange above the stored buildings, and reads the points' regions only."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = points.where("k < 300 AND CAST(lon AS DOUBLE) < 10.2").selectExpr(f"k AS {ROW}", "CAST(lon AS DOUBLE) AS l_xmin", "CAST(lat AS DOUBLE) AS l_ymin", "CAST(lon AS DOUBLE) AS l_xmax", "CAST(lat AS DOUBLE) AS l_ymax")
        pairs = stored_pairs(materialised(near), tiled, [F.col("building_id")], tuple(F.col(c) for c in matching.BOX))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("Union")[1 if "Union" in plan else 0].splitlines()
    scan = next(i for i, x in enumerate(lines) if tiled.table in x and "FileScan" in x)
    join = max(i for i, x in enumerate(lines[:scan]) if "SortMergeJoin" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above = [x for i, x in enumerate(lines[join:scan], join) if depth(x) < depth(lines[scan]) and all(depth(y) > depth(x) for y in lines[i + 1 : scan + 1])]
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in x for x in above[1:]), plan
    regions = {r.region for r in tiled.tiles().select("region").distinct().collect()}
    asked = tiled.regions_around(points.where("k < 300 AND CAST(lon AS DOUBLE) < 10.2").selectExpr("CAST(lon AS DOUBLE) AS __lon", "CAST(lat AS DOUBLE) AS __lat"), 100.0)
    assert len(regions) == 2 and len(regions & set(asked)) == 1 and "PartitionFilters: [region" in lines[scan].replace("isnotnull(region", "region").replace("(", "").replace("#", " ") or "region" in lines[scan]


def brute(rows, places, radius, gap):
    out = {}
    for p in places:
        best = min(((gap(p, b), b.building_id) for b in rows), default=None)
        if best and best[0] <= radius:
            out[p[ROW]] = best
    return out


def to_box(p, b):
    """Planar distance of a point to the projected corners' polygon."""
    ring = b.rings_3035[0].pts
    if b.bbox_xmin <= p["__lon"] <= b.bbox_xmax and b.bbox_ymin <= p["__lat"] <= b.bbox_ymax:
        return 0.0
    found = []
    for u, v in zip(ring, ring[1:], strict=False):
        dx, dy = v.x - u.x, v.y - u.y
        t = max(0.0, min(1.0, ((p.px - u.x) * dx + (p.py - u.y) * dy) / (dx * dx + dy * dy)))
        found.append(math.hypot(p.px - u.x - t * dx, p.py - u.y - t * dy))
    return min(found)


def sphere(p, b):
    dy, dx = math.radians(b.centroid_lat - p["__lat"]) / 2, math.radians(b.centroid_lon - p["__lon"]) / 2
    h = math.sin(dy) ** 2 + math.cos(math.radians(p["__lat"])) * math.cos(math.radians(b.centroid_lat)) * math.sin(dx) ** 2
    return 2 * crs.EARTH_RADIUS * math.asin(math.sqrt(h))


def test_wide_searches_are_brute_force(spark, lookup, tiled, points):
    """At 20 km, from points in dense and in empty places; far fewer pairs than buildings times points are made."""
    places = matching.with_places(matching.with_points(points, "lat", "lon", "k"))
    rows, at = lookup.collect(), places.collect()
    for b in (lookup, tiled):
        found = {r[ROW]: (r.distance_m, r.building_id) for r in nearest_polygons(places, b, 20_000.0).collect()}
        want = brute(rows, at, 20_000.0, to_box)
        assert {k: (pytest.approx(d, abs=1e-6), i) for k, (d, i) in want.items()} == found and len(want) > 200
        if b is tiled:
            continue
        found = {r[ROW]: (r.distance_m, r.building_id) for r in nearest_centroids(places, b, 20_000.0).collect()}
        want = brute(rows, at, 20_000.0, sphere)
        assert {k: (pytest.approx(d, abs=1e-6), i) for k, (d, i) in want.items()} == found
    near = {}
    for r in candidate_centroids(places, lookup, 2000.0, 7).collect():
        near.setdefault(r[ROW], []).append((r["rank"], r.building_id))
    for p in at:
        order = sorted((sphere(p, b), b.building_id) for b in rows)
        assert sorted(near.get(p[ROW], [])) == [(k, i) for k, (d, i) in enumerate(order[:7], 1) if d <= 8000.0]


def test_places_leave_a_search_early(spark, lookup, points, monkeypatch):
    asked = []
    kept = matching._nearest
    monkeypatch.setattr(matching, "_nearest", lambda pairs, reach: asked.append((reach, pairs.count(), pairs.select(ROW).distinct().count())) or kept(pairs, reach))
    places = matching.with_places(matching.with_points(points, "lat", "lon", "k"))
    nearest_polygons(places, lookup, 5000.0).count()
    assert [a[0] for a in asked] == [100.0, 400.0, 1600.0, 5000.0]
    assert sum(a[1] for a in asked) < 0.5 * places.count() * lookup.count() * 0.3


@pytest.mark.parametrize("lat", [0.0, 52.0, 78.0, 85.0, -84.0])
def test_windows_hold_what_they_are_sure_of(spark, lat):
    """Nothing outside the window is nearer than what is sure, on the sphere and in the European grid."""
    pick = random.Random(int(lat))
    rows = []
    for reach in (100.0, 25_600.0):
        for _ in range(300):
            turn = pick.uniform(0, 2 * math.pi)
            rows.append((reach, 10.0, lat, 10.0 + math.cos(turn) * pick.uniform(0, 3) * reach / (111_320 * max(math.cos(math.radians(lat)), 0.05)), lat + math.sin(turn) * pick.uniform(0, 3) * reach / 111_320))
    df = spark.createDataFrame(rows, "reach double, x double, y double, u double, v double")
    for reach in (100.0, 25_600.0):
        dx, dy = crs.window(F.col("y"), reach)
        outside = (F.abs(F.col("u") - F.col("x")) > dx) | (F.abs(F.col("v") - F.col("y")) > dy)
        sure = crs.sure_within(F.col("y"), reach)
        (px, py), (qx, qy) = crs.laea(F.col("x"), F.col("y")), crs.laea(F.col("u"), F.col("v"))
        own = df.where(F.col("reach") == reach).where(outside)
        planar = F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))
        assert own.count() > 50
        assert own.where(crs.haversine(F.col("x"), F.col("y"), F.col("u"), F.col("v")) < sure).count() == 0
        assert own.where(planar < sure * crs.EUROPE.least_scale(F.col("x"), F.col("y"))).count() == 0
