"""Registered queries over real shapes (rotated, holed, of several parts, invalid), and their SQL by cross products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafoot import fixtures
from terrafoot.functions.geometry import area, decode_wkb, geojson, measures, pair_covers, pair_distance, wkb_bounds
from terrafoot.operators import profile
from terrafoot.operators.cells import clip_by_cells
from terrafoot.operators.joins import clip, dissolved, dissolved_parts, overlap_join
from terrafoot.session import materialised

#: Degrees around a point in which shapes are candidates of the distance query.
REACH = 5e-4
#: The features of the clip: a large rotated square and a large L with a hole, as (kind, centre, size).
FEATURES = [(0, 10.0303, 52.0021, 30), (1, 10.1007, 52.0043, 45)]


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.shapes(spark, sf_dir).where("kind <> 3").withColumn("box", wkb_bounds("geom_wkb"))
    return rows.select("id", decode_wkb("geom_wkb").alias("shape"), *[F.col(f"box.{c}").alias(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])


def _near(spark: SparkSession, sf_dir: str, reach: float) -> tuple[DataFrame, DataFrame]:
    """Points, and pairs of their distinct coordinates with the shapes around them."""
    points = fixtures.places(spark, sf_dir)
    places = materialised(points.select("x", "y").distinct(), "places")
    boxed = places.select("*", (F.col("x") - reach).alias("l_xmin"), (F.col("y") - reach).alias("l_ymin"), (F.col("x") + reach).alias("l_xmax"), (F.col("y") + reach).alias("l_ymax"))
    return points, overlap_join(boxed, materialised(_valid(spark, sf_dir)), left_fits=True)


def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, pairs = _near(spark, sf_dir, 0.0)
    found = materialised(pairs.where(pair_covers("shape.rings", "x", "y")).select("x", "y", "id"), "inside")
    return points.join(found, ["x", "y"]).select("exposure_id", "id")


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, pairs = _near(spark, sf_dir, REACH)
    found = materialised(pairs.select("x", "y", "id", F.round(pair_distance("shape.rings", "x", "y") * 1e6, 3).alias("microdegrees")), "distances")
    return points.join(found, ["x", "y"]).select("exposure_id", "id", "microdegrees")


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.shapes(spark, sf_dir).where("kind <> 3").select("id", measures("geom_wkb").alias("m"))
    return rows.select("id", F.round(F.col("m.area") * 1e9, 3).alias("area_e9"), F.round("m.x", 8).alias("lon"), F.round("m.y", 8).alias("lat"), *[F.round(f"m.{c}", 7).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = geojson(F.col("shape.kind"), F.col("shape.rings"))
    parts = F.json_array_length(F.get_json_object(text, "$.coordinates"))
    return _valid(spark, sf_dir).select("id", F.get_json_object(text, "$.type").alias("type"), parts.alias("parts"))


def _boundary(spark: SparkSession) -> DataFrame:
    from terrafoot.functions.geometry import encode_polygon

    rows = [(i, bytearray(encode_polygon([[(x + dx * n * 1e-4, y + dy * n * 1e-4) for dx, dy in ring] for ring in fixtures.SHAPES[kind][0]]))) for i, (kind, x, y, n) in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "feature_id int, geom_wkb binary")


def _clipped(most_bytes: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = fixtures.raw_footprints(spark, sf_dir)
        rows = rows.select("id", F.col("geometry").alias("geom_wkb"), *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
        return clip(rows, _boundary(spark), most_bytes=most_bytes).select("id")

    return run


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip with cells of about the buildings' size: most buildings are refined, across cells too."""
    rows = fixtures.raw_footprints(spark, sf_dir)
    rows = rows.select("id", F.col("geometry").alias("geom_wkb"), *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    return clip_by_cells(rows, _boundary(spark), level=11).select("id")


def _dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dissolved shapes of each kind: how many polygons they have, and their area, summed over the parts of the union."""
    rows = dissolved_parts(fixtures.shapes(spark, sf_dir).where("kind <> 3"), "kind").withColumn("shape", decode_wkb("geom_wkb"))
    polygons = F.array_max(F.transform("shape.rings", lambda r: r["poly"])) + 1
    parts = rows.select("kind", "srid", F.col("shape.kind").alias("geom_type"), polygons.alias("polygons"), area(F.col("shape.rings")).alias("area"))
    return parts.groupBy("kind", "srid", "geom_type").agg(F.sum("polygons").cast("int").alias("polygons"), F.round(F.sum("area") * 1e9, 1).alias("area_e9"))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that the buildings of each row of the grid cover; neighbours overlap."""
    rows = fixtures.rectangles(spark, sf_dir).select(((F.col("id") - F.col("id") % 200) / 200).cast("long").alias("row"), fixtures.rectangle("xmin", "ymin", "xmax", "ymax").alias("geom_wkb"))
    found = dissolved(rows, "row").withColumn("shape", decode_wkb("geom_wkb"))
    return found.select("row", "srid", F.round(area(F.col("shape.rings")) * 1e9, 1).alias("area_e9"))


QUERIES = {
    "shape_check": lambda s, d: profile.geometry_check(fixtures.shapes(s, d)),
    "shape_contains": _contains,
    "shape_distance": _distance,
    "shape_measures": _measures,
    "shape_geojson": _geojson,
    "shape_clip": _clipped(1 << 20),
    "shape_clip_joined": _clipped(-1),
    "boundary_clip_cells": _cells,
    "boundary_dissolve": _dissolved,
    "boundary_union": _union,
}

_EDGES = ", ".join(
    f"({kind}, {part}, {int(hole > 0)}, {a[0]}, {a[1]}, {b[0]}, {b[1]})"
    for kind, parts in enumerate(fixtures.SHAPES)
    for part, rings in enumerate(parts)
    for hole, ring in enumerate(rings)
    for a, b in zip(ring[:-1], ring[1:], strict=True)
)
#: Shapes as ``s``, their edges as ``e`` (corner to corner), points as ``p``.
_BASE = f"""
WITH s AS ({fixtures.SHAPES_SQL}),
o(kind, part, hole, ax, ay, zx, zy) AS (VALUES {_EDGES}),
e AS (SELECT s.id, s.kind, o.part, o.hole, cx + ax * 1e-4 AS ax, cy + ay * 1e-4 AS ay, cx + zx * 1e-4 AS zx, cy + zy * 1e-4 AS zy, cx, cy FROM s JOIN o ON s.kind = o.kind WHERE s.kind <> 3),
b AS (SELECT id, min(ax) AS xmin, min(ay) AS ymin, max(ax) AS xmax, max(ay) AS ymax FROM e GROUP BY id),
p AS ({fixtures.PLACES_SQL})"""
#: An upward edge with the point on its left, or a downward one with the point on its right, is passed by a ray to the right.
_PASSED = "((e.ay <= {y} AND e.zy > {y} AND {left} > 0) OR (e.ay > {y} AND e.zy <= {y} AND {left} < 0))"
_SIDE = "((e.zx - e.ax) * ({y} - e.ay) - ({x} - e.ax) * (e.zy - e.ay))"
_INSIDE = f"sum(CASE WHEN {_PASSED.format(x='p.x', y='p.y', left=_SIDE.format(x='p.x', y='p.y'))} THEN 1 ELSE 0 END) % 2 = 1"
_T = "greatest(0e0, least(1e0, ((p.x - e.ax) * (e.zx - e.ax) + (p.y - e.ay) * (e.zy - e.ay)) / ((e.zx - e.ax) * (e.zx - e.ax) + (e.zy - e.ay) * (e.zy - e.ay))))"
_AWAY = f"sqrt(pow(p.x - e.ax - {_T} * (e.zx - e.ax), 2) + pow(p.y - e.ay - {_T} * (e.zy - e.ay), 2))"
#: Moments about the centre, edge by edge; a hole's count the other way round whatever its turn.
_RINGS = """r AS (SELECT id, part, hole, min(cx) AS cx, min(cy) AS cy, sum((ax - cx) * (zy - cy) - (zx - cx) * (ay - cy)) AS turn,
    sum((ax + zx - 2 * cx) * ((ax - cx) * (zy - cy) - (zx - cx) * (ay - cy))) AS mx, sum((ay + zy - 2 * cy) * ((ax - cx) * (zy - cy) - (zx - cx) * (ay - cy))) AS my FROM e GROUP BY id, part, hole),
w AS (SELECT id, min(cx) AS cx, min(cy) AS cy, sum(CASE WHEN hole = 1 THEN -abs(turn) ELSE abs(turn) END) AS turn,
    sum(CASE WHEN hole = 1 THEN -sign(turn) ELSE sign(turn) END * mx) AS mx, sum(CASE WHEN hole = 1 THEN -sign(turn) ELSE sign(turn) END * my) AS my FROM r GROUP BY id)"""

_FEATURE_EDGES = ", ".join(
    f"({i}, {x} + {a[0] * n} * 1e-4, {y} + {a[1] * n} * 1e-4, {x} + {b[0] * n} * 1e-4, {y} + {b[1] * n} * 1e-4)"
    for i, (kind, x, y, n) in enumerate(FEATURES)
    for ring in fixtures.SHAPES[kind][0]
    for a, b in zip(ring[:-1], ring[1:], strict=True)
)
_TURN = "sign(({1}x - {0}x) * ({2}y - {0}y) - ({1}y - {0}y) * ({2}x - {0}x))"
_CROSS = " AND ".join(f"{_TURN.format(a, b, c)} <> {_TURN.format(a, b, d)}" for a, b, c, d in (("f.a", "f.z", "e.a", "e.z"), ("e.a", "e.z", "f.a", "f.z")))
_CLIP = f"""WITH raw AS ({fixtures.BUILDINGS_SQL}),
f(i, ax, ay, zx, zy) AS (VALUES {_FEATURE_EDGES}),
e AS (SELECT id, xmin AS ax, ymin AS ay, xmax AS zx, ymin AS zy FROM raw UNION ALL SELECT id, xmax, ymin, xmax, ymax FROM raw UNION ALL SELECT id, xmax, ymax, xmin, ymax FROM raw UNION ALL SELECT id, xmin, ymax, xmin, ymin FROM raw),
crossing AS (SELECT DISTINCT e.id FROM e JOIN f ON {_CROSS}),
within AS (SELECT DISTINCT id FROM (SELECT e.id, f.i FROM e, f WHERE (f.ay <= e.ay AND f.zy > e.ay AND (f.zx - f.ax) * (e.ay - f.ay) - (e.ax - f.ax) * (f.zy - f.ay) > 0)
    OR (f.ay > e.ay AND f.zy <= e.ay AND (f.zx - f.ax) * (e.ay - f.ay) - (e.ax - f.ax) * (f.zy - f.ay) < 0) GROUP BY e.id, e.ax, e.ay, f.i HAVING count(*) % 2 = 1)),
around AS (SELECT DISTINCT raw.id FROM raw JOIN f ON f.ax BETWEEN xmin AND xmax AND f.ay BETWEEN ymin AND ymax)
SELECT id FROM crossing UNION SELECT id FROM within UNION SELECT id FROM around"""

ORACLE_SQL = {
    "shape_check": f"""{_BASE} SELECT CASE WHEN kind = 2 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS geom_type, kind <> 3 AS is_valid, count(*) AS row_count FROM s GROUP BY 1, 2""",
    "shape_contains": f"""{_BASE}, n AS (SELECT p.*, b.id FROM p JOIN b ON p.x BETWEEN xmin AND xmax AND p.y BETWEEN ymin AND ymax)
        SELECT p.exposure_id, p.id FROM n AS p JOIN e ON p.id = e.id GROUP BY p.exposure_id, p.id HAVING {_INSIDE}""",
    "shape_distance": f"""{_BASE}, n AS (SELECT p.*, b.id FROM p JOIN b ON xmin <= p.x + {REACH} AND xmax >= p.x - {REACH} AND ymin <= p.y + {REACH} AND ymax >= p.y - {REACH})
        SELECT p.exposure_id, p.id, round(CASE WHEN {_INSIDE} THEN 0e0 ELSE min({_AWAY}) END * 1e6, 3) AS microdegrees FROM n AS p JOIN e ON p.id = e.id GROUP BY p.exposure_id, p.id""",
    "shape_measures": f"""{_BASE}, {_RINGS} SELECT w.id, round(turn / 2 * 1e9, 3) AS area_e9, round(cx + mx / (3 * turn), 8) AS lon, round(cy + my / (3 * turn), 8) AS lat,
        round(xmin, 7) AS xmin, round(ymin, 7) AS ymin, round(xmax, 7) AS xmax, round(ymax, 7) AS ymax FROM w JOIN b ON w.id = b.id""",
    "shape_geojson": f"""{_BASE} SELECT id, CASE WHEN kind = 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS type, CASE WHEN kind = 0 THEN 1 ELSE 2 END AS parts FROM s WHERE kind <> 3""",
    "shape_clip": _CLIP,
    "shape_clip_joined": _CLIP,
    "boundary_clip_cells": _CLIP,
    "boundary_dissolve": f"""{_BASE}, {_RINGS} SELECT s.kind, 4326 AS srid, 'MULTIPOLYGON' AS geom_type, count(*) * CASE WHEN s.kind = 2 THEN 2 ELSE 1 END AS polygons, round(sum(turn / 2) * 1e9, 1) AS area_e9
        FROM w JOIN s ON w.id = s.id GROUP BY s.kind""",
    "boundary_union": f"""WITH raw AS ({fixtures.BUILDINGS_SQL}), r AS (SELECT *, CAST((id - id % 200) / 200 AS BIGINT) AS row FROM raw),
        o AS (SELECT a.row, sum(greatest(0e0, a.xmax - b.xmin) * least(a.ymax - a.ymin, b.ymax - b.ymin)) AS twice FROM r AS a JOIN r AS b ON b.id = a.id + 1 AND b.row = a.row GROUP BY a.row)
        SELECT r.row, 4326 AS srid, round((sum((xmax - xmin) * (ymax - ymin)) - coalesce(min(twice), 0e0)) * 1e9, 1) AS area_e9 FROM r LEFT JOIN o ON r.row = o.row GROUP BY r.row""",
}
