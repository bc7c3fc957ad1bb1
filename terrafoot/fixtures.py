"""Buildings and exposures derived from the test tables by integer arithmetic.

Buildings are axis-aligned rectangles on a grid near 10 degrees east, 52 degrees north, one for each
part; exposures are points among them, one for each event, some with unusable coordinates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from terrafoot.functions.geometry import encode_multipolygon, encode_polygon, layout
from terrafoot.functions.tiles import quadkey, tile_x, tile_y

#: The same text runs in both SQL dialects.
BUILDINGS_SQL = """
SELECT p_partkey AS id,
  CASE p_partkey % 3 WHEN 0 THEN 'OSM' WHEN 1 THEN 'Google' ELSE 'Microsoft' END AS source,
  CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'HHT:' || CAST(p_size AS STRING) || '.5'
    WHEN 3 THEN 'H:' || CAST(p_size AS STRING) WHEN 4 THEN 'HBET:1-' || CAST(1 + p_size % 5 AS STRING)
    WHEN 5 THEN 'HHT:4.2+H:2' WHEN 6 THEN 'HBET:2-3+H:2' ELSE 'ROOF:flat' END AS height,
  CASE p_partkey % 12 WHEN 0 THEN 'RES1' WHEN 1 THEN 'com3' WHEN 2 THEN 'MIX' WHEN 3 THEN 'IND2'
    WHEN 4 THEN 'AGR' WHEN 5 THEN 'ASS' WHEN 6 THEN 'GOV' WHEN 7 THEN 'EDU1' WHEN 8 THEN ''
    WHEN 9 THEN NULL WHEN 10 THEN 'R' ELSE 'XYZ' END AS occupancy,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'n/a'
    ELSE CAST(p_size * 10 AS STRING) END AS floorspace,
  1e1 + (p_partkey % 200) * 1e-3 AS xmin,
  5.2e1 + ((p_partkey - p_partkey % 200) / 200) * 1e-3 AS ymin,
  1e1 + (p_partkey % 200) * 1e-3 + 4e-4 + (p_partkey % 9) * 1e-4 AS xmax,
  5.2e1 + ((p_partkey - p_partkey % 200) / 200) * 1e-3 + 4e-4 + (p_partkey % 5) * 1e-4 AS ymax
FROM part"""

EXPOSURES_SQL = """
SELECT event_id AS exposure_id,
  CASE event_id % 50 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '200.5'
    ELSE '10.' || lpad(CAST((event_id * 7919) % 210000 AS STRING), 6, '0') END AS lon,
  '52.' || lpad(CAST((event_id * 104729) % 12000 AS STRING), 6, '0') AS lat
FROM events"""

#: The box that holds all of them, however many rows the grid has, and a boundary (two rectangles) that cuts through them.
WORLD = (-math.inf, -math.inf, math.inf, math.inf)
BOUNDARY = [(10.02045, 51.9, 10.08035, 52.00455), (10.1006, 52.0026, 10.1506, 52.3)]


def wkb_like(sample: bytes, points: list[np.ndarray]) -> pa.Array:
    """WKB with the structure of ``sample`` and, ring by ring, these points (rows, points, 2)."""
    n = len(points[0])
    data = np.tile(np.frombuffer(sample, np.uint8), (n, 1))
    for (_, _, at, count, _, order), pts in zip(layout(sample)[1], points, strict=True):
        data[:, at : at + 16 * count] = np.ascontiguousarray(pts.reshape(n, 2 * count), f"{order}f8").view(np.uint8)
    ends = np.arange(n + 1, dtype=np.int32) * len(sample)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])


@F.arrow_udf(BinaryType())
def rectangle(xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
    """WKB of axis-aligned rectangles."""
    a, b, c, d = (np.asarray(v, float) for v in (xmin, ymin, xmax, ymax))
    return wkb_like(encode_polygon([[(0.0, 0.0)] * 5]), [np.column_stack([a, b, c, b, c, d, a, d, a, b]).reshape(-1, 5, 2)])


def _over(spark: SparkSession, sf_dir: str, name: str, sql: str, key: str | None = None) -> DataFrame:
    """The query over a table; with ``key`` a table of few files is dealt to all cores first."""
    view, rows = f"terrafoot_{name}", spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(2 * cores, key)
    rows.createOrReplaceTempView(view)
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {view}"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "events", EXPOSURES_SQL)


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, height, occupancy, floorspace and the rectangle's bounds."""
    return _over(spark, sf_dir, "part", BUILDINGS_SQL, "p_partkey")


def raw_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles in the raw schema, with WKB geometry and a nested bounding box."""
    return raw_of(rectangles(spark, sf_dir))


def raw_of(rows: DataFrame) -> DataFrame:
    """Rectangles in the raw schema."""
    key = quadkey(tile_x(F.col("xmin"), 18), tile_y(F.col("ymin"), 18), 18)
    box = F.struct("xmin", "ymin", "xmax", "ymax")
    return rows.select("id", "source", "height", "occupancy", "floorspace", F.lit(None).cast("double").alias("relation_id"), key.alias("quadkey"), F.timestamp_seconds(F.col("id") * 60).alias("last_update"), rectangle("xmin", "ymin", "xmax", "ymax").alias("geometry"), box.alias("bbox"))


def boundary(spark: SparkSession) -> DataFrame:
    names = ["feature_id", "xmin", "ymin", "xmax", "ymax"]
    rows = spark.createDataFrame(pa.table(dict(zip(names, zip(*[(i, *b) for i, b in enumerate(BOUNDARY)], strict=True), strict=True))))
    return rows.select("feature_id", F.lit("country").alias("layer"), rectangle("xmin", "ymin", "xmax", "ymax").alias("geom_wkb"))

#: Real shapes as polygons of rings of (x, y), in 1e-4 degrees about a centre: a rotated square, an L with a
#: hole, two separate parts, and a bow-tie, which is no valid shape. Shells and holes turn either way.
SHAPES: list[list[list[list[tuple[int, int]]]]] = [
    [[[(4, 0), (0, 4), (-4, 0), (0, -4), (4, 0)]]],
    [[[(-4, -4), (-4, 4), (-1, 4), (-1, -1), (4, -1), (4, -4), (-4, -4)], [(-3, -3), (-2, -3), (-2, 2), (-3, 2), (-3, -3)]]],
    [[[(-4, -4), (-1, -3), (-2, 0), (-4, -4)]], [[(0, 1), (3, 2), (2, 4), (-1, 3), (0, 1)]]],
    [[[(-4, -4), (4, 4), (4, -4), (-4, 4), (-4, -4)]]],
]

SHAPES_SQL = """
SELECT p_partkey AS id, p_partkey % 4 AS kind,
  1e1 + (p_partkey % 200) * 1e-3 AS cx, 5.2e1 + ((p_partkey - p_partkey % 200) / 200) * 1e-3 AS cy
FROM part"""

#: Points that lie on no edge.
PLACES_SQL = """
SELECT event_id AS exposure_id, 1e1 + ((event_id * 7919) % 200000) * 1e-6 + 37e-8 AS x,
  5.2e1 + ((event_id * 104729) % 12000) * 1e-6 + 41e-8 AS y
FROM events"""


@F.arrow_udf(BinaryType())
def shape_wkb(kind: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
    """WKB of the shape of this kind about a centre."""
    kind, middle = np.asarray(kind), np.column_stack([np.asarray(cx, float), np.asarray(cy, float)])
    order, made = [], [pa.array([], pa.binary())]
    for k, polygons in enumerate(SHAPES):
        own = np.flatnonzero(kind == k)
        parts = [encode_polygon(rings) for rings in polygons]
        order.append(own)
        made.append(wkb_like(parts[0] if len(parts) == 1 else encode_multipolygon(parts), [middle[own, None] + np.array(ring) * 1e-4 for rings in polygons for ring in rings]))
    return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order))))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, cx, cy and geom_wkb, one for each part."""
    return _over(spark, sf_dir, "part", SHAPES_SQL, "p_partkey").withColumn("geom_wkb", shape_wkb("kind", "cx", "cy"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, "events", PLACES_SQL)
