"""Registered queries over sources, sinks and their options, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from terrafoot import fixtures
from terrafoot.functions.crs import SPHERICAL_RADIUS
from terrafoot.functions.geometry import encode_polygon, wkb_bounds
from terrafoot.functions.parsing import json_safe, safe_double
from terrafoot.functions.projections import SYSTEMS
from terrafoot.operators import matching
from terrafoot.plans.country import BuildConfig, build_country, run_country
from terrafoot.session import materialised, shared_dir
from terrafoot.sources.exposures import read_exposures_checked, read_exposures_typed
from terrafoot.sources.footprints import boundary_features, geometry_wkb, read_footprints, source_paths

#: Tiles of the source files, and the box whose tiles are read; some of them have no file.
ZOOM, BOX = 12, (9.9, 51.95, 10.1, 52.06)
#: Radius and number of the candidate centroids.
RADIUS, CANDIDATES = 100.0, 5
#: The conformal conic system of Europe.
CONIC = 3034


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a tile, every second one without the floorspace column, read back by the box's tiles."""
    root, raw = _folder(spark, "tiles"), materialised(fixtures.raw_footprints(spark, sf_dir).withColumn("tile", F.substring("quadkey", 1, ZOOM)))
    numbers = raw.select("tile").distinct().withColumn("odd", F.row_number().over(Window.orderBy("tile")) % 2 == 0)
    keyed = raw.join(F.broadcast(numbers), "tile").withColumn("file", F.concat("tile", F.lit(".parquet"))).drop("tile")
    for odd in (False, True):  # two writes, however many tiles there are
        own = keyed.where(F.col("odd") if odd else ~F.col("odd")).drop("odd", *(["floorspace"] if odd else []))
        own.repartition("file").write.mode("append").partitionBy("file").parquet(root)
    rows = read_footprints(spark, source_paths(f"{root}/file=*.parquet", BOX, ZOOM), with_file=True)
    return rows.select("id", "source", F.regexp_extract("filename", r"/file=(\d+)\.parquet/", 1).alias("tile"))


def _hex_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry stored as hexadecimal text, and no bounding boxes: both come from the shapes."""
    raw = fixtures.raw_footprints(spark, sf_dir).drop("bbox").withColumn("geometry", F.hex("geometry"))
    box = wkb_bounds(geometry_wkb(raw))
    return raw.select("id", box.alias("box")).select("id", *[F.round(f"box.{c}", 7).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@F.arrow_udf(BinaryType())
def _web_mercator(xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
    """Rectangles in EPSG:3857, big-endian and as one polygon each."""
    (a, c), (b, d) = ([np.radians(np.asarray(v, float)) * SPHERICAL_RADIUS for v in (xmin, xmax)], [SPHERICAL_RADIUS * np.log(np.tan(np.pi / 4 + np.radians(np.asarray(v, float)) / 2)) for v in (ymin, ymax)])
    return pa.array([encode_polygon([[(w, s), (e, s), (e, n), (w, n), (w, s)]], little=False) for w, s, e, n in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)], pa.binary())


@F.arrow_udf(BinaryType())
def _conic(xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
    """Rectangles' corners in the European conformal conic system."""
    a, b, c, d = (np.asarray(v, float) for v in (xmin, ymin, xmax, ymax))
    corners = [np.column_stack(SYSTEMS[CONIC].forward(x, y)) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]
    return fixtures.wkb_like(encode_polygon([[(0.0, 0.0)] * 5]), [np.stack(corners, 1)])


def _boundary_conic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a national projection, in degrees again."""
    rows = fixtures.rectangles(spark, sf_dir).select(F.col("id").alias("feature_id"), _conic("xmin", "ymin", "xmax", "ymax").alias("geom_wkb"))
    found = boundary_features(rows, srid=CONIC).withColumn("box", wkb_bounds("geom_wkb"))
    return found.select("feature_id", "srid", *[F.round(f"box.{c}", 7).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _boundary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.rectangles(spark, sf_dir).withColumn("geom_wkb", F.when(F.col("id") % 7 != 0, _web_mercator("xmin", "ymin", "xmax", "ymax")))
    rows = rows.select(F.col("id").alias("feature_id"), F.when(F.col("id") % 2 == 0, "country").otherwise("sea").alias("layer"), "geom_wkb")
    found = boundary_features(rows, srid=3857, layer="country").withColumn("box", wkb_bounds("geom_wkb"))
    return found.select("feature_id", "srid", *[F.round(f"box.{c}", 7).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one field too many are dropped; the others have inferred types."""
    path = _folder(spark, "typed")
    rows = fixtures.exposures(spark, sf_dir).where(safe_double(F.col("lon")).isNotNull())
    line = F.concat_ws(",", F.col("exposure_id").cast("string"), "lon", "lat", F.when(F.col("exposure_id") % 9 == 0, "more,fields"))
    spark.range(1).select(F.lit("exposure_id,lon,lat").alias("value")).unionAll(rows.select(line.alias("value"))).coalesce(1).write.text(path)  # one file has one header
    found = read_exposures_typed(spark, path)
    types = ",".join(t for _, t in found.dtypes)
    return found.select(F.col("exposure_id").cast("long").alias("exposure_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.lit(types).alias("types"))


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a file, accepted or rejected: those with one field too many are kept apart with their number."""
    path = _folder(spark, "checked")
    rows = fixtures.exposures(spark, sf_dir).where(safe_double(F.col("lon")).isNotNull())
    line = F.concat_ws(",", F.col("exposure_id").cast("string"), "lon", "lat", F.when(F.col("exposure_id") % 9 == 0, "more"))
    lines = spark.range(1).select(F.lit(-1).alias("at"), F.lit("exposure_id,lon,lat").alias("value")).unionAll(rows.select("exposure_id", line.alias("value")))
    lines.repartition(1).sortWithinPartitions("at").select("value").write.text(path)  # one file, whose lines have numbers that SQL knows
    accepted, rejected = read_exposures_checked(spark, path)
    kept = accepted.select(F.col("exposure_id").cast("long").alias("exposure_id"), F.lit(None).cast("long").alias("line_number"), F.round("lat", 6).alias("lat"))
    return kept.unionAll(rejected.select(F.split("line", ",")[0].cast("long"), "line_number", F.lit(None).cast("double")))


def _sample_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = build_country(fixtures.raw_footprints(spark, sf_dir), None, BuildConfig(fixtures.WORLD, sample_limit=150))
    return found.agg(F.count("*").alias("rows"), F.count_distinct("building_id").alias("buildings"))


def _profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's files, read back: each distribution's sum, and the mean completeness that the shares give."""
    out, profile = _folder(spark, "clean"), _folder(spark, "profile")
    run_country(fixtures.raw_footprints(spark, sf_dir), fixtures.boundary(spark), BuildConfig(fixtures.WORLD), out, profile)
    s = spark.read.json(f"{profile}/summary")
    mean = 0.25 + 0.30 * (1 - F.col("missing_height_share")) + 0.30 * (1 - F.col("unknown_occupancy_share")) + 0.15 * (1 - F.col("missing_floorspace_share"))
    rows = s.select(F.lit("summary").alias("part"), F.col("total_buildings").alias("buildings"), F.round("avg_attribute_completeness_score", 4).alias("value"), (F.abs(mean - F.col("avg_attribute_completeness_score")) < 1e-9).alias("holds"))
    for name in ("occupancy", "height_source", "source"):
        d = spark.read.option("header", True).csv(f"{profile}/{name}_distribution").agg(F.sum(F.col("building_count").cast("long")).alias("n"), F.round(F.sum(F.col("share").cast("double")), 9).alias("share"))
        rows = rows.unionAll(d.select(F.lit(name), "n", "share", F.lit(True)))
    return rows


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest candidate centroids of each point, cut off at CANDIDATES."""
    raw = fixtures.rectangles(spark, sf_dir)
    buildings = raw.select(F.col("id").cast("string").alias("building_id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("centroid_lon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("centroid_lat"))
    points = matching.with_points(fixtures.exposures(spark, sf_dir), "lat", "lon", "exposure_id")
    places = matching.with_places(points)
    found = matching.candidate_centroids(places, buildings, RADIUS, CANDIDATES).join(places.select(matching.ROW, "__lon", "__lat"), matching.ROW)
    rows = points.where("coordinate_valid").select("exposure_id", "__lon", "__lat").join(found.drop(matching.ROW), ["__lon", "__lat"])
    return rows.select("exposure_id", "building_id", "rank", F.round("distance_m", 3).alias("distance_m"))


def _json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    odd = F.when(F.col("o_orderkey") % 5 == 0, float("nan")).when(F.col("o_orderkey") % 5 == 1, float("inf")).when(F.col("o_orderkey") % 5 == 2, float("-inf")).otherwise(F.col("price"))
    text = F.to_json(F.struct(json_safe(odd).alias("price")), {"ignoreNullFields": "false"})
    return rows.select("o_orderkey", F.round(F.get_json_object(text, "$.price").cast("double"), 2).alias("price"), (text == '{"price":null}').alias("empty"))


QUERIES = {
    "tile_files": _tile_files,
    "hex_geometry": _hex_geometry,
    "boundary_features": _boundary_features,
    "boundary_conic": _boundary_conic,
    "typed_csv": _typed_csv,
    "csv_rejects": _csv_rejects,
    "sample_limit": _sample_limit,
    "profile_files": _profile_files,
    "top_candidates": _candidates,
    "json_values": _json_values,
}

_N = 1 << ZOOM
_TX = "CAST(floor(({} + 180e0) / 360e0 * {}) AS BIGINT)"
_TY = "CAST(floor((1e0 - ln(tan(radians({0})) + 1e0 / cos(radians({0}))) / pi()) / 2e0 * {1}) AS BIGINT)"
_KEY = f"array_to_string(list_transform(range({ZOOM - 1}, -1, -1), lambda i: ((tx >> i) & 1) + 2 * ((ty >> i) & 1)), '')"
_RAW = f"WITH raw AS ({fixtures.BUILDINGS_SQL}), x AS ({fixtures.EXPOSURES_SQL})"
_ROUNDED = ", ".join(f"round({c}, 7) AS {c}" for c in ("xmin", "ymin", "xmax", "ymax"))
_METRES = "(2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - p.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(p.lat)) * pow(sin(radians(b.lon - p.lon) / 2), 2)))))"
_WIDE = max(4 * RADIUS, RADIUS + 150)

ORACLE_SQL = {
    "tile_files": f"""{_RAW}, t AS (SELECT id, source, {_TX.format("xmin", _N)} AS tx, {_TY.format("ymin", _N)} AS ty FROM raw)
        SELECT id, source, {_KEY} AS tile FROM t WHERE tx BETWEEN {_TX.format(BOX[0], _N)} AND {_TX.format(BOX[2], _N)} AND ty BETWEEN {_TY.format(BOX[3], _N)} AND {_TY.format(BOX[1], _N)}""",
    "hex_geometry": f"{_RAW} SELECT id, {_ROUNDED} FROM raw",
    "boundary_features": f"{_RAW} SELECT id AS feature_id, 4326 AS srid, {_ROUNDED} FROM raw WHERE id % 2 = 0 AND id % 7 <> 0",
    "typed_csv": f"{_RAW} SELECT exposure_id, round(CAST(lon AS DOUBLE), 6) AS lon, round(CAST(lat AS DOUBLE), 6) AS lat, 'int,double,double' AS types FROM x WHERE TRY_CAST(lon AS DOUBLE) IS NOT NULL AND exposure_id % 9 <> 0",
    "boundary_conic": f"{_RAW} SELECT id AS feature_id, 4326 AS srid, round(xmin, 7) AS xmin, round(ymin, 7) AS ymin, round(xmax, 7) AS xmax, round(ymax, 7) AS ymax FROM raw",
    "csv_rejects": f"""{_RAW}, n AS (SELECT *, row_number() OVER (ORDER BY exposure_id) + 1 AS number FROM x WHERE TRY_CAST(lon AS DOUBLE) IS NOT NULL)
        SELECT exposure_id, CASE WHEN exposure_id % 9 = 0 THEN number END AS line_number, CASE WHEN exposure_id % 9 <> 0 THEN round(CAST(lat AS DOUBLE), 6) END AS lat FROM n""",
    "sample_limit": f"{_RAW} SELECT least(150, count(*)) AS rows, least(150, count(*)) AS buildings FROM raw",
    "top_candidates": f"""{_RAW}, b AS (SELECT CAST(id AS VARCHAR) AS building_id, (xmin + xmax) / 2 AS lon, (ymin + ymax) / 2 AS lat FROM raw),
        p AS (SELECT exposure_id, TRY_CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM x WHERE TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180),
        d AS (SELECT exposure_id, building_id, {_METRES} AS metres FROM p JOIN b ON abs(b.lon - p.lon) < 2e-2 AND abs(b.lat - p.lat) < 1e-2),
        r AS (SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY metres, building_id) AS rank FROM d WHERE metres <= {_WIDE})
        SELECT exposure_id, building_id, rank, round(metres, 3) AS distance_m FROM r WHERE rank <= {CANDIDATES}""",
    "json_values": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN round(CAST(o_totalprice AS DOUBLE), 2) END AS price, o_orderkey % 5 <= 2 AS empty FROM orders",
}
