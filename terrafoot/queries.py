"""Registered queries over the test tables, each with its parameters, and their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafoot import fixtures, queries_shapes, queries_sources
from terrafoot.functions import crs
from terrafoot.functions.geometry import decode_wkb, geojson, measures
from terrafoot.functions.parsing import coordinate_valid, safe_double
from terrafoot.functions.tiles import quadkey, quadkeys_of_box, tile_cover, tile_x, tile_y
from terrafoot.operators import matching, profile
from terrafoot.operators.joins import clip
from terrafoot.operators.stored import StoredLookup, store_lookup
from terrafoot.plans.country import BuildConfig, build_country
from terrafoot.plans.lookup import NO_RESPONSE, prepare_lookup, responses, write_lookup
from terrafoot.session import materialised, shared_dir
from terrafoot.sources.exposures import read_exposures, write_exposures
from terrafoot.sources.footprints import geometry_wkb, in_box, union_by_name
from terrafoot.sources.geocoding import geocode_candidates
from terrafoot.streaming.enrichment import enrich_stream, stream_results, stream_summary

RADIUS, FAR, ZOOM = 50.0, 5000.0, 16
BOX = (10.02, 52.001, 10.15, 52.0065)
ORIGIN = (10.1, 52.005)

Query = Callable[[SparkSession, str], DataFrame]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_country(fixtures.raw_footprints(spark, sf_dir), None, BuildConfig(fixtures.WORLD))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(prepare_lookup(clean(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> StoredLookup:
    return store_lookup(lookup(spark, sf_dir), f"terrafoot_lookup_{uuid.uuid4().hex}")


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.exposures(spark, sf_dir)
    return rows.select("exposure_id", safe_double(F.col("lon")).alias("lon"), safe_double(F.col("lat")).alias("lat")).where(coordinate_valid(F.col("lon"), F.col("lat")))


def enriched(spark: SparkSession, sf_dir: str, mode: str, **how) -> DataFrame:
    return matching.enrich(fixtures.exposures(spark, sf_dir), lookup(spark, sf_dir), mode=mode, radius=RADIUS, key="exposure_id", **how)


def _matches(mode: str, **how) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = enriched(spark, sf_dir, mode, **how)
        return rows.select("exposure_id", "coordinate_valid", "building_match_type", F.round("building_distance_m", 3).alias("building_distance_m"), "building_confidence", "building_building_id", "building_source", "building_height_m", "building_occupancy_group")

    return run


def _stored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.enrich(fixtures.exposures(spark, sf_dir), stored(spark, sf_dir), radius=RADIUS, key="exposure_id")
    return rows.select("exposure_id", "coordinate_valid", "building_match_type", F.round("building_distance_m", 3).alias("building_distance_m"), "building_confidence", "building_building_id", "building_source", "building_height_m", "building_occupancy_group")


def _nearest_far(search: Callable, buildings: Callable) -> Query:
    """The nearest building within 5 km of points up to 4.4 km off their places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir).withColumn("lat", F.col("lat") + F.col("exposure_id") % 5 * 0.01)
        points = points.select("exposure_id", F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
        places = matching.with_places(points.withColumn("coordinate_valid", F.lit(True)))  # each coordinate is searched once
        found = materialised(search(places, buildings(spark, sf_dir), FAR).join(places.select(matching.ROW, "__lon", "__lat"), matching.ROW))
        return points.join(found, ["__lon", "__lat"]).select("exposure_id", "building_id", F.round("distance_m", 3).alias("distance_m"))

    return run


def _clean(*columns: str, **places: int) -> Query:
    return lambda spark, sf_dir: rounded(clean(spark, sf_dir).select("building_id", *columns), places)


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.laea(F.col("lon"), F.col("lat"))
    return _points(spark, sf_dir).select("exposure_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_footprints(spark, sf_dir)
    return raw.select(F.col("id").cast("string").alias("building_id"), geometry_wkb(raw).alias("geom_wkb"), "bbox")


def _footprint_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean("footprint_area_m2", footprint_area_m2=3)(spark, sf_dir)


def _planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shapes(spark, sf_dir).select("building_id", measures("geom_wkb").alias("m"))
    return rows.select("building_id", F.round("m.x", 7).alias("centroid_lon"), F.round("m.y", 7).alias("centroid_lat"), F.round(F.col("m.area") * 1e9, 3).alias("area_deg2_e9"))


def _haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = crs.haversine(F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.col("lon"), F.col("lat"))
    return _points(spark, sf_dir).select("exposure_id", F.round(d, 3).alias("distance_m"))


def _boundary_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shapes(spark, sf_dir).select("building_id", "geom_wkb", *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    return clip(rows, fixtures.boundary(spark)).select("building_id")


def _boundary_clip_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shapes(spark, sf_dir).select("building_id", "geom_wkb", *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    return clip(rows, fixtures.boundary(spark), most_bytes=0).select("building_id")


def _tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.rectangles(spark, sf_dir).select(F.col("id").cast("string").alias("building_id"), "xmin", "ymin", "xmax", "ymax")
    return tile_cover(rows, ZOOM).select("building_id", "tx", "ty", "quadkey")


def _tile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}"
    write_lookup(clean(spark, sf_dir), root)
    rows = spark.read.parquet(root).where(F.col("quadkey_prefix_6").cast("string").isin(quadkeys_of_box(*BOX, 6)))
    touching = (F.col("bbox_xmin") <= BOX[2]) & (F.col("bbox_xmax") >= BOX[0]) & (F.col("bbox_ymin") <= BOX[3]) & (F.col("bbox_ymax") >= BOX[1])
    return rows.where(touching).select("building_id", "source")


def _lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare_lookup(clean(spark, sf_dir)).select("building_id", "last_update", "footprint_area_m2", *[f"bbox_3035_{c}" for c in ("xmin", "ymin", "xmax", "ymax")])
    return rounded(rows, {c: 3 for c in rows.columns[2:]})


def _point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.lookup_points(fixtures.exposures(spark, sf_dir), lookup(spark, sf_dir), radius=RADIUS, key="exposure_id")
    return found.select("exposure_id", "coordinate_valid", "match_type", F.round("distance_m", 3).alias("distance_m"), "confidence", F.col("building.building_id").alias("building_id"))


def _point_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the responses: each coordinate is answered, and its response read, once."""
    points = matching.with_points(fixtures.exposures(spark, sf_dir), "lat", "lon", "exposure_id")
    paths = {"match_type": "$.match_type", "building_id": "$.building.building_id", "occupancy_group": "$.building.occupancy_group", "geometry_type": "$.building.geometry.type"}
    read = lambda response: {name: F.get_json_object(response, path) for name, path in paths.items()}
    answers = responses(matching.lookup_places(points, lookup(spark, sf_dir), RADIUS)).select("__lon", "__lat", "response")
    answers = answers.select("__lon", "__lat", F.lit(True).alias("answered"), *[v.alias(k) for k, v in read(F.col("response")).items()])
    rows = matching.attached(points, materialised(answers, "answers"))
    return rows.select("exposure_id", *[F.when(F.col("answered"), F.col(k)).otherwise(v).alias(k) for k, v in read(F.lit(NO_RESPONSE)).items()])


def _geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = decode_wkb("geom_wkb")
    rows = _shapes(spark, sf_dir).select("building_id", shape.alias("shape")).select("building_id", geojson(F.col("shape.kind"), F.col("shape.rings")).alias("geojson"))
    back = F.from_json("geojson", "struct<type:string,coordinates:array<array<array<double>>>>")
    ring = back["coordinates"][0]
    return rows.select("building_id", back["type"].alias("type"), F.size(ring).alias("points"), F.round(ring[0][0], 6).alias("first_lon"), F.round(ring[2][1], 6).alias("third_lat"))


def _responses_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    key = F.col("c_custkey").cast("string")
    nominatim = F.concat(F.lit('[{"display_name":"'), "c_name", F.lit('","lat":"52.'), key, F.lit('","lon":"10.'), key, F.lit('","type":"house"},{"display_name":"","lat":"1","lon":"2"},{"display_name":"Second '), key, F.lit('","lat":"52.5","lon":"10.5","type":"road"}]'))
    photon = F.concat(F.lit('{"features":[{"geometry":{"coordinates":[10.'), key, F.lit(',52.25]},"properties":{"name":"'), "c_name", F.lit('","county":"Shire","state":"","country":"Land","osm_value":"city"}},{"geometry":{"coordinates":[10.0]},"properties":{"name":"cut off"}}]}'))
    query = F.concat(F.lit("  Customer "), key, F.lit(" "))
    first = rows.select(query.alias("query"), F.lit("Nominatim").alias("provider"), F.when(F.col("c_custkey") % 3 == 0, "[]").otherwise(nominatim).alias("response"))
    return first.unionAll(rows.select(query, F.lit("Photon"), photon))


def _geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geocode_candidates(_responses_table(spark, sf_dir)), {"lon": 6, "lat": 6})


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/exposures-{uuid.uuid4().hex}"
    write_exposures(fixtures.exposures(spark, sf_dir), path)
    return read_exposures(spark, path, multi_line=False).select(F.col("exposure_id").cast("long").alias("exposure_id"), "lon", "lat")


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.raw_footprints(spark, sf_dir)
    parts = [raw.where("id % 2 = 0").select("id", "source", "height"), raw.where("id % 2 = 1").select("height", "id", "occupancy")]
    return union_by_name(parts).select("id", "source", "height", "occupancy")


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # small row groups, so that all cores share a batch's two files
    fixtures.exposures(spark, sf_dir).repartition(4, "exposure_id").write.option("parquet.block.size", 4 << 20).parquet(f"{root}/in")
    stream = spark.readStream.schema("exposure_id long, lon string, lat string").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    query = enrich_stream(stream, stored(spark, sf_dir), f"{root}/out", f"{root}/summaries", f"{root}/checkpoint", radius=RADIUS, key="exposure_id")
    query.awaitTermination()
    return stream_results(spark, f"{root}/out"), stream_summary(spark, f"{root}/summaries")


def _stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _stream(spark, sf_dir)
    return rows.select("exposure_id", "coordinate_valid", "building_match_type", F.round("building_distance_m", 3).alias("building_distance_m"), "building_building_id")


def _stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stream(spark, sf_dir)[1], {"average_nearest_distance_m": 3})


QUERIES: dict[str, Query] = {
    "inside_match": _matches("inside"),
    "nearest_centroid_match": _matches("centroid"),
    "inside_nearest_cascade": _matches("inside_nearest"),
    "centroid_gated_nearest": _matches("inside_nearest", candidates="centroid"),
    "nearest_polygon_match": lambda s, d: _matches("inside_nearest")(s, d).where("building_match_type = 'nearest_polygon'").select("exposure_id", "building_building_id", "building_distance_m"),
    "stored_match": _stored_match,
    "nearest_far": _nearest_far(matching.nearest_polygons, lookup),
    "nearest_far_stored": _nearest_far(matching.nearest_polygons, stored),
    "nearest_far_centroid": _nearest_far(matching.nearest_centroids, lookup),
    "coordinate_validation": lambda s, d: fixtures.exposures(s, d).select("exposure_id", coordinate_valid(safe_double(F.col("lon")), safe_double(F.col("lat"))).alias("coordinate_valid")),
    "height_parse": _clean("height_source_type", "height_m", "stories_exact", "stories_min", "stories_max", "height_quality"),
    "occupancy_classify": _clean("occupancy_code", "occupancy_group", "occupancy_quality"),
    "floorspace_estimate": _clean("floorspace_source_m2", "floorspace_est_m2", floorspace_est_m2=3),
    "completeness_score": _clean("attribute_completeness_score"),
    "bbox_prefilter": lambda s, d: fixtures.raw_footprints(s, d).where(in_box(BOX)).select("id", "source"),
    "boundary_clip": _boundary_clip,
    "boundary_clip_joined": _boundary_clip_joined,
    "quadkey_encode": lambda s, d: _points(s, d).select("exposure_id", quadkey(tile_x(F.col("lon"), ZOOM), tile_y(F.col("lat"), ZOOM), ZOOM).alias("quadkey")),
    "tile_cover": _tile_cover,
    "tile_pruned_scan": _tile_scan,
    "laea_project": _projected,
    "footprint_area": _footprint_area,
    "centroid": _planar,
    "haversine_distance": _haversine,
    "profile_summary": lambda s, d: rounded(profile.profile_summary(clean(s, d)), {c: 4 for c in ("min_area_m2", "avg_area_m2", "max_area_m2", "unknown_occupancy_share", "missing_height_share", "missing_floorspace_share", "avg_attribute_completeness_score")}),
    "occupancy_distribution": lambda s, d: rounded(profile.distribution(clean(s, d), "occupancy_group"), {"share": 6}),
    "height_source_distribution": lambda s, d: rounded(profile.distribution(clean(s, d), "height_source_type"), {"share": 6}),
    "source_distribution": lambda s, d: rounded(profile.distribution(clean(s, d), "source"), {"share": 6}),
    "schema_profile": lambda s, d: profile.schema_profile(fixtures.rectangles(s, d)).select("column_name", "null_count"),
    "geometry_check": lambda s, d: profile.geometry_check(_shapes(s, d)),
    "union_by_name": _union,
    "match_summary": lambda s, d: rounded(profile.match_summary(enriched(s, d, "inside_nearest")), {"average_nearest_distance_m": 3}),
    "share_table": lambda s, d: profile.shares(profile.match_summary(enriched(s, d, "inside_nearest"))),
    "detailed_occupancy_distribution": lambda s, d: profile.value_distribution(enriched(s, d, "inside"), "building_occupancy_raw"),
    "occupancy_group_shares": lambda s, d: profile.distribution_shares(enriched(s, d, "inside"), "building_occupancy_group"),
    "lookup_table": _lookup_table,
    "point_lookup": _point_lookup,
    "point_responses": _point_responses,
    "geojson_out": _geojson,
    "geocode_flatten": _geocode,
    "csv_round_trip": _csv_round_trip,
    "stream_enrich": _stream_enrich,
    "stream_summary": _stream_summary,
    **queries_shapes.QUERIES,
    **queries_sources.QUERIES,
}


# --- the same in SQL -------------------------------------------------------------------------------


def _laea_sql(lon: str, lat: str) -> tuple[str, str]:
    e = math.sqrt(crs.E2)
    s = f"sin(radians({lat}))"
    q = f"((1 - {crs.E2!r}) * ({s} / (1 - {crs.E2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / (2 * {e!r})))"
    sb = f"greatest(-1e0, least(1e0, {q} / {crs.QP!r}))"
    cb = f"sqrt(1 - {sb} * {sb})"
    turn = f"(radians({lon}) - {crs.LON0!r})"
    b = f"({crs.RQ!r} * sqrt(2 / (1 + {math.sin(crs.BETA0)!r} * {sb} + {math.cos(crs.BETA0)!r} * {cb} * cos({turn}))))"
    x = f"({crs.FALSE_E!r} + {b} * {crs.D!r} * {cb} * sin({turn}))"
    return x, f"({crs.FALSE_N!r} + {b} / {crs.D!r} * ({math.cos(crs.BETA0)!r} * {sb} - {math.sin(crs.BETA0)!r} * {cb} * cos({turn})))"


def _haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {crs.EARTH_RADIUS!r} * asin(sqrt(least(1e0, {h}))))"


def _edge_sql(a: int, b: int) -> str:
    ax, ay, dx, dy = f"b.x{a}", f"b.y{a}", f"(b.x{b} - b.x{a})", f"(b.y{b} - b.y{a})"
    t = f"greatest(0e0, least(1e0, ((e.px - {ax}) * {dx} + (e.py - {ay}) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow(e.px - {ax} - {t} * {dx}, 2) + pow(e.py - {ay} - {t} * {dy}, 2))"


_CORNERS = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]
_PROJECTED = ", ".join(f"{_laea_sql(x, y)[0]} AS x{i}, {_laea_sql(x, y)[1]} AS y{i}" for i, (x, y) in enumerate(_CORNERS))
_SHOELACE = " + ".join(f"((x{i} - x0) * (y{i + 1} - y0) - (x{i + 1} - x0) * (y{i} - y0))" for i in (1, 2))

#: Clean buildings as ``b``, exposures as ``e``.
def _base_sql(radius: float = RADIUS, north: str = "0e0") -> str:
    return f"""
WITH raw AS ({fixtures.BUILDINGS_SQL}),
p AS (SELECT *, TRY_CAST(NULLIF(regexp_extract(height, 'HHT:([0-9.]+)', 1), '') AS DOUBLE) AS direct,
             TRY_CAST(NULLIF(regexp_extract(height, '(^|\\\\+)H:([0-9]+)', 2), '') AS INTEGER) AS stories_exact,
             TRY_CAST(NULLIF(regexp_extract(height, 'HBET:([0-9]+)-([0-9]+)', 1), '') AS INTEGER) AS stories_min,
             TRY_CAST(NULLIF(regexp_extract(height, 'HBET:([0-9]+)-([0-9]+)', 2), '') AS INTEGER) AS stories_max,
             TRY_CAST(floorspace AS DOUBLE) AS floorspace_source_m2, {_PROJECTED} FROM raw),
m AS (SELECT *, CAST(id AS VARCHAR) AS building_id, abs({_SHOELACE}) / 2 AS footprint_area_m2,
             (xmin + xmax) / 2 AS centroid_lon, (ymin + ymax) / 2 AS centroid_lat,
             CASE WHEN direct IS NOT NULL THEN direct WHEN stories_exact IS NOT NULL THEN stories_exact * 3e0
                  WHEN stories_min IS NOT NULL AND stories_max IS NOT NULL THEN (stories_min + stories_max) / 2e0 * 3e0 END AS height_m,
             CASE WHEN direct IS NOT NULL THEN 'exact_height_m' WHEN stories_exact IS NOT NULL THEN 'estimated_from_exact_storeys'
                  WHEN stories_min IS NOT NULL AND stories_max IS NOT NULL THEN 'estimated_from_storey_range'
                  WHEN height IS NULL OR height = '' THEN 'unknown' ELSE 'other' END AS height_source_type,
             CASE WHEN direct IS NOT NULL THEN 'high' WHEN stories_exact IS NOT NULL THEN 'medium'
                  WHEN stories_min IS NOT NULL AND stories_max IS NOT NULL THEN 'low' ELSE 'none' END AS height_quality,
             coalesce(NULLIF(substr(upper(occupancy), 1, 3), ''), 'UNK') AS occupancy_code,
             CASE substr(upper(occupancy), 1, 3) WHEN 'RES' THEN 'Residential' WHEN 'COM' THEN 'Commercial' WHEN 'MIX' THEN 'Mixed'
                  WHEN 'IND' THEN 'Industrial' WHEN 'AGR' THEN 'Agricultural' WHEN 'ASS' THEN 'Assembly' WHEN 'GOV' THEN 'Government'
                  WHEN 'EDU' THEN 'Education' ELSE 'Unknown' END AS occupancy_group,
             CASE WHEN occupancy IS NULL OR occupancy = '' THEN 'none' WHEN length(occupancy) >= 3 THEN 'available' ELSE 'low' END AS occupancy_quality
      FROM p),
b AS (SELECT *, CASE WHEN floorspace_source_m2 IS NOT NULL THEN floorspace_source_m2 WHEN stories_exact IS NOT NULL THEN footprint_area_m2 * stories_exact
                     WHEN stories_min IS NOT NULL AND stories_max IS NOT NULL THEN footprint_area_m2 * ((stories_min + stories_max) / 2e0) END AS floorspace_est_m2 FROM m),
c AS (SELECT *, round(25e-2 + CASE WHEN height_m IS NOT NULL THEN 30e-2 ELSE 0e0 END + CASE WHEN occupancy_group <> 'Unknown' THEN 30e-2 ELSE 0e0 END
                      + CASE WHEN floorspace_est_m2 IS NOT NULL THEN 15e-2 ELSE 0e0 END, 2) AS attribute_completeness_score FROM b),
x AS ({fixtures.EXPOSURES_SQL}),
v AS (SELECT exposure_id, TRY_CAST(lon AS DOUBLE) AS lon, TRY_CAST(lat AS DOUBLE) + {north} AS lat,
             coalesce(TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180 AND TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90, false) AS coordinate_valid FROM x),
w AS (SELECT *, {radius} / (111320e0 * greatest(cos(radians(lat)), 2e-1)) AS dx, {radius} / 111320e0 AS dy FROM v WHERE coordinate_valid),
e AS (SELECT *, {_laea_sql("lon", "lat")[0]} AS px, {_laea_sql("lon", "lat")[1]} AS py FROM w)"""


_BASE = _base_sql()
_FAR_BASE = _base_sql(FAR, "(exposure_id % 5) * 1e-2")
_INSIDE = """,
ir AS (SELECT e.exposure_id, b.building_id, row_number() OVER (PARTITION BY e.exposure_id ORDER BY b.footprint_area_m2 NULLS LAST, b.building_id) AS k
       FROM e JOIN b ON e.lon BETWEEN b.xmin AND b.xmax AND e.lat BETWEEN b.ymin AND b.ymax),
i AS (SELECT exposure_id, building_id, 'inside_polygon' AS kind, 0e0 AS d FROM ir WHERE k = 1)"""
_NEAR = f""",
nc AS (SELECT e.exposure_id, b.building_id, least({_edge_sql(0, 1)}, {_edge_sql(1, 2)}, {_edge_sql(2, 3)}, {_edge_sql(3, 0)}) AS d
       FROM e JOIN b ON b.xmin <= e.lon + e.dx AND b.xmax >= e.lon - e.dx AND b.ymin <= e.lat + e.dy AND b.ymax >= e.lat - e.dy
       WHERE e.exposure_id NOT IN (SELECT exposure_id FROM i)),
nr AS (SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY d, building_id) AS k FROM nc WHERE d <= {RADIUS}),
n AS (SELECT exposure_id, building_id, 'nearest_polygon' AS kind, d FROM nr WHERE k = 1)"""
_CENTROID = f""",
cr AS (SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY d, building_id) AS k FROM (
         SELECT e.exposure_id, b.building_id, {_haversine_sql("b.centroid_lon", "b.centroid_lat", "e.lon", "e.lat")} AS d
         FROM e JOIN b ON b.centroid_lon BETWEEN e.lon - e.dx AND e.lon + e.dx AND b.centroid_lat BETWEEN e.lat - e.dy AND e.lat + e.dy) WHERE d <= {RADIUS}),
n AS (SELECT exposure_id, building_id, 'nearest_centroid' AS kind, d FROM cr WHERE k = 1)"""
_FOUND = """,
f AS (SELECT exposure_id, kind AS match_type, d, building_id FROM i
      UNION ALL SELECT exposure_id, 'nearest', d, building_id FROM n WHERE exposure_id NOT IN (SELECT exposure_id FROM i))"""
_WIDE = max(4 * RADIUS, RADIUS + 150)
_GATED = f""",
gc AS (SELECT e.exposure_id, b.building_id, least({_edge_sql(0, 1)}, {_edge_sql(1, 2)}, {_edge_sql(2, 3)}, {_edge_sql(3, 0)}) AS d,
              row_number() OVER (PARTITION BY e.exposure_id ORDER BY {_haversine_sql("b.centroid_lon", "b.centroid_lat", "e.lon", "e.lat")}, b.building_id) AS g
       FROM e JOIN b ON {_haversine_sql("b.centroid_lon", "b.centroid_lat", "e.lon", "e.lat")} <= {_WIDE}
       WHERE e.exposure_id NOT IN (SELECT exposure_id FROM i)
         AND b.centroid_lon BETWEEN e.lon - {_WIDE / RADIUS} * e.dx AND e.lon + {_WIDE / RADIUS} * e.dx
         AND b.centroid_lat BETWEEN e.lat - {_WIDE / RADIUS} * e.dy AND e.lat + {_WIDE / RADIUS} * e.dy),
nr AS (SELECT *, row_number() OVER (PARTITION BY exposure_id ORDER BY d, building_id) AS k FROM gc WHERE g <= 500 AND d <= {RADIUS}),
n AS (SELECT exposure_id, building_id, 'nearest_polygon' AS kind, d FROM nr WHERE k = 1)"""


def _all_sql(matches: str) -> str:
    return f""",
mt AS ({matches}),
en AS (SELECT v.exposure_id, v.coordinate_valid, coalesce(mt.kind, 'none') AS building_match_type, mt.d AS distance,
              CASE WHEN mt.kind IS NULL THEN 'none' WHEN mt.kind = 'inside_polygon' THEN 'high' WHEN mt.d <= 15 THEN 'medium' ELSE 'low' END AS building_confidence,
              c.* FROM v LEFT JOIN mt ON v.exposure_id = mt.exposure_id LEFT JOIN c ON mt.building_id = c.building_id)"""


_BOTH = "SELECT * FROM i UNION ALL SELECT * FROM n"
_MATCH_COLUMNS = "SELECT exposure_id, coordinate_valid, building_match_type, round(distance, 3) AS building_distance_m, building_confidence, building_id AS building_building_id, source AS building_source, height_m AS building_height_m, occupancy_group AS building_occupancy_group FROM en"
_CASCADE = _BASE + _INSIDE + _NEAR + _all_sql(_BOTH)
_SUMMARY = """SELECT count(*) AS total_rows, count(*) FILTER (WHERE coordinate_valid) AS valid_coordinate_rows,
  count(*) FILTER (WHERE building_match_type = 'inside_polygon') AS inside_polygon_matches, count(*) FILTER (WHERE building_match_type = 'nearest_polygon') AS nearest_matches,
  count(*) FILTER (WHERE building_match_type = 'none') AS no_matches, round(avg(distance) FILTER (WHERE building_match_type = 'nearest_polygon'), 3) AS average_nearest_distance_m FROM en"""
_TX = "greatest(0, least({n} - 1, CAST(floor(({lon} + 180e0) / 360e0 * {n}) AS BIGINT)))"
_TY = "greatest(0, least({n} - 1, CAST(floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * {n}) AS BIGINT)))"
_N = 1 << ZOOM
_KEY = f"array_to_string(list_transform(range({ZOOM - 1}, -1, -1), lambda i: ((tx >> i) & 1) + 2 * ((ty >> i) & 1)), '')"
_TOUCH = f"xmin <= {BOX[2]} AND xmax >= {BOX[0]} AND ymin <= {BOX[3]} AND ymax >= {BOX[1]}"
_CLIPPED = " OR ".join(f"(xmin <= {c} AND xmax >= {a} AND ymin <= {d} AND ymax >= {b})" for a, b, c, d in fixtures.BOUNDARY)


def _columns(columns: str) -> str:
    return f"{_BASE} SELECT building_id, {columns} FROM c"


def _distribution(key: str) -> str:
    return f"{_BASE} SELECT {key}, count(*) AS building_count, round(count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS share FROM c GROUP BY {key}"


#: Of each point the least (distance, building); a point within a building is at 0.
_FIRST = f"SELECT exposure_id, k.building_id, round(k.d, 3) AS distance_m FROM (SELECT exposure_id, min(struct_pack(d := d, building_id := building_id)) AS k FROM d WHERE d <= {FAR} GROUP BY exposure_id)"
_FAR_SQL = f"""{_FAR_BASE}, d AS (SELECT e.exposure_id, b.building_id, CASE WHEN e.lon BETWEEN b.xmin AND b.xmax AND e.lat BETWEEN b.ymin AND b.ymax THEN 0e0
        ELSE least({_edge_sql(0, 1)}, {_edge_sql(1, 2)}, {_edge_sql(2, 3)}, {_edge_sql(3, 0)}) END AS d
        FROM e JOIN b ON b.xmin <= e.lon + e.dx AND b.xmax >= e.lon - e.dx AND b.ymin <= e.lat + e.dy AND b.ymax >= e.lat - e.dy)
        {_FIRST}"""

ORACLE_SQL: dict[str, str] = {
    "inside_match": _BASE + _INSIDE + _all_sql("SELECT * FROM i") + _MATCH_COLUMNS,
    "nearest_centroid_match": _BASE + _CENTROID + _all_sql("SELECT * FROM n") + _MATCH_COLUMNS,
    "inside_nearest_cascade": _CASCADE + _MATCH_COLUMNS,
    "centroid_gated_nearest": _BASE + _INSIDE + _GATED + _all_sql(_BOTH) + _MATCH_COLUMNS,
    "nearest_polygon_match": _CASCADE + "SELECT exposure_id, building_id AS building_building_id, round(distance, 3) AS building_distance_m FROM en WHERE building_match_type = 'nearest_polygon'",
    "stored_match": _CASCADE + _MATCH_COLUMNS,
    "nearest_far": _FAR_SQL,
    "nearest_far_stored": _FAR_SQL,
    "nearest_far_centroid": f"""{_FAR_BASE}, d AS (SELECT e.exposure_id, b.building_id, {_haversine_sql("b.centroid_lon", "b.centroid_lat", "e.lon", "e.lat")} AS d
        FROM e JOIN b ON b.centroid_lon BETWEEN e.lon - e.dx AND e.lon + e.dx AND b.centroid_lat BETWEEN e.lat - e.dy AND e.lat + e.dy)
        {_FIRST}""",
    "coordinate_validation": f"{_BASE} SELECT exposure_id, coordinate_valid FROM v",
    "height_parse": _columns("height_source_type, height_m, stories_exact, stories_min, stories_max, height_quality"),
    "occupancy_classify": _columns("occupancy_code, occupancy_group, occupancy_quality"),
    "floorspace_estimate": _columns("floorspace_source_m2, round(floorspace_est_m2, 3) AS floorspace_est_m2"),
    "completeness_score": _columns("attribute_completeness_score"),
    "bbox_prefilter": f"{_BASE} SELECT id, source FROM raw WHERE {_TOUCH}",
    "boundary_clip": f"{_BASE} SELECT building_id FROM c WHERE {_CLIPPED}",
    "boundary_clip_joined": f"{_BASE} SELECT building_id FROM c WHERE {_CLIPPED}",
    "quadkey_encode": f"{_BASE} SELECT exposure_id, {_KEY} AS quadkey FROM (SELECT exposure_id, {_TX.format(n=_N, lon='lon')} AS tx, {_TY.format(n=_N, lat='lat')} AS ty FROM e)",
    "tile_cover": f"""{_BASE}, t AS (SELECT building_id, {_TX.format(n=_N, lon="xmin")} AS x0, {_TX.format(n=_N, lon="xmax")} AS x1, {_TY.format(n=_N, lat="ymax")} AS y0, {_TY.format(n=_N, lat="ymin")} AS y1 FROM c),
        r AS (SELECT building_id, unnest(range(x0, x1 + 1)) AS tx, y0, y1 FROM t), s AS (SELECT building_id, tx, unnest(range(y0, y1 + 1)) AS ty FROM r)
        SELECT building_id, tx, ty, {_KEY} AS quadkey FROM s""",
    "tile_pruned_scan": f"{_BASE} SELECT building_id, source FROM c WHERE {_TOUCH}",
    "laea_project": f"{_BASE} SELECT exposure_id, round(px, 3) AS easting, round(py, 3) AS northing FROM e",
    "footprint_area": _columns("round(footprint_area_m2, 3) AS footprint_area_m2"),
    "centroid": _columns("round(centroid_lon, 7) AS centroid_lon, round(centroid_lat, 7) AS centroid_lat, round((xmax - xmin) * (ymax - ymin) * 1e9, 3) AS area_deg2_e9"),
    "haversine_distance": f"{_BASE} SELECT exposure_id, round({_haversine_sql(str(ORIGIN[0]), str(ORIGIN[1]), 'lon', 'lat')}, 3) AS distance_m FROM e",
    "profile_summary": f"""{_BASE} SELECT count(*) AS total_buildings, round(min(footprint_area_m2), 4) AS min_area_m2, round(avg(footprint_area_m2), 4) AS avg_area_m2, round(max(footprint_area_m2), 4) AS max_area_m2,
        round(avg(CASE WHEN occupancy_group = 'Unknown' THEN 1e0 ELSE 0e0 END), 4) AS unknown_occupancy_share, round(avg(CASE WHEN height_m IS NULL THEN 1e0 ELSE 0e0 END), 4) AS missing_height_share,
        round(avg(CASE WHEN floorspace_est_m2 IS NULL THEN 1e0 ELSE 0e0 END), 4) AS missing_floorspace_share, round(avg(attribute_completeness_score), 4) AS avg_attribute_completeness_score FROM c""",
    "occupancy_distribution": _distribution("occupancy_group"),
    "height_source_distribution": _distribution("height_source_type"),
    "source_distribution": _distribution("source"),
    "schema_profile": f"{_BASE} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM raw" for c in ("id", "source", "height", "occupancy", "floorspace", "xmin", "ymin", "xmax", "ymax")),
    "geometry_check": f"{_BASE} SELECT 'POLYGON' AS geom_type, true AS is_valid, count(*) AS row_count FROM raw",
    "union_by_name": f"{_BASE} SELECT id, CASE WHEN id % 2 = 0 THEN source END AS source, height, CASE WHEN id % 2 = 1 THEN occupancy END AS occupancy FROM raw",
    "match_summary": _CASCADE + _SUMMARY,
    "share_table": f"""{_CASCADE}, s AS ({_SUMMARY})
        SELECT metric, count, round(100e0 * count / total, 1) AS share FROM (
          SELECT 'total_rows' AS metric, total_rows AS count, total_rows AS total FROM s UNION ALL SELECT 'valid_coordinate_rows', valid_coordinate_rows, total_rows FROM s
          UNION ALL SELECT 'inside_polygon_matches', inside_polygon_matches, total_rows FROM s UNION ALL SELECT 'nearest_matches', nearest_matches, total_rows FROM s
          UNION ALL SELECT 'no_matches', no_matches, total_rows FROM s)""",
    "detailed_occupancy_distribution": _BASE + _INSIDE + _all_sql("SELECT * FROM i") + "SELECT occupancy AS name, count(*) AS count FROM en WHERE occupancy IS NOT NULL AND occupancy <> '' GROUP BY occupancy",
    "occupancy_group_shares": _BASE + _INSIDE + _all_sql("SELECT * FROM i") + "SELECT occupancy_group AS name, count(*) AS count, round(100e0 * count(*) / (SELECT count(occupancy_group) FROM en), 1) AS share FROM en WHERE occupancy_group IS NOT NULL GROUP BY occupancy_group",
    "lookup_table": _columns(
        "strftime(make_timestamp(id * 60000000), '%Y-%m-%d %H:%M:%SZ') AS last_update, round(footprint_area_m2, 3) AS footprint_area_m2, "
        + ", ".join(f"round({f}({', '.join(f'{a}{i}' for i in range(4))}), 3) AS bbox_3035_{a}{n}" for f, n in (("least", "min"), ("greatest", "max")) for a in "xy")
    ),
    "point_lookup": f"""{_BASE}{_INSIDE}{_CENTROID}{_FOUND}
        SELECT exposure_id, coordinate_valid, coalesce(match_type, 'none') AS match_type, round(d, 3) AS distance_m,
               CASE WHEN match_type IS NULL THEN 'none' WHEN match_type = 'inside_polygon' THEN 'high' WHEN d <= 15 THEN 'medium' ELSE 'low' END AS confidence, building_id
        FROM v LEFT JOIN f USING (exposure_id)""",
    "point_responses": f"""{_BASE}{_INSIDE}{_CENTROID}{_FOUND}
        SELECT exposure_id, coalesce(match_type, 'none') AS match_type, building_id, occupancy_group, CASE WHEN building_id IS NOT NULL THEN 'Polygon' END AS geometry_type
        FROM v LEFT JOIN f USING (exposure_id) LEFT JOIN c USING (building_id)""",
    "geojson_out": _columns("'Polygon' AS type, 5 AS points, round(xmin, 6) AS first_lon, round(ymax, 6) AS third_lat"),
    "geocode_flatten": """
        WITH q AS (SELECT c_custkey, c_name, 'customer ' || CAST(c_custkey AS VARCHAR) AS query FROM customer)
        SELECT query, 1 AS rank, c_name AS label, round(CAST('10.' || CAST(c_custkey AS VARCHAR) AS DOUBLE), 6) AS lon, round(CAST('52.' || CAST(c_custkey AS VARCHAR) AS DOUBLE), 6) AS lat, 'house' AS type, 'Nominatim' AS provider FROM q WHERE c_custkey % 3 <> 0
        UNION ALL SELECT query, 2, 'Second ' || CAST(c_custkey AS VARCHAR), 10.5, 52.5, 'road', 'Nominatim' FROM q WHERE c_custkey % 3 <> 0
        UNION ALL SELECT query, 1, c_name || ', Shire, Land', round(CAST('10.' || CAST(c_custkey AS VARCHAR) AS DOUBLE), 6), 52.25, 'city', 'Photon' FROM q WHERE c_custkey % 3 = 0""",
    "csv_round_trip": f"{_BASE} SELECT exposure_id, lon, lat FROM x",
    "stream_enrich": _CASCADE + "SELECT exposure_id, coordinate_valid, building_match_type, round(distance, 3) AS building_distance_m, building_id AS building_building_id FROM en",
    "stream_summary": _CASCADE + _SUMMARY,
    "profile_files": f"""{_BASE}, k AS (SELECT * FROM c WHERE {_CLIPPED})
        SELECT 'summary' AS part, count(*) AS buildings, round(avg(attribute_completeness_score), 4) AS value, true AS holds FROM k
        UNION ALL SELECT name, (SELECT count(*) FROM k), 1e0, true FROM (VALUES ('occupancy'), ('height_source'), ('source')) AS n(name)""",
    **queries_shapes.ORACLE_SQL,
    **queries_sources.ORACLE_SQL,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["inside_nearest_cascade"](spark, sf_dir)
