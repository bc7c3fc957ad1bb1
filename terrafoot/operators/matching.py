"""Matching points to buildings: inside, nearest polygon, nearest centroid, and their cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafoot.columns import BUILDING
from terrafoot.functions.crs import EUROPE, Metric, haversine, sure_within, window
from terrafoot.functions.geometry import pair_covers, pair_distance
from terrafoot.functions.parsing import coordinate_valid, safe_double
from terrafoot.operators.joins import ZOOM, overlap_join, window_zoom
from terrafoot.operators.stored import StoredLookup, stored_pairs
from terrafoot.session import materialised

Buildings = DataFrame | StoredLookup

MODES = ("centroid", "inside", "inside_nearest")
CANDIDATES = 500
#: Nearest matches up to this many metres have medium confidence.
MEDIUM_M = 15.0
ROW = "__exposure_row_id"


def with_points(exposure: DataFrame, lat: str, lon: str, key: str | None = None) -> DataFrame:
    """Adds the row id (``key``, or one that is made up and written down), __lon, __lat and coordinate_valid."""
    if missing := [c for c in (lat, lon) if c not in exposure.columns]:
        raise ValueError(f"the exposure table has no column {missing}")
    rows = exposure.drop("coordinate_valid").withColumns({"__lon": safe_double(F.col(lon)), "__lat": safe_double(F.col(lat))})
    rows = rows.withColumn("coordinate_valid", coordinate_valid(F.col("__lon"), F.col("__lat")))
    if key:
        return rows.withColumn(ROW, F.col(key))
    return materialised(rows.withColumn(ROW, F.monotonically_increasing_id()))


def with_places(points: DataFrame, metric: Metric = EUROPE) -> DataFrame:
    """The distinct valid coordinates of ``points``, written down: __lon, __lat, a row id each, and px, py in metres.

    Each coordinate is matched once, however many rows share it, and is projected before any join. Validity
    is tested after the grouping: a filter before it would parse the texts behind a coordinate three times.
    """
    places = points.groupBy("__lon", "__lat").agg(F.max("coordinate_valid").alias("valid")).where("valid").drop("valid")
    px, py = metric.columns(F.col("__lon"), F.col("__lat"))
    return materialised(places.withColumns({ROW: F.monotonically_increasing_id(), "px": px, "py": py}), "places")


def _boxed(points: DataFrame, dx: Column, dy: Column, *more: str) -> DataFrame:
    x, y = F.col("__lon"), F.col("__lat")
    return points.select(ROW, "__lon", "__lat", *more, (x - dx).alias("l_xmin"), (y - dy).alias("l_ymin"), (x + dx).alias("l_xmax"), (y + dy).alias("l_ymax"))


def _pairs(left: DataFrame, buildings: Buildings, columns: list[str], box: list[str], zoom: int, centres: bool = False) -> DataFrame:
    """Pairs of boxed places and buildings, from a table or a stored lookup."""
    if isinstance(buildings, StoredLookup) and zoom >= buildings.zoom - 6:  # else a window has too many tiles
        return stored_pairs(left, buildings, [F.col(c) for c in columns], tuple(F.col(c) for c in box), centres)
    right = _rows(buildings).select(*columns, *[F.col(c).alias(f"r_{n}") for c, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    return overlap_join(left, right, zoom, left_fits=True)


def _rows(buildings: Buildings) -> DataFrame:
    return buildings.buildings() if isinstance(buildings, StoredLookup) else buildings


BOX = [f"bbox_{c}" for c in ("xmin", "ymin", "xmax", "ymax")]
#: The first window of a search, and how much each next one is wider.
FIRST_REACH, GROWTH = 100.0, 4.0


def _grown(places: DataFrame, radius: float, search, scale, most: int = 1) -> DataFrame:
    """``search(places, reach)`` with growing reach: (row, ..., distance_m).

    A place leaves as soon as its ``most`` nearest lie within what the window of that reach holds for
    certain, so a wide radius makes no more pairs than the neighbourhood of the nearest.
    """
    done, rest, reach = [], places, FIRST_REACH
    while reach * GROWTH / 2 < radius:
        found = materialised(search(rest, reach), "found")
        at = rest.select(ROW, (sure_within(F.col("__lat"), reach) * scale(F.col("__lon"), F.col("__lat"))).alias("__sure"))
        settled = found.join(at, ROW).where(F.col("distance_m") <= F.col("__sure")).groupBy(ROW).agg(F.count("*").alias("n")).where(F.col("n") >= most).select(ROW)
        settled = materialised(settled, "settled")
        done.append(found.join(settled, ROW, "left_semi"))
        rest = materialised(rest.join(settled, ROW, "left_anti"), "rest")
        if rest.isEmpty():
            break
        reach *= GROWTH
    else:
        done.append(search(rest, radius))
    return reduce(DataFrame.unionAll, done)


def _best(pairs: DataFrame, order: Column) -> DataFrame:
    """One building a row: the least ``order``, nulls last, then the smallest building_id."""
    least = F.min(F.struct(F.isnull("__order").alias("none"), F.col("__order").alias("order"), "building_id"))
    best = pairs.withColumn("__order", order).groupBy(ROW).agg(least.alias("best"))
    return best.select(ROW, F.col("best.building_id").alias("building_id"), F.col("best.order").alias("order"))


def inside_matches(places: DataFrame, buildings: Buildings) -> DataFrame:
    """(row, building_id): the smallest building that holds the point; unknown areas come last."""
    pairs = _pairs(_boxed(places, F.lit(0.0), F.lit(0.0)), buildings, ["building_id", "footprint_area_m2", "rings"], BOX, ZOOM)
    return _best(pairs.where(pair_covers("rings", "__lon", "__lat")), F.col("footprint_area_m2")).select(ROW, "building_id")


def centroid_pairs(places: DataFrame, buildings: Buildings, radius: float, *more: str) -> DataFrame:
    """All (row, building_id, distance_m, and the places' columns ``more``) with the centroid within ``radius`` metres on the sphere."""
    centre = ["centroid_lon", "centroid_lat"]
    pairs = _pairs(_boxed(places, *window(F.col("__lat"), radius), *more), buildings, ["building_id", *centre], centre * 2, window_zoom(radius), centres=True)
    pairs = pairs.withColumn("distance_m", haversine(F.col("centroid_lon"), F.col("centroid_lat"), F.col("__lon"), F.col("__lat")))
    return pairs.where(F.col("distance_m") <= float(radius)).select(ROW, *more, "building_id", "distance_m")


def nearest_centroids(places: DataFrame, buildings: Buildings, radius: float) -> DataFrame:
    """(row, building_id, distance_m) of the nearest centroid within the radius."""
    search = lambda rest, reach: _best(centroid_pairs(rest, buildings, reach), F.col("distance_m")).withColumnRenamed("order", "distance_m")
    return _grown(places, radius, search, lambda lon, lat: F.lit(1.0))


METRIC = ["rings_3035", "bbox_3035_xmin", "bbox_3035_ymin", "bbox_3035_xmax", "bbox_3035_ymax"]


def _metric_box_near(radius: float) -> Column:
    r = F.lit(float(radius))
    return (F.col("bbox_3035_xmin") <= F.col("px") + r) & (F.col("bbox_3035_xmax") >= F.col("px") - r) & (F.col("bbox_3035_ymin") <= F.col("py") + r) & (F.col("bbox_3035_ymax") >= F.col("py") - r)


def _nearest(pairs: DataFrame, radius: float) -> DataFrame:
    """The nearest shape of each row; the distance is computed once a pair and tested on the least one only."""
    best = _best(pairs, pair_distance("rings_3035", "px", "py")).withColumnRenamed("order", "distance_m")
    return best.where(F.col("distance_m") <= float(radius))


def nearest_polygons(places: DataFrame, buildings: Buildings, radius: float, metric: Metric = EUROPE) -> DataFrame:
    """(row, building_id, distance_m) of the nearest polygon within the radius in the metric grid."""

    def search(rest: DataFrame, reach: float) -> DataFrame:
        pairs = _pairs(_boxed(rest, *window(F.col("__lat"), reach), "px", "py"), buildings, ["building_id", *METRIC], BOX, window_zoom(reach))
        return _nearest(pairs.where(_metric_box_near(reach)), reach)

    return _grown(places, radius, search, metric.least_scale)


def candidate_centroids(places: DataFrame, buildings: Buildings, radius: float, most: int = CANDIDATES, *more: str) -> DataFrame:
    """(row, building_id, distance_m, rank, and ``more``) of the ``most`` nearest centroids within max(4 r, r + 150) metres."""
    order = Window.partitionBy(ROW).orderBy("distance_m", "building_id")

    def search(rest: DataFrame, reach: float) -> DataFrame:
        return centroid_pairs(rest, buildings, reach, *more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    return _grown(places, max(4.0 * radius, radius + 150.0), search, lambda lon, lat: F.lit(1.0), most)


def nearest_polygons_by_centroid(places: DataFrame, buildings: Buildings, radius: float, most: int = CANDIDATES) -> DataFrame:
    """The same among the ``most`` nearest centroids within max(4 r, r + 150) metres only.

    The metric boxes thin the candidates out before their shapes are attached.
    """
    near = candidate_centroids(places, buildings, radius, most, "px", "py").select(ROW, "px", "py", "building_id")
    near = materialised(near.join(_rows(buildings).select("building_id", *METRIC[1:]), "building_id").where(_metric_box_near(radius)).select(ROW, "px", "py", "building_id"), "candidates")
    return _nearest(near.join(_rows(buildings).select("building_id", "rings_3035"), "building_id"), radius)


def match(points: DataFrame, buildings: Buildings, mode: str, radius: float = 50.0, candidates: str = "window", metric: Metric = EUROPE) -> DataFrame:
    """(__lon, __lat, building_id, building_match_type, building_distance_m) of every distinct coordinate that is matched.

    ``metric`` projects a longitude and a latitude to metres; the columns rings_3035 and bbox_3035_* of
    ``buildings`` must be in the same system, by default the European grid.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    if not radius > 0:
        raise ValueError("the radius must be positive")
    places = with_places(points, metric)
    label = lambda df, name, d: df.select(ROW, "building_id", F.lit(name).alias("building_match_type"), d.alias("building_distance_m"))
    if mode == "centroid":
        found = label(nearest_centroids(places, buildings, radius), "nearest_centroid", F.col("distance_m"))
    else:
        found = label(inside_matches(places, buildings), "inside_polygon", F.lit(0.0))
        if mode == "inside_nearest":
            found = materialised(found, "inside")
            rest = places.join(found.select(ROW), ROW, "left_anti")
            near = nearest_polygons_by_centroid(rest, buildings, radius) if candidates == "centroid" else nearest_polygons(rest, buildings, radius, metric)
            found = found.unionAll(label(near, "nearest_polygon", F.col("distance_m")))
    return found.join(places.select(ROW, "__lon", "__lat"), ROW).drop(ROW)


def confidence(kind: Column, metres: Column) -> Column:
    return F.when(kind.isNull() | (kind == "none"), "none").when(kind == "inside_polygon", "high").when(metres <= MEDIUM_M, "medium").otherwise("low")


def enrich(exposure: DataFrame, lookup: Buildings, lat: str = "lat", lon: str = "lon", mode: str = "inside_nearest", radius: float = 50.0, key: str | None = None, candidates: str = "window", ordered: bool = False, metric: Metric = EUROPE) -> DataFrame:
    """Every exposure row once, with four match columns and 27 ``building_`` columns.

    ``lookup`` is a table of :func:`terrafoot.plans.lookup.prepare_lookup`, whose building_id is
    unique, or one that :func:`terrafoot.operators.stored.store_lookup` has stored by tile: then its
    buildings aren't shuffled, and only regions that the points touch are read. Input columns that clash with an output column are replaced. Rows without a match, or
    with invalid coordinates, have type and confidence ``none`` and nulls. ``key`` names a unique
    column that saves making up row ids; ``ordered`` sorts by the row id. ``metric`` is the
    projection in which the lookup's metric columns are, see :func:`match`.
    """
    points = with_points(exposure, lat, lon, key)
    found = match(points.select("__lon", "__lat", "coordinate_valid"), lookup, mode, radius, candidates, metric)
    if isinstance(lookup, StoredLookup):
        found = materialised(found, "matches")
        lookup = lookup.buildings(lookup.regions_around(found.select("__lon", "__lat"), radius))
    details = lookup.select("building_id", *[F.col(c).alias(f"__b_{c}") for c in BUILDING])
    found = found.join(details, "building_id").drop("building_id")
    found = found.withColumnsRenamed({"__lon": "__x", "__lat": "__y", "building_match_type": "__type", "building_distance_m": "__distance"})
    rows = points.join(found, (F.col("__lon") == F.col("__x")) & (F.col("__lat") == F.col("__y")) & F.col("coordinate_valid"), "left")
    if ordered:
        rows = rows.orderBy(ROW)
    made = {"coordinate_valid", "building_match_type", "building_distance_m", "building_confidence"} | {prefixed(c) for c in BUILDING}
    return rows.select(
        *[c for c in exposure.columns if c not in made],
        "coordinate_valid",
        F.coalesce("__type", F.lit("none")).alias("building_match_type"),
        F.col("__distance").alias("building_distance_m"),
        confidence(F.col("__type"), F.col("__distance")).alias("building_confidence"),
        *[F.col(f"__b_{c}").alias(prefixed(c)) for c in BUILDING],
    )


def prefixed(column: str) -> str:
    return f"building_{column}"


def lookup_places(points: DataFrame, lookup: Buildings, radius: float = 50.0) -> DataFrame:
    """(__lon, __lat, match_type, distance_m, confidence, building) of every distinct coordinate of ``points`` (of :func:`with_points`) that has a building.

    ``building`` is a struct of the lookup's columns.
    """
    places = with_places(points)
    found = materialised(inside_matches(places, lookup).select(ROW, "building_id", F.lit("inside_polygon").alias("match_type"), F.lit(0.0).alias("distance_m")), "inside")
    near = nearest_centroids(places.join(found.select(ROW), ROW, "left_anti"), lookup, radius)
    found = found.unionAll(near.select(ROW, "building_id", F.lit("nearest").alias("match_type"), "distance_m"))
    found = found.join(places.select(ROW, "__lon", "__lat"), ROW).drop(ROW)
    lookup = _rows(lookup)
    found = found.join(lookup.select(F.col("building_id"), F.struct(*lookup.columns).alias("building")), "building_id").drop("building_id")
    return found.withColumn("confidence", confidence(F.col("match_type"), F.col("distance_m")))


def attached(points: DataFrame, answers: DataFrame) -> DataFrame:
    """Every row of ``points`` (of :func:`with_points`) with the answer to its coordinate (__lon, __lat), nulls without one."""
    answers = answers.withColumnsRenamed({"__lon": "__x", "__lat": "__y"})
    at = (F.col("__lon") == F.col("__x")) & (F.col("__lat") == F.col("__y")) & F.col("coordinate_valid")
    return points.join(answers, at, "left").drop("__lon", "__lat", "__x", "__y", ROW)


def lookup_points(points: DataFrame, lookup: Buildings, lat: str = "lat", lon: str = "lon", radius: float = 50.0, key: str | None = None) -> DataFrame:
    """Every point once: the building that holds it, else the nearest centroid within the radius, else none.

    Columns: those of ``points``, coordinate_valid, match_type (``inside_polygon``, ``nearest`` or
    ``none``), distance_m, confidence, building (a struct of the lookup's columns). Points without a
    building, or with invalid coordinates, have ``none`` twice and nulls.
    """
    rows = with_points(points, lat, lon, key)
    found = lookup_places(rows, lookup, radius)
    made = ("coordinate_valid", "match_type", "distance_m", "confidence", "building")
    rows = attached(rows.select("__lon", "__lat", "coordinate_valid", ROW, *[F.col(c) for c in points.columns if c not in made]), found)
    return rows.withColumns({c: F.coalesce(c, F.lit("none")) for c in ("match_type", "confidence")})
