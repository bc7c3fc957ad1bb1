"""The lookup table: clean buildings with decoded and projected shapes, clustered by tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.columns import BUILDING
from terrafoot.functions.crs import EUROPE, Metric
from terrafoot.functions.geometry import geojson, lookup_shape
from terrafoot.functions.parsing import json_safe


def prepare_lookup(clean: DataFrame, metric: Metric = EUROPE) -> DataFrame:
    """The 27 attributes (last_update as text), kind, rings, rings_3035 and their metric box.

    Far from Europe the default grid distorts distances: another ``metric``, given to matching as well,
    takes its place under the same column names.
    """
    rows = clean.withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd HH:mm:ssXXX")).withColumn("__shape", lookup_shape(metric)("geom_wkb"))
    metric = [F.col(f"__shape.{c}").alias(f"bbox_3035_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    return rows.select(*BUILDING, "__shape.kind", "__shape.rings", "__shape.rings_3035", *metric)


def write_lookup(clean: DataFrame, path: str, force: bool = False) -> None:
    """Parquet by tile prefix, sorted inside each: scans prune partitions and row groups by box."""
    rows = prepare_lookup(clean).repartitionByRange("quadkey_prefix_6", "bbox_xmin").sortWithinPartitions("quadkey_prefix_6", "bbox_xmin", "bbox_ymin")
    rows.write.mode("overwrite" if force else "errorifexists").partitionBy("quadkey_prefix_6").parquet(path)


def building_json(building: Column, numbers: tuple[str, ...] = ("relation_id", "centroid_lon", "centroid_lat", "footprint_area_m2", "height_m", "floorspace_source_m2", "floorspace_est_m2", "attribute_completeness_score")) -> Column:
    """A lookup struct as JSON without NaN or infinity, its geometry as GeoJSON; nulls are written."""
    box = ("bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax", "quadkey_prefix_6")
    own = [(json_safe(building[c]) if c in numbers else building[c]).alias(c) for c in BUILDING if c not in box]
    shape = F.parse_json(geojson(building["kind"], building["rings"]))
    return F.to_json(F.struct(*own, shape.alias("geometry")), {"ignoreNullFields": "false"})


def responses(matched: DataFrame) -> DataFrame:
    """``matched`` of lookup_points or lookup_places with one ``response`` column: match fields and the nested building as JSON, null without one."""
    building = F.when(F.col("building").isNotNull(), F.parse_json(building_json(F.col("building"))))
    head = F.struct("match_type", json_safe(F.col("distance_m")).alias("distance_m"), "confidence", building.alias("building"))
    return matched.withColumn("response", F.to_json(head, {"ignoreNullFields": "false"})).drop("building")


#: The response to a point without a building.
NO_RESPONSE = '{"match_type":"none","distance_m":null,"confidence":"none","building":null}'
