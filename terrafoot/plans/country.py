"""Country build: raw footprints to a clean, measured, profiled table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafoot.columns import CLEAN
from terrafoot.functions.attributes import with_attributes
from terrafoot.functions.geometry import Shapes, doubles, wkb_bounds
from terrafoot.functions.parsing import safe_double
from terrafoot.operators.joins import clip, prepared, small_boundary
from terrafoot.operators.profile import write_profile
from terrafoot.sources.footprints import RAW, geometry_wkb, in_box, write_clean


@dataclass
class BuildConfig:
    """Bounding box (xmin, ymin, xmax, ymax) and the constants of the estimates."""

    box: tuple[float, float, float, float]
    metres_per_storey: float = 3.0
    usable_floor_factor: float = 1.0
    lenient_storeys: bool = False
    sample_limit: int | None = None


FACTS = T.StructType([T.StructField("good", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in ("area", "lon", "lat")]])


def shape_facts(sent: Broadcast | None):
    """A UDF from WKB to (good, area, lon, lat), all from one parse: area on the equal-area grid, centroid in degrees.

    ``good`` are valid shapes that meet the boundary. A shape must meet it first, so what lies outside is
    not tested for validity. Spark would run the function again in a filter on ``good`` moved below, before the
    rows are dealt to all cores: it is called nondeterministic, so that it stays where it is and runs once a row.
    """
    area = prepared(sent) if sent is not None else None

    @F.arrow_udf(FACTS)
    def facts(wkb: pa.Array) -> pa.Array:
        shapes = Shapes(wkb)
        near = area().meets(shapes) if area else np.ones(len(shapes), bool)
        middle = shapes.centroid()
        return pa.StructArray.from_arrays([pa.array(shapes.valid(near)), doubles(shapes.area(shapes.projected())), doubles(middle[:, 0]), doubles(middle[:, 1])], [f.name for f in FACTS])

    return facts.asNondeterministic()


def build_country(raw: DataFrame, boundary: DataFrame | None, cfg: BuildConfig) -> DataFrame:
    """The clean table, one row for each raw building that is valid and meets the boundary.

    One lazy plan: box filter at the scan, one pass over the shapes, attributes. ``boundary`` holds
    feature_id and geom_wkb in degrees; without it the box alone decides. ``sample_limit`` takes
    that many arbitrary rows before the clip, for trials.
    """
    missing = [F.lit(None).cast("string").alias(c) for c in RAW if c not in raw.columns and c not in ("geometry", "bbox")]
    wkb = geometry_wkb(raw)
    rows = raw.select(*[c for c in RAW if c in raw.columns and c != "geometry"], *missing, wkb.alias("geom_wkb"))
    if "bbox" not in raw.columns:
        rows = rows.withColumn("bbox", wkb_bounds("geom_wkb"))
    rows = rows.where(in_box(cfg.box))
    if cfg.sample_limit:
        rows = rows.limit(cfg.sample_limit)
    rows = rows.select("*", *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    sent = small_boundary(boundary) if boundary is not None else None
    if boundary is not None and sent is None:
        rows = clip(rows, boundary, most_bytes=-1)
    rows = rows.withColumn("__facts", shape_facts(sent)("geom_wkb")).where("__facts.good").withColumns({
        "footprint_area_m2": F.col("__facts.area"),
        "centroid_lon": F.col("__facts.lon"),
        "centroid_lat": F.col("__facts.lat"),
        "building_id": F.col("id").cast("string"),
        "relation_id": F.col("relation_id").try_cast("double"),
        "quadkey_prefix_6": F.substring(F.col("quadkey").cast("string"), 1, 6),
        "height_raw": F.col("height"),
        "occupancy_raw": F.col("occupancy"),
        "floorspace_source_m2": safe_double(F.col("floorspace")),
    })
    rows = with_attributes(rows, metres_per_storey=cfg.metres_per_storey, usable_floor_factor=cfg.usable_floor_factor, lenient_storeys=cfg.lenient_storeys)
    return rows.select(*CLEAN)


def run_country(raw: DataFrame, boundary: DataFrame | None, cfg: BuildConfig, output: str, profile: str | None = None, force: bool = False) -> DataFrame:
    """Writes the clean table and, from what was written, its profile; returns the table."""
    write_clean(build_country(raw, boundary, cfg), output, force)
    clean = raw.sparkSession.read.parquet(output)
    if profile:
        write_profile(clean, profile)
    return clean
