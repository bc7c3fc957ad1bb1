"""Reading raw footprints and boundary features, and writing clean tables."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from terrafoot.functions.geometry import reproject_wkb
from terrafoot.functions.tiles import quadkeys_of_box

log = logging.getLogger(__name__)
RAW = ["id", "source", "relation_id", "quadkey", "last_update", "height", "occupancy", "floorspace", "geometry", "bbox"]


def source_paths(root: str, box: tuple[float, float, float, float], zoom: int = 6) -> list[str]:
    """The files of the tiles that cover (xmin, ymin, xmax, ymax): ``root`` ends in ``*.parquet``, else it is used as is."""
    if not root.endswith("*.parquet"):
        return [root]
    return [f"{root[: -len('*.parquet')]}{key}.parquet" for key in quadkeys_of_box(*box, zoom)]


#: From so many paths in one folder on, the folder is listed.
LISTED = 64


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that exist, in their order, by one listing of each folder that has many of them; patterns are kept as they are."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    asked: dict[str, list[str]] = {}
    for p in paths:
        if "*" not in p:
            asked.setdefault(p.rpartition("/")[0], []).append(p)
    there = set()
    for folder, own in asked.items():
        at = path(folder or ".")
        files = at.getFileSystem(conf)
        if len(own) < LISTED:
            there |= {p for p in own if files.exists(path(p))}
        elif files.exists(at):
            names = {status.getPath().getName() for status in files.listStatus(at)}
            there |= {p for p in own if p.rpartition("/")[2] in names}
    return [p for p in paths if "*" in p or p in there]


def read_footprints(spark: SparkSession, paths: list[str] | str, with_file: bool = False) -> DataFrame:
    """Raw footprints of all files, matched by column name; tiles without a file are skipped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = existing(spark, paths)
    if not there:
        raise FileNotFoundError(f"none of {len(paths)} source files exists")
    df = spark.read.option("mergeSchema", "true").parquet(*there)
    return df.withColumn("filename", F.col("_metadata.file_path")) if with_file else df


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ; what a frame lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def geometry_wkb(df: DataFrame, name: str = "geometry") -> Column:
    """The geometry column as WKB, whatever it is stored as."""
    if name not in df.columns:
        raise ValueError(f"the source has no column {name!r}")
    kind = df.schema[name].dataType
    if isinstance(kind, BinaryType):
        return F.col(name)
    if kind.typeName().startswith(("geometry", "geography")):
        return F.expr(f"st_asbinary(`{name}`)")
    log.warning("column %s has type %s; it is read as hexadecimal WKB", name, kind.simpleString())
    return F.unhex(F.col(name).cast("string"))


def in_box(box: tuple[float, float, float, float], bbox: str = "bbox") -> Column:
    """Bounding boxes that touch (xmin, ymin, xmax, ymax); reaches the Parquet scan as pushed filters."""
    xmin, ymin, xmax, ymax = map(float, box)
    at = lambda f: F.col(f"{bbox}.{f}")
    return (at("xmax") >= xmin) & (at("xmin") <= xmax) & (at("ymax") >= ymin) & (at("ymin") <= ymax)


def boundary_features(df: DataFrame, srid: int = 4326, layer: str | None = None) -> DataFrame:
    """feature_id, geom_wkb in degrees and srid (4326) of a boundary table; null geometries go, ``layer`` chooses rows."""
    df = df.where(F.col("geom_wkb").isNotNull())
    if layer is not None:
        df = df.where(F.col("layer") == layer)
    wkb = F.col("geom_wkb") if srid == 4326 else reproject_wkb(srid)("geom_wkb")
    return df.select("feature_id", wkb.alias("geom_wkb"), F.lit(4326).alias("srid"))


def write_clean(df: DataFrame, path: str, force: bool = False, rows_per_file: int = 0) -> None:
    """ZSTD Parquet; fails if ``path`` exists unless ``force``."""
    writer = df.write.mode("overwrite" if force else "errorifexists").option("compression", "zstd")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)
