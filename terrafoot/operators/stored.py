"""A lookup stored by tile, for matching without moving its buildings.

One row for each building and tile that its box touches, in a table that is partitioned by coarse
region and bucketed by tile. Points are dealt to tiles and shuffled to the buckets; the buildings are
read where they lie, and only in the regions that the points touch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafoot.functions.crs import window
from terrafoot.functions.tiles import tile_x, tile_y
from terrafoot.operators.joins import MOST_TILES, TILE_POINTS, ZOOM, boxes_meet, by_tile, dealt, overlap_join
from terrafoot.session import materialised

#: Zoom of the regions; regions that a scan is narrowed to at most.
REGION_ZOOM, MOST_REGIONS = 6, 2048
#: Buildings of a bucket, where no number of buckets is given.
BUCKET_ROWS = 100_000
OWN = ("tx", "ty", "r_tx", "r_ty", "region", "home", "centre")


def region_of(tx: Column, ty: Column, zoom: int, region_zoom: int) -> Column:
    up = zoom - region_zoom
    return (F.shiftright(tx, up) * (1 << region_zoom) + F.shiftright(ty, up)).cast("int")


@dataclass(frozen=True)
class StoredLookup:
    """A table of :func:`store_lookup`: its zooms, and whether it has buildings of very many tiles, which are kept apart."""

    spark: SparkSession
    table: str
    zoom: int
    region_zoom: int
    wide: bool

    def tiles(self, regions: list[int] | None = None) -> DataFrame:
        """Rows by tile, of the given regions."""
        rows = self.spark.table(self.table)
        return rows if regions is None else rows.where(F.col("region").isin(regions))

    def wide_rows(self) -> DataFrame:
        return self.spark.table(f"{self.table}_wide")

    def buildings(self, regions: list[int] | None = None) -> DataFrame:
        """Each building once; with ``regions`` those whose tiles begin there."""
        rows = self.tiles(regions).where("home").drop(*OWN)
        return rows.unionByName(self.wide_rows()) if self.wide else rows

    def regions_around(self, points: DataFrame, radius: float) -> list[int] | None:
        """The regions in which buildings begin whose boxes touch the windows of (__lon, __lat), or None if they are very many."""
        dx, dy = window(F.col("__lat"), radius)
        up = self.zoom - self.region_zoom
        first = lambda tile: F.shiftright(F.greatest(F.lit(0).cast("long"), tile - MOST_TILES), up)
        last = lambda tile: F.shiftright(tile, up)
        x = F.sequence(first(tile_x(F.col("__lon") - dx, self.zoom)), last(tile_x(F.col("__lon") + dx, self.zoom)))
        y = F.sequence(first(tile_y(F.col("__lat") + dy, self.zoom)), last(tile_y(F.col("__lat") - dy, self.zoom)))
        boxes = points.select(x.alias("x"), y.alias("y")).distinct().withColumn("x", F.explode("x")).withColumn("y", F.explode("y"))
        found = boxes.distinct().limit(MOST_REGIONS + 1).collect()  # bounded
        return sorted(r.x * (1 << self.region_zoom) + r.y for r in found) if len(found) <= MOST_REGIONS else None


def store_lookup(lookup: DataFrame, table: str, zoom: int = ZOOM, region_zoom: int = REGION_ZOOM, buckets: int | None = None) -> StoredLookup:
    """Stores a table of :func:`terrafoot.plans.lookup.prepare_lookup` by tile, in the session's warehouse.

    ``buckets`` is the number of tasks that later joins have, by default one for :data:`BUCKET_ROWS`
    buildings, at least three for each core and at most as many as the session's shuffles have: every
    region has a file of each bucket. A building without a box is left out: it matches nothing.
    """
    if not 0 <= region_zoom <= zoom:
        raise ValueError("regions are no smaller than tiles")
    spark = lookup.sparkSession
    x0, x1 = (tile_x(F.col(f"bbox_{c}"), zoom) for c in ("xmin", "xmax"))
    y0, y1 = (tile_y(F.col(f"bbox_{c}"), zoom) for c in ("ymax", "ymin"))
    rows = lookup if hasattr(lookup, "scratch") else materialised(lookup, "lookup")
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(3 * spark.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS)))
    rows = rows.where(" AND ".join(f"bbox_{c} IS NOT NULL" for c in ("xmin", "ymin", "xmax", "ymax")))
    narrow = (x1 - x0 + 1) * (y1 - y0 + 1) <= MOST_TILES
    tiles = rows.where(narrow).withColumns({"r_tx": x0, "r_ty": y0}).withColumn("tx", F.explode(F.sequence(x0, x1))).withColumn("ty", F.explode(F.sequence(y0, y1)))
    centre = (tile_x(F.col("centroid_lon"), zoom) == F.col("tx")) & (tile_y(F.col("centroid_lat"), zoom) == F.col("ty"))
    tiles = tiles.withColumns({"home": (F.col("tx") == F.col("r_tx")) & (F.col("ty") == F.col("r_ty")), "centre": F.coalesce(centre, F.lit(False)), "region": region_of(F.col("tx"), F.col("ty"), zoom, region_zoom)})
    tiles.repartition(buckets, "tx", "ty").write.mode("overwrite").format("parquet").partitionBy("region").bucketBy(buckets, "tx", "ty").sortBy("tx", "ty").saveAsTable(table)
    wide = rows.where(~narrow)
    wide.write.mode("overwrite").format("parquet").saveAsTable(f"{table}_wide")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('terrafoot.zoom' = '{zoom}', 'terrafoot.region_zoom' = '{region_zoom}')")
    return open_lookup(spark, table)


def open_lookup(spark: SparkSession, table: str) -> StoredLookup:
    """A lookup that :func:`store_lookup` has stored."""
    own = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if "terrafoot.zoom" not in own:
        raise ValueError(f"{table} is not a stored lookup")
    return StoredLookup(spark, table, int(own["terrafoot.zoom"]), int(own["terrafoot.region_zoom"]), not spark.table(f"{table}_wide").isEmpty())


def stored_pairs(left: DataFrame, stored: StoredLookup, columns: list[Column], box: tuple[Column, Column, Column, Column], centres: bool = False) -> DataFrame:
    """Pairs of rows of ``left`` (boxes l_xmin, ...) and buildings whose boxes (``box``) meet, with the buildings' ``columns``.

    With ``centres`` a building counts in the tile of its centroid, else in all that its box touches. A
    tile with very many points is joined in parts, to each of which its buildings are copied.
    """
    bounds = [c.alias(f"r_{n}") for c, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)]
    spread = dealt(left.where(" AND ".join(f"l_{c} IS NOT NULL" for c in ("xmin", "ymin", "xmax", "ymax"))), "l", stored.zoom)
    tiles = materialised(spread.groupBy("tx", "ty").agg(F.count("*").alias("n")), "tiles")
    regions = tiles.select(region_of(F.col("tx"), F.col("ty"), stored.zoom, stored.region_zoom).alias("region")).distinct().limit(MOST_REGIONS + 1).collect()  # bounded
    rows = stored.tiles([r.region for r in regions] if len(regions) <= MOST_REGIONS else None)
    first = [F.col("tx").alias("r_tx"), F.col("ty").alias("r_ty")] if centres else [F.col("r_tx"), F.col("r_ty")]
    right = (rows.where("centre") if centres else rows).select("tx", "ty", *first, *columns, *bounds).hint("merge")  # never sent to the driver, however few a scan leaves
    joined = by_tile(spread, right, tiles, TILE_POINTS)
    owner = (F.col("tx") == F.greatest("l_tx", "r_tx")) & (F.col("ty") == F.greatest("l_ty", "r_ty"))
    found = [df.where(boxes_meet() & owner).drop("tx", "ty", "l_tx", "l_ty", "r_tx", "r_ty") for df in joined]
    if stored.wide:
        found.append(overlap_join(left, stored.wide_rows().select(*columns, *bounds), stored.zoom))
    return reduce(lambda a, b: a.unionByName(b), found)
