"""The tile join: overlap of boxes as an equi-join on web-map tiles.

A theta join on box bounds would compare every pair. Both sides are dealt to the tiles that their
boxes touch; a pair that meets in several tiles counts only in the greatest of the two boxes' first
tiles, so no ``distinct`` is needed. Boxes that would touch very many tiles join on coarse tiles.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.functions.geometry import Shapes, parsed
from terrafoot.functions.tiles import tile_x, tile_y
from terrafoot.operators.boundary import Prepared
from terrafoot.operators.cells import clip_by_cells
from terrafoot.operators.overlay import union, union_parts
from terrafoot.session import materialised

ZOOM, COARSER, MOST_TILES = 16, 8, 256
#: Rows of a tile that one task joins.
TILE_POINTS = 100_000
BOX = ("xmin", "ymin", "xmax", "ymax")


def _first_and_last(side: str, zoom: int) -> tuple[Column, Column, Column, Column]:
    at = lambda c: F.col(f"{side}_{c}")
    return tile_x(at("xmin"), zoom), tile_y(at("ymax"), zoom), tile_x(at("xmax"), zoom), tile_y(at("ymin"), zoom)


def dealt(df: DataFrame, side: str, zoom: int) -> DataFrame:
    """One row for each tile (tx, ty) that a row's box touches, with the box's first tile."""
    x0, y0, x1, y1 = _first_and_last(side, zoom)
    df = df.withColumns({f"{side}_tx": x0, f"{side}_ty": y0})
    return df.withColumn("tx", F.explode(F.sequence(x0, x1))).withColumn("ty", F.explode(F.sequence(y0, y1)))


def boxes_meet() -> Column:
    return (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("l_xmax") >= F.col("r_xmin")) & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("l_ymax") >= F.col("r_ymin"))


def overlap_join(left: DataFrame, right: DataFrame, zoom: int = ZOOM, coarser: int = COARSER, most_tiles: int = MOST_TILES, left_fits: bool = False) -> DataFrame:
    """Pairs of rows whose closed boxes meet.

    Boxes are the columns l_xmin, l_ymin, l_xmax, l_ymax of ``left`` and r_... of ``right``. Rows
    with a null bound match nothing. Boxes that touch more than ``most_tiles`` tiles are joined
    ``coarser`` levels up instead, where there are any: coarse tiles hold many rows. ``left_fits`` says
    that the left side holds none of them. Each side is read several times, so both should be tables,
    not long plans.
    """
    has = lambda side: reduce(Column.__and__, [F.col(f"{side}_{c}").isNotNull() for c in BOX])

    def large(side):
        x0, y0, x1, y1 = _first_and_last(side, zoom)
        return (x1 - x0 + 1) * (y1 - y0 + 1) > most_tiles

    left, right = left.where(has("l")), right.where(has("r"))
    owner = (F.col("tx") == F.greatest("l_tx", "r_tx")) & (F.col("ty") == F.greatest("l_ty", "r_ty"))

    def pairs(l_rows, r_rows, z):
        joined = by_tile(dealt(l_rows, "l", z), dealt(r_rows, "r", z))
        return [df.where(boxes_meet() & owner) for df in joined]

    top = max(0, zoom - coarser)
    wide = right.where(large("r"))
    found = pairs(left if left_fits else left.where(~large("l")), right.where(~large("r")), zoom)
    if not wide.isEmpty():
        found += pairs(left, wide, top)
    if not left_fits and not (wide := left.where(large("l"))).isEmpty():
        found += pairs(wide, right.where(~large("r")), top)
    return reduce(DataFrame.unionAll, found).drop("tx", "ty", "l_tx", "l_ty", "r_tx", "r_ty")


def by_tile(left: DataFrame, right: DataFrame, tiles: DataFrame | None = None, most: int = TILE_POINTS) -> list[DataFrame]:
    """Frames whose rows are those of the join of ``left`` (with l_xmin, ...) and ``right`` on (tx, ty).

    A tile with more than ``most`` rows of ``left`` is joined in parts, to each of which its right rows are
    copied; ``tiles`` are the counts (tx, ty, n), if they are known.
    """
    tiles = materialised(left.groupBy("tx", "ty").agg(F.count("*").alias("n")), "tiles") if tiles is None else tiles
    hot = tiles.where(F.col("n") > most).select("tx", "ty", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    if hot.isEmpty():
        return [left.join(right, ["tx", "ty"])]
    split = left.join(hot, ["tx", "ty"], "left")
    calm = split.where("parts IS NULL").drop("parts").join(right, ["tx", "ty"])
    salted = split.where("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("l_xmin", "l_ymin"), F.col("parts")).cast("int")).drop("parts")
    copies = right.join(hot, ["tx", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return [calm, salted.join(copies, ["tx", "ty", "part"]).drop("part").select(*calm.columns)]


def window_zoom(radius: float, deepest: int = ZOOM) -> int:
    """The deepest zoom at which a window of ``radius`` metres covers a few tiles only, cosine floor included."""
    degrees = 2 * radius / (111_320.0 * 0.2)
    return max(1, min(deepest, int(math.log2(360.0 / degrees)) + 1)) if degrees > 0 else deepest


#: Bytes of a boundary that is sent to every task.
MOST_BYTES = 16 << 20


def small_boundary(boundary: DataFrame, most_bytes: int = MOST_BYTES) -> Broadcast | None:
    """The boundary's shapes for every task, or None if they take more than ``most_bytes``: their size is summed first."""
    total = boundary.agg(F.sum(F.octet_length("geom_wkb"))).first()[0] or 0
    if total > most_bytes:
        return None
    return boundary.sparkSession.sparkContext.broadcast([bytes(r[0]) for r in boundary.select("geom_wkb").where("geom_wkb IS NOT NULL").collect()])


def prepared(sent: Broadcast):
    """A function that prepares the boundary at its first call in a task and gives the same object from then on."""
    held: list[Prepared] = []

    def get() -> Prepared:
        if not held:
            held.append(Prepared([p[1] for p in map(parsed, sent.value) if p]))
        return held[0]

    return get


def clip(buildings: DataFrame, boundary: DataFrame, wkb: str = "geom_wkb", box: tuple[str, str, str, str] = tuple(f"bbox_{c}" for c in BOX), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Buildings that meet a boundary feature, each once: a semi-join with the features, not their union.

    A boundary of at most ``most_bytes`` is sent to every task; a larger one is cut into cells, see
    :func:`terrafoot.operators.cells.clip_by_cells`. Shapes that are null, damaged or empty meet nothing.
    """
    if (sent := small_boundary(boundary, most_bytes)) is None:
        return clip_by_cells(buildings, boundary, wkb, box)
    area = prepared(sent)

    @F.arrow_udf("boolean")
    def meets(shape: pa.Array) -> pa.Array:
        return pa.array(area().meets(Shapes(shape)))

    return buildings.where(meets(wkb))


def dissolved(boundary: DataFrame, group: str | None = None) -> DataFrame:
    """One row (per ``group``) with geom_wkb, the union of its features' polygons, and srid (4326); see :func:`terrafoot.operators.overlay.union`."""
    return union(boundary, group)


def dissolved_parts(boundary: DataFrame, group: str | None = None) -> DataFrame:
    """The same union in parts of bounded size, as many rows as there are, for groups of any size; see :func:`terrafoot.operators.overlay.union_parts`."""
    return union_parts(boundary, group)
