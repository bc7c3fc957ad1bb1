"""Web-map tiles and quadkeys as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: latitude at which the square web map ends.
MAX_LATITUDE = 85.05112878


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180.0) / 360.0 * n))).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    across = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(across * n))).cast("long")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """One digit for each level, from the top: the x bit plus twice the y bit."""
    digits = [(F.shiftright(x, level).bitwiseAND(1) + 2 * F.shiftright(y, level).bitwiseAND(1)).cast("string") for level in range(zoom - 1, -1, -1)]
    return F.concat(*digits) if digits else F.lit("")


def tile_cover(df: DataFrame, zoom: int, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """One row for each tile that a box touches: adds tx, ty and quadkey."""
    xs = F.sequence(tile_x(F.col(xmin), zoom), tile_x(F.col(xmax), zoom))
    ys = F.sequence(tile_y(F.col(ymax), zoom), tile_y(F.col(ymin), zoom))
    rows = df.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))
    return rows.withColumn("quadkey", quadkey(F.col("tx"), F.col("ty"), zoom))


def quadkeys_of_box(xmin: float, ymin: float, xmax: float, ymax: float, zoom: int = 6) -> list[str]:
    """The sorted quadkeys that cover one box, for choosing source files."""
    n = 1 << zoom

    def clamp(v: float) -> int:
        return max(0, min(n - 1, int(v)))

    def y_of(lat: float) -> int:
        phi = math.radians(max(-MAX_LATITUDE, min(MAX_LATITUDE, lat)))
        return clamp((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n)

    xs = range(clamp((xmin + 180) / 360 * n), clamp((xmax + 180) / 360 * n) + 1)
    ys = range(y_of(ymax), y_of(ymin) + 1)
    return sorted("".join(str((x >> i & 1) + 2 * (y >> i & 1)) for i in range(zoom - 1, -1, -1)) for x in xs for y in ys)
