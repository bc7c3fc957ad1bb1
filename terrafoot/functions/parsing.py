"""Guarded parsing of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_double(value: Column) -> Column:
    """The number a text spells, else null: no type suffixes, digit separators, NaN or infinity."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def coordinate_valid(lon: Column, lat: Column) -> Column:
    """True for longitudes in -180..180 with latitudes in -90..90; false otherwise, never null."""
    return F.coalesce(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0), F.lit(False))


def json_safe(value: Column) -> Column:
    """A double without NaN or infinity, for JSON."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
