"""Clean attributes from raw height and occupancy strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Occupancy prefixes and their groups.
GROUPS = {
    "RES": "Residential",
    "COM": "Commercial",
    "MIX": "Mixed",
    "IND": "Industrial",
    "AGR": "Agricultural",
    "ASS": "Assembly",
    "GOV": "Government",
    "EDU": "Education",
}
#: Patterns of the height string. The strict storey pattern accepts a backslash, not a
#: plus, before its tag, so storeys count only at the start; the lenient one accepts the plus.
DIRECT, RANGE = r"HHT:([0-9.]+)", r"HBET:([0-9]+)-([0-9]+)"
STOREYS, STOREYS_LENIENT = r"(^|\\+)H:([0-9]+)", r"(^|\+)H:([0-9]+)"

#: What an area, a height, an occupancy and a floorspace add to the completeness score.
WEIGHTS = (0.25, 0.30, 0.30, 0.15)


def _found(text: Column, pattern: str, group: int, kind: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast(kind)


def height_parts(height: Column, lenient_storeys: bool = False) -> dict[str, Column]:
    """The numbers in a height string: direct, exact, least and most."""
    exact = _found(height, STOREYS_LENIENT if lenient_storeys else STOREYS, 2, "int")
    return {"direct": _found(height, DIRECT, 1, "double"), "exact": exact, "least": _found(height, RANGE, 1, "int"), "most": _found(height, RANGE, 2, "int")}


def height_columns(height: Column, metres_per_storey: float = 3.0, lenient_storeys: bool = False, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """height_source_type, height_m, stories_exact, stories_min, stories_max and height_quality.

    ``parts`` are those of :func:`height_parts` where they are columns of their own already.
    """
    direct, exact, least, most = (parts or height_parts(height, lenient_storeys)).values()
    ranged = least.isNotNull() & most.isNotNull()
    pick = lambda a, b, c: F.when(direct.isNotNull(), a).when(exact.isNotNull(), b).when(ranged, c)
    return {
        "height_source_type": pick("exact_height_m", "estimated_from_exact_storeys", "estimated_from_storey_range").when(height.isNull() | (height == ""), "unknown").otherwise("other"),
        "height_m": pick(direct, exact * F.lit(metres_per_storey), (least + most) / F.lit(2.0) * metres_per_storey),
        "stories_exact": exact,
        "stories_min": least,
        "stories_max": most,
        "height_quality": pick(F.lit("high"), F.lit("medium"), F.lit("low")).otherwise("none"),
    }


def occupancy_columns(occupancy: Column) -> dict[str, Column]:
    """occupancy_code, occupancy_group and occupancy_quality."""
    upper = F.upper(occupancy)
    group = F
    for prefix, name in GROUPS.items():
        group = group.when(upper.startswith(prefix), name)
    return {
        "occupancy_code": F.coalesce(F.nullif(F.substring(upper, 1, 3), F.lit("")), F.lit("UNK")),
        "occupancy_group": group.otherwise("Unknown"),
        "occupancy_quality": F.when(occupancy.isNull() | (occupancy == ""), "none").when(F.char_length(occupancy) >= 3, "available").otherwise("low"),
    }


def floorspace_estimate(given: Column, area: Column, exact: Column, least: Column, most: Column, usable_floor_factor: float = 1.0) -> Column:
    """The given floorspace, else area times storeys, else area times the mean of the storey range."""
    return F.coalesce(given, area * exact * usable_floor_factor, area * ((least + most) / F.lit(2.0)) * usable_floor_factor)


def completeness(area: Column, height: Column, group: Column, floorspace: Column) -> Column:
    """The sum of WEIGHTS for an area, a height, a known occupancy and a floorspace."""
    part = lambda condition, weight: F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(part(area.isNotNull(), WEIGHTS[0]) + part(height.isNotNull(), WEIGHTS[1]) + part(group != "Unknown", WEIGHTS[2]) + part(floorspace.isNotNull(), WEIGHTS[3]), 2)


def with_attributes(df, height: str = "height", occupancy: str = "occupancy", floorspace: str = "floorspace_source_m2", area: str = "footprint_area_m2", metres_per_storey: float = 3.0, usable_floor_factor: float = 1.0, lenient_storeys: bool = False):
    """``df`` with all attribute columns.

    The height's numbers are columns first: each pattern is then searched once a row, and the code that
    Spark makes of the choices among them is small enough to be compiled.
    """
    parts = {f"__{k}": v for k, v in height_parts(F.col(height), lenient_storeys).items()}
    found = {k.removeprefix("__"): F.col(k) for k in parts}
    df = df.withColumns(parts).withColumns({**height_columns(F.col(height), metres_per_storey, lenient_storeys, found), **occupancy_columns(F.col(occupancy))}).drop(*parts)
    df = df.withColumn("floorspace_est_m2", floorspace_estimate(F.col(floorspace), F.col(area), F.col("stories_exact"), F.col("stories_min"), F.col("stories_max"), usable_floor_factor))
    return df.withColumn("attribute_completeness_score", completeness(F.col(area), F.col("height_m"), F.col("occupancy_group"), F.col("floorspace_est_m2")))
