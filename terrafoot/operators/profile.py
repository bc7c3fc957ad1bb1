"""Profiles, distributions and match summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.functions.geometry import kind_and_validity
from terrafoot.session import materialised

NEAREST = ("nearest_polygon", "nearest_centroid")


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def _facts() -> list[Column]:
    return [
        F.count("*").alias("total_buildings"),
        F.min("footprint_area_m2").alias("min_area_m2"),
        F.avg("footprint_area_m2").alias("avg_area_m2"),
        F.max("footprint_area_m2").alias("max_area_m2"),
        _share(F.col("occupancy_group") == "Unknown").alias("unknown_occupancy_share"),
        _share(F.col("height_m").isNull()).alias("missing_height_share"),
        _share(F.col("floorspace_est_m2").isNull()).alias("missing_floorspace_share"),
        F.avg("attribute_completeness_score").alias("avg_attribute_completeness_score"),
    ]


def profile_summary(clean: DataFrame) -> DataFrame:
    """One row: counts, area range, shares of unknown attributes and mean completeness."""
    return clean.agg(*_facts())


#: The distributions of a profile by the name of their file.
DISTRIBUTIONS = {"occupancy": "occupancy_group", "height_source": "height_source_type", "source": "source"}


def profile_sets(clean: DataFrame) -> DataFrame:
    """The summary's facts of all rows and of each value of the distributions' keys, by one scan and one shuffle.

    ``part`` is ``summary`` or a distribution's name, the keys are null but for that distribution's
    own. An empty table has no rows.
    """
    of = {name: f"__{key}" for name, key in DISTRIBUTIONS.items()}  # the facts read a key's values in every set
    rows = clean.withColumns({of[name]: F.col(key) for name, key in DISTRIBUTIONS.items()})
    sets = rows.groupingSets([[F.col(c)] for c in of.values()] + [[]], *of.values()).agg(*[F.grouping(c).alias(f"{c}_out") for c in of.values()], *_facts())
    part = F.coalesce(*[F.when(F.col(f"{c}_out") == 0, name) for name, c in of.items()], F.lit("summary"))
    return sets.select(part.alias("part"), *[F.col(of[name]).alias(key) for name, key in DISTRIBUTIONS.items()], *[c for c in sets.columns if not c.startswith("__")])


def _with_total(counts: DataFrame, column: str) -> DataFrame:
    """``counts``, written down, with the sum of a column as __total: the input behind it is read once."""
    counts = materialised(counts, "counts").withColumn("__one", F.lit(1))
    return counts.join(F.broadcast(counts.groupBy("__one").agg(F.sum(column).alias("__total"))), "__one").drop("__one")  # one row


def distribution(df: DataFrame, key: str) -> DataFrame:
    """key, building_count and share of all rows, most frequent first."""
    counts = df.groupBy(key).agg(F.count("*").alias("building_count"))
    return _with_total(counts, "building_count").select(key, "building_count", (F.col("building_count") / F.col("__total")).alias("share")).orderBy(F.desc("building_count"), F.col(key).asc_nulls_last())


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """name and count of a column's values, without null and empty ones, most frequent first."""
    rows = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")


def match_summary(enriched: DataFrame) -> DataFrame:
    """One row of match counts and the mean distance of nearest matches, null without any."""
    kind = F.col("building_match_type")
    return enriched.agg(
        F.count("*").alias("total_rows"),
        F.count_if("coordinate_valid").alias("valid_coordinate_rows"),
        F.count_if(kind == "inside_polygon").alias("inside_polygon_matches"),
        F.count_if(kind.isin(*NEAREST)).alias("nearest_matches"),
        F.count_if(kind == "none").alias("no_matches"),
        F.avg(F.when(kind.isin(*NEAREST), F.col("building_distance_m"))).alias("average_nearest_distance_m"),
    )


def merged_summaries(parts: DataFrame) -> DataFrame:
    """One summary of several: counts add up, the mean is weighted by the nearest matches."""
    sums = [F.sum(c).alias(c) for c in ("total_rows", "valid_coordinate_rows", "inside_polygon_matches", "nearest_matches", "no_matches")]
    mean = F.sum(F.col("average_nearest_distance_m") * F.col("nearest_matches")) / F.nullif(F.sum("nearest_matches"), F.lit(0))
    return parts.agg(*sums, mean.alias("average_nearest_distance_m"))


def shares(summary: DataFrame) -> DataFrame:
    """metric, count and share (percent of total rows, one decimal, 0 when empty) of a match summary."""
    metrics = ["total_rows", "valid_coordinate_rows", "inside_polygon_matches", "nearest_matches", "no_matches"]
    rows = summary.select("total_rows", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("count")) for m in metrics])).alias("m"))
    return rows.select("m.metric", "m.count", F.when(F.col("total_rows") > 0, F.round(100.0 * F.col("m.count") / F.col("total_rows"), 1)).otherwise(0.0).alias("share"))


def distribution_shares(df: DataFrame, column: str) -> DataFrame:
    """name, count and share (percent of the listed values, one decimal)."""
    return _with_total(value_distribution(df, column), "count").select("name", "count", F.round(100.0 * F.col("count") / F.col("__total"), 1).alias("share"))


def schema_profile(df: DataFrame) -> DataFrame:
    """column_name, column_type and null_count of each column, in one pass."""
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.col(f"n{i}").alias("null_count")) for i, (c, t) in enumerate(df.dtypes)]
    return nulls.select(F.explode(F.array(*rows)).alias("r")).select("r.*").orderBy("place").drop("place")


def geometry_check(shapes: DataFrame, wkb: str = "geom_wkb") -> DataFrame:
    """geom_type, is_valid and row count over a geometry table."""
    rows = shapes.select(kind_and_validity(wkb).alias("shape")).select("shape.*")
    return rows.groupBy("geom_type", "is_valid").agg(F.count("*").alias("row_count"))


def write_profile(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """summary (JSON) and the three distributions (CSV with header) below ``path``; ``clean`` is read once."""
    sets = materialised(profile_sets(clean), "profile")
    summary = profile_summary(clean.limit(0)) if sets.isEmpty() else sets.where("part = 'summary'").drop("part", *DISTRIBUTIONS.values())
    total = float(summary.first()["total_buildings"])
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")
    for name, key in DISTRIBUTIONS.items():
        own = sets.where(F.col("part") == name).select(key, F.col("total_buildings").alias("building_count"), (F.col("total_buildings") / total).alias("share"))
        own.orderBy(F.desc("building_count"), F.col(key).asc_nulls_last()).coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/{name}_distribution")
