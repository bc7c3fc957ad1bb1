"""Candidate places from stored geocoder responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafoot.functions.parsing import safe_double

NOMINATIM = "array<struct<display_name:string,lat:string,lon:string,type:string>>"
PHOTON = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<name:string,street:string,city:string,county:string,state:string,country:string,osm_value:string>>>>"
MOST = 5


def geocode_candidates(responses: DataFrame, most: int = MOST, shortest: int = 3) -> DataFrame:
    """query, rank, label, lon, lat, type, provider from rows (query, provider, response).

    Queries are folded (trimmed, lower case) and asked once per provider; those shorter than
    ``shortest`` are left out. A query takes Photon's places only if Nominatim has none.
    """
    rows = responses.withColumn("query", F.lower(F.trim("query"))).where(F.char_length("query") >= shortest)
    rows = rows.groupBy("query", "provider").agg(F.min("response").alias("response"))
    first = rows.where(F.col("provider") == "Nominatim").select("query", F.posexplode(F.from_json("response", NOMINATIM)).alias("at", "item"))
    first = first.select("query", "at", F.col("item.display_name").alias("label"), safe_double(F.col("item.lon")).alias("lon"), safe_double(F.col("item.lat")).alias("lat"), F.col("item.type").alias("type"), F.lit("Nominatim").alias("provider"))
    first = first.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.col("label") != ""))
    second = rows.where(F.col("provider") == "Photon").select("query", F.posexplode(F.from_json("response", PHOTON)["features"]).alias("at", "item"))
    filled = lambda name: F.nullif(F.col(f"item.properties.{name}"), F.lit(""))
    label = F.concat_ws(", ", filled("name"), filled("street"), F.coalesce(filled("city"), filled("county")), filled("state"), filled("country"))
    place = F.col("item.geometry.coordinates")
    second = second.where(F.size(place) >= 2).select("query", "at", label.alias("label"), place[0].alias("lon"), place[1].alias("lat"), F.col("item.properties.osm_value").alias("type"), F.lit("Photon").alias("provider")).where(F.col("label") != "")
    second = second.join(first.select("query").distinct(), "query", "left_anti")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("at"))
    return first.unionByName(second).withColumn("rank", rank).where(F.col("rank") <= most).select("query", "rank", "label", "lon", "lat", "type", "provider")
