"""Venues: faceted search, counts and the box around what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def venue_search(venues: DataFrame, text: str = "", prefecture: str = "", uses: tuple[str, ...] = ()) -> DataFrame:
    """Rows that contain the text in name, prefecture, city or address, lie in the prefecture and have every use; an
    empty facet asks for nothing."""
    if text.strip():
        venues = venues.where(F.contains(F.lower(F.concat_ws(" ", "n", "p", "c", "a")), F.lit(text.strip().lower())))
    if prefecture:
        venues = venues.where(F.col("p") == prefecture)
    if uses:
        venues = venues.where(F.size(F.array_except(F.array(*map(F.lit, uses)), F.coalesce("u", F.array().cast("array<string>")))) == 0)
    return venues


def facet_counts(venues: DataFrame) -> DataFrame:
    """(facet, value, n): venues of each prefecture and use, and the totals."""
    base = [F.struct(F.lit("prefecture").alias("facet"), F.col("p").alias("value")), F.struct(F.lit("all").alias("facet"), F.lit("venues").alias("value"))]
    tags = F.transform(F.coalesce("u", F.array().cast("array<string>")), lambda t: F.struct(F.lit("use").alias("facet"), t.alias("value")))
    counts = venues.select(F.explode(F.concat(F.array(*base), tags)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
    points = venues.select("lat", "lon").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("facet"), F.lit("points").alias("value"), "n")
    regions = venues.select("p").where("p is not null").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("facet"), F.lit("prefectures").alias("value"), "n")
    return counts.unionByName(points).unionByName(regions)


def bounding_box(venues: DataFrame) -> DataFrame:
    return venues.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
