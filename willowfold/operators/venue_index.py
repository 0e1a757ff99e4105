"""Venues by bitmaps of their facets, and in the order of a space-filling curve for searches of a box."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each coordinate in the key, and the square that it divides: all longitudes and latitudes.
BITS = 16
GROUP_BYTES = 64 << 10


def numbered_facets(venues: DataFrame) -> DataFrame:
    """(number, facet, value) of each venue's prefecture and uses, and of all; number must be a venue's own, from 0."""
    base = [F.struct(F.lit("prefecture").alias("facet"), F.col("p").alias("value")), F.struct(F.lit("all").alias("facet"), F.lit("venues").alias("value"))]
    tags = F.transform(F.array_distinct(F.coalesce("u", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("use").alias("facet"), t.alias("value")))
    return venues.select("number", F.inline(F.concat(F.array(*base), tags))).where("value is not null")


def facet_bitmaps(venues: DataFrame) -> DataFrame:
    """(facet, value, bucket, bits): for every facet value a bitmap over each run of 32,768 venue numbers; built by partial bitmaps in each task."""
    rows = numbered_facets(venues)
    position = F.bitmap_bit_position("number")
    return rows.groupBy("facet", "value", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bits"))


def selected(bitmaps: DataFrame, venues: DataFrame, text: str = "", prefecture: str = "", uses: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, bits) of the venues that a selection leaves: the bitmaps of what is asked, cut with each other and with those whose text holds the text."""
    asked = [(F.col("facet") == "use") & (F.col("value") == u) for u in dict.fromkeys(uses)]
    asked += [(F.col("facet") == "prefecture") & (F.col("value") == prefecture)] if prefecture else []
    chosen = bitmaps.where(reduce(Column.__or__, asked, F.col("facet") == "all")).select("bucket", "bits")
    needed = len(asked) + 1
    if text.strip():
        found = venues.where(F.contains(F.lower(F.concat_ws(" ", "n", "p", "c", "a")), F.lit(text.strip().lower())))
        own = found.groupBy(F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        chosen, needed = chosen.unionByName(own), needed + 1
    # a bucket that lacks one of the bitmaps has no venue with it
    return chosen.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == needed).select("bucket", "bits")


def counts_under(bitmaps: DataFrame, selection: DataFrame) -> DataFrame:
    """(facet, value, n): venues of each facet value within the selection, for those that have any; every value is cut with the selection once, bucket by bucket."""
    picked = selection.select("bucket", F.col("bits").alias("_picked"))
    both = bitmaps.join(picked, "bucket").select("facet", "value", "bucket", F.explode(F.array("bits", "_picked")).alias("bits"))
    cut = both.groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return cut.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n")).where("n > 0")


def _scaled(c: Column, low: float, high: float) -> Column:
    top = (1 << BITS) - 1
    return F.least(F.greatest(F.floor((c - low) / (high - low) * (top + 1)), F.lit(0)), F.lit(top)).cast("long")


def _apart(x: Column) -> Column:
    """The bits of x with a free one between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve_key(lat: Column, lon: Column) -> Column:
    """The place of a point on the curve that takes the bits of both coordinates by turns: points of a small box lie on few pieces of it."""
    return _apart(_scaled(lat, -90.0, 90.0)).bitwiseOR(F.shiftleft(_apart(_scaled(lon, -180.0, 180.0)), 1))


def write_curve(venues: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """Venues along the curve, ranges of it to a file each, in row groups so small that their least and largest coordinates bound little."""
    rows = venues.withColumn("_key", curve_key(F.col("lat"), F.col("lon")))
    rows.repartitionByRange("_key", "n").sortWithinPartitions("_key").drop("_key").write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 512).parquet(path)


def in_box(spark: SparkSession, path: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Venues in a box, its edges included; the reader passes over files' row groups whose statistics lie outside."""
    return spark.read.parquet(path).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
