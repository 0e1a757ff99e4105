"""Stores of deliveries: folders that a scope prunes, and a log in buckets that joins and windows read without a shuffle."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from willowfold.operators.deliveries import scope_matches

FOLDERS = ("match_type", "gender", "year")


def write_store(deliveries: DataFrame, matches: DataFrame, path: str, spread: int = 16) -> None:
    """Deliveries in folders by their match's type, gender and year; matches: (match_id, match_type, gender, date).

    A folder is written by up to ``spread`` tasks, so that no year or gender is one task's.
    """
    dated = matches.select("match_id", "match_type", "gender", F.year("date").alias("year"))
    rows = deliveries.join(dated, "match_id")
    rows.repartition(*FOLDERS, F.pmod(F.xxhash64("match_id"), F.lit(spread))).write.partitionBy(*FOLDERS).parquet(path)


def read_scope(spark: SparkSession, path: str, matches: DataFrame, **scope) -> DataFrame:
    """The store's deliveries of the matches that ``scope_matches`` lets through, with their date.

    Type and gender are constants, which prune when the query is planned.  Years are those that the matches in scope have: the join asks for them, so
    the planner prunes by what the matches' side holds when it runs, if that side is small enough to be sent around.
    """
    wanted = scope_matches(matches, **scope).select("match_id", "match_type", "gender", F.year("date").alias("year"), "date")
    return spark.read.parquet(path).join(wanted, ["match_id", *FOLDERS])


def write_buckets(df: DataFrame, buckets: int, path: str, order: tuple[str, ...] = (), key: str = "match_id") -> DataFrame:
    """df in buckets by key below path, each one file sorted by key and order, read back as a table that knows its buckets.

    Tables written with the same number of buckets are joined and grouped by key without an exchange, as often as they are read.  The name
    that the catalog needs for that is let go at once; the files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid4().hex}"
    rows = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    rows.write.bucketBy(buckets, key).sortBy(key, *order).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved while the catalog has the name
    spark.sql(f"DROP TABLE {name}")
    return table
