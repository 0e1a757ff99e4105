"""Cells kept up to date by match: adds, corrections and removals read what is new only, and totals fold what is kept.

Cells are sums, so those of different matches add up, and a match is the unit that changes.  Every load writes the cells of its matches, and a list of
the matches that it replaces or removes, into folders of its own number; the last load that names a match tells what it counts.  Nothing written is changed, so a
load that failed is written again under its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(deliveries: DataFrame, cells: Callable[[DataFrame], DataFrame], path: str, number: int, removed: DataFrame | None = None) -> None:
    """Write load ``number``: cells of new or corrected matches, whole, and the match_id of removed ones; an earlier attempt of it is overwritten."""
    cells(deliveries).write.mode("overwrite").parquet(f"{path}/cells/load={number}")
    named = deliveries.select("match_id").distinct().withColumn("gone", F.lit(False))
    if removed is not None:
        gone = removed.select("match_id").distinct().withColumn("gone", F.lit(True))
        named = gone.unionByName(named).groupBy("match_id").agg(F.bool_and("gone").alias("gone"))  # removed and given in one load: replaced
    named.write.mode("overwrite").parquet(f"{path}/matches/load={number}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The cells that count now.  The list of matches, a row for each match and load, meets the cells by match; cells of loads that nothing counts of are not read."""
    last = spark.read.option("basePath", f"{path}/matches").parquet(f"{path}/matches").groupBy("match_id").agg(F.max(F.struct("load", "gone")).alias("last"))
    counted = last.where("not last.gone").select("match_id", F.col("last.load").alias("load"))
    cells = spark.read.option("basePath", f"{path}/cells").parquet(f"{path}/cells")
    return cells.join(counted, ["match_id", "load"]).drop("load")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """What counts now as the first load of a new store."""
    current(spark, path).write.parquet(f"{to}/cells/load=0")
    spark.read.parquet(f"{to}/cells/load=0").select("match_id").distinct().withColumn("gone", F.lit(False)).write.parquet(f"{to}/matches/load=0")
