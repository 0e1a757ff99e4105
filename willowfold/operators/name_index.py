"""A posting table of n-grams for searches of a part of a name, and a list in order that is read by its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from willowfold.sources.shared_dir import kept

GRAM, BUCKETS = 3, 64


def searched(*names: str) -> Column:
    """What a search looks into: the names in lower case, a blank between."""
    return F.lower(F.concat_ws(" ", *names))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_grams(players: DataFrame, text: Column, path: str, id_col: str = "player", buckets: int = BUCKETS) -> None:
    """(gram, id) of every part of one to GRAM characters of each text, in folders by the gram's hash, sorted by gram in each.

    A frequent letter is in the names of a third of all players or more; its rows are laid down once a player and dealt by player too.
    """
    texts = players.select(F.col(id_col).alias("id"), text.alias("text"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, n))))
    grams = texts.select("id", F.explode(F.array_distinct(parts)).alias("gram")).where("gram <> ''").withColumn("bucket", _bucket(F.col("gram"), buckets))
    grams.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(path)


def find(spark: SparkSession, path: str, players: DataFrame, text: Column, q: str, id_col: str = "player", buckets: int = BUCKETS) -> DataFrame:
    """Players whose text holds q, in any case: those that have every gram of q are looked at, no others.

    Only the folders of q's grams are read.  The grams of a text say nothing of their order, so what has all of them is verified.  An empty text is held by all.
    """
    q = q.strip().lower()
    if not q:
        return players
    grams = sorted({q[i : i + GRAM] for i in range(max(1, len(q) - GRAM + 1))})
    places = [r["b"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"), buckets).alias("b")).distinct().collect()]
    lists = spark.read.parquet(path)
    hits = lists.where(F.col("bucket").isin(places) & F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return players.join(hits.select(F.col("id").alias(id_col)), id_col, "left_semi").where(F.contains(text, F.lit(q)))


def write_pages(rows: DataFrame, order: list[Column], path: str, id_col: str = "player", parts: int | None = None) -> None:
    """rows in order, in folders of a range each, with a table of their counts.

    order decides between all rows with id_col behind it, which must be one row's; ranges are cut from a sample of the keys, and counts of equal keys matter no more than others.
    """
    by = [*order, F.col(id_col)]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/schema")  # an empty list has no folder that tells it
    _paged(rows.sparkSession, path).groupBy("part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def _paged(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(f"{path}/schema").schema.fields
    return spark.read.schema(StructType([*fields, StructField("part", IntegerType())])).parquet(f"{path}/rows")


def page(spark: SparkSession, path: str, order: list[Column], offset: int, limit: int, id_col: str = "player") -> DataFrame:
    """Rows offset + 1 to offset + limit of the order, with the total; only the folders that hold them are read and sorted.

    What reaches the driver is a count for each folder, of which there are as many as shuffle partitions.
    """
    counts = spark.read.schema("part int, n long").parquet(f"{path}/counts").orderBy("part").collect()
    before, wanted, skip = 0, [], 0
    for r in counts:
        if before < offset + limit and before + r["n"] > offset:
            skip = skip if wanted else offset - before
            wanted.append(r["part"])
        before += r["n"]
    rows = _paged(spark, path).where(F.col("part").isin(wanted) if wanted else F.lit(False))
    return rows.orderBy("part", *order, id_col).offset(skip).limit(limit).drop("part").withColumn("total", F.lit(before).cast("long"))


def listed(rated: DataFrame, x: str = "raw_x_pct", y: str = "raw_y_pct") -> DataFrame:
    """The rows of a directory: eligible or focus players with both scores."""
    return kept(rated.where((F.col("eligible") | F.col("is_focus")) & F.col(x).isNotNull() & F.col(y).isNotNull()), "listed")


def directory_order(score: str = "raw_overall") -> list[Column]:
    return [F.desc("is_focus"), F.desc("eligible"), F.desc_nulls_last(score)]
