"""Helpers that several corpus operators use: shared storage, ranks, components, row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from willowfold.sources.shared_dir import discard
from willowfold.sources.shared_dir import kept as stash

#: Keys below this count are sent to every executor (16 MB of 8-byte keys); above it the join is shuffled.
BROADCAST_KEYS = 2_000_000


def small_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, since one text may be many times the mean; a batch always holds one row.

    Both bounds are the session's: Spark reads them when a plan runs, which is after an operator has returned it.  Smaller ones stay as they are.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def hinted(keys: DataFrame, count: int) -> DataFrame:
    """Broadcast keys only if their counted number is below BROADCAST_KEYS."""
    return F.broadcast(keys) if count <= BROADCAST_KEYS else keys


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs, written once, and the name of a key of its own for every row: (no id, id, row number), so that the least key has the least id.

    Row numbers are given where the rows are written and read back with them; a lost task cannot change them.
    """
    row, key = free_name(docs.columns, "_row"), free_name(docs.columns, "_key")
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    return rows.select(*docs.columns, F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias(key)), key


def without_rows(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Keyed docs less the rows whose key is in dropped (doc_id), without the key."""
    row = free_name(docs.columns, "_row")
    dropped = stash(dropped.select(F.col("doc_id.row").alias(row)), "dropped")  # read twice, once to be counted
    rows = docs.withColumn(row, F.col(f"{key}.row"))
    return rows.join(hinted(dropped, dropped.count()), row, "left_anti").select(*[c for c in docs.columns if c != key])


def numbered(df: DataFrame, keys: list[str], name: str, label: str = "numbered") -> DataFrame:
    """df, written to the shared folder, with ``name``: 0, 1, ... within equal keys, in the order of the partitions and in them.

    In each partition rows of equal keys must follow each other.  They are numbered by their row, less the first one's, plus the
    counts of the partitions before; only those counts meet, a row for each (partition, key).  keys must not be null.
    """
    columns = df.columns
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stash(placed, label)
    runs = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stash(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "runs")
    return placed.join(hinted(runs, runs.count()), ["_part", *keys]).select(*columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... within equal keys by order, without a task that holds a whole key or a whole run of ties.

    For narrow rows: they are written with a row number, which breaks ties, so that a run of equal rows is dealt out like any other.
    """
    tied = stash(df.withColumn("_tie", F.monotonically_increasing_id()), "unranked")
    by = [*keys, *order, "_tie"]
    return numbered(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"), keys, name, "ranked")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node reachable from it.

    Alternates large-star and small-star steps (Kiveris et al., 2014) over tables in the shared
    folder until the links no longer change.  Only three numbers a step reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stash(edges, "links")
    seen = _signature(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, last = stash(large, "large"), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = _signature(edges)
        discard(last, large)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
