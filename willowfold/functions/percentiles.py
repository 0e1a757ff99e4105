"""Mid-rank percentiles against a reference population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midrank(df: DataFrame, value: str, member: str, keys: list[str], name: str, inverse: bool = False) -> DataFrame:
    """Add ``name``: where value stands among the members (a boolean column) of equal keys, 0 to 100.

    Members count themselves: 100 * (worse + max(0, equal - 1) / 2) / (members - 1), clamped.  A row outside is
    placed by the same formula, with equal the members that share its value.  One member gives 50; a null value or
    no member gives null.  Values are counted first, and rows fetch their place by an
    equi-join; no row meets another.
    """
    places = _places(df.where(F.col(value).isNotNull()), value, member, keys, F.lit(inverse)).withColumnRenamed("_place", name)
    return df.join(places, [*keys, value], "left").select(*df.columns, name)


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises; values less than a thousandth apart (near 0; relative to their size beyond 1) may share one."""
    value = value.cast("double")
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(value) * F.log1p(F.abs(value)) * 1024))


def _places(rows: DataFrame, value: str, member: str, keys: list[str], inverse: Column) -> DataFrame:
    """(keys, value, _place) of every distinct value.

    Distinct values are counted and summed within buckets; only the sums of the buckets, a row for each, meet for the members before a
    bucket, so no task holds all values of a metric.
    """
    counts = rows.groupBy(*keys, value).agg(F.count_if(F.col(member)).alias("_equal")).withColumn("_bucket", _bucket(F.col(value)))
    sums = counts.groupBy(*keys, "_bucket").agg(F.sum("_equal").alias("_sum"))
    whole = Window.partitionBy(*keys)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_sum").over(whole)})
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_within", F.coalesce(F.sum("_equal").over(within), F.lit(0)))
    counts = counts.join(sums, [*keys, "_bucket"]).withColumn("_less", F.col("_before") + F.col("_within"))
    worse = F.when(inverse, F.col("_n") - F.col("_less") - F.col("_equal")).otherwise(F.col("_less"))
    raw = 100 * (worse + F.greatest(F.lit(0), F.col("_equal") - 1) / 2) / (F.col("_n") - 1)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return counts.select(*keys, value, F.when(F.col("_n") == 1, 50.0).when(F.col("_n") > 1, clamped).alias("_place"))


def midranks(df: DataFrame, specs: dict[str, tuple[str, bool]], member: str, keys: list[str], id_col: str) -> DataFrame:
    """midrank for several values at once: specs maps each new column to its value and whether less is better.

    The values are laid under each other, so all metrics share one count, one window and one join.
    """
    each = [F.struct(F.lit(name).alias("_metric"), F.col(value).cast("double").alias("_value")) for name, (value, _) in specs.items()]
    long = df.select(*keys, id_col, F.col(member).alias("_member"), F.inline(F.array(*each))).where("_value is not null")
    inverse = F.col("_metric").isin([name for name, (_, less) in specs.items() if less])
    places = _places(long, "_value", "_member", ["_metric", *keys], inverse)
    placed = long.join(places, ["_metric", *keys, "_value"])
    wide = placed.groupBy(*keys, id_col).agg(*[F.max(F.when(F.col("_metric") == name, F.col("_place"))).alias(name) for name in specs])
    return df.join(wide, [*keys, id_col], "left").select(*df.columns, *specs)
