"""Outcome tables of batting kind against bowling kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a ball may end in.
RESULTS = ("0", "1", "2", "4", "6", "W")


def outcome_matrix(df: DataFrame, batting: str, bowling: str, result: str = "result") -> DataFrame:
    """Percent of each result, a column each, for every pair of kinds."""
    counts = df.groupBy(F.col(batting).alias("batting"), F.col(bowling).alias("bowling")).pivot(result, list(RESULTS)).count()
    counts = counts.fillna(0, list(RESULTS))
    total = sum((F.col(r) for r in RESULTS[1:]), F.col(RESULTS[0]))
    return counts.select("batting", "bowling", total.alias("n"), *[F.when(total > 0, 100 * F.col(r) / total).alias(f"pct_{r.lower()}") for r in RESULTS])


def expected_runs(matrix: DataFrame) -> DataFrame:
    """Runs a ball of each pair; a wicket counts none."""
    runs = sum((int(r) * F.col(f"pct_{r}") for r in RESULTS if r not in ("0", "W")), F.lit(0.0))
    return matrix.withColumn("expected_runs", runs / 100)


def matchup_summary(matrix: DataFrame) -> DataFrame:
    """For each batting kind the unweighted means over bowling kinds of expected runs, boundary and wicket percent."""
    rows = expected_runs(matrix).withColumn("boundary", F.col("pct_4") + F.col("pct_6"))
    return rows.groupBy("batting").agg(F.avg("expected_runs").alias("expected_runs"), F.avg("boundary").alias("boundary_pct"), F.avg("pct_w").alias("wicket_pct"))


def validate_distribution(weights: DataFrame, batting: list[str], bowling: list[str]) -> DataFrame:
    """(batting, bowling, problems) of every pair of the domain whose weights are missing, miskeyed, no numbers or negative, or do not sum to 100.

    The domain is the product of two given lists, as large as a table of rules.  A weight that is null, not finite or below zero is a "weight"
    problem; what is no number counts 0 in the total.
    """
    spark = weights.sparkSession
    domain = spark.createDataFrame([(a, b) for a in batting for b in bowling], "batting string, bowling string")
    value = F.col("weight").cast("double")
    bad = F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0), F.lit(True))
    counted = F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)
    own = weights.groupBy("batting", "bowling").agg(F.collect_set("result").alias("keys"), F.sum(counted).alias("total"), F.bool_or(bad).alias("bad"))
    df = domain.join(own, ["batting", "bowling"], "left")
    keys = F.sort_array("keys") != F.array(*[F.lit(r) for r in RESULTS])
    there = F.col("keys").isNotNull()
    off = F.isnan("total") | (F.abs(F.col("total") - 100) > 1e-9)
    problems = F.array_compact(F.array(F.when(~there, "missing"), F.when(there & keys, "keys"), F.when(F.col("bad"), "weight"), F.when(there & off, "total")))
    return df.select("batting", "bowling", problems.alias("problems")).where(F.size("problems") > 0)
