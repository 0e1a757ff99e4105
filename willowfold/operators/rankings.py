"""Team ratings and rank histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Matches a team needs in three years to be listed, by the date from which the rule holds.
MIN_MATCHES = (("0001-01-01", 6), ("2026-01-01", 8))


def _years_before(as_of: Column, years: int) -> Column:
    return F.add_months(as_of, -12 * years)


def period_start(as_of: Column, years: int, update_month: int | None = None) -> Column:
    """The last day before the period of so many years: rolling up to as_of, or whole years of the annual update in a month.

    With the update in May, from May 2026 on results since May 2025 are the last year and the two years before are the rest.
    """
    if update_month is None:
        return _years_before(as_of, years)
    updated = F.make_date(F.year(as_of) - F.when(F.month(as_of) < update_month, 1).otherwise(0), F.lit(update_month), F.lit(1))
    return F.date_sub(_years_before(updated, years), 1)


def team_rating(results: DataFrame, dates: DataFrame, update_month: int | None = None) -> DataFrame:
    """(gender, team, as_of, matches, rating): points a match, the last year in full and the two before by half.

    The three years roll with as_of, our reading where none is given; with update_month they are those of the annual update, and results since then
    count in full.  A result is dealt only to the dates within four years after it, so nothing meets dates it does not count for: both
    sides are keyed by year and joined on the year and those after.
    """
    rows = results.withColumn("_year", F.explode(F.sequence(F.year("date"), F.year("date") + (3 if update_month is None else 4))))
    on_year = dates.select("as_of").distinct().withColumn("_year", F.year("as_of"))
    start = lambda years: period_start(F.col("as_of"), years, update_month)
    rows = rows.join(on_year, "_year").where((F.col("date") <= F.col("as_of")) & (F.col("date") > start(3)))
    # doubled weights, 2 and 1, so that all sums are whole
    weight = F.when(F.col("date") > start(1), 2).otherwise(1)
    own = rows.groupBy("gender", "team", "as_of").agg(F.count(F.lit(1)).alias("matches"), F.sum(weight * F.col("points")).alias("p"), F.sum(weight).alias("w"))
    return own.select("gender", "team", "as_of", "matches", F.floor(F.col("p") / F.col("w") + F.lit(0.5)).cast("long").alias("rating"))


def published(rated: DataFrame, rules: tuple[tuple[str, int], ...] = MIN_MATCHES) -> DataFrame:
    """Teams with enough matches for the rule that holds at the date."""
    least = F.lit(None).cast("int")
    for start, n in rules:
        least = F.when(F.col("as_of") >= F.lit(start).cast("date"), F.lit(n)).otherwise(least)
    return rated.where(F.col("matches") >= least)


def team_rank(rated: DataFrame) -> DataFrame:
    """Add rank: by rating within gender and date; equal ratings share a rank."""
    return rated.withColumn("rank", F.rank().over(Window.partitionBy("gender", "as_of").orderBy(F.desc("rating"))))


def rolling_matches(results: DataFrame, days: int = 3 * 365) -> DataFrame:
    """Matches of a team in the days up to each date on which it played, counted from one row a day."""
    daily = results.groupBy("gender", "team", "date").agg(F.count(F.lit(1)).alias("n"))
    daily = daily.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    window = Window.partitionBy("gender", "team").orderBy("_day").rangeBetween(-days + 1, 0)
    return daily.select("gender", "team", "date", F.sum("n").over(window).alias("rolling"))


def rank_as_of(history: DataFrame, dates: list[str]) -> DataFrame:
    """(gender, team, as_of, rank, since): the last entry on or before each date; null rank before the first and while
    an entry with a null rank says the team is unlisted.  Entries and dates are put in one order, so no pair of them is made."""
    asked = history.select("gender", "team").distinct().withColumn("date", F.explode(F.array(*[F.lit(d).cast("date") for d in sorted(set(dates))])))
    entries = history.select("gender", "team", "date", F.struct("rank", F.col("date").alias("since")).alias("entry"), F.lit(0).alias("_asked"))
    both = entries.unionByName(asked.withColumns({"entry": F.lit(None).cast("struct<rank:int,since:date>"), "_asked": F.lit(1)}))
    window = Window.partitionBy("gender", "team").orderBy("date", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("last", F.last("entry", ignorenulls=True).over(window))
    return both.where("_asked = 1").select("gender", "team", F.col("date").alias("as_of"), F.col("last.rank").alias("rank"), F.col("last.since").alias("since"))


def rank_change(history: DataFrame) -> DataFrame:
    """Each entry with the change from the ranked entry before and the days since it, the gain since the first rank, and the days off the list before it.

    An entry with a null rank says that the team is off the list from then on; the next entry with a rank ends that.
    """
    order = Window.partitionBy("gender", "team").orderBy("date")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.last(F.when(F.col("rank").isNotNull(), F.col(c)), ignorenulls=True).over(past)
    first = F.first("rank", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the first unranked entry after the last ranked one
    unranked = F.lag(F.col("rank").isNull()).over(order)
    left = F.when(F.col("rank").isNull() & ~F.coalesce(unranked, F.lit(False)), F.col("date"))
    df = history.withColumns({"_left": left, "_unranked": F.coalesce(unranked, F.lit(False))})
    off = F.when(F.col("rank").isNotNull(), F.when(F.col("_unranked"), F.datediff("date", F.last("_left", ignorenulls=True).over(past))).otherwise(0))
    return df.select("gender", "team", "date", "rank", (before("rank") - F.col("rank")).alias("step"), F.datediff("date", before("date")).alias("days_since"), (first - F.col("rank")).alias("gained"), off.cast("int").alias("days_off"))


def rank_men_women(ranks: DataFrame) -> DataFrame:
    """(team, men, women): full outer join of both lists; a team may be in one only."""
    side = lambda g, name: ranks.where(F.col("gender") == g).select("team", F.col("rank").alias(name))
    return side("men", "men").join(side("women", "women"), "team", "full")


def top_teams(both: DataFrame, k: int = 10, focus: str | None = None) -> DataFrame:
    """Teams in either top k, in the order of their rank sum with a missing rank last; the focus team is pinned last."""
    is_focus = F.lit(False) if focus is None else F.col("team") == focus
    kept = both.where((F.col("men") <= k) | (F.col("women") <= k) | is_focus)
    order = Window.orderBy(is_focus.cast("int"), F.asc_nulls_last(F.col("men") + F.col("women")), F.coalesce("men", "women"), "team")  # at most 2k + 1 rows
    return kept.withColumn("position", F.row_number().over(order))


def stack_genders(men: DataFrame, women: DataFrame) -> DataFrame:
    """Both histories with a gender column; a column that one lacks is null there."""
    return men.withColumn("gender", F.lit("men")).unionByName(women.withColumn("gender", F.lit("women")), allowMissingColumns=True)
