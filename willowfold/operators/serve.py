"""What readers of ratings ask for: lists, searches, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from willowfold.sources.shared_dir import kept

#: Fixed value: how the focus country may be written.
FOCUS_PATTERN = "japan|日本"


def plottable(rated: DataFrame, x: str = "raw_x_pct", y: str = "raw_y_pct") -> DataFrame:
    """Observed players with both scores that are eligible or of the focus team."""
    observed = (F.col("innings") > 0) & (F.col("balls") > 0)
    return rated.where(observed & F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col("eligible") | F.col("is_focus")))


def focus_only(players: DataFrame, pattern: str) -> DataFrame:
    """Players of the focus country, by flag or by the country's name."""
    return players.where(F.coalesce(F.col("is_focus"), F.lit(False)) | F.coalesce(F.lower("country").rlike(pattern), F.lit(False)))


def search_players(players: DataFrame, q: str) -> DataFrame:
    """Players whose names or country contain the text, in any case."""
    return players.where(F.contains(F.lower(F.concat_ws(" ", "display_name", "latin_name", "country")), F.lit(q.strip().lower())))


def find_player(players: DataFrame, q: str, whole: bool = False) -> DataFrame:
    """The first focus player of that very name, else the first whose name contains it; names are either name, first is by id.

    With whole only that very name counts.  An empty text finds nobody.
    """
    q = q.strip().lower()
    if not q:
        return players.limit(0)
    players = players.where("is_focus")
    names = [F.lower("display_name"), F.lower("latin_name")]
    exact = F.coalesce(names[0] == q, F.lit(False)) | F.coalesce(names[1] == q, F.lit(False))
    part = F.coalesce(F.contains(names[0], F.lit(q)), F.lit(False)) | F.coalesce(F.contains(names[1], F.lit(q)), F.lit(False))
    level = F.when(exact, 0) if whole else F.when(exact, 0).when(part, 1)
    return players.withColumn("_level", level).where("_level is not null").orderBy("_level", "player").limit(1).drop("_level")


def spotlight(rated: DataFrame, k: int = 3, score: str = "raw_overall", x: str = "raw_x_pct", y: str = "raw_y_pct") -> DataFrame:
    """The k best eligible players of the focus team who have a point in the chart."""
    return plottable(rated, x, y).where(F.col("is_focus") & F.col("eligible")).orderBy(F.desc_nulls_last(score), "player").limit(k)


def directory_page(rated: DataFrame, limit: int = 60, offset: int = 0, q: str = "", score: str = "raw_overall", x: str = "raw_x_pct", y: str = "raw_y_pct") -> DataFrame:
    """A page of the directory, focus team first, eligible first, best first, with the count of all that are listed: eligible or focus
    players with both scores whose names or country contain the text.

    The list is made once and kept, since its count and its page are read from it.
    """
    listed = rated.where((F.col("eligible") | F.col("is_focus")) & F.col(x).isNotNull() & F.col(y).isNotNull())
    listed = kept(search_players(listed, q) if q.strip() else listed, "directory")
    page = listed.orderBy(F.desc("is_focus"), F.desc("eligible"), F.desc_nulls_last(score), "player").offset(offset).limit(limit)
    return page.withColumn("total", F.lit(listed.count()).cast("long"))


def chart_table(rated: DataFrame, score: str = "raw_overall") -> DataFrame:
    """Rows in the table's order: eligible first, best first."""
    return rated.orderBy(F.desc("eligible"), F.desc_nulls_last(score), "player")


def insights(rated: DataFrame, score: str = "raw_overall", x: str = "raw_x_pct") -> DataFrame:
    """One row: the eligible focus player with the best overall and the one with the best x; smallest id on ties."""
    own = rated.where(F.col("is_focus") & F.col("eligible"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), F.col("player").alias("player"))))["player"]
    return own.agg(best(score).alias("best_overall"), best(x).alias("best_x"))


def label_budget(rated: DataFrame, score: str = "raw_overall", top: float = 90, others: int = 6, budget: int = 10) -> DataFrame:
    """Players whose labels are drawn: up to ``others`` eligible ones outside the focus team from ``top`` on, then eligible focus players
    until ``budget`` labels are used."""
    order = [F.desc(score), F.col("player")]
    far = rated.where(~F.col("is_focus") & F.col("eligible") & (F.col(score) >= top)).orderBy(*order).limit(others)
    near = rated.where(F.col("is_focus") & F.col("eligible") & F.col(score).isNotNull()).orderBy(*order).limit(budget)
    rows = far.withColumn("_g", F.lit(0)).unionByName(near.withColumn("_g", F.lit(1)))  # at most others + budget rows
    position = F.row_number().over(Window.orderBy("_g", *order))
    return rows.withColumn("position", position).where(F.col("position") <= budget).drop("_g")


def leader_flag(rated: DataFrame, leaders: DataFrame, role: str, mode: str) -> DataFrame:
    """Add is_leader: listed under role_mode, or under role if there is no such list.

    leaders: one row with a map from list name to ids.
    """
    chosen = leaders.select(F.explode(F.coalesce(F.try_element_at("lists", F.lit(f"{role}_{mode}")), F.try_element_at("lists", F.lit(role)))).alias("player")).distinct()
    return rated.join(chosen.withColumn("_leader", F.lit(True)), "player", "left").withColumn("is_leader", F.coalesce("_leader", F.lit(False))).drop("_leader")


def name_index(players: DataFrame) -> DataFrame:
    """Every distinct name of a focus player that is not empty."""
    return players.where("is_focus").select(F.explode(F.array("latin_name", "display_name")).alias("name")).where("name <> ''").distinct()


def compare_pair(rated: DataFrame, a: int, b: int, metrics: list[str]) -> DataFrame:
    """(metric, a, b, difference) of two players."""
    rows = rated.where(F.col("player").isin(a, b)).select("player", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = rows.unpivot("player", metrics, "metric", "value")
    pick = lambda p: F.max(F.when(F.col("player") == p, F.col("value")))
    return long.groupBy("metric").agg(pick(a).alias("a"), pick(b).alias("b")).withColumn("difference", F.col("a") - F.col("b"))


def snapshot_diff(old: DataFrame, new: DataFrame, id_col: str = "player") -> DataFrame:
    """(player, state): added, removed or kept between two snapshots."""
    a, b = old.select(id_col).distinct().withColumn("_old", F.lit(True)), new.select(id_col).distinct().withColumn("_new", F.lit(True))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return a.join(b, id_col, "full").select(id_col, state.alias("state"))
