"""Player totals and rates, folded from deliveries through cells of (player, opponent, phase, match, innings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from willowfold.sources.shared_dir import kept

#: Thresholds of a rated player.
MIN_INNINGS, MIN_BALLS, MIN_WICKETS = 10, {"bat": 200, "bowl": 120}, 5


def _long(c: Column) -> Column:
    return c.cast("long")


#: Of each role: who has the ball, against whom, whether it counts, its runs and its out.
SIDES = {"bat": ("striker", "bowling_country", "is_ball_faced", "runs_off_bat", "is_out"), "bowl": ("bowler", "batting_country", "is_legal", "bowler_runs", "bowler_wicket")}
_KEYS = ("player", "opponent", "phase", "match_id", "innings")


def _side(role: str) -> list[Column]:
    return [F.col(c).alias(n) for c, n in zip(SIDES[role], ("player", "opponent", "_ball", "_runs", "_out"), strict=True)]


def _celled(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, *_KEYS).agg(
        _long(F.count_if(F.col("_ball"))).alias("balls"), _long(F.sum("_runs")).alias("runs"), _long(F.count_if(F.col("_out"))).alias("outs"),
        F.count(F.lit(1)).alias("events"), _long(F.count_if(F.col("is_dot"))).alias("dots"), _long(F.count_if(F.col("is_boundary"))).alias("boundaries"),
    )


def cells(flagged: DataFrame, role: str) -> DataFrame:
    """One row for each (player, opponent, phase, match, innings): the only pass over all balls of a role.

    balls are balls faced or legal balls; runs are off the bat or the bowler's; outs are dismissals or the bowler's wickets.
    """
    return _celled(flagged.select("phase", "match_id", "innings", "is_dot", "is_boundary", *_side(role)))


def role_cells(flagged: DataFrame) -> DataFrame:
    """The cells of both roles, with the role as first column, from one pass over the balls: each is laid down for its striker and for its bowler, folded before it is shuffled."""
    sides = F.array(*[F.struct(F.lit(role).alias("role"), *_side(role)) for role in SIDES])
    return _celled(flagged.select("phase", "match_id", "innings", "is_dot", "is_boundary", F.inline(sides)), "role")


def totals(cell: DataFrame, by_phase: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """innings, balls, runs and outs of each player; with by_phase also of each phase, the whole being phase "all"; with by, of each of its groups.

    Innings are counted by folding to (player, match, innings) first, in place of a distinct count over all cells.
    """
    sums = [F.sum(c).alias(c) for c in ("balls", "runs", "outs")]
    if by_phase:
        cell = cell.withColumn("phase", F.explode(F.array(F.lit("all"), F.col("phase")))).where("phase is not null")
    keys = [*by, "player", "phase"] if by_phase else [*by, "player"]
    innings = cell.groupBy(*keys, "match_id", "innings").agg(*sums)
    return innings.groupBy(*keys).agg(F.count(F.lit(1)).alias("innings"), *sums)


def batting_rates(df: DataFrame) -> DataFrame:
    """average, balls per dismissal and strike rate; null where the divisor is 0."""
    ratio = lambda a, b, k=1: F.when(F.col(b) != 0, k * F.col(a) / F.col(b))
    return df.withColumns({"average": ratio("runs", "outs"), "balls_per_out": ratio("balls", "outs"), "strike_rate": ratio("runs", "balls", 100)})


def bowling_rates(df: DataFrame) -> DataFrame:
    """economy and wickets per 100 balls."""
    ratio = lambda a, b, k: F.when(F.col(b) != 0, k * F.col(a) / F.col(b))
    return df.withColumns({"economy": ratio("runs", "balls", 6), "wickets_per_100": ratio("outs", "balls", 100)})


def eligible(role: str, min_innings: int = MIN_INNINGS, min_balls: int | None = None, min_wickets: int = MIN_WICKETS) -> Column:
    """Whether a player's totals make a rating."""
    enough = (F.col("innings") >= min_innings) & (F.col("balls") >= (MIN_BALLS[role] if min_balls is None else min_balls))
    return enough & (F.col("outs") >= min_wickets) if role == "bowl" else enough


def eligible_by_role(**limits: int) -> Column:
    """``eligible`` for rows of both roles, told by their column role."""
    return F.when(F.col("role") == "bat", eligible("bat", **limits)).otherwise(eligible("bowl", **limits))


def has_observed() -> Column:
    return (F.col("innings") > 0) & (F.col("balls") > 0)


def dot_boundary_rate(cell: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Percent of a player's deliveries without a run, and hit for four or six, in each group of by."""
    share = lambda c: 100 * F.sum(c) / F.sum("events")
    return cell.groupBy(*by, "player").agg(share("dots").alias("dot_rate"), share("boundaries").alias("boundary_rate"))


def player_matches(cell: DataFrame) -> DataFrame:
    return cell.groupBy("player", "match_id").agg(F.lit(1).alias("_")).groupBy("player").agg(F.count(F.lit(1)).alias("matches"))


def fielding_totals(deliveries: DataFrame, fielders: Column) -> DataFrame:
    """catches, stumpings and run-outs of each fielder; each name of the array has a part."""
    rows = deliveries.where(F.col("wicket_type").isNotNull()).select(F.explode(F.array_compact(fielders)).alias("player"), "wicket_type")
    count = lambda *kinds: F.count_if(F.col("wicket_type").isin(*kinds))
    return rows.groupBy("player").agg(count("caught", "caught and bowled").alias("catches"), count("stumped").alias("stumpings"), count("run out").alias("run_outs"))


def threshold_audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many players pass each rule."""
    return df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def scope_meta(flagged: DataFrame, focus: str, matches: DataFrame | None = None, **limits: int) -> DataFrame:
    """One row: matches, deliveries and players of the scope, its first and last date, matches, players and last match date of the focus team, and
    the players eligible in each role.

    matches: (match_id, date); without it dates are null.  Balls are folded to cells of each role and kept; everything is counted from them.
    """
    both = kept(role_cells(flagged), "scope-cells")
    bat = both.where("role = 'bat'")
    dates = matches.select("match_id", "date") if matches is not None else bat.select("match_id", F.lit(None).cast("date").alias("date")).limit(0)
    # a batting cell's opponent is the bowling side, a bowling cell's the batting side
    of = both.groupBy("match_id").agg(F.sum(F.when(F.col("role") == "bat", F.col("events"))).alias("n"), F.bool_or(F.col("opponent") == focus).alias("focus"))
    of = of.join(dates, "match_id", "left")
    a = of.agg(F.count(F.lit(1)).alias("matches"), F.sum("n").alias("deliveries"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("focus")).alias("focus_matches"), F.max(F.when(F.col("focus"), F.col("date"))).alias("focus_last_date"))
    sides = flagged.groupBy("striker", "batting_country", "bowler", "bowling_country").agg(F.lit(1).alias("_"))
    sides = sides.select(F.inline(F.array(F.struct(F.col("striker").alias("p"), F.col("batting_country").alias("c")), F.struct(F.col("bowler").alias("p"), F.col("bowling_country").alias("c"))))).distinct()
    b = sides.agg(F.count_distinct("p").alias("players"), F.count_distinct(F.when(F.col("c") == focus, F.col("p"))).alias("focus_players"))
    rated = [totals(both.where(F.col("role") == role)).agg(F.count_if(eligible(role, **limits)).alias(f"eligible_{name}")) for role, name in (("bat", "batters"), ("bowl", "bowlers"))]
    return a.join(b, F.lit(True)).join(rated[0], F.lit(True)).join(rated[1], F.lit(True))  # one row each
