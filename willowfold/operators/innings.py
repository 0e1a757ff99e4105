"""Innings: running state, cut-off, chase, totals and outcomes of ordered deliveries.

Every window runs within (match_id, innings), which a rule of the game bounds; one shuffle by match serves all.
A ball (match_id, innings, over_no, ball_no) must be one row: of a log in which deliveries were replayed, drop the copies first, as the scoreboard's stream does, else sums up to
a ball depend on which copy comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["match_id", "innings"]


def _to_here():
    return Window.partitionBy(*KEYS).orderBy("over_no", "ball_no").rowsBetween(Window.unboundedPreceding, 0)


def legal_ball_number(df: DataFrame) -> DataFrame:
    """Add legal_ball: the running count, so a wide or no-ball repeats the number before it."""
    return df.withColumn("legal_ball", F.sum(F.col("is_legal").cast("long")).over(_to_here()))


def innings_progress(df: DataFrame) -> DataFrame:
    """Add score, wickets, balls so far and the run rate per over."""
    balls = F.sum(F.col("is_legal").cast("long")).over(_to_here())
    df = df.withColumns({"score": F.sum("total_runs").over(_to_here()).cast("long"), "wickets": F.sum(F.col("is_out").cast("long")).over(_to_here()), "balls": balls})
    return df.withColumn("run_rate", F.when(F.col("balls") > 0, 6 * F.col("score") / F.col("balls")))


def innings_totals(df: DataFrame) -> DataFrame:
    """score, wickets and legal balls of each innings."""
    return df.groupBy(*KEYS).agg(F.sum("total_runs").cast("long").alias("score"), F.count_if(F.col("is_out")).alias("wickets"), F.count_if(F.col("is_legal")).alias("balls"))


def target_join(totals: DataFrame) -> DataFrame:
    """Second innings with the target: the first's score and one more."""
    first = totals.where("innings = 1").select("match_id", (F.col("score") + 1).alias("target"))
    return totals.where("innings = 2").join(first, "match_id")


def innings_cutoff(df: DataFrame, max_balls: int, max_wickets: int) -> DataFrame:
    """Deliveries up to the one that ends the innings: by balls, by wickets or, in a chase, by the target.

    The limits only grow, so a delivery counts if the state before it was open; no row-by-row state is needed.  One shuffle by
    match serves the running state and the target.
    """
    live = innings_progress(df.repartition("match_id"))
    # the ball itself is taken off again: what stood before it
    before = {"_balls": F.col("balls") - F.col("is_legal").cast("long"), "_wickets": F.col("wickets") - F.col("is_out").cast("long"), "_score": F.col("score") - F.col("total_runs")}
    live = live.withColumns(before).where((F.col("_balls") < max_balls) & (F.col("_wickets") < max_wickets))
    first = F.max(F.when(F.col("innings") == 1, F.col("score"))).over(Window.partitionBy("match_id"))
    live = live.withColumn("target", first + 1)
    return live.where((F.col("innings") == 1) | F.col("target").isNull() | (F.col("_score") < F.col("target"))).drop("_balls", "_wickets", "_score")


def chase_state(cut: DataFrame, max_balls: int) -> DataFrame:
    """Second innings, ball by ball: runs needed, balls left, required rate per over, and whether the target is reached."""
    needed = F.greatest(F.lit(0), F.col("target") - F.col("score"))
    left = F.lit(max_balls) - F.col("balls")
    return cut.where("innings = 2 and target is not null").withColumns({"needed": needed, "balls_left": left, "reached": F.col("score") >= F.col("target")}).withColumn("required_rate", F.when((F.col("balls_left") > 0), 6 * F.col("needed") / F.col("balls_left")))


def match_outcome(totals: DataFrame, max_wickets: int) -> DataFrame:
    """(match_id, first_score, second_score, outcome, margin, margin_in): won by runs when defending, by wickets when chasing."""
    pick = lambda n, c: F.max(F.when(F.col("innings") == n, F.col(c)))
    both = totals.groupBy("match_id").agg(pick(1, "score").alias("first_score"), pick(2, "score").alias("second_score"), pick(2, "wickets").alias("lost")).where("first_score is not null and second_score is not null")
    ahead = F.col("second_score") - F.col("first_score")
    outcome = F.when(ahead > 0, "chased").when(ahead < 0, "defended").otherwise("draw")
    margin = F.when(ahead > 0, max_wickets - F.col("lost")).when(ahead < 0, -ahead)
    return both.select("match_id", "first_score", "second_score", outcome.alias("outcome"), margin.alias("margin"), F.when(ahead > 0, "wickets").when(ahead < 0, "runs").alias("margin_in"))


def over_progress(df: DataFrame) -> DataFrame:
    """runs and wickets of each over."""
    return df.groupBy(*KEYS, "over_no").agg(F.sum("total_runs").cast("long").alias("runs"), F.count_if(F.col("is_out")).alias("wickets"))
