"""Par rates, adjusted indices, two-axis ratings, phase scores and nearest peers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from willowfold.functions.percentiles import midranks
from willowfold.operators.totals import batting_rates, bowling_rates, eligible, eligible_by_role, totals
from willowfold.sources.shared_dir import kept

# Fixed value: balls that a phase needs; the cell's bound is our own.
MIN_CELL_BALLS = 60
MIN_PHASE_BALLS = 60
#: The two raw axes of each role, and whether less is better.
RAW = {"bat": (("strike_rate", False), ("balls_per_out", False)), "bowl": (("economy", True), ("wickets_per_100", False))}


def folded(cell: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """balls, runs and outs of each (player, opponent, phase), in each group of by; folding again changes nothing."""
    return cell.groupBy(*by, "player", "opponent", "phase").agg(*[F.sum(c).alias(c) for c in ("balls", "runs", "outs")])


def par_rates(cell: DataFrame, min_balls: int = MIN_CELL_BALLS, by: tuple[str, ...] = ()) -> DataFrame:
    """runs and outs per ball of each (opponent, phase), of the phase as a whole where the opponent has too few balls; no rates outside the phases.

    Rows are few, opponents by phases, so the whole is a window over them.
    """
    own = cell.groupBy(*by, "opponent", "phase").agg(*[F.sum(c).alias(c) for c in ("balls", "runs", "outs")])
    whole = lambda c: F.sum(c).over(Window.partitionBy(*by, "phase"))
    enough = F.col("balls") >= min_balls
    rate = lambda c: F.when(F.col("phase").isNotNull(), F.when(enough, F.col(c) / F.col("balls")).otherwise(F.when(whole("balls") > 0, whole(c) / whole("balls"))))
    return own.select(*by, "opponent", "phase", "balls", rate("runs").alias("par_runs"), rate("outs").alias("par_outs"))


def attach_par(own: DataFrame, par: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Folded cells of (player, opponent, phase) with what par expects of their balls.

    Keys are compared null-safely, which asks no filter of either side: where par comes of the same cells, both read one shuffle of them.
    """
    keys = [*by, "opponent", "phase"]
    rates = par.select(*[F.col(k).alias(f"_{k}") for k in keys], "par_runs", "par_outs")
    expected = lambda c: (F.col("balls") * F.coalesce(c, F.lit(0.0)))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return own.join(rates, same, "left").withColumns({"expected_runs": expected(F.col("par_runs")), "expected_outs": expected(F.col("par_outs"))}).drop("par_runs", "par_outs", *[f"_{k}" for k in keys])


def adjusted_indices(parred: DataFrame, role: str | None, by_phase: bool = False, sums: tuple[str, ...] = ()) -> DataFrame:
    """adj_x and adj_y, 100 being par, and the sums asked for.  Speed and wickets are ratios to par; survival is smoothed by one dismissal on both
    sides; control is par over runs, so more is better on every axis.  Nothing expected, or no run conceded, is par.  Without a role the rows tell it, and both
    are indexed at once."""
    if by_phase:
        parred = parred.withColumn("phase", F.explode(F.array(F.lit("all"), F.col("phase")))).where("phase is not null")
    keys = [*([] if role else ["role"]), "player", *(["phase"] if by_phase else [])]
    own = parred.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*sums, "runs", "outs", "expected_runs", "expected_outs")])
    runs, outs, e_runs, e_outs = (F.col(c) for c in ("runs", "outs", "expected_runs", "expected_outs"))
    axes = {
        "bat": (F.when(e_runs == 0, 100.0).otherwise(100 * runs / e_runs), 100 * (e_outs + 1) / (outs + 1)),
        "bowl": (F.when((e_runs == 0) | (runs == 0), 100.0).otherwise(100 * e_runs / runs), F.when(e_outs == 0, 100.0).otherwise(100 * outs / e_outs)),
    }
    x, y = axes[role] if role else (F.when(F.col("role") == "bat", a).otherwise(b) for a, b in zip(*axes.values(), strict=True))
    return own.select(*keys, *sums, x.alias("adj_x"), y.alias("adj_y"))


def two_axis_overall(x: Column, y: Column, stored: Column | None = None) -> Column:
    """The stored overall if there is one, else the mean of both axes; null if either is."""
    mean = (x + y) / 2
    return mean if stored is None else F.coalesce(stored, mean)


def ratings(cell: DataFrame, role: str, **limits: int) -> DataFrame:
    """Totals, rates, eligibility, raw and adjusted axes with their percentiles and overall scores of every player.

    Cells are folded once to (player, opponent, phase) and once to innings, from one shuffle of the balls; players are kept in the shared folder for
    the steps that read them again.
    """
    rates = batting_rates if role == "bat" else bowling_rates
    df = rates(totals(cell)).withColumn("eligible", eligible(role, **limits))
    own = folded(cell)
    df = df.join(adjusted_indices(attach_par(own, par_rates(own)), role), "player")
    df = kept(df.withColumn("role", F.lit(role)), "players")
    axes = dict(zip(("raw_x_pct", "raw_y_pct", "adj_x_pct", "adj_y_pct"), (*RAW[role], ("adj_x", False), ("adj_y", False)), strict=True))
    df = midranks(df, axes, "eligible", [], "player")
    return df.withColumns({
        "raw_overall": two_axis_overall(F.col("raw_x_pct"), F.col("raw_y_pct")),
        "adj_overall": two_axis_overall(F.col("adj_x_pct"), F.col("adj_y_pct")),
    })


def role_indices(cell: DataFrame, by_phase: bool = True, sums: tuple[str, ...] = (), keep: bool = True) -> DataFrame:
    """adjusted_indices of both roles from cells that tell their role: one fold, kept, since par and players both read it; not if the cells themselves are."""
    own = folded(cell, ("role",))
    own = kept(own, "role-cells") if keep else own
    return adjusted_indices(attach_par(own, par_rates(own, by=("role",)), ("role",)), None, by_phase, sums)


def phase_scores(cell: DataFrame, min_phase_balls: int = MIN_PHASE_BALLS, **limits: int) -> DataFrame:
    """(role, player, phase, balls, pct): mean of both adjusted percentiles within role and phase, for eligible players with enough balls.

    cell tells its role; it is read once, and kept while it is folded to phases and to innings.
    """
    cell = kept(cell, "cells")
    rated = totals(cell, by=("role",)).where(eligible_by_role(**limits)).select("role", "player")
    df = role_indices(cell, sums=("balls",), keep=False).where((F.col("phase") != "all") & (F.col("balls") >= min_phase_balls))
    df = kept(df.join(rated, ["role", "player"], "left_semi").withColumn("member", F.lit(True)), "phases")
    df = midranks(df, {"x_pct": ("adj_x", False), "y_pct": ("adj_y", False)}, "member", ["role", "phase"], "player")
    return df.select("role", "player", "phase", "balls", ((F.col("x_pct") + F.col("y_pct")) / 2).alias("pct"))


def phase_score(cell: DataFrame, role: str, min_phase_balls: int = MIN_PHASE_BALLS, **limits: int) -> DataFrame:
    """``phase_scores`` of the cells of one role, without the role."""
    return phase_scores(cell.withColumn("role", F.lit(role)), min_phase_balls, **limits).drop("role")


def nearest_peer(players: DataFrame, x: str = "raw_x_pct", y: str = "raw_y_pct", members: int = 4) -> DataFrame:
    """(player, peer, distance2): the nearest eligible player outside the focus team, other than itself; smallest id on ties.

    Percentiles lie in a square of 0 to 100.  Peers of one point fold to the two with the smallest ids, which is all that anybody can need of them, and
    the square is cut into cells, about one for each ``members`` points.  Players look in the 3 x 3 cells
    around theirs; whoever finds none nearer than the ring's width looks again with cells four times as wide, the last time in
    the whole square.  Every row meets only the candidates of its cells.
    """
    players = players.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    seek = kept(players.select("player", F.col(x).alias("x"), F.col(y).alias("y"), (F.col("eligible") & ~F.col("is_focus")).alias("is_peer")), "seekers")
    peers = seek.where("is_peer").select(F.col("player").alias("peer"), F.col("x").alias("px"), F.col("y").alias("py"))
    first = peers.groupBy("px", "py").agg(F.min("peer").alias("first"))
    second = peers.join(first, ["px", "py"]).groupBy("px", "py").agg(F.min("first").alias("first"), F.min(F.when(F.col("peer") > F.col("first"), F.col("peer"))).alias("second"))
    pool = kept(second, "peers")
    cell = 100 / max(1, int((pool.count() / members) ** 0.5))
    seek, found = seek.select("player", "x", "y"), None
    while True:
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: E731, B023
        around = lambda c: F.sequence(at(c) - 1, at(c) + 1)  # noqa: E731, B023
        probes = seek.withColumn("cx", F.explode(around("x"))).withColumn("cy", F.explode(around("y")))
        homes = pool.withColumns({"cx": at("px"), "cy": at("py")})
        d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
        near = probes.join(homes, ["cx", "cy"]).withColumn("peer", F.when(F.col("first") == F.col("player"), F.col("second")).otherwise(F.col("first")))
        near = near.where("peer is not null").select("player", F.struct(d2.alias("d2"), "peer").alias("b"))
        best = near.groupBy("player").agg(F.min("b").alias("b")).select("player", F.col("b.peer").alias("peer"), F.col("b.d2").alias("distance2"))
        last = cell >= 100
        sure = kept(best if last else best.where(F.col("distance2") <= cell * cell), "nearest")
        found = sure if found is None else found.unionByName(sure)
        if last:
            return found
        seek = kept(seek.join(sure, "player", "left_anti"), "seekers")
        if seek.isEmpty():
            return found
        cell = min(cell * 4, 100)
