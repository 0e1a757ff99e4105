"""Deliveries: scope, flags, matches, persons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from willowfold.functions.scalars import phase_of

#: Dismissals that are not the bowler's.
NOT_BOWLERS = ("run out", "retired hurt", "retired out", "retired not out", "obstructing the field", "timed out")
#: The compared window.
WINDOW = (dt.date(2022, 10, 10), dt.date(2026, 7, 2))


def scope_matches(matches: DataFrame, start: dt.date = WINDOW[0], end: dt.date = WINDOW[1], gender: str = "male", match_type: str = "T20") -> DataFrame:
    """Matches of the compared window, gender and type."""
    return matches.where(F.col("date").between(F.lit(start), F.lit(end)) & (F.col("gender") == gender) & (F.col("match_type") == match_type))


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def delivery_flags(deliveries: DataFrame) -> DataFrame:
    """Add what a ball counts as.  Balls faced leave out wides, legal balls no-balls too; byes are not the bowler's."""
    legal = (_n("wides") == 0) & (_n("noballs") == 0)
    total = _n("runs_off_bat") + _n("extras")
    return deliveries.withColumns({
        "phase": phase_of(F.col("over_no")),
        "is_legal": legal,
        "is_ball_faced": _n("wides") == 0,
        "total_runs": total,
        "bowler_runs": _n("runs_off_bat") + _n("wides") + _n("noballs"),
        "is_out": F.col("wicket_type").isNotNull(),
        "bowler_wicket": F.col("wicket_type").isNotNull() & ~F.coalesce(F.col("wicket_type").isin(*NOT_BOWLERS), F.lit(False)),
        "is_dot": total == 0,
        "is_boundary": _n("runs_off_bat").isin(4, 6) & ~F.coalesce(F.col("non_boundary"), F.lit(False)) if "non_boundary" in deliveries.columns else _n("runs_off_bat").isin(4, 6),
    })


def attach_match(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Inner join by match_id; the planner broadcasts matches if their size allows."""
    return deliveries.join(matches, "match_id")


def resolve_person(deliveries: DataFrame, registry: DataFrame, roles: tuple[str, ...] = ("striker", "bowler", "player_dismissed")) -> DataFrame:
    """Add <role>_id: the registry's person of (match_id, name); null if the name is not registered.

    A match's registry is one small map, so one join by match_id serves all roles.  Of several persons of one name in a
    match the least id is taken.
    """
    listed = registry.where("name is not null").groupBy("match_id").agg(F.sort_array(F.collect_set(F.struct("name", "person_id"))).alias("_all"))
    first = F.filter("_all", lambda x, i: (i == 0) | (F.get("_all", i - 1)["name"] != x["name"]))
    people = listed.select("match_id", F.map_from_entries(first).alias("_people"))
    found = deliveries.join(people, "match_id", "left")
    return found.withColumns({f"{role}_id": F.try_element_at("_people", F.col(role)) for role in roles}).drop("_people")


def localise_names(players: DataFrame, names: DataFrame, id_col: str = "player") -> DataFrame:
    """Add display_name: the local name if there is one, else the latin name."""
    local = names.select(id_col, F.col("name_local").alias("_local"))
    return players.join(local, id_col, "left").withColumn("display_name", F.coalesce(F.nullif(F.col("_local"), F.lit("")), F.col("latin_name"))).drop("_local")


def squad_flag(players: DataFrame, squad: DataFrame, id_col: str = "player") -> DataFrame:
    """Add in_squad."""
    listed = squad.select(id_col).distinct().withColumn("_listed", F.lit(True))
    return players.join(listed, id_col, "left").withColumn("in_squad", F.coalesce("_listed", F.lit(False))).drop("_listed")


def coverage_gaps(expected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Expected keys that have no row."""
    return expected.select(key).distinct().join(rows, key, "left_anti")
