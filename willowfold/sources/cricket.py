"""Readers and writers: delivery logs, match info, packed snapshots, rank histories, venues.

All schemas are given, so no reader looks through a file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIVERIES = """match_id string, season string, start_date date, venue string, innings int, ball string, actual_delivery string,
batting_team string, bowling_team string, striker string, non_striker string, bowler string, runs_off_bat int, extras int, wides int, noballs int,
byes int, legbyes int, penalty int, non_boundary boolean, wicket_type string, player_dismissed string, other_wicket_type string,
other_player_dismissed string, fielder_1 string, fielder_2 string, fielder_3 string"""
INFO_KEYS = ("gender", "match_type", "overs", "date", "venue", "city", "toss_winner", "toss_decision", "winner", "winner_runs", "winner_wickets", "event", "player_of_match")
RANK_HISTORY = "gender string, team string, date date, rank int, matches int, note string"
VENUES = "n string, p string, c string, a string, lat double, lon double, u array<string>, s string, s2 string"


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """The 27 columns of every delivery file below path; info files are left out and blanks are null.

    The ball stays text; over and sequence are added as numbers.
    """
    from willowfold.functions.scalars import split_ball

    rows = spark.read.schema(DELIVERIES).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{*[!o],*[!f]o,*[!n]fo,*[!i]nfo}.csv").csv(path)
    over, ball = split_ball(F.col("ball"))
    return rows.withColumns({"over_no": over, "ball_no": ball})


def compact_deliveries(deliveries: DataFrame, matches: DataFrame, path: str) -> None:
    """Many small files into Parquet by match type, gender and year, so that a scope reads its folders only."""
    from willowfold.functions.scalars import season_year

    kept = deliveries.join(matches.select("match_id", "match_type", "gender"), "match_id").withColumn("year", season_year(F.col("season")))
    kept.repartition("match_type", "gender", "year", F.pmod(F.xxhash64("match_id"), F.lit(16))).write.partitionBy("match_type", "gender", "year").parquet(path)


def _info(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("tag string, key string, v1 string, v2 string, v3 string").option("recursiveFileLookup", True).option("pathGlobFilter", "*_info.csv").csv(path)
    return rows.withColumn("match_id", F.regexp_extract("_metadata.file_name", r"^(.*)_info\.csv$", 1))


def name_files(spark: SparkSession, path: str, key: str, end: str) -> None:
    """Give the one file of every folder <key>=<value> below path the name <value><end>, as the source names its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(at(f"{path}/{key}=*")):
        value = folder.getPath().getName().split("=", 1)[1]
        for n, part in enumerate(fs.globStatus(at(f"{folder.getPath()}/part-*"))):
            if n:
                raise ValueError(f"{folder.getPath()} has several files")
            fs.rename(part.getPath(), at(f"{folder.getPath()}/{value}{end}"))


def read_match_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, match_players, match_registry) from ragged info files; the match is named by its file."""
    return split_match_info(_info(spark, path))


def split_match_info(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of rows (match_id, tag, key, v1, v2, v3).

    Keys that repeat keep their least value; teams become a sorted array.
    """
    rows = rows.where("tag = 'info'")
    one = rows.where(F.col("key").isin(*INFO_KEYS)).groupBy("match_id").pivot("key", list(INFO_KEYS)).agg(F.min("v1"))
    teams = rows.where("key = 'team'").groupBy("match_id").agg(F.sort_array(F.collect_list("v1")).alias("teams"))
    typed = {"date": F.to_date(F.regexp_replace("date", "/", "-")), **{c: F.col(c).try_cast("int") for c in ("overs", "winner_runs", "winner_wickets")}}
    matches = rows.select("match_id").distinct().join(one, "match_id", "left").join(teams, "match_id", "left").withColumns(typed)
    players = rows.where("key in ('player', 'players')").select("match_id", F.col("v1").alias("team"), F.col("v2").alias("name"))
    registry = rows.where("key = 'registry' and v1 = 'people'").select("match_id", F.col("v2").alias("name"), F.col("v3").alias("person_id"))
    return matches, players, registry


_ROLE = ("eligible", "innings", "balls", "runs", "outs", "avg_or_econ", "sr_or_w100", "raw_x_pct", "raw_y_pct", "raw_overall_pct", "adj_x", "adj_y", "adj_x_pct", "adj_y_pct", "adj_overall_pct")
_INTS, _PHASES = ("innings", "balls", "runs", "outs"), ("early", "middle", "late")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(player_id, latin_name, name_local, country, is_focus, matches, role, ..., phases) of packed snapshots, format 2 and 3.

    A packed player is an array of mixed kinds, so it is read as an array of texts and each place is cast.
    """
    docs = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "format int, players array<array<string>>").alias("d"))
    rows = docs.select("d.format", F.explode("d.players").alias("p"))
    at = lambda i: F.try_element_at("p", F.lit(i + 1))
    flag = lambda c: F.lower(c).isin("true", "1")
    is2 = F.col("format") == 2
    role = lambda name, i2, i3: F.struct(F.lit(name).alias("role"), F.from_json(F.when(is2, at(i2)).otherwise(at(i3)), "array<string>").alias("r"))
    rows = rows.select(
        "format", at(0).alias("player_id"), at(1).alias("latin_name"), at(2).alias("name_local"), at(3).alias("country"), flag(at(4)).alias("is_focus"), F.when(is2, flag(at(5))).alias("squad"),
        F.when(is2, at(6)).otherwise(at(5)).cast("int").alias("matches"), F.explode(F.array(role("bat", 9, 6), role("bowl", 10, 7))).alias("x"),
    ).where("x.r is not null")
    own = lambda i: F.try_element_at("x.r", F.lit(i + 1))
    cast = lambda n, c: flag(c) if n == "eligible" else c.try_cast("int" if n in _INTS else "double")
    phases = F.from_json(own(15), "array<array<double>>")
    pct_at = F.when(is2, F.lit(5)).otherwise(F.lit(2))
    phase = [F.struct(F.try_element_at(F.try_element_at(phases, F.lit(i + 1)), F.lit(1)).cast("int").alias("balls"), F.try_element_at(F.try_element_at(phases, F.lit(i + 1)), pct_at).alias("pct")) for i in range(3)]
    named = F.map_from_arrays(F.array(*map(F.lit, _PHASES)), F.array(*phase))
    head = ["player_id", "latin_name", "name_local", "country", "is_focus", "squad", "matches", F.col("x.role").alias("role")]
    return rows.select(*head, *[cast(n, own(i)).alias(n) for i, n in enumerate(_ROLE)], named.alias("phases"))


def write_snapshot(players: DataFrame, meta: DataFrame, path: str) -> None:
    """Parquet by role, and the one row of meta as JSON."""
    players.write.partitionBy("role").parquet(f"{path}/players")
    meta.coalesce(1).write.json(f"{path}/meta")


def read_rank_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANK_HISTORY).json(path)


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VENUES).json(path)
