"""The given tables as deliveries, results and venues, in Spark and in SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from willowfold.operators.deliveries import delivery_flags
from willowfold.sources.tables import spread

FOCUS = "NATION_12"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as deliveries without an order: a ball for each line, 32 orders to a match, and for every hundred matches fifty players of each role by a
    skewed hash of part and supplier, so that matches and players grow with the table."""
    used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = spread(table(spark, sf_dir, "lineitem").select(*used)).selectExpr(
        "l_orderkey div 32 AS match_id", "CAST((l_orderkey div 16) % 2 + 1 AS INT) AS innings",
        "CAST((l_orderkey div 3200) * 50 + floor(sqrt((l_partkey*31 + l_suppkey) % 2500)) AS INT) AS striker", "CAST((l_orderkey div 3200) * 50 + floor(sqrt((l_partkey*7919 + l_suppkey*13) % 2500)) AS INT) AS bowler",
        "CAST((l_orderkey + 3*l_linenumber) % 20 AS INT) AS over_no", "CAST(l_quantity AS INT) AS q", "CAST(round(l_discount*100) AS INT) AS d", "CAST(round(l_tax*100) AS INT) AS t",
        "l_returnflag", "l_linestatus",
    )
    rows = rows.selectExpr(
        "match_id", "innings", "striker", "bowler", "over_no",
        "CASE q % 12 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN 1 WHEN 9 THEN 6 WHEN 10 THEN 1 ELSE 0 END AS runs_off_bat",
        "CASE WHEN d = 10 THEN 1 ELSE 0 END AS wides", "CASE WHEN t = 8 AND d <> 10 THEN 1 ELSE 0 END AS noballs",
        "CASE WHEN l_returnflag = 'A' AND q % 7 = 0 THEN CASE WHEN q % 5 = 0 THEN 'run out' WHEN l_linestatus = 'O' THEN 'caught' ELSE 'bowled' END END AS wicket_type",
        "concat('NATION_', striker % 25) AS batting_country", "concat('NATION_', bowler % 25) AS bowling_country",
    )
    return delivery_flags(rows.withColumn("extras", F.col("wides") + F.col("noballs")))


BULK_SQL = """
bulk0 AS (SELECT l_orderkey // 32 AS match_id, CAST((l_orderkey // 16) % 2 + 1 AS INT) AS innings,
    CAST((l_orderkey // 3200) * 50 + floor(sqrt((l_partkey*31 + l_suppkey) % 2500)) AS INT) AS striker, CAST((l_orderkey // 3200) * 50 + floor(sqrt((l_partkey*7919 + l_suppkey*13) % 2500)) AS INT) AS bowler,
    CAST((l_orderkey + 3*l_linenumber) % 20 AS INT) AS over_no, CAST(l_quantity AS INT) AS q, CAST(round(l_discount*100) AS INT) AS d, CAST(round(l_tax*100) AS INT) AS t,
    l_returnflag, l_linestatus FROM lineitem),
bulk1 AS (SELECT match_id, innings, striker, bowler, over_no,
    CASE q % 12 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN 1 WHEN 9 THEN 6 WHEN 10 THEN 1 ELSE 0 END AS runs_off_bat,
    CASE WHEN d = 10 THEN 1 ELSE 0 END AS wides, CASE WHEN t = 8 AND d <> 10 THEN 1 ELSE 0 END AS noballs,
    CASE WHEN l_returnflag = 'A' AND q % 7 = 0 THEN CASE WHEN q % 5 = 0 THEN 'run out' WHEN l_linestatus = 'O' THEN 'caught' ELSE 'bowled' END END AS wicket_type,
    'NATION_' || (striker % 25) AS batting_country, 'NATION_' || (bowler % 25) AS bowling_country FROM bulk0),
bulk AS (SELECT *, wides + noballs AS extras, CASE WHEN over_no <= 5 THEN 'early' WHEN over_no <= 14 THEN 'middle' ELSE 'late' END AS phase,
    wides = 0 AND noballs = 0 AS is_legal, wides = 0 AS is_ball_faced, runs_off_bat + wides + noballs AS total_runs, runs_off_bat + wides + noballs AS bowler_runs,
    wicket_type IS NOT NULL AS is_out, coalesce(wicket_type <> 'run out', false) AS bowler_wicket, runs_off_bat + wides + noballs = 0 AS is_dot, runs_off_bat IN (4, 6) AS is_boundary FROM bulk1)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as deliveries in order: 120 to an innings, two innings to a match."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id div 240 AS match_id", "CAST((event_id % 240) div 120 + 1 AS INT) AS innings", "CAST((event_id % 120) div 6 AS INT) AS over_no", "CAST(event_id % 6 + 1 AS INT) AS ball_no",
        "user_id AS striker", "(user_id*7 + event_id) % 150 + (event_id div 10000) * 150 AS bowler", "event_type",
        "CASE WHEN event_type = 'error' AND value < 8 THEN 'W' WHEN value < 15 THEN '0' WHEN value < 40 THEN '1' WHEN value < 60 THEN '2' WHEN value < 100 THEN '4' ELSE '6' END AS result",
    )
    rows = rows.selectExpr("*", "CASE WHEN result = 'W' THEN 0 ELSE CAST(result AS INT) END AS runs_off_bat", "CASE WHEN result = 'W' THEN CASE WHEN event_id % 4 = 0 THEN 'run out' WHEN event_id % 4 = 1 THEN 'caught' WHEN event_id % 4 = 2 THEN 'stumped' ELSE 'bowled' END END AS wicket_type")
    none = F.lit(0)
    return delivery_flags(rows.withColumns({"wides": F.when(F.col("event_id") % 29 == 0, 1).otherwise(0), "noballs": none}).withColumn("extras", F.col("wides")))


LOG_SQL = """
log0 AS (SELECT event_id, event_id // 240 AS match_id, CAST((event_id % 240) // 120 + 1 AS INT) AS innings, CAST((event_id % 120) // 6 AS INT) AS over_no, CAST(event_id % 6 + 1 AS INT) AS ball_no,
    user_id AS striker, (user_id*7 + event_id) % 150 + (event_id // 10000) * 150 AS bowler, event_type, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS wides,
    CASE WHEN event_type = 'error' AND value < 8 THEN 'W' WHEN value < 15 THEN '0' WHEN value < 40 THEN '1' WHEN value < 60 THEN '2' WHEN value < 100 THEN '4' ELSE '6' END AS result FROM events),
log1 AS (SELECT *, CASE WHEN result = 'W' THEN 0 ELSE CAST(result AS INT) END AS runs_off_bat,
    CASE WHEN result = 'W' THEN CASE WHEN event_id % 4 = 0 THEN 'run out' WHEN event_id % 4 = 1 THEN 'caught' WHEN event_id % 4 = 2 THEN 'stumped' ELSE 'bowled' END END AS wicket_type FROM log0),
log AS (SELECT *, wides = 0 AS is_legal, runs_off_bat + wides AS total_runs, wicket_type IS NOT NULL AS is_out, CASE WHEN over_no <= 5 THEN 'early' WHEN over_no <= 14 THEN 'middle' ELSE 'late' END AS phase FROM log1),
run AS (SELECT *, CAST(sum(total_runs) OVER w AS BIGINT) AS score, CAST(sum(is_out::int) OVER w AS BIGINT) AS wickets, CAST(sum(is_legal::int) OVER w AS BIGINT) AS balls
    FROM log WINDOW w AS (PARTITION BY match_id, innings ORDER BY over_no, ball_no ROWS UNBOUNDED PRECEDING))
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dated results of nations: (gender, team, date, points)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    gender = F.when(F.col("o_orderkey") % 3 == 0, "women").otherwise("men")
    return joined.select(gender.alias("gender"), F.concat(F.lit("NATION_"), "c_nationkey").alias("team"), F.col("o_orderdate").cast("date").alias("date"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("points"))


RESULTS_SQL = """
results AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'women' ELSE 'men' END AS gender, 'NATION_' || c_nationkey AS team, CAST(o_orderdate AS DATE) AS date,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS points FROM orders JOIN customer ON o_custkey = c_custkey)
"""

AS_OF = ("1997-12-28", "1998-12-28", "1999-12-28", "2000-12-28")
ASKED = ("1996-06-30", "1998-06-30", "1999-06-30", "2001-06-30")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as venues, with use tags."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS n", "concat('PREF_', s_nationkey) AS p", "concat('City ', s_suppkey % 40) AS c", "concat('Street ', s_suppkey) AS a",
        "30 + (s_suppkey % 97) / 8D AS lat", "130 + (s_suppkey % 89) / 8D AS lon",
        "filter(array(CASE WHEN s_suppkey % 2 = 0 THEN 'match' END, CASE WHEN s_suppkey % 3 = 0 THEN 'practice' END, CASE WHEN s_suppkey % 5 = 0 THEN 'indoor' END), x -> x IS NOT NULL) AS u",
        "'s' AS s", "'s2' AS s2",
    )


VENUES_SQL = """
venues AS (SELECT s_name AS n, 'PREF_' || s_nationkey AS p, 'City ' || (s_suppkey % 40) AS c, 'Street ' || s_suppkey AS a, 30 + (s_suppkey % 97) / 8.0::double AS lat, 130 + (s_suppkey % 89) / 8.0::double AS lon,
    s_suppkey % 2 = 0 AS u_match, s_suppkey % 3 = 0 AS u_practice, s_suppkey % 5 = 0 AS u_indoor FROM supplier)
"""


def people(players: DataFrame) -> DataFrame:
    """Names, country and focus flag of players; every third has a local name."""
    local = F.when(F.col("player") % 3 == 0, F.concat(F.lit("選手"), F.col("player").cast("string"))).otherwise("")
    country = F.concat(F.lit("NATION_"), (F.col("player") % 25).cast("string"))
    return players.withColumns({"latin_name": F.concat(F.lit("Player "), F.col("player").cast("string")), "name_local": local, "country": country, "is_focus": country == FOCUS})
