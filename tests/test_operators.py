"""Operators on small hand-made frames: ties, limits, nulls, scripted innings, golden rates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from willowfold.functions import scalars as sc
from willowfold.functions.percentiles import midrank
from willowfold.operators import deliveries, innings, matchups, rankings, ratings, serve, totals, venues


@pytest.mark.parametrize(
    ("values", "value", "inverse", "want"),
    [
        ([10, 20, 30], 20, False, 50), ([10, 20, 20, 30], 20, False, 50), ([10, 10, 10], 10, False, 50), ([10, 20, 30], 10, True, 100), ([7], 7, False, 50),
        ([10, 20, 30], 25, False, 100), ([10, 20, 30], 99, False, 100), ([10, 20, 30], None, False, None), ([], 5, False, None),
    ],
)
def test_midrank(spark, values, value, inverse, want):
    inside = value in values
    rows = [(i, float(v), True) for i, v in enumerate(values)] + ([] if inside else [(99, None if value is None else float(value), False)])
    df = spark.createDataFrame(rows, "i int, v double, m boolean")
    got = [r.p for r in midrank(df, "v", "m", [], "p", inverse).collect() if r.v == value and (inside or r.i == 99)]
    assert got and all(p == want for p in got)


def test_midranks_average_fifty(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 91).alias("v"), F.lit(True).alias("m"))
    row = midrank(df, "v", "m", [], "p").agg(F.avg("p"), F.min("p"), F.max("p")).first()
    assert abs(row[0] - 50) < 1e-9 and row[1] >= 0 and row[2] <= 100


def script(spark, *plays):
    rows = [(m, i, 0, n + 1, 0 if r == "W" else int(r), r == "W") for m, i, balls in plays for n, r in enumerate(balls)]
    return spark.createDataFrame(rows, "match_id long, innings int, over_no int, ball_no int, total_runs int, is_out boolean").withColumn("is_legal", F.lit(True))


def play(spark, *plays):
    cut = innings.innings_cutoff(script(spark, *plays), 6, 2)
    return {(r.match_id, r.innings): (r.score, r.wickets, r.balls) for r in innings.innings_totals(cut).collect()}, cut


def test_innings_end(spark):
    done, cut = play(spark, (1, 1, "111111111"), (2, 1, "WW11"), (3, 1, "100000"), (3, 2, "2111"), (4, 1, "200000"), (4, 2, "200000"), (5, 1, "600000"), (5, 2, "1W1W44"))
    assert done[1, 1] == (6, 0, 6)
    assert done[2, 1] == (0, 2, 2)
    assert done[3, 2] == (2, 0, 1)
    assert done[5, 2] == (2, 2, 4)
    targets = {r.match_id: r.target for r in cut.select("match_id", "target").distinct().collect()}
    assert targets == {1: 7, 2: 1, 3: 2, 4: 3, 5: 7}
    out = {r.match_id: (r.outcome, r.margin, r.margin_in) for r in innings.match_outcome(innings.innings_totals(cut), 2).collect()}
    assert out == {3: ("chased", 2, "wickets"), 4: ("draw", None, None), 5: ("defended", 4, "runs")}
    last = innings.chase_state(cut, 6).where("match_id = 3").collect()
    assert [(r.needed, r.balls_left, r.reached) for r in last] == [(0, 5, True)]


def test_legal_balls_repeat_on_extras(spark):
    df = script(spark, (1, 1, "1111")).withColumn("is_legal", F.col("ball_no") != 2)
    assert [r.legal_ball for r in innings.legal_ball_number(df).orderBy("ball_no").collect()] == [1, 1, 2, 3]


def test_flags(spark):
    schema = "over_no int, runs_off_bat int, extras int, wides int, noballs int, wicket_type string, non_boundary boolean"
    rows = [(0, 0, 1, 1, None, None, None), (5, 4, 1, None, 1, None, None), (6, 4, 0, None, None, None, True), (14, 0, 4, None, None, "run out", None), (15, 0, 0, None, None, "bowled", None), (20, 6, 0, 0, 0, "retired hurt", False)]
    got = deliveries.delivery_flags(spark.createDataFrame(rows, schema)).collect()
    assert [r.phase for r in got] == ["early", "early", "middle", "middle", "late", None]
    assert [(r.is_legal, r.is_ball_faced) for r in got[:3]] == [(False, False), (False, True), (True, True)]
    assert [r.bowler_runs for r in got] == [1, 5, 4, 0, 0, 6] and [r.total_runs for r in got] == [1, 5, 4, 4, 0, 6]
    assert [r.bowler_wicket for r in got] == [False, False, False, False, True, False]
    assert [r.is_boundary for r in got] == [False, True, False, False, False, True]


def test_eligibility_edges_and_golden_rates(spark):
    df = spark.createDataFrame([(1, 10, 200, 50, 2), (2, 9, 200, 50, 2), (3, 10, 199, 50, 2), (4, 50, 1278, 1779, 46), (5, 6, 32, 24, 0)], "player int, innings long, balls long, runs long, outs long")
    rated = {r.player: r for r in totals.batting_rates(df.withColumn("e", totals.eligible("bat"))).collect()}
    assert [rated[i].e for i in (1, 2, 3)] == [True, False, False]
    assert (round(rated[4].average, 1), round(rated[4].strike_rate, 1)) == (38.7, 139.2)
    assert rated[5].average is None and rated[5].strike_rate == 75
    bowl = spark.createDataFrame([(1, 10, 120, 100, 5), (2, 10, 119, 100, 5), (3, 10, 120, 100, 4), (4, 19, 328, 216, 20), (5, 1, 0, 0, 0)], "player int, innings long, balls long, runs long, outs long")
    rated = {r.player: r for r in totals.bowling_rates(bowl.withColumn("e", totals.eligible("bowl"))).collect()}
    assert [rated[i].e for i in (1, 2, 3)] == [True, False, False]
    assert (round(rated[4].economy, 1), round(rated[4].wickets_per_100, 1)) == (4.0, 6.1) and rated[5].economy is None


def cell_frame(spark, rows):
    return spark.createDataFrame(rows, "player int, opponent string, phase string, match_id int, innings int, balls long, runs long, outs long, events long, dots long, boundaries long")


def test_par_falls_back_below_sixty_balls(spark):
    cell = cell_frame(spark, [(1, "A", "early", 1, 1, 60, 60, 3, 60, 0, 0), (2, "B", "early", 2, 1, 59, 118, 0, 59, 0, 0)])
    par = {r.opponent: (r.par_runs, r.par_outs) for r in ratings.par_rates(cell).collect()}
    assert par == {"A": (1.0, 0.05), "B": (178 / 119, 3 / 119)}


def test_indices(spark):
    parred = spark.createDataFrame([(1, "early", 100, 0, 80.0, 3.0), (2, "early", 0, 2, 0.0, 1.0), (3, "late", 50, 4, 100.0, 2.0), (4, "late", 0, 0, 6.0, 0.0)], "player int, phase string, runs long, outs long, expected_runs double, expected_outs double")
    bat = {r.player: (r.adj_x, r.adj_y) for r in ratings.adjusted_indices(parred, "bat").collect()}
    assert bat[1] == (125, 400) and bat[2][0] == 100 and bat[3] == (50, 60)
    bowl = {r.player: (r.adj_x, r.adj_y) for r in ratings.adjusted_indices(parred, "bowl").collect()}
    assert bowl[2][0] == 100 and bowl[3] == (200, 200) and bowl[4] == (100, 100)


def test_phase_score_needs_sixty_balls(spark):
    rows = [(p, "A", ph, m, 1, b, b + p, 1, b, 0, 0) for p in (1, 2, 3) for m in range(10) for ph, b in (("early", 20), ("late", 6 if p == 1 else 5))]
    got = {(r.player, r.phase): r.balls for r in ratings.phase_score(cell_frame(spark, rows), "bat").collect()}
    assert got == {(1, "early"): 200, (2, "early"): 200, (3, "early"): 200, (1, "late"): 60}


def test_nearest_peer_in_grid_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([rng.random() * 100, 50.0, 100.0]), rng.random() ** 3 * 100, rng.random() < 0.5, rng.random() < 0.3) for i in range(120)] + [(500, None, 1.0, True, False)]
    df = spark.createDataFrame(rows, "player int, raw_x_pct double, raw_y_pct double, eligible boolean, is_focus boolean")
    got = {r.player: r.peer for r in ratings.nearest_peer(df).collect()}
    pool = [r for r in rows if r[3] and not r[4] and r[1] is not None]
    want = {a[0]: min(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in pool if b[0] != a[0])[1] for a in rows if a[1] is not None}
    assert got == want


def test_distribution_problems(spark):
    good = [("a", "x", r, w) for r, w in zip(matchups.RESULTS, (30, 30, 10, 15, 10, 5), strict=True)]
    bad = [("a", "y", "0", 120.0), ("a", "y", "1", -20.0), ("b", "x", "0", 50.0), *[("c", "x", r, w) for r, w in zip(matchups.RESULTS, (100.0, 0.0, 0.0, 0.0, 0.0, None), strict=True)]]
    bad += [("c", "y", r, w) for r, w in zip(matchups.RESULTS, (100.0, 0.0, 0.0, 0.0, float("inf"), float("nan")), strict=True)]
    weights = spark.createDataFrame([(*g[:3], float(g[3])) for g in good] + bad, "batting string, bowling string, result string, weight double")
    got = {(r.batting, r.bowling): list(r.problems) for r in matchups.validate_distribution(weights, ["a", "b", "c"], ["x", "y"]).collect()}
    assert got == {("a", "y"): ["keys", "weight"], ("b", "x"): ["keys", "total"], ("b", "y"): ["missing"], ("c", "x"): ["weight"], ("c", "y"): ["weight", "total"]}


def test_rank_as_of_with_delisting(spark):
    rows = [("men", "A", dt.date(2020, 1, 5), 3), ("men", "A", dt.date(2021, 2, 1), None), ("men", "B", dt.date(2021, 1, 1), 1)]
    history = spark.createDataFrame(rows, "gender string, team string, date date, rank int")
    got = {(r.team, str(r.as_of)): r["rank"] for r in rankings.rank_as_of(history, ["2019-12-28", "2020-12-28", "2021-12-28"]).collect()}
    assert got == {("A", "2019-12-28"): None, ("A", "2020-12-28"): 3, ("A", "2021-12-28"): None, ("B", "2019-12-28"): None, ("B", "2020-12-28"): None, ("B", "2021-12-28"): 1}


def test_rating_weights_by_age(spark):
    rows = [("men", "A", dt.date(2024, 6, 1), 100), ("men", "A", dt.date(2022, 6, 1), 40), ("men", "A", dt.date(2021, 1, 1), 999), ("men", "A", dt.date(2025, 1, 1), 999)]
    results = spark.createDataFrame(rows, "gender string, team string, date date, points long")
    dates = spark.createDataFrame([(dt.date(2024, 12, 28),)], "as_of date")
    (row,) = rankings.team_rating(results, dates).collect()
    assert (row.matches, row.rating) == (2, 80)
    assert rankings.published(rankings.team_rating(results, dates)).count() == 0


def test_venue_facets(spark):
    df = spark.createDataFrame([("N1", "P", "C", "A", 1.0, 2.0, ["m", "t"]), ("N2", "Q", "C", "A", 1.0, 2.0, None)], "n string, p string, c string, a string, lat double, lon double, u array<string>")
    count = lambda **k: venues.venue_search(df, **k).count()
    assert (count(), count(uses=("m", "t")), count(uses=("m", "x")), count(text=" n2 "), count(prefecture="P", text="n2")) == (2, 1, 0, 1, 0)
    facets = {(r.facet, r.value): r.n for r in venues.facet_counts(df).collect()}
    assert facets["all", "points"] == 1 and facets["use", "m"] == 1 and facets["all", "prefectures"] == 2


def test_scalars(spark):
    df = spark.createDataFrame([(1.5, "0.1", "2025/26", "x" * 25), (None, "0.10", "2025", "y" * 24)], "v double, b string, s string, t string")
    over, seq = sc.split_ball(F.col("b"))
    got = df.select(sc.fmt(F.col("v"), 1).alias("f"), over.alias("o"), seq.alias("q"), sc.season_year(F.col("s")).alias("y"), sc.short_label(F.col("t")).alias("t"), sc.norm_pct(F.col("v")).alias("p"), sc.norm_pct(F.col("v"), "fraction").alias("g")).collect()
    assert [(r.f, r.o, r.q, r.y) for r in got] == [("1.5", 0, 1, 2025), ("—", 0, 10, 2025)]
    assert got[0].t == "x" * 22 + "…" and got[1].t == "y" * 24 and got[0].p == 1.5 and got[0].g == 100 and got[1].p is None
    band = spark.createDataFrame([(799, True), (800, True), (400, True), (399, True), (900, False)], "b int, e boolean").select(sc.sample_band(F.col("b"), 200, F.col("e")).alias("x")).collect()
    assert [r.x for r in band] == ["medium", "large", "medium", "small", "below"]
    flags = spark.createDataFrame([("TRUE",), ("yes",), ("1",), (None,)], "v string").select(sc.truthy(F.col("v")).alias("x")).collect()
    assert [r.x for r in flags] == [True, True, False, False]


def test_label_budget_shares_one_counter(spark):
    rows = [(i, False, True, 99.0 - i / 10) for i in range(8)] + [(100 + i, True, True, float(i)) for i in range(12)] + [(200, True, False, 100.0), (201, False, False, 100.0)]
    df = spark.createDataFrame(rows, "player int, is_focus boolean, eligible boolean, raw_overall double")
    got = [r.player for r in serve.label_budget(df).orderBy("position").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 111, 110, 109, 108]


def test_find_whole_names(spark):
    df = spark.createDataFrame([(24912, "Player 24912", "選手24912", True), (249, "Player 249", "選手249", False), (12, "Player 12", "Player 12", True)], "player int, latin_name string, display_name string, is_focus boolean")
    found = lambda q, **kw: [r.player for r in serve.find_player(df, q, **kw).collect()]
    assert found("player 249") == [24912] and found("player 249", whole=True) == found("layer", whole=True) == found(" ", whole=True) == []
    assert found(" PLAYER 12", whole=True) == [12] and found("選手24912", whole=True) == [24912]


def test_find_and_leaders(spark):
    df = spark.createDataFrame([(2, "Ann Lee", "Ann Lee", "x", True), (1, "Joann Lee", "Joann Lee", "x", True), (0, "Ann Lee", "Lee", "x", False)], "player int, latin_name string, display_name string, country string, is_focus boolean")
    assert [serve.find_player(df, q).first()[0] for q in ("ann lee", "LEE", "jo")] == [2, 1, 1] and serve.find_player(df, "zz").count() == 0
    assert serve.find_player(df, "").count() == serve.find_player(df, "  ").count() == 0
    assert {r.name for r in serve.name_index(df).collect()} == {"Ann Lee", "Joann Lee"}
    df = df.where("is_focus")
    leaders = spark.createDataFrame([({"bat_adjusted": [2], "bat": [1]},)], "lists map<string,array<int>>")
    flags = lambda mode: {r.player: r.is_leader for r in serve.leader_flag(df, leaders, "bat", mode).collect()}
    assert flags("adjusted") == {1: False, 2: True} and flags("raw") == {1: True, 2: False}


RATED = "player int, display_name string, latin_name string, country string, is_focus boolean, eligible boolean, innings int, balls int, raw_x_pct double, raw_y_pct double, raw_overall double"


def rated_rows(spark):
    rows = [
        (1, "A", "A", "JAPAN", True, True, 5, 9, 90.0, 10.0, 50.0), (2, "B", "B", "JAPAN", True, False, 5, 9, 99.0, 99.0, 99.0), (3, "C", "C", "X", False, True, 5, 9, 80.0, 80.0, 80.0),
        (4, "D", "D", "X", False, False, 5, 9, 70.0, 70.0, 70.0), (5, "E", "E", "JAPAN", True, True, 5, 9, 20.0, 90.0, 55.0), (6, "F", "F", "JAPAN", True, True, 5, 9, None, 90.0, None), (7, "G", "G", "X", False, True, 5, 9, 60.0, 60.0, 60.0),
    ]
    return spark.createDataFrame(rows, RATED)


def test_lists_of_readers(spark):
    df = rated_rows(spark)
    assert [(r.player, r.total) for r in serve.directory_page(df).collect()] == [(5, 5), (1, 5), (2, 5), (3, 5), (7, 5)]
    assert [(r.player, r.total) for r in serve.directory_page(df, 2, 1, " japan").collect()] == [(1, 3), (2, 3)]
    assert serve.directory_page(df, q="zz").count() == 0
    assert serve.insights(df).collect() == [(5, 1)]
    assert [r.player for r in serve.spotlight(df).collect()] == [5, 1]
    assert [r.player for r in serve.label_budget(df, top=70).orderBy("position").collect()] == [3, 5, 1]


def test_fmt_groups_digits(spark):
    df = spark.createDataFrame([(1234567.891,), (-1234.5,), (999.0,), (None,), (-0.001,), (0.005,)], "v double")
    assert [tuple(r) for r in df.select(sc.fmt(F.col("v"), 2), sc.fmt(F.col("v"), 0)).collect()] == [("1,234,567.89", "1,234,568"), ("-1,234.50", "-1,235"), ("999.00", "999"), ("—", "—"), ("0.00", "0"), ("0.01", "0")]


def test_scope_meta(spark):
    schema = "match_id int, innings int, striker int, bowler int, batting_country string, bowling_country string, over_no int, runs_off_bat int, extras int, wides int, noballs int, wicket_type string"
    rows = [(m, 1, 1, 2, "A" if m < 3 else "C", "B", 0, 1, 0, 0, 0, None) for m in (1, 1, 2, 3)] + [(3, 2, 2, 1, "B", "C", 7, 0, 0, 0, 0, "bowled")]
    dates = spark.createDataFrame([(m, dt.date(2024, 1, m)) for m in (1, 2, 3)], "match_id int, date date")
    (r,) = totals.scope_meta(deliveries.delivery_flags(spark.createDataFrame(rows, schema)), "A", dates, min_innings=2, min_balls=2, min_wickets=0).collect()
    assert (r.matches, r.deliveries, r.first_date, r.last_date) == (3, 5, dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    assert (r.focus_matches, r.focus_last_date, r.players, r.focus_players) == (2, dt.date(2024, 1, 2), 2, 1)
    assert (r.eligible_batters, r.eligible_bowlers) == (1, 1)


def test_time_off_the_list(spark):
    day = lambda m, d: dt.date(2022, m, d)
    rows = [("men", "A", day(1, 1), 50), ("men", "A", day(3, 1), 48), ("men", "A", day(9, 27), None), ("men", "A", day(10, 2), None), ("men", "A", day(11, 26), 51), ("men", "A", day(12, 28), 53)]
    got = rankings.rank_change(spark.createDataFrame(rows, "gender string, team string, date date, rank int")).orderBy("date").collect()
    assert [(r.step, r.days_since, r.gained, r.days_off) for r in got] == [(None, None, 0, 0), (2, 59, 2, 0), (None, 210, None, None), (None, 215, None, None), (-3, 270, -1, 60), (-2, 32, -3, 0)]


def test_rating_periods_of_the_annual_update(spark):
    rows = [("men", "A", dt.date(2025, 5, 1), 100), ("men", "A", dt.date(2025, 4, 30), 40), ("men", "A", dt.date(2023, 5, 1), 10), ("men", "A", dt.date(2023, 4, 30), 999), ("men", "A", dt.date(2026, 7, 1), 60)]
    results = spark.createDataFrame(rows, "gender string, team string, date date, points long")
    dates = spark.createDataFrame([(dt.date(2026, 7, 24),), (dt.date(2026, 4, 30),)], "as_of date")
    got = {str(r.as_of): (r.matches, r.rating) for r in rankings.team_rating(results, dates, update_month=5).collect()}
    # after the update: 100 and 60 in full, 40 and 10 by half; before it the year runs from May 2024 and the rest from May 2022
    assert got == {"2026-07-24": (4, 62), "2026-04-30": (4, round((2 * 100 + 2 * 40 + 10 + 999) / 6))}


def test_folded_peers_of_one_point(spark):
    rows = [(3, 50.0, 50.0, True, False), (1, 50.0, 50.0, True, False), (2, 50.0, 50.0, True, False), (9, 50.0, 50.0, False, True), (4, 51.0, 50.0, True, False), (5, None, 1.0, True, False)]
    df = spark.createDataFrame(rows, "player int, raw_x_pct double, raw_y_pct double, eligible boolean, is_focus boolean")
    assert {r.player: (r.peer, r.distance2) for r in ratings.nearest_peer(df).collect()} == {1: (2, 0), 2: (1, 0), 3: (1, 0), 9: (1, 0), 4: (1, 1)}
    assert ratings.nearest_peer(df.where("player = 1")).count() == 0
