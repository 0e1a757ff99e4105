"""A match as state: order of arrival, replays, ends of innings, restarts, lateness and what is kept."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from willowfold.operators import innings
from willowfold.streaming import innings_state as st
from willowfold.streaming import scoreboard

START = dt.datetime(2024, 1, 1)


def script(results, match=1, innings_no=1, minute=0):
    """Rows of one innings from letters: a digit scores, W is out, w is a wide of one run."""
    return [(match, innings_no, i, START + dt.timedelta(minutes=minute + i), 0 if r == "W" else 1 if r == "w" else int(r), r == "W", r != "w", i == len(results) - 1) for i, r in enumerate(results)]


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, st.BALL).coalesce(1).write.mode(mode).parquet(path)


def play(spark, tmp_path, steps, balls=6, wickets=2, **options):
    """Feed the steps one after another, a query each, as if it were started again every time."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    query = None
    for rows in steps:
        write(spark, source, rows)
        query = st.run(spark, source, out, check, balls, wickets, files=1, **options)
        query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(out).drop("batch").collect()], query


def balls_of(rows, match=1):
    return sorted(r[1:3] + r[4:] for r in rows if r[3] == "ball" and r[0] == match)


# Rules of the game of six balls and two wickets, and what they end in.
GOLDEN = [
    ("111111", "", [(1, 5, 6, 0, 6)], 7, None),  # six balls end the first innings, the target is one more
    ("WW1111", "", [(1, 1, 0, 2, 2)], 1, None),  # so do two wickets
    ("100000", "2", [(2, 0, 2, 0, 1)], 2, True),  # the chase ends with the ball that reaches the target
    ("200000", "200000", [(2, 5, 2, 0, 6)], 3, False),  # equal scores: not reached
    ("000000", "WW", [(2, 1, 0, 2, 2)], 1, False),
]


@pytest.mark.parametrize("first, second, ends, target, reached", GOLDEN)
def test_golden_rules(spark, tmp_path, first, second, ends, target, reached):
    rows, _ = play(spark, tmp_path, [script(first + "444") + script(second + "444" * bool(second), innings_no=2, minute=50)])
    got = balls_of(rows)
    last = {n: max((r for r in got if r[0] == n), default=None) for n in (1, 2)}
    for n, seq, score, wickets, balls in ends:
        assert last[n][:5] == (n, seq, score, wickets, balls)
    if second:
        assert last[2][5] == target and (last[2][2] >= target) == reached and last[2][6] == max(0, target - last[2][2])


def log(seed, n_matches=6):
    rng = random.Random(seed)
    letters = "0000111112446Ww"
    return [r for m in range(n_matches) for n in (1, 2) for r in script("".join(rng.choices(letters, k=20)), m, n, 60 * m + 25 * n)]


def test_disorder_and_restarts_equal_the_batch(spark, tmp_path):
    rows = log(1)
    batch = spark.createDataFrame(rows, st.BALL).withColumns({"over_no": F.floor(F.col("seq") / 6), "ball_no": F.col("seq") % 6})
    cut = innings.innings_cutoff(batch, 12, 4)
    needed = F.when(F.col("innings") == 2, F.greatest(F.lit(0), F.col("target") - F.col("score")))
    want = sorted(tuple(r) for r in cut.select("match_id", "innings", "seq", "score", "wickets", "balls", F.when(F.col("innings") == 2, F.col("target")), needed, 12 - F.col("balls")).collect())
    rng = random.Random(2)
    mixed = rng.sample(rows + rng.sample(rows, 40), len(rows) + 40)
    size = len(mixed) // 5 + 1
    got, query = play(spark, tmp_path, [mixed[i : i + size] for i in range(0, len(mixed), size)], 12, 4, delay="1000 hours")
    assert sorted((r[0], *r[1:3], *r[4:]) for r in got if r[3] == "ball") == want
    assert sum(r[3] == "replay" for r in got) <= 40
    # one count for each innings, a last time and a timer a match, and nothing that waits: every innings has ended
    assert st.state_rows(query) <= 6 * 6
    shutil.rmtree(tmp_path / "out")
    whole, _ = play(spark, tmp_path / "again", [mixed], 12, 4, delay="1000 hours")
    assert sorted((r[0], *r[1:3], *r[4:]) for r in whole if r[3] == "ball") == want


def test_finished_matches_are_forgotten_and_late_balls_counted(spark, tmp_path):
    first = script("111111", 1) + script("2222", 1, 2, 10)
    later = script("1", 2, minute=600)
    last = script("1", 3, minute=1300)
    late = [script("111111", 1)[3], script("6", 9)[0]]  # a ball of a match that is forgotten, and of one never seen
    rows, query = play(spark, tmp_path, [first, later, late + last, script("1", 4, minute=1400)], delay="10 minutes", idle_ms=300 * 60_000)
    ends = {r[0]: r[3] for r in rows if r[3] in ("finished", "abandoned")}
    assert ends[1] == "finished" and ends[2] == "abandoned" and 9 not in ends
    assert not [r for r in rows if r[0] == 9] and len(balls_of(rows)) == 10
    assert st.late_rows(query) == 0  # in the last run; those two were counted in the run before
    assert st.state_rows(query) <= 2 * 6


def test_scoreboard_by_event_time(spark, tmp_path):
    """Replays within the delay count once, rows behind the watermark not at all, and matches are joined to the totals."""
    schema = f"{scoreboard.DELIVERY}, time timestamp"
    day = lambda n: START + dt.timedelta(days=n)
    steps = [
        [(1, 1, 0, b, 1, False, True, day(0)) for b in range(6)],
        [(1, 1, 0, 0, 1, False, True, day(1)), (2, 1, 0, 0, 4, False, True, day(1))],  # a replay of the day before
        [(3, 1, 0, 0, 2, True, True, day(5))],
        [(2, 1, 0, 0, 4, False, True, day(5))],  # a batch later rows are told late by the watermark that this one began with
        [(1, 1, 7, 0, 6, False, True, day(0)), (3, 1, 0, 1, 1, False, False, day(5))],  # the first is five days late
    ]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    matches = spark.createDataFrame([(1, "a"), (3, "c")], "match_id long, venue string")
    query = scoreboard.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), ("time", "36 hours"), 1, matches)
    query.awaitTermination()
    got = sorted(map(tuple, scoreboard.latest(spark, str(tmp_path / "out"), "venue").collect()))
    assert got == [(1, 1, 6, 0, 6, "a"), (2, 1, 4, 0, 1, None), (3, 1, 3, 1, 1, "c")]
    assert st.late_rows(query) >= 1
    # without a watermark the late row counts, and keys of all balls are kept
    plain = scoreboard.scoreboard(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    done = plain.writeStream.outputMode("complete").format("memory").queryName("plain_board").trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted((r.match_id, r.score) for r in spark.table("plain_board").collect()) == [(1, 12), (2, 4), (3, 3)]
