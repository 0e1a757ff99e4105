"""Values that were published, from the totals that were published with them."""

import pytest
from pyspark.sql import functions as F

from willowfold.functions.scalars import badges
from willowfold.operators.ratings import two_axis_overall
from willowfold.operators.totals import batting_rates, bowling_rates

# A batter's balls, runs and outs with average and strike rate; a bowler's balls, runs and wickets with economy and wickets per 100 balls.
BATTER = (1278, 1779, 46, 38.7, 139.2)
BOWLER = (328, 216, 20, 4.0, 6.1)
#: The bowler's percentiles on both axes, and the overall that was stored; their mean, 80.55, is not what was.
AXES = (100.0, 61.1, 80.5)


def frame(spark, row):
    return spark.createDataFrame([row[:3]], "balls long, runs long, outs long")


def test_published_rates(spark):
    bat, bowl = batting_rates(frame(spark, BATTER)).first(), bowling_rates(frame(spark, BOWLER)).first()
    assert (round(bat.average, 1), round(bat.strike_rate, 1)) == BATTER[3:]
    assert (round(bowl.economy, 1), round(bowl.wickets_per_100, 1)) == BOWLER[3:]


@pytest.mark.parametrize("stored, want", [(80.5, 80.5), (None, 80.55)])
def test_a_stored_overall_goes_first(spark, stored, want):
    rows = spark.createDataFrame([(*AXES[:2], stored), (None, 61.1, stored), (100.0, None, None)], "x double, y double, stored double")
    got = [r.o for r in rows.select(two_axis_overall(F.col("x"), F.col("y"), F.col("stored")).alias("o")).collect()]
    assert got[0] == pytest.approx(want) and got[1] == stored and got[2] is None


def test_badges_in_their_order(spark):
    rows = spark.createDataFrame([(75.0, 74.9, None, 75.0, 100.0), (None, None, None, None, None), (10.0, 90.0, 80.0, 0.0, 74.999)], "x double, y double, early double, middle double, late double")
    got = [r.b for r in rows.select(badges(*[(c, F.col(c)) for c in rows.columns]).alias("b")).collect()]
    assert got == [["x", "middle", "late"], [], ["y", "early"]]
