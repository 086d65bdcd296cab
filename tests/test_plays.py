"""Hand-computed play columns."""

import pytest
from pyspark.sql import functions as F

from priorline.functions import odds, plays as P, regimes, stats

COLUMNS = "play_type STRING, yards DOUBLE, down INT, yards_to_first DOUBLE, yards_to_goal DOUBLE, yard_line DOUBLE"


def one(spark, row, *columns):
    df = spark.createDataFrame([row], COLUMNS)
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize("row,expected", [
    (("Rush", 5.0, 1, 10.0, 50.0, 50.0), 1.0),       # half of ten on first down
    (("Rush", 4.0, 1, 10.0, 50.0, 50.0), 0.0),
    (("Rush", 7.0, 2, 10.0, 50.0, 50.0), 1.0),       # seventy percent on second
    (("Pass", 9.0, 3, 10.0, 50.0, 50.0), 0.0),       # all of it on third
    (("Pass", 2.0, 3, 10.0, 2.0, 98.0), 1.0),        # the goal is nearer than the marker
    (("Rush", 1.0, 1, 0.0, 2.0, 98.0), 1.0),         # goal to go
    (("Interception", 0.0, 1, 10.0, 50.0, 50.0), 0.0),
    (("Penalty", 5.0, 1, 10.0, 50.0, 50.0), None),
])
def test_success(spark, row, expected):
    assert one(spark, row, P.success()) == (expected,)


@pytest.mark.parametrize("play,yards,expected", [
    ("Rush", 15.0, 1.0), ("Rush", 14.0, 0.0), ("Pass", 19.0, 0.0), ("Pass", 20.0, 1.0), ("Safety", 30.0, 0.0), ("Punt", 40.0, None)])
def test_explosive(spark, play, yards, expected):
    assert one(spark, (play, yards, 1, 10.0, 50.0, 50.0), P.explosive()) == (expected,)


@pytest.mark.parametrize("yards,line,second,open_", [(-2.0, -2.4, 0.0, 0.0), (4.0, 4.0, 0.0, 0.0), (8.0, 6.0, 3.0, 0.0), (14.0, 7.0, 5.0, 4.0)])
def test_rush_yards(spark, yards, line, second, open_):
    got = one(spark, ("Rush", yards, 1, 10.0, 50.0, 50.0), P.line_yards(), P.second_level_yards(), P.open_field_yards())
    assert got == pytest.approx((line, second, open_))


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (20.5,), (100.0,), (101.0,), (None,)], "yard_line DOUBLE")
    got = [r[0] for r in df.select(P.right_closed_bin("yard_line", *P.FIELD_POSITION)).collect()]
    assert got == [None, "Own Red Zone", "Own", "Red Zone", None, None]


def test_normal_cdf_matches_math(spark):
    import math
    zs = [x / 10 for x in range(-80, 81)]
    df = spark.createDataFrame([(z,) for z in zs], "z DOUBLE").select("z", stats.normal_cdf(F.col("z")).alias("p"))
    for z, p in df.collect():
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-15)


def test_prices(spark):
    df = spark.createDataFrame([(150,), (-120,), (None,)], "p INT")
    assert [r[0] for r in df.select(odds.profit_per_unit(F.col("p"))).collect()] == pytest.approx([1.5, 100 / 120, 1 / 1.1])
    with pytest.raises(Exception, match="cannot be zero"):
        spark.createDataFrame([(0,)], "p INT").select(odds.profit_per_unit(F.col("p"))).collect()


def test_routes(spark):
    df = spark.createDataFrame([(None, "preseason"), (0, "game_2"), (3, "three_games"), (9, "nonsense")], "n INT, s STRING")
    got = df.select(regimes.upcoming_route(F.col("n")), regimes.canonical_route(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("game_1", "game_1"), ("game_1", "game_2"), ("game_4", "game_4"), ("established", None)]


def test_unknown_point_stays_unknown(spark):
    from priorline.functions.geo import distance_km
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0)], "lat DOUBLE, lon DOUBLE")
    got = [r[0] for r in df.select(distance_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(2.0))).collect()]
    assert got[0] is None and got[1] == pytest.approx(111.3195, abs=0.001)


def test_distance_is_that_of_published_geodesics(spark):
    from priorline.functions.geo import distance_km, great_circle_km
    dms = lambda d, m, s: d + m / 60 + s / 3600
    points = [(-dms(37, 57, 3.72030), dms(144, 25, 29.52440), -dms(37, 39, 10.15610), dms(143, 55, 35.38390), 54.972271),  # Flinders Peak to Buninyong
              (0.0, 0.0, 0.0, 1.0, 111.319491),  # a degree of the equator
              (0.0, 0.0, 90.0, 0.0, 10001.965729),  # a quarter of a meridian
              (0.0, 179.5, 0.0, -179.5, 111.319491),  # across the date line
              (12.0, 34.0, 12.0, 34.0, 0.0)]
    df = spark.createDataFrame(points + [(0.0, 0.0, 0.5, 179.7, -1.0), (1.0, None, 2.0, 3.0, None)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, km DOUBLE")
    columns = [F.col(c) for c in "abcd"]
    got = df.select("km", distance_km(*columns).alias("got"), great_circle_km(*columns).alias("round")).collect()
    for r in got[:5]:
        assert r["got"] == pytest.approx(r["km"], abs=0.001)
    assert got[5]["got"] == got[5]["round"] and got[6]["got"] is None  # nearly opposite points, an unknown one


def test_many_distances_are_quick(spark):
    import time
    from priorline.functions.geo import distance_km
    x = F.col("id")
    df = spark.range(400_000).select(distance_km(x * 7 % 120 - 60.0, x * 13 % 300 - 150.0, x * 11 % 120 - 60.0, x * 17 % 300 - 150.0).alias("km"))
    df.limit(1).collect()
    start = time.perf_counter()
    assert df.agg(F.count("km")).first()[0] == 400_000
    assert time.perf_counter() - start < 20
