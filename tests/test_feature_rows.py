"""Rows the predictions start from: what passes through Python, how the latest values are found, how they are rounded."""

import random

import pytest
from pyspark.sql import functions as F

from hoopspark.functions import windows
from hoopspark.operators import predictions
from hoopspark.registry import bind, outlook

KEYS, ORDER = ["team", "p"], ["d", "g"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    value = lambda: None if draw.random() < 0.4 else round(draw.random(), 3)
    data = [(draw.choice(["a", "b", None]), p, None if n == 0 else n // 2, n, value(), draw.choice(["x", "y", None])) for p in (1, 2, 3, None) for n in range(12)]
    return spark.createDataFrame(data, "team string, p long, d int, g long, v double, name string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_in_series_equals_latest_values(rows):
    got = windows.latest_in_series(rows, KEYS, ORDER, ["name", "v", "g"])
    want = windows.latest_values(rows, KEYS, ORDER, ["name", "v", "g"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert windows.latest_in_series(rows.limit(0), KEYS, ORDER, ["v"]).count() == 0


def test_current_players_of_rows_hashed_by_player_are_not_shuffled(rows):
    named = rows.selectExpr("team AS teamTricode", "p AS personId", "d AS game_date", "g AS gameId", "3 AS season", "v", "name")
    latest = plan(predictions.current_players(named.repartition("personId"), 3, cols=["v", "name"]))
    assert latest.count("Exchange") == 1 and "SortAggregate" not in latest


def test_rows_of_predictions_carry_only_what_is_read_through_python(spark):
    shown_fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        shown = plan(outlook.rated_rows(bind.season_tables(spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown_fields)
    carried = next(line for line in shown.splitlines() if "MapInArrow" in line)
    assert "pts_ewma" in carried
    assert not any(c in carried for c in ("_x_", "_stint_ewma", "fg3_pct", "pts_per36", "team_poss"))


def test_settled_values_are_those_of_decimal_rounding(spark):
    draw = random.Random(9)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(-9, 14) for _ in range(4000)] + [k / 2e6 for k in range(-301, 301)]
    values += [0.0, -0.0, -1e-9, 1e9, -1e9, 1e300, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    both = bind.settle(df, "x").select(F.col("x").alias("got")).collect()
    want = df.select(F.round(F.col("x") + bind.OFF_TIE, 6).alias("want")).collect()
    assert [str(r[0]) for r in both] == [str(r[0]) for r in want]
    assert "rint" in bind.settle(df, "x")._jdf.queryExecution().analyzed().toString().lower()
