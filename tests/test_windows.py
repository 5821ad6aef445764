import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hoopspark.functions import scalars, windows


def frame(spark, n_keys=3, rows=60, seed=1, nulls=0.25):
    rng = random.Random(seed)
    data = [(k, i * 7 + rng.randrange(5), None if rng.random() < nulls else float(rng.randrange(100))) for k in range(n_keys) for i in range(rows)]
    return spark.createDataFrame(data, "k int, t bigint, x double")


def test_weighted_mean_matches_pandas_over_null_gaps(spark):
    df = frame(spark, rows=300)
    got = windows.ewma_means(df, ["k"], ["t"], ["x"]).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = got.groupby("k")["x"].transform(lambda s: s.shift(1).ewm(alpha=0.3, adjust=False, min_periods=1).mean())
    assert got["x_ewma"].isna().equals(want.isna())
    assert (got["x_ewma"] - want).abs().max() < 1e-9


def test_weighted_mean_carries_over_block_boundaries(spark):
    rng = random.Random(5)
    data = [(0, i, None if 500 < i < 1800 or rng.random() < 0.3 else rng.random()) for i in range(4000)]
    df = spark.createDataFrame(data, "k int, t bigint, x double")
    got = windows.ewma_means(df, ["k"], ["t"], ["x"]).toPandas().sort_values("t").reset_index(drop=True)
    want = got["x"].shift(1).ewm(alpha=0.3, adjust=False, min_periods=1).mean()
    assert got["x_ewma"].isna().equals(want.isna())
    assert (got["x_ewma"] - want).abs().max() < 1e-9


def test_weighted_mean_forgets_over_gaps_of_any_length(spark):
    gaps = [1, 50, 1500, 1995, 2000, 2050, 2200, 5000]
    data = [(g, t, x) for g in gaps for t, x in [(0, 10.0), *((i + 1, None) for i in range(g)), (g + 1, 20.0), (g + 2, 1.0)]]
    got = {r.k: r.x_ewma for r in windows.ewma_means(spark.createDataFrame(data, "k int, t bigint, x double"), ["k"], ["t"], ["x"]).where("x = 1").collect()}
    for g in gaps:
        d = 0.7 ** (g + 1)
        assert abs(got[g] - (d * 10 + 0.3 * 20) / (d + 0.3)) < 1e-9


def test_exact_ratio_rounds_ties_to_even(spark):
    pairs = [(n, d) for n in (-2013, -5, 0, 1, 5, 15, 25, 69, 2012, 2013, 12345) for d in (-8, -3, 0, 1, 8, 16, 40, 200, 6000)]
    rows = spark.createDataFrame(pairs, "n long, d long").withColumn("q", scalars.exact_ratio("n", "d", 3)).collect()
    for r in rows:
        assert r.q == (None if r.d == 0 else float(round(Fraction(r.n, r.d), 3)))


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before_is_the_same_in_ranges(spark, inclusive):
    df = frame(spark)
    whole = windows.last_before(df, ["k"], "t", {"last": F.col("x")}, None, inclusive)
    split = windows.last_before(df, ["k"], "t", {"last": F.col("x")}, 50, inclusive)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_running_state_is_the_same_in_ranges(spark):
    df = frame(spark, nulls=0)
    whole = windows.running_state(df, ["k"], "t", {"s": "x"}, {"next_t": "t", "next_x": "x"})
    split = windows.running_state(df, ["k"], "t", {"s": "x"}, {"next_t": "t", "next_x": "x"}, 30)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_trailing_means_leave_the_row_out_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, 9.0)], "k int, t int, x double")
    rows = {r.t: r.x_roll3 for r in windows.trailing_means(df, ["k"], ["t"], ["x"], [3]).collect()}
    assert rows == {1: None, 2: 2.0, 3: 2.0, 4: 3.0}


def test_latest_values_are_per_column(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, None, 6), (1, 3, "c", None)], "k int, t int, a string, b int")
    row = windows.latest_values(df, ["k"], ["t"], ["a", "b"]).first()
    assert (row.a, row.b) == ("c", 6)


def test_change_runs_return_to_the_old_team(spark):
    df = spark.createDataFrame([(1, t, team) for t, team in enumerate([7, 7, 9, 7, 7, 7])], "p int, t int, team int")
    rows = windows.change_runs(df, ["p"], ["t"], "team", "run", "n").orderBy("t").collect()
    assert [(r.run, r.n) for r in rows] == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (2, 3)]
