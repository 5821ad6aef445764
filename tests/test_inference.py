"""Coefficient tables and resampled errors against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoopspark.operators import inference, models
from hoopspark.session import written


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, .2] + [0, 2, 1]
    y = (x[:, 0] + .2 * x[:, 1] + rng.logistic(size=300) > .5).astype(int)
    made = [(1, i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(made, "season int, gameId long, a double, b double, c double, home_win int").repartition(3)


def test_coefficients_equal_a_newton_fit(rows):
    x, y, table = rows
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0, ddof=1)])
    penalty, beta = np.diag([0, 1, 1, 1]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        information = (z * (p * (1 - p))[:, None]).T @ z + penalty
        beta += inference.inverse(information) @ (z.T @ (y - p) - penalty @ beta)
    got = models.win_coefficients(table, list("abc"), 1).collect()
    assert [r["feature"] for r in got] == ["(intercept)", "a", "b", "c"]
    assert np.allclose([r["coefficient"] for r in got], beta, atol=1e-5)
    assert np.allclose([r["error"] for r in got], np.sqrt(np.diag(inference.inverse(information))), rtol=1e-5)
    assert all(r["low"] < r["coefficient"] < r["high"] for r in got)


def test_inverse():
    a = np.random.default_rng(1).normal(size=(40, 40))
    a = a @ a.T + np.eye(40)
    assert np.allclose(inference.inverse(a) @ a, np.eye(40), atol=1e-8)


def weight(replicate, day):
    share = int(hashlib.md5(f"{replicate}|{day}".encode()).hexdigest()[:8], 16) / 2 ** 32
    return sum(share >= limit for limit in inference.POISSON)


def test_days_are_drawn_whole_and_alike_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    made = [("m", f"2024-01-{1 + i % 20:02d}", float(e)) for i, e in enumerate(rng.gamma(2, size=400))]
    table = written(spark.createDataFrame(made, "model string, day string, e double").select("model", F.to_date("day").alias("game_date"), "e"))
    got = [inference.resampled_errors(table.repartition(n), ["model"], {"mae": F.col("e")}).first() for n in (1, 7)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got[0][1:], got[1][1:]))
    means = []
    for r in range(1, inference.REPLICATES + 1):
        w = np.array([weight(r, day) for _, day, _ in made])
        means.append(w @ [e for *_, e in made] / w.sum())
    assert abs(got[0]["mae"] - np.mean([e for *_, e in made])) < 1e-9 and abs(got[0]["mae_error"] - np.std(means, ddof=1)) < 1e-9
    assert abs(got[0]["mae_low"] - np.percentile(means, 2.5)) < 1e-9 and got[0]["n"] == 400


def test_weights_are_poisson():
    w = [weight(r, "2024-01-01") for r in range(4000)]
    assert abs(np.mean(w) - 1) < .06 and abs(np.var(w) - 1) < .1
