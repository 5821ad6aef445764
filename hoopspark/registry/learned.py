"""Evaluation tables, models and streams."""

from __future__ import annotations

from functools import partial

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hoopspark.operators import artefacts, elo, evaluation, inference, models
from hoopspark.operators.columns import game_model_columns, player_model_columns
from hoopspark.registry.bind import BOX, EV, PBP, actions, box, events, r6, settle, settled
from hoopspark.registry.core import query
from hoopspark.registry.court import COUNTERS, DEFENCE, SHOTS
from hoopspark.registry.play import MEAN_COLS, game_scores, game_table
from hoopspark.registry.series import ELO, EWMA, FEAT, MATRIX, POINTS, SEASON, games_with_league, matrix, rounded
from hoopspark.session import work_folder, written
from hoopspark.streaming import live

FOLD_SQL = """fo AS (SELECT *, row_number() OVER (ORDER BY game_date, gameId, personId) - 1 AS place, count(*) OVER () AS n, count(*) OVER () // 6 AS size FROM box)"""


@query("temporal_folds", f"WITH {BOX}, {FOLD_SQL} SELECT gameId, personId, CASE WHEN place < n - 5 * size THEN 0 ELSE 1 + (place - (n - 5 * size)) // size END::INTEGER AS fold FROM fo")
def temporal_folds(spark, sf):
    rows = box(spark, sf).select("gameId", "personId", "game_date")
    return evaluation.expanding_folds(rows, ["gameId", "personId"], 5).select("gameId", "personId", "fold")


def naive_rows(spark, sf):
    """Two simple predictors of the next game, recent form and season mean, against a constant."""
    rows = settle(matrix(spark, sf), *EWMA, *SEASON).where("season > 1")
    parts = [F.struct(F.lit(name).alias("model"), F.lit(t).alias("target"), F.col(t).cast("double").alias("actual"),
                      F.coalesce(F.col(f"{t}_{c}"), F.lit(0.0)).alias("predicted"), F.lit(base).alias("baseline"))
             for t, base in (("pts", 4.0), ("reb", 3.0), ("ast", 0.5), ("min", 20.0)) for name, c in (("form", "ewma"), ("season", "season_avg"))]
    return rows.select("game_date", F.explode(F.array(*parts)).alias("p")).select("game_date", "p.*")


NAIVE = f"""WITH RECURSIVE {MATRIX}, m6 AS MATERIALIZED (SELECT season, game_date, pts, reb, ast, min, {settled(EWMA + SEASON)} FROM matrix WHERE season > 1),
naive AS ({' UNION ALL '.join(f"SELECT game_date, '{n}' AS model, '{t}' AS target, {t}::DOUBLE AS actual, coalesce({t}_{c}, 0) AS predicted, {b}::DOUBLE AS baseline FROM m6" for t, b in (('pts', 4.0), ('reb', 3.0), ('ast', 0.5), ('min', 20.0)) for n, c in (('form', 'ewma'), ('season', 'season_avg')))}),
errs AS (SELECT model, target, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(baseline - actual)) AS baseline_mae, count(*) AS n FROM naive GROUP BY model, target)"""
ERRS = ["mae", "rmse", "baseline_mae"]


@query("regression_errors", f"{NAIVE} SELECT model, target, n, {rounded(ERRS)}, round(100 * (baseline_mae - mae) / baseline_mae, 6) AS improvement_pct FROM errs")
def regression_errors(spark, sf):
    return r6(evaluation.regression_errors(naive_rows(spark, sf), ["model", "target"]), *ERRS, "improvement_pct")


def interval_sql(rows: str, keys: str, measures: dict[str, str]) -> str:
    """Errors over resampled days: the same hash weights and replicates."""
    share = "(CAST('0x' || substr(md5(r || '|' || game_date), 1, 8) AS BIGINT) / 4294967296::DOUBLE)"
    weight = " + ".join(f"CAST({share} >= {p!r}::DOUBLE AS INTEGER)" for p in inference.POISSON)
    return f"""dy AS (SELECT {keys}, game_date, count(*) AS n, {', '.join(f'sum({e}) AS {m}' for m, e in measures.items())} FROM {rows} GROUP BY ALL),
      dr AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {weight} END AS w FROM (SELECT *, unnest(range(0, {inference.REPLICATES + 1})) AS r FROM dy)),
      rp AS (SELECT {keys}, r, sum(w * n) AS n, {', '.join(f'sum(w * {m}) / sum(w * n) AS {m}' for m in measures)} FROM dr WHERE w > 0 GROUP BY {keys}, r)
      SELECT {keys}, CAST(max(n) FILTER (r = 0) AS BIGINT) AS n, {', '.join(f"round(max({m}) FILTER (r = 0), 6) AS {m}, round(stddev_samp({m}) FILTER (r > 0), 6) AS {m}_error, round(quantile_cont({m}, 0.025) FILTER (r > 0), 6) AS {m}_low, round(quantile_cont({m}, 0.975) FILTER (r > 0), 6) AS {m}_high" for m in measures)}
      FROM rp GROUP BY {keys}"""


def spread(*measures: str) -> list[str]:
    return [f"{m}{s}" for m in measures for s in ("", "_error", "_low", "_high")]


@query("regression_error_intervals", f"{NAIVE}, {interval_sql('naive', 'model, target', {'mae': 'abs(predicted - actual)', 'gain': 'abs(baseline - actual) - abs(predicted - actual)'})}")
def regression_error_intervals(spark, sf):
    off, base = F.abs(F.col("predicted") - F.col("actual")), F.abs(F.col("baseline") - F.col("actual"))
    return r6(inference.resampled_errors(naive_rows(spark, sf), ["model", "target"], {"mae": off, "gain": base - off}), *spread("mae", "gain"))


@query("best_model_per_target", f"{NAIVE} SELECT target, arg_min(model, (mae, model)) AS model, round(min(mae), 6) AS mae FROM errs GROUP BY target")
def best_model_per_target(spark, sf):
    return r6(evaluation.best_models(evaluation.regression_errors(naive_rows(spark, sf), ["model", "target"])), "mae")


@query("results_pivot", f"""{NAIVE} SELECT target, {', '.join(f"round_even(max({e}) FILTER (model = '{m}'), 3) AS {m}_{e}" for m in ('form', 'season') for e in ('mae', 'rmse'))} FROM errs GROUP BY target""")
def results_pivot(spark, sf):
    return evaluation.results_pivot(evaluation.regression_errors(naive_rows(spark, sf), ["model", "target"]), ["form", "season"])


def elo_win_rows(spark, sf):
    """Home win probability from the ratings alone."""
    games = games_with_league(spark, sf)
    rows = elo.elo_ratings(games, "league").join(games.drop("league"), "gameId").where("home_pts IS NOT NULL AND away_pts IS NOT NULL")
    prob = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("away_elo") - F.col("home_elo")) / 400.0))
    return rows.select("season", "game_date", (F.col("home_pts") > F.col("away_pts")).cast("int").alias("label"), F.round(prob, 6).alias("prob"))


WINS = f"""WITH RECURSIVE {FEAT}, {POINTS}, {ELO}, wr AS (SELECT g.season, g.game_date, CAST(g.home_pts > g.away_pts AS INTEGER) AS label,
  round(1 / (1 + pow(10.0::DOUBLE, (e.away_elo - e.home_elo) / 400)), 6) AS prob FROM elo e JOIN gp g ON g.gameId = e.gameId WHERE g.home_pts IS NOT NULL AND g.away_pts IS NOT NULL)"""


@query("classification_errors", f"""{WINS}, k AS (SELECT *, (rank() OVER (PARTITION BY season ORDER BY prob) + (count(*) OVER (PARTITION BY season, prob) - 1) / 2.0) AS rk FROM wr)
  SELECT season, count(*) AS n, round(avg(((prob >= 0.5)::INT = label)::INT), 6) AS accuracy, round(avg((prob - label) * (prob - label)), 6) AS brier,
  round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc FROM k GROUP BY season""")
def classification_errors(spark, sf):
    return r6(evaluation.classification_errors(elo_win_rows(spark, sf), ["season"]), "accuracy", "brier", "auc")


@query("classification_error_intervals", f"{WINS}, {interval_sql('wr', 'season', {'brier': '(prob - label) * (prob - label)', 'accuracy': 'CAST(CAST(prob >= 0.5 AS INTEGER) = label AS INTEGER)'})}")
def classification_error_intervals(spark, sf):
    off = F.col("prob") - F.col("label")
    right = ((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("int")
    return r6(inference.resampled_errors(elo_win_rows(spark, sf), ["season"], {"brier": off * off, "accuracy": right}), *spread("brier", "accuracy"))


@query("calibration", f"{WINS} SELECT season, least(floor(prob * 10), 9)::INTEGER AS bin, round(avg(prob), 5) AS mean_predicted, round(avg(label), 5) AS observed, count(*) AS n FROM wr GROUP BY ALL")
def calibration(spark, sf):
    return r6(evaluation.calibration(elo_win_rows(spark, sf), ["season"]), "mean_predicted", "observed", digits=5)


def player_rows(spark, sf):
    return matrix(spark, sf)


@query("player_model_errors")
def player_model_errors(spark, sf):
    rows = player_rows(spark, sf)
    return models.player_model_errors(rows, player_model_columns(rows), 2)


@query("win_model_errors")
def win_model_errors(spark, sf):
    rows = game_table(spark, sf)
    return models.win_model_errors(rows, game_model_columns(rows), 2)


@query("win_model_calibration")
def win_model_calibration(spark, sf):
    rows = game_table(spark, sf)
    return evaluation.calibration(models.win_predictions(rows, game_model_columns(rows), 2), ["model"])


@query("stacked_player_errors")
def stacked_player_errors(spark, sf):
    rows = player_rows(spark, sf)
    return models.stacked_player_errors(rows, player_model_columns(rows), 2)


@query("stacked_game_errors")
def stacked_game_errors(spark, sf):
    rows = game_scores(spark, sf)
    return models.stacked_game_errors(rows, [f"diff_{c}" for c in MEAN_COLS] + ["elo_diff", "rest_diff"], 2)


@query("parameter_choice")
def parameter_choice(spark, sf):
    rows = player_rows(spark, sf)
    return models.chosen_parameters(rows, player_model_columns(rows), "pts")


@query("feature_importance")
def feature_importance(spark, sf):
    rows = player_rows(spark, sf)
    return models.feature_importance(rows, player_model_columns(rows), 2)


@query("win_model_coefficients")
def win_model_coefficients(spark, sf):
    rows = game_table(spark, sf)
    return models.win_coefficients(rows, game_model_columns(rows), 2)


@query("published_model_scores", f"""WITH RECURSIVE {MATRIX}, ln AS (SELECT regr_slope(pts, coalesce(pts_season_avg, 0)) AS a, regr_intercept(pts, coalesce(pts_season_avg, 0)) AS b FROM matrix WHERE season <= 2)
  SELECT gameId, personId, round(b + a * coalesce(pts_season_avg, 0), 5) AS predicted, 2 AS version FROM matrix, ln WHERE season > 2""")
def published_model_scores(spark, sf):
    """Two versions of a linear model are trained and published; another session loads the one in force and scores the last season."""
    rows = written(matrix(spark, sf).select("gameId", "personId", "season", "pts", "pts_season_avg", "min_season_avg"))
    folder, train = work_folder(spark, "models"), rows.where("season <= 2")
    for features in (["min_season_avg"], ["pts_season_avg"]):
        model = LinearRegression(featuresCol="features", labelCol="pts", solver="normal").fit(models.vectors(train, features, ["pts"]))
        artefacts.publish(model, folder, "points", features, "pts", 2, {"rmse": model.summary.rootMeanSquaredError}, spark)
    other = spark.newSession()
    scored = artefacts.score(rows.where("season > 2"), artefacts.load(other, folder, "points"), ["gameId", "personId"])
    return r6(scored, "predicted", digits=5)


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events(spark, sf, raw).withColumn("ts", F.col("ts").cast("timestamp"))


@query("latest_live_scores", f"""WITH {EV} SELECT gameId::VARCHAR AS game_id, arg_max(k, (ts, k, event_id)) AS home_score, arg_max(event_id, (ts, k, event_id)) AS snapshot FROM ev GROUP BY gameId""")
def latest_live_scores(spark, sf):
    snapshots = event_stream(spark, sf).select(
        F.col("gameId").cast("string").alias("game_id"), "game_date", "ts", F.col("k").alias("home_score"), F.col("event_id").alias("snapshot"))
    return live.gather(snapshots, partial(live.latest_scores, bucket="game_date"), work_folder(spark, "stream"), "game_date").drop("ts", "game_date")


@query("running_box_scores", f"WITH {PBP}, {SHOTS}, {COUNTERS}, {DEFENCE} SELECT * FROM shots JOIN counters USING (gameId, personId) JOIN defence USING (gameId, personId)")
def running_box_scores(spark, sf):
    plays = actions(event_stream(spark, sf)).withColumn("game_date", F.to_date("ts"))
    return live.gather(plays.unionByName(plays), live.distinct_plays, work_folder(spark, "stream"), "game_date",
                       lambda state: live.running_box(state, "game_date")).drop("game_date")
