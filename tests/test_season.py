"""The season's feature table: one reading of the events, and the rows that late joins give."""

import datetime
import random

from pyspark.sql import functions as F

from hoopspark.functions import windows
from hoopspark.operators import elo, features
from hoopspark.plans import season
from hoopspark.registry import bind, series
from hoopspark.session import written


def events(spark, folder, days=24, players=50):
    draw, rows = random.Random(3), []
    for d in range(days):
        for u in range(players):
            for _ in range(draw.randrange(4)):
                ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, seconds=draw.randrange(86400))
                kind = draw.choice(["click", "signup", "view", "purchase", "error", None])
                rows.append((len(rows), ts, None if draw.random() < .02 else u, kind, round(draw.random() * 30, 2), '{"k": %d}' % draw.randrange(100)))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def lines(df):
    at = sorted(df.columns)
    plain = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted(str([plain(r[c]) for c in at]) for r in df.collect())


def test_events_are_read_once(spark, tmp_path):
    sf = events(spark, tmp_path)
    plan = series.matrix(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "user_id" not in plan
    rows, games = bind.season_tables(spark, sf)
    assert lines(rows) == lines(bind.box(spark, sf)) and lines(games) == lines(bind.schedule(spark, sf))


def test_early_lists_give_the_rows_of_late_joins(spark, tmp_path):
    sf = events(spark, tmp_path)
    box, games = written(bind.box(spark, sf)), written(bind.schedule(spark, sf))
    for schedule in (games, games.unionByName(games.where("gameId % 3 = 0").withColumn("game_date", F.date_add("game_date", 1)))):
        ratings = written(season.team_ratings(box, games, "league"))
        late = features.team_runs(features.rest(features.attach_schedule(box, schedule)))
        if schedule is games:      # the order of a player's rows decides the means, so it has to be one
            late = features.stint_ewma(features.player_ewma(features.season_to_date(features.player_trailing(late))))
        late = features.opponent_defence(late, box, schedule)
        late = late.join(features.efficiency_so_far(box, schedule).drop("game_date", "season"), ["gameId", "teamId"], "left")
        late = elo.attach_elo(features.attach_head_to_head(late, box, schedule), ratings, schedule)
        early = season.player_features(box, schedule, ratings=ratings)
        same = [c for c in early.columns if c in late.columns and (schedule is games or c in ("gameId", "personId", "opp_team_id", "is_home", "h2h_games", "home_elo"))]
        assert len(same) == len(early.columns) or schedule is not games
        assert lines(early.select(same)) == lines(late.select(same))


def test_means_of_several_kinds_over_batches(spark):
    draw = random.Random(9)
    data = [(p, t, t // 700, None if draw.random() < .2 else draw.random()) for p in (1, 2, None) for t in range(1500)]
    df = spark.createDataFrame(data, "p int, t int, run int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = windows.ewma_series(df, ["p"], ["t"], [([], ["x"], "_all"), (["run"], ["x"], "_run")]).toPandas().sort_values(["p", "t"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for keys, col in ((["p"], "x_all"), (["p", "run"], "x_run")):
        want = got.groupby(keys, dropna=False)["x"].transform(lambda s: s.shift(1).ewm(alpha=.3, adjust=False, min_periods=1).mean())
        assert got[col].isna().equals(want.isna()) and (got[col] - want).abs().max() < 1e-9
