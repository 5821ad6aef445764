"""Streams against the batch query: any split and order, late rows, a batch that fails half-way, and what a batch touches."""

import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from hoopspark.operators import boxscore
from hoopspark.registry.bind import actions, events
from hoopspark.session import work_folder, written
from hoopspark.streaming import live


def rows_of(df, columns):
    return sorted(map(str, df.select(sorted(columns)).collect()))


@pytest.fixture(scope="module")
def plays(spark):
    rows = events(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    return written(actions(rows).withColumn("game_date", F.to_date("ts")))


def stream_of(spark, table, path):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_box_scores_in_any_split_and_order(spark, plays, tmp_path):
    """Six files, one per batch, newest days first and with plays sent twice."""
    plays.repartitionByRange(4, F.desc("ts")).write.parquet(str(tmp_path / "in"))
    plays.where("actionNumber % 5 = 0").repartition(2, "gameId").write.mode("append").parquet(str(tmp_path / "in"))
    got = live.gather(stream_of(spark, plays, tmp_path / "in"), live.distinct_plays, work_folder(spark, "stream"), "game_date", lambda s: live.running_box(s, "game_date"))
    want = boxscore.player_rows(plays).groupBy(*boxscore.KEY).agg(*boxscore.running_counts())
    assert rows_of(got, want.columns) == rows_of(want, want.columns)


def test_scores_of_old_days_that_come_late(spark, plays, tmp_path):
    shots = plays.select(F.col("gameId").cast("string").alias("game_id"), "game_date", "ts", F.col("pointsTotal").alias("home_score"))
    folder, first, second = work_folder(spark, "stream"), tmp_path / "in", "game_date = DATE'2024-01-03' AND hour(ts) >= 12"
    newest = partial(live.latest_scores, bucket="game_date")
    shots.where(f"NOT ({second})").repartitionByRange(3, "ts").write.parquet(str(first))
    live.gather(stream_of(spark, shots, first), newest, folder, "game_date")
    table = live.Epochs(spark, f"{folder}/state")
    before = {b: table.epochs(b)[-1] for b in table.buckets()}
    shots.where(second).coalesce(1).write.mode("append").parquet(str(first))
    got = live.gather(stream_of(spark, shots, first), newest, folder, "game_date")
    assert rows_of(got, shots.columns) == rows_of(live.latest_scores(shots, bucket="game_date"), shots.columns)
    after = {b: table.epochs(b)[-1] for b in table.buckets()}
    assert [b for b in after if after[b] != before[b]] == ["game_date=2024-01-03"]           # a batch writes the days it brings, no other
    assert all(len(table.epochs(b)) <= live.KEPT_EPOCHS for b in table.buckets())


def test_a_batch_that_fails_half_way_runs_again(spark, plays, tmp_path, monkeypatch):
    plays.repartitionByRange(3, F.desc("ts")).write.parquet(str(tmp_path / "in"))
    folder, write, calls = work_folder(spark, "stream"), live.Epochs.write, []

    def failing(self, rows, bucket, number):
        write(self, rows, bucket, number)
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            raise OSError("lost after the state was written")

    monkeypatch.setattr(live.Epochs, "write", failing)
    arguments = (live.distinct_plays, folder, "game_date", lambda s: live.running_box(s, "game_date"))
    with pytest.raises(Exception):
        live.gather(stream_of(spark, plays, tmp_path / "in"), *arguments)
    got = live.gather(stream_of(spark, plays, tmp_path / "in"), *arguments)
    want = boxscore.player_rows(plays).groupBy(*boxscore.KEY).agg(*boxscore.running_counts())
    assert calls.count(1) == 3 and rows_of(got, want.columns) == rows_of(want, want.columns)


def test_nothing_has_arrived(spark, plays, tmp_path):
    os.makedirs(tmp_path / "empty")
    assert live.gather(stream_of(spark, plays, tmp_path / "empty"), live.distinct_plays, work_folder(spark, "stream"), "game_date") is None
