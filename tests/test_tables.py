"""Season upsert, checked reading, and published models."""

import os

import pytest
from pyspark.ml.regression import LinearRegression

from hoopspark.operators import artefacts, models
from hoopspark.sources import tables

KEYS = ["gameId", "personId"]


def season_rows(spark, rows):
    return spark.createDataFrame(rows, "gameId long, personId long, season int, pts int")


def files_of(path):
    return {os.path.join(r, f): os.path.getmtime(os.path.join(r, f)) for r, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(spark, path):
    return sorted((r["gameId"], r["personId"], r["season"], r["pts"]) for r in tables.read_table(spark, path).collect())


def test_upsert_twice_gives_one_copy_and_touches_its_seasons_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.upsert_seasons(season_rows(spark, [(1, 1, 2022, 5), (2, 1, 2023, 6)]), path, KEYS) == [2022, 2023]
    old = files_of(f"{path}/season=2022")
    new = season_rows(spark, [(2, 1, 2023, 99), (3, 1, 2023, 7), (3, 1, 2023, 8), (4, 1, 2024, None)])
    assert tables.upsert_seasons(new, path, KEYS) == [2023, 2024]
    want = [(1, 1, 2022, 5), (2, 1, 2023, 6), (3, 1, 2023, 7), (4, 1, 2024, None)]
    assert sorted(content(spark, path), key=lambda r: r[0]) == want and files_of(f"{path}/season=2022") == old
    everything = files_of(path)
    assert tables.upsert_seasons(new, path, KEYS) == [] and files_of(path) == everything
    assert tables.upsert_seasons(new.limit(0), path, KEYS) == []


def test_upsert_that_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert_seasons(season_rows(spark, [(1, 1, 2022, 5), (2, 1, 2023, None), (3, 1, 2023, 4)]), path, KEYS)
    new = season_rows(spark, [(2, 1, 2023, None), (3, 1, 2023, 9)])
    assert tables.upsert_seasons(new, path, KEYS, replace=True) == [2023] and tables.upsert_seasons(new, path, KEYS, replace=True) == []
    assert content(spark, path)[-1] == (3, 1, 2023, 9) and len(content(spark, path)) == 3


def test_upsert_refuses_rows_without_season_or_key(spark, tmp_path):
    for row in ((1, 1, None, 5), (None, 1, 2022, 5)):
        with pytest.raises(ValueError):
            tables.upsert_seasons(season_rows(spark, [row]), str(tmp_path / "t"), KEYS)


def test_a_publish_that_failed_is_finished_by_running_again(spark, tmp_path, monkeypatch):
    path, write = str(tmp_path / "t"), tables.write_seasons
    tables.upsert_seasons(season_rows(spark, [(1, 1, 2022, 5)]), path, KEYS)
    monkeypatch.setattr(tables, "write_seasons", lambda df, p, mode="overwrite": (_ for _ in ()).throw(OSError("lost")))
    new = season_rows(spark, [(5, 1, 2022, 1), (6, 1, 2023, 2)])
    with pytest.raises(OSError):
        tables.upsert_seasons(new, path, KEYS)
    assert content(spark, path) == [(1, 1, 2022, 5)]
    monkeypatch.setattr(tables, "write_seasons", write)
    assert tables.upsert_seasons(new, path, KEYS) == [2022, 2023] and len(content(spark, path)) == 3


def test_checked_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gameId,personId,pts,name\n1,2,3,x\n1,2\n,2,3,x\n1,2,many,x\n1,q,many,x\n1,2,,\n1,2,3,x,9\n")
    (tmp_path / "b.csv").write_text("gameId,personId,pts,name\n7,8,9,é\n")
    types = {"gameId": "bigint", "personId": "bigint", "pts": "int", "name": "string"}
    good, rejected = tables.read_checked(spark, str(tmp_path), types, ["gameId"])
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2, 3, "x"), (1, 2, None, None), (7, 8, 9, "é")]
    found = sorted((r["file"], r["reason"], r["line"]) for r in rejected.collect())
    assert found == [("a.csv", "no gameId", ",2,3,x"), ("a.csv", "personId is no bigint", "1,q,many,x"), ("a.csv", "pts is no int", "1,2,many,x"),
                     ("a.csv", "wrong number of fields", "1,2"), ("a.csv", "wrong number of fields", "1,2,3,x,9")]


def test_published_models(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), float(i * i % 7), 2.0 * i + 1) for i in range(50)], "row long, a double, b double, y double")
    folder = str(tmp_path / "models")
    with pytest.raises(LookupError):
        artefacts.load(spark, folder, "points")
    for features in (["a"], ["b", "a"]):
        model = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(models.vectors(rows, features, ["y"]))
        artefacts.publish(model, folder, "points", features, "y", 2, {"rmse": model.summary.rootMeanSquaredError}, spark)
    other = spark.newSession()
    current = artefacts.load(other, folder, "points")
    assert (current.version, current.features, current.target, current.last_training_season) == (2, ["b", "a"], "y", 2) and current.errors["rmse"] < 1e-6
    for published in (current, artefacts.load(other, folder, "points", 1)):
        scored = artefacts.score(rows.select("b", "row", "a"), published, ["row"]).collect()
        assert all(abs(r["predicted"] - (2 * r["row"] + 1)) < 1e-6 and r["version"] == published.version for r in scored) and len(scored) == 50
    with pytest.raises(ValueError, match="needs b"):
        artefacts.score(rows.drop("b"), current, ["row"])
    with pytest.raises(LookupError):
        artefacts.load(other, folder, "points", 3)


def test_condensed_keeps_its_result_and_removes_what_led_to_it(spark):
    from hoopspark.session import condensed, path_exists, remove, written

    before, seen = written(spark.range(5), "before"), []

    def inner():
        own = written(spark.range(7), "inner")
        seen.append(own.inputFiles()[0])
        return own

    def outer():
        own = condensed(spark, inner, "own")
        seen.append(own.inputFiles()[0])
        assert not path_exists(spark, seen[0])
        return own.unionByName(before)

    got = condensed(spark, outer, "outer")
    assert got.count() == 12 and not any(path_exists(spark, f) for f in seen)
    with pytest.raises(ZeroDivisionError):
        condensed(spark, lambda: seen.append(written(spark.range(1)).inputFiles()[0]) or 1 / 0)
    assert not path_exists(spark, seen[-1])
    files = before.inputFiles()
    remove(before, spark.range(1))
    assert got.count() == 12 and not path_exists(spark, files[0])
    remove(before)
