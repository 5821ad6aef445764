import json

from pyspark.sql import functions as F

from hoopspark.schemas import PBP_COLUMNS
from hoopspark.sources import feeds, tables


def test_play_files_carry_their_season(spark, tmp_path):
    for season in (2022, 2023):
        (tmp_path / f"plays_{season}.csv").write_text("gameId,orderNumber,personId,clock,jerseyNumber,scoreHome\n1,1,22,PT12M00.00S,5,\n2,2,abc,,7,x\n")
    rows = tables.read_plays(spark, str(tmp_path)).orderBy("season", "orderNumber").collect()
    assert rows[0].asDict().keys() == set(PBP_COLUMNS)
    assert [(r.season, r.personId, r.scoreHome, r.area) for r in rows] == [(2022, 22, None, ""), (2022, None, None, ""), (2023, 22, None, ""), (2023, None, None, "")]


def test_shot_and_matchup_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("GAME_ID,PLAYER_ID,GAME_DATE,SHOT_DISTANCE,EXTRA\n1,2,20240105,25,x\n1,3,bad,4,y\n")
    rows = tables.read_shots(spark, str(tmp_path / "s.csv"), 2023).orderBy("player_id").collect()
    assert [str(r.game_date) for r in rows] == ["2024-01-05", "None"] and "extra" not in rows[0].asDict()
    (tmp_path / "m.csv").write_text("GAME_ID,PERSON_ID,PARTIAL_POSSESSIONS\n1,2,3.5\n")
    assert tables.read_matchups(spark, str(tmp_path / "m.csv"), 2023).first().partial_possessions == 3.5


def test_season_table_replaces_only_its_seasons(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_seasons(spark.createDataFrame([(2022, 1), (2023, 2)], "season int, v int"), path)
    tables.write_seasons(spark.createDataFrame([(2023, 3)], "season int, v int"), path)
    assert sorted((r.season, r.v) for r in tables.read_table(spark, path).collect()) == [(2022, 1), (2023, 3)]


def test_append_keeps_the_existing_row(spark):
    old = spark.createDataFrame([(1, 1, 10)], "gameId int, personId int, pts int")
    new = spark.createDataFrame([(1, 1, 99), (2, 1, 5), (2, 1, 5)], "gameId int, personId int, pts int")
    assert sorted((r.gameId, r.pts) for r in tables.append_rows(old, new, ["gameId", "personId"]).collect()) == [(1, 10), (2, 5)]


def test_a_team_listed_by_two_payloads_is_one_team(spark):
    team = "struct<id:string,abbreviation:string>"
    teams = spark.createDataFrame([(json.dumps({"sports": [{"leagues": [{"teams": [{"team": {"id": "7", "abbreviation": "BOS"}}]}]}]}),)] * 2, "j string")
    listed = feeds.team_map(teams.select(F.from_json("j", f"sports array<struct<leagues:array<struct<teams:array<struct<team:{team}>>>>>>").alias("p")).select("p.*"))
    assert listed.count() == 1
    doubled = listed.unionByName(listed)
    person = {"athlete": {"displayName": "A", "position": {"abbreviation": "G"}}, "status": "Out", "details": {"type": "Knee", "detail": ""}, "shortComment": None, "longComment": None}
    report = spark.createDataFrame([(json.dumps({"injuries": [{"id": "7", "displayName": "?", "injuries": [person]}]}),)], "j string")
    inner = "struct<athlete:struct<displayName:string,position:struct<abbreviation:string>>,status:string,details:struct<type:string,detail:string>,shortComment:string,longComment:string>"
    report = report.select(F.from_json("j", f"injuries array<struct<id:string,displayName:string,injuries:array<{inner}>>>").alias("p")).select("p.*")
    assert [(r.team_tri, r.player_name) for r in feeds.injury_report(report, doubled).collect()] == [("BOS", "A")]
