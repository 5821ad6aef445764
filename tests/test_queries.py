"""Registered queries against their SQL. Set ALL_QUERIES=1 for every query; the default is a quick cross-section."""

import os

import pytest
from oracle import compare, duck

from hoopspark.registry.catalog import oracle_sql, queries

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.01")
QUICK = ["game_clock", "player_identity", "shooting_counts", "minutes_on_court", "rest_days", "team_runs", "trailing_means",
         "ewma_means", "season_to_date_means", "head_to_head", "elo_ratings", "team_efficiency", "shot_features",
         "matchup_features", "team_results", "scoreboard_games", "injury_report", "current_rosters", "live_scores", "live_box",
         "reconciliation", "normal_names", "playoff_odds", "classification_errors", "latest_live_scores"]
NAMES = list(queries()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, queries()[name], oracle_sql().get(name)) is None


def test_names_are_consistent():
    assert set(oracle_sql()) <= set(queries())
