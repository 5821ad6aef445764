"""Elo ratings, an ordered fold over the games of each league.

A rating couples teams through time, so no window expresses it. The input is one row per game; leagues never
play each other and are independent. Rows are hashed by league and sorted, and a task streams its rows in
Arrow batches holding one number per team, so no league is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = 1500.0
K = 20.0
SCHEMA = "league bigint, gameId bigint, home_elo double, away_elo double"


def _stream(batches: Iterator[pd.DataFrame], k: float, start: float) -> Iterator[pd.DataFrame]:
    league, rating = None, {}
    for batch in batches:
        home_elo, away_elo = [], []
        rows = zip(batch["league"], batch["home_team_id"], batch["away_team_id"], batch["home_pts"], batch["away_pts"])
        for row_league, home, away, home_pts, away_pts in rows:
            if row_league != league:
                league, rating = row_league, {}
            h, a = rating.get(home, start), rating.get(away, start)
            home_elo.append(h)
            away_elo.append(a)
            if pd.notna(home_pts) and pd.notna(away_pts):
                result = 0.5 if home_pts == away_pts else float(home_pts > away_pts)
                shift = k * (result - 1.0 / (1.0 + 10.0 ** ((a - h) / 400.0)))
                rating[home], rating[away] = h + shift, a - shift
        yield pd.DataFrame({"league": batch["league"], "gameId": batch["gameId"], "home_elo": home_elo, "away_elo": away_elo})


def elo_ratings(games: DataFrame, league: str, k: float = K, start: float = START) -> DataFrame:
    """Ratings before each game. ``games``: gameId, game_date, both team ids, both points (null: not played).

    Teams of different leagues never meet, so each league is a series of its own; the column that names it is required.
    """
    rows = games.select(
        F.col(league).cast("bigint").alias("league"),
        F.col("gameId").cast("bigint").alias("gameId"), "game_date", "home_team_id", "away_team_id",
        F.col("home_pts").cast("double").alias("home_pts"), F.col("away_pts").cast("double").alias("away_pts"),
    )
    ordered = rows.repartition("league").sortWithinPartitions("league", "game_date", "gameId")
    return ordered.mapInPandas(lambda batches: _stream(batches, k, start), SCHEMA)


def attach_elo(features: DataFrame, ratings: DataFrame, schedule: DataFrame) -> DataFrame:
    """Own and opposing team's rating before the game, and their difference."""
    return own_and_opposing(features.join(sided(ratings, schedule), "gameId", "left"))


RATED = ["home_elo", "away_elo", "team_elo", "opp_elo", "elo_diff"]


def sided(ratings: DataFrame, schedule: DataFrame) -> DataFrame:
    """Ratings with the home team they belong to."""
    return ratings.drop("league").join(schedule.select("gameId", F.col("home_team_id").alias("_home")), "gameId")


def own_and_opposing(joined: DataFrame) -> DataFrame:
    home = F.coalesce(F.col("teamId") == F.col("_home"), F.lit(False))
    return joined.withColumns({
        "team_elo": F.when(home, F.col("home_elo")).otherwise(F.col("away_elo")),
        "opp_elo": F.when(home, F.col("away_elo")).otherwise(F.col("home_elo")),
    }).withColumn("elo_diff", F.col("team_elo") - F.col("opp_elo")).drop("_home")
