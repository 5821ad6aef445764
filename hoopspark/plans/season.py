"""The season tables, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hoopspark.operators import elo, features, games
from hoopspark.operators.columns import feature_matrix_columns


def player_features(
    box: DataFrame, schedule: DataFrame, shots: DataFrame | None = None, matchups: DataFrame | None = None,
    stats=features.ROLL_STATS, stint_stats=features.STINT_STATS, ratings: DataFrame | None = None,
) -> DataFrame:
    """Pre-game feature row for every player-game; with ``ratings`` (``elo.elo_ratings``) also those of both teams.

    Everything that hangs on a game meets the narrow box rows, in one shuffle on the game, as one list per game. The rows
    take what is theirs out of the lists after the player windows, so that no wide row is shuffled and no series grows.
    """
    tables = {
        "_sides": features.points_allowed(box, schedule).withColumnRenamed("teamId", "opp_team_id"),
        "_eff": features.efficiency_so_far(box, schedule).drop("game_date", "season"),
        "_h2h": features.head_to_head(box, schedule),
    }
    if ratings is not None:
        tables["_elo"] = elo.sided(ratings, schedule)
    own = {"_sides": ["opp_team_id"], "_eff": ["teamId"]}
    df = features.attach_schedule(box, schedule)
    for name, table in tables.items():
        df = df.join(features.listed(table, name), "gameId", "left")
    df = df.withColumns({name: features.matching(name, own.get(name, [])) for name in tables})
    df = features.team_runs(features.rest(df))
    df = features.weighted_means(df, stats, stint_stats)
    df = features.player_trailing(df, stats)
    df = features.season_to_date(df, stats)
    for name, table in tables.items():
        df = features.taken_out(df, name, [c for c in table.columns if c not in ("gameId", *own.get(name, []))])
    df = features.filled_head_to_head(df)
    df = features.attach_rolled(features.attach_rolled(df, shots), matchups)
    rated = [] if ratings is None else elo.RATED
    return (df if ratings is None else elo.own_and_opposing(df)).select(*feature_matrix_columns(df), *rated)


def team_ratings(box: DataFrame, schedule: DataFrame, league: str) -> DataFrame:
    """Ratings of both teams before each game of the schedule."""
    return elo.elo_ratings(features.game_points(box, schedule).join(schedule.select("gameId", league), "gameId"), league)


def training_rows(player_rows: DataFrame, box: DataFrame, schedule: DataFrame, league: str) -> DataFrame:
    """Feature rows with team ratings (attached here unless they have them already) and workload."""
    rated = set(elo.RATED) <= set(player_rows.columns)
    return features.workload(player_rows if rated else elo.attach_elo(player_rows, team_ratings(box, schedule, league), schedule))


def game_rows(player_rows: DataFrame, box: DataFrame, schedule: DataFrame) -> DataFrame:
    return games.game_features(player_rows, box, schedule)
