"""One row per game: team means of active players on both sides, differences and the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.operators.columns import of_role, team_mean_columns

ACTIVE_MINUTES = 5.0


def team_results(box: DataFrame) -> DataFrame:
    """Points, opponent, opponent points and win flag per team and game (games with two teams)."""
    points = box.groupBy("gameId", "teamId").agg(F.sum("pts").alias("pts"))
    game = Window.partitionBy("gameId")
    paired = points.withColumns({
        "_n": F.count("*").over(game), "opp_id": F.sum("teamId").over(game) - F.col("teamId"),
        "opp_pts": F.sum("pts").over(game) - F.col("pts"),
    }).where("_n = 2")
    return paired.select("gameId", "teamId", "opp_id", "pts", "opp_pts", (F.col("pts") > F.col("opp_pts")).cast("int").alias("won"))


def home_results(box: DataFrame, schedule: DataFrame) -> DataFrame:
    """Home win flag per game."""
    home = schedule.select("gameId", F.col("home_team_id").alias("teamId"))
    return team_results(box).join(home, ["gameId", "teamId"]).select("gameId", F.col("won").alias("home_win"))


def active(features: DataFrame, threshold: float = ACTIVE_MINUTES) -> DataFrame:
    return features.where(F.coalesce(F.col("min_ewma"), F.lit(0.0)) > threshold)


def team_means(features: DataFrame, cols: list[str] | None = None, threshold: float = ACTIVE_MINUTES) -> DataFrame:
    """Means over a team's active players and how many there are."""
    cols = team_mean_columns(features) if cols is None else cols
    return active(features, threshold).groupBy("gameId", "teamId").agg(
        *[F.avg(c).alias(c) for c in [*cols, "rest_days"]], F.count("personId").alias("active_players")
    )


def home_away_rows(team_rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Home and away columns of a game side by side, by conditional aggregation in one shuffle."""
    games = schedule.select("gameId", "game_date", "season", "home_team_id", "away_team_id")
    cols = [c for c in team_rows.columns if c not in ("gameId", "teamId")]
    rows = team_rows.join(games, "gameId")
    pick = lambda side, c: F.max(F.when(F.col("teamId") == F.col(f"{side}_team_id"), F.col(c))).alias(f"{side}_{c}")
    wide = rows.groupBy("gameId").agg(
        F.first("game_date").alias("game_date"), F.first("season").alias("season"),
        *[pick(side, c) for side in ("home", "away") for c in cols],
    )
    return wide.where(F.col("home_active_players").isNotNull() & F.col("away_active_players").isNotNull())


def differences(games: DataFrame, cols: list[str]) -> DataFrame:
    """Home minus away for each column, rest and roster size."""
    diffs = {f"diff_{c}": F.col(f"home_{c}") - F.col(f"away_{c}") for c in cols}
    diffs["rest_diff"] = F.col("home_rest_days") - F.col("away_rest_days")
    diffs["roster_diff"] = F.col("home_active_players") - F.col("away_active_players")
    if "home_team_elo" in games.columns:
        diffs["elo_diff"] = F.col("home_team_elo") - F.col("away_team_elo")
    return games.withColumns(diffs)


def head_to_head_of_games(features: DataFrame) -> DataFrame:
    """The head-to-head columns per game, taken from the home players' rows where there are any."""
    cols = of_role(features, "head_to_head")
    first = F.struct(F.col("is_home").cast("int") * -1, "personId")
    return features.groupBy("gameId").agg(*[F.min_by(c, first).alias(c) for c in cols])


def game_features(features: DataFrame, box: DataFrame, schedule: DataFrame, elo: bool = False) -> DataFrame:
    """Game rows for the win and score models; games without a result are left out."""
    cols = team_mean_columns(features)
    means = team_means(features, [*cols, "team_elo"] if elo else cols)
    wide = differences(home_away_rows(means, schedule), cols)
    if of_role(features, "head_to_head"):
        wide = wide.join(head_to_head_of_games(features), "gameId", "left")
    return wide.join(home_results(box, schedule), "gameId")


def score_targets(game_rows: DataFrame, points: DataFrame) -> DataFrame:
    """Attach home, away and total points."""
    scored = points.select("gameId", "home_pts", "away_pts").where("home_pts IS NOT NULL AND away_pts IS NOT NULL")
    return game_rows.join(scored, "gameId").withColumn("total_pts", F.col("home_pts") + F.col("away_pts"))
