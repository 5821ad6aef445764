"""Shot-level rows to rolled shot-quality features per player-game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import ratio_or
from hoopspark.functions.windows import trailing_means

WIDTHS = [3, 5, 10]
METRICS = ["shot_3pt_rate", "shot_rim_rate", "shot_mid_rate", "shot_dist_avg", "shot_efg"]
RIM_FEET = 6
MID_FEET = 16

# League-average effective shooting by zone.
ZONE_EFG = {
    "Restricted Area": 0.640,
    "In The Paint (Non-RA)": 0.395,
    "Mid-Range": 0.395,
    "Left Corner 3": 0.530,
    "Right Corner 3": 0.530,
    "Above the Break 3": 0.520,
    "Backcourt": 0.200,
}
OTHER_ZONE_EFG = 0.480


def zone_expectation(zone) -> Column:
    """Expected effective shooting of a zone."""
    table = F.create_map(*[F.lit(x) for pair in ZONE_EFG.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(zone)), F.lit(OTHER_ZONE_EFG))


def player_game_shots(shots: DataFrame) -> DataFrame:
    """Zone rates, mean distance, effective shooting and quality over the zone mix, per player and game."""
    three = F.coalesce(F.contains(F.col("shot_zone_basic"), F.lit("3")), F.lit(False))
    feet = F.col("shot_distance")
    made = F.col("shot_made_flag")
    share = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    totals = shots.groupBy("game_id", "player_id", "team_id", "game_date", "season").agg(
        F.sum("shot_attempted_flag").alias("fga"), F.sum(made).alias("fgm"),
        share(three).alias("fg3a"), F.sum(F.when(three, made).otherwise(0)).alias("fg3m"),
        share(feet <= RIM_FEET).alias("rim_a"), share((feet > RIM_FEET) & (feet <= MID_FEET)).alias("mid_a"),
        F.avg(feet).alias("shot_dist_avg"), F.avg(zone_expectation("shot_zone_basic")).alias("zone_efg"),
    )
    rated = totals.withColumns({
        "shot_3pt_rate": ratio_or("fg3a", "fga", 0.0), "shot_rim_rate": ratio_or("rim_a", "fga", 0.0),
        "shot_mid_rate": ratio_or("mid_a", "fga", 0.0),
        "shot_efg": ratio_or(F.col("fgm") + 0.5 * F.col("fg3m"), "fga", 0.0),
    }).withColumn("shot_quality", F.col("shot_efg") - F.col("zone_efg"))
    return rated.drop("fga", "fgm", "fg3a", "fg3m", "rim_a", "mid_a")


def rolled_shots(player_games: DataFrame) -> DataFrame:
    return trailing_means(player_games, ["player_id"], ["game_date", "game_id"], METRICS, WIDTHS)


def team_game_shooting(player_games: DataFrame) -> DataFrame:
    """Mean effective shooting of each team and of its opponent in the same game."""
    teams = player_games.groupBy("game_id", "team_id", "game_date").agg(F.avg("shot_efg").alias("team_efg"))
    game = Window.partitionBy("game_id")
    paired = teams.withColumns({
        "_n": F.count("*").over(game), "opp_def_efg": F.sum("team_efg").over(game) - F.col("team_efg"),
    })
    return paired.where("_n = 2").drop("_n")


def opponent_shooting(team_games: DataFrame) -> DataFrame:
    """Effective shooting a team allowed in its last games, one row per team-game."""
    return trailing_means(team_games, ["team_id"], ["game_date", "game_id"], ["opp_def_efg"], WIDTHS)


def shot_features(shots: DataFrame) -> DataFrame:
    """Rolled shot columns per player-game, keyed by game_id and personId."""
    games = player_game_shots(shots)
    allowed = [f"opp_def_efg_roll{w}" for w in WIDTHS]
    defence = opponent_shooting(team_game_shooting(games)).select("game_id", "team_id", *allowed)
    joined = rolled_shots(games).join(defence, ["game_id", "team_id"])
    rolled = [f"{m}_roll{w}" for m in METRICS for w in WIDTHS]
    return joined.select(
        F.col("game_id").cast("bigint"), F.col("player_id").cast("bigint").alias("personId"), "game_date", "season",
        *rolled, *allowed,
    )
