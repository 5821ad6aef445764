"""Who guarded whom: offensive and defensive matchup features per player-game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.functions.scalars import ratio_or
from hoopspark.functions.windows import top_rows, trailing_means

MIN_POSSESSIONS = 2.0
WIDTHS = [3, 5, 10]
METRICS = ["matchup_def_fg_pct", "matchup_pts_per_poss", "matchup_3pt_rate", "defended_fg_pct",
           "defended_pts_per_poss", "switches_on"]


def enough_possessions(matchups: DataFrame, least: float = MIN_POSSESSIONS) -> DataFrame:
    return matchups.where(F.col("partial_possessions") >= least)


def offensive_view(matchups: DataFrame) -> DataFrame:
    """Shooting, points per possession and three-point rate of the player the row belongs to."""
    sums = matchups.groupBy("game_id", F.col("person_id").alias("personId"), "team_id", "season").agg(
        F.sum("matchup_field_goals_made").alias("_made"), F.sum("matchup_field_goals_attempted").alias("_tried"),
        F.sum("matchup_three_pointers_attempted").alias("_threes"), F.sum("player_points").alias("_points"),
        F.sum("partial_possessions").alias("_poss"), F.sum("switches_on").cast("double").alias("switches_on"),
    )
    return sums.select(
        "game_id", "personId", "team_id", "season",
        ratio_or("_made", "_tried", 0.0).alias("matchup_def_fg_pct"),
        ratio_or("_points", "_poss", 0.0).alias("matchup_pts_per_poss"),
        ratio_or("_threes", "_tried", 0.0).alias("matchup_3pt_rate"), "switches_on",
    )


def defensive_view(matchups: DataFrame) -> DataFrame:
    """Shooting and points per possession grouped by the other player of the matchup."""
    sums = matchups.groupBy("game_id", F.col("matchups_person_id").alias("personId"), "team_id", "season").agg(
        F.sum("matchup_field_goals_made").alias("_made"), F.sum("matchup_field_goals_attempted").alias("_tried"),
        F.sum("player_points").alias("_points"), F.sum("partial_possessions").alias("_poss"),
    )
    return sums.select(
        "game_id", "personId", ratio_or("_made", "_tried", 0.0).alias("defended_fg_pct"),
        ratio_or("_points", "_poss", 0.0).alias("defended_pts_per_poss"),
    )


def matchup_features(matchups: DataFrame, schedule: DataFrame) -> DataFrame:
    """Both views together, dated from the schedule and rolled over earlier games."""
    kept = enough_possessions(matchups)
    both = offensive_view(kept).join(defensive_view(kept), ["game_id", "personId"], "full_outer")
    dates = schedule.select(F.col("gameId").alias("game_id"), "game_date")
    dated = both.join(dates, "game_id", "left")
    rolled = trailing_means(dated, ["personId"], ["game_date", "game_id"], METRICS, WIDTHS)
    rolled_columns = [f"{m}_roll{w}" for m in METRICS for w in WIDTHS]
    once = top_rows(rolled, ["game_id", "personId"], [F.col("team_id").asc_nulls_last()], 1)
    return once.select("game_id", "personId", "game_date", "season", *rolled_columns)
