"""Official game logs: box-score rows and the schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import log_minutes, ratio_or

# Game-log column -> box-score column.
LOG_COLUMNS = {
    "PTS": "pts", "REB": "reb", "OREB": "oreb", "DREB": "dreb",
    "AST": "ast", "STL": "stl", "BLK": "blk", "TOV": "tov",
    "PF": "pf", "FGM": "fgm", "FGA": "fga",
    "FG3M": "fg3m", "FG3A": "fg3a", "FTM": "ftm", "FTA": "fta",
    "FG_PCT": "fg_pct", "FG3_PCT": "fg3_pct", "FT_PCT": "ft_pct",
}


def box_from_log(log: DataFrame, season: int | None = None) -> DataFrame:
    """Box-score rows of one log: minutes parsed, absentees dropped, team totals and ratios added.

    Usage here weighs a player's share by minutes; it is called ``usage_rate`` to keep it apart from the
    play-by-play share.
    """
    upper = log.toDF(*[c.upper() for c in log.columns])
    rows = upper.select(
        F.col("GAME_ID").try_cast("bigint").alias("gameId"),
        (F.col("SEASON") if season is None else F.lit(season)).cast("int").alias("season"),
        F.col("PLAYER_ID").try_cast("bigint").alias("personId"), F.col("PLAYER_NAME").alias("playerName"),
        F.col("TEAM_ID").try_cast("bigint").alias("teamId"), F.col("TEAM_ABBREVIATION").alias("teamTricode"),
        F.expr("try_to_date(CAST(GAME_DATE AS STRING))").alias("game_date"), log_minutes("MIN").alias("min"),
        *[F.col(src).try_cast("double").alias(out) for src, out in LOG_COLUMNS.items()],
    ).where(F.col("min") > 0)
    team = Window.partitionBy("gameId", "teamId")
    total = lambda c: F.coalesce(F.sum(c).over(team), F.lit(0.0))
    load = F.col("fga") + 0.44 * F.col("fta")
    team_load = total("fga") + 0.44 * total("fta") + total("tov")
    derived = rows.withColumns({
        "efg_pct": ratio_or(F.col("fgm") + 0.5 * F.col("fg3m"), "fga", 0.0),
        "ts_pct": ratio_or("pts", 2 * load, 0.0),
        "usage_rate": ratio_or((load + F.col("tov")) * (total("min") / 5), F.col("min") * team_load, 0.0),
        "team_poss": total("fga") - total("oreb") + total("tov") + 0.44 * total("fta"),
        "tf": F.lit(0).cast("smallint"), "fouls_drawn": F.lit(0).cast("smallint"),
    } | {f"{c}_per36": ratio_or(F.col(c) * 36, "min", 0.0) for c in ("pts", "reb", "ast")})
    counts = [c for c in LOG_COLUMNS.values() if not c.endswith("_pct")]
    return derived.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)).cast("smallint") for c in counts})


def schedule_from_log(log: DataFrame, season: int | None = None) -> DataFrame:
    """One row per game from the matchup text: ``vs.`` marks the home side.

    Home and away are picked in one aggregate per game; games with one side missing are left out.
    """
    upper = log.toDF(*[c.upper() for c in log.columns])
    home = F.coalesce(F.contains(F.col("MATCHUP"), F.lit("vs.")), F.lit(False))
    rows = upper.select(
        F.col("GAME_ID").try_cast("bigint").alias("gameId"), F.expr("try_to_date(CAST(GAME_DATE AS STRING))").alias("game_date"),
        (F.col("SEASON") if season is None else F.lit(season)).cast("int").alias("season"),
        F.col("TEAM_ID").try_cast("bigint").alias("_team"), F.col("TEAM_ABBREVIATION").alias("_code"), home.alias("_home"),
    )
    pick = lambda c, side: F.max(F.when(F.col("_home") == side, F.col(c)))
    games = rows.groupBy("gameId", "game_date", "season").agg(
        pick("_team", True).alias("home_team_id"), pick("_code", True).alias("home_tricode"),
        pick("_team", False).alias("away_team_id"), pick("_code", False).alias("away_tricode"),
    )
    return games.where(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull())
