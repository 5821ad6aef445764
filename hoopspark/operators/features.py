"""Pre-game features: every value of a row comes from earlier games only.

All series here have one row per player (or team) and game, so a series is bounded by the calendar. The
player windows share one shuffle on the player; season and team-run windows refine the same partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import half_even, ratio_or
from hoopspark.functions.windows import (
    change_runs, day_gap, ewma_means, ewma_series, expanding_means, trailing_means, trailing_sums,
)

# fixed values
ROLL_STATS = ["pts", "reb", "ast", "stl", "blk", "tov", "min", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta",
              "ts_pct", "efg_pct", "usg_pct", "fouls_drawn"]
# fixed values
STINT_STATS = ["pts", "reb", "ast", "stl", "blk", "tov", "min", "ts_pct", "usg_pct"]
WIDTHS = [3, 5, 10]
ORDER = ["game_date", "gameId"]
PLAYER = ["personId"]
EFFICIENCY = ["ortg", "drtg", "net_rtg", "pace_proxy", "team_efg", "opp_efg"]
TEAM_TOTALS = ["pts", "fga", "fg3m", "fgm", "fta", "tov", "oreb"]


def attach_schedule(box: DataFrame, schedule: DataFrame) -> DataFrame:
    """Game date (the box's own wins), home flag and opponent; rows without a date are dropped."""
    games = schedule.select("gameId", F.col("game_date").alias("_date"), "home_team_id", "away_team_id")
    joined = box.join(games, "gameId", "left")
    own = F.col("game_date") if "game_date" in box.columns else F.lit(None).cast("date")
    home = F.coalesce(F.col("teamId") == F.col("home_team_id"), F.lit(False))
    return (
        joined.withColumns({
            "game_date": F.coalesce(own.cast("date"), F.col("_date").cast("date")),
            "is_home": home.cast("int"),
            "opp_team_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")),
        })
        .where(F.col("game_date").isNotNull())
        .drop("_date")
    )


def rest(df: DataFrame) -> DataFrame:
    """Days since the player's previous game (7 before the first) and the back-to-back flag."""
    rested = day_gap(df, PLAYER, ORDER, "game_date")
    return rested.withColumn("is_back_to_back", (F.col("rest_days") == 1).cast("int"))


def team_runs(df: DataFrame) -> DataFrame:
    """Number a player's spells with a team from 0 and the games inside each spell from 1."""
    return change_runs(df, PLAYER, ORDER, "teamId", "team_stint_id", "games_on_current_team")


def player_trailing(df: DataFrame, stats=ROLL_STATS, widths=WIDTHS) -> DataFrame:
    return trailing_means(df, PLAYER, ORDER, stats, widths)


def player_ewma(df: DataFrame, stats=ROLL_STATS) -> DataFrame:
    return ewma_means(df, PLAYER, ORDER, stats)


def stint_ewma(df: DataFrame, stats=STINT_STATS) -> DataFrame:
    """Weighted means that start over when the player changes team."""
    return ewma_means(df, [*PLAYER, "team_stint_id"], ORDER, stats, suffix="_stint_ewma")


def weighted_means(df: DataFrame, stats=ROLL_STATS, stint_stats=STINT_STATS) -> DataFrame:
    """Both kinds of weighted means in one pass over the players."""
    return ewma_series(df, PLAYER, ORDER, [([], stats, "_ewma"), (["team_stint_id"], stint_stats, "_stint_ewma")])


def season_to_date(df: DataFrame, stats=ROLL_STATS) -> DataFrame:
    return expanding_means(df, [*PLAYER, "season"], ORDER, stats)


def team_points(box: DataFrame) -> DataFrame:
    return box.groupBy("gameId", "teamId").agg(F.sum("pts").alias("team_pts"))


def game_points(box: DataFrame, schedule: DataFrame) -> DataFrame:
    """Schedule rows with home and away points, null for a side without rows.

    Both sides come from one aggregate per game rather than two joins.
    """
    games = schedule.select("gameId", "game_date", "season", "home_team_id", "away_team_id")
    scored = games.join(team_points(box), "gameId", "left")
    return scored.groupBy("gameId", "game_date", "season", "home_team_id", "away_team_id").agg(
        F.max(F.when(F.col("teamId") == F.col("home_team_id"), F.col("team_pts"))).alias("home_pts"),
        F.max(F.when(F.col("teamId") == F.col("away_team_id"), F.col("team_pts"))).alias("away_pts"),
    )


def by_side(games: DataFrame, home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """One row per team and game; ``home``/``away`` map output names to the source column of each side."""
    side = lambda names: F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    rows = games.select("gameId", "game_date", "season", F.explode(F.array(side(home), side(away))).alias("s"))
    return rows.select("gameId", "game_date", "season", "s.*")


def points_allowed(box: DataFrame, schedule: DataFrame) -> DataFrame:
    """Points a team allowed per game so far this season, two decimals."""
    sides = by_side(
        game_points(box, schedule),
        {"teamId": "home_team_id", "pts_allowed": "away_pts"},
        {"teamId": "away_team_id", "pts_allowed": "home_pts"},
    )
    w = Window.partitionBy("teamId", "season").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return sides.select("gameId", "teamId", half_even(F.avg("pts_allowed").over(w), 2).alias("opp_def_rating"))


def opponent_defence(df: DataFrame, box: DataFrame, schedule: DataFrame) -> DataFrame:
    """Attach what the opponent has allowed so far."""
    table = points_allowed(box, schedule).withColumnRenamed("teamId", "opp_team_id")
    return df.join(table, ["gameId", "opp_team_id"], "left")


def team_efficiency(box: DataFrame) -> DataFrame:
    """Per team and game: ratings per 100 possessions, pace and effective shooting of both sides.

    A game has two teams, so the opponent's totals are the game's totals less the team's own; games in which
    only one team has rows are left out.
    """
    totals = box.groupBy("gameId", "teamId", "season").agg(*[F.sum(c).alias(c) for c in TEAM_TOTALS])
    game = Window.partitionBy("gameId")
    paired = totals.withColumns(
        {"_n": F.count("*").over(game)} | {f"opp_{c}": F.sum(c).over(game) - F.col(c) for c in TEAM_TOTALS}
    ).where("_n = 2")
    pace = F.col("fga") + 0.44 * F.col("fta") - F.col("oreb") + F.col("tov")
    paired = paired.withColumn("pace_proxy", pace)
    return paired.withColumns({
        "ortg": ratio_or(100.0 * F.col("pts"), "pace_proxy", 110.0),
        "drtg": ratio_or(100.0 * F.col("opp_pts"), "pace_proxy", 110.0),
        "team_efg": ratio_or(F.col("fgm") + 0.5 * F.col("fg3m"), "fga", 0.0),
        "opp_efg": ratio_or(F.col("opp_fgm") + 0.5 * F.col("opp_fg3m"), "opp_fga", 0.0),
    }).withColumn("net_rtg", F.col("ortg") - F.col("drtg")).drop("_n")


def efficiency_so_far(box: DataFrame, schedule: DataFrame) -> DataFrame:
    """Team efficiency before each game: last 5, last 10 and season to date."""
    dated = team_efficiency(box).join(schedule.select("gameId", "game_date"), "gameId", "left")
    keys = ["teamId", "season"]
    rolled = trailing_means(dated, keys, ORDER, EFFICIENCY, [5, 10])
    rolled = expanding_means(rolled, keys, ORDER, EFFICIENCY, "_szn")
    added = [f"{c}{s}" for c in EFFICIENCY for s in ("_roll5", "_roll10", "_szn")]
    return rolled.select("gameId", "teamId", "game_date", "season", *added)


def head_to_head(box: DataFrame, schedule: DataFrame, last: int = 10) -> DataFrame:
    """Home side's win share and mean margin over the last meetings of the same two teams.

    Meetings are kept once per unordered pair, seen from the lower team id, and flipped for the row's home
    side afterwards.
    """
    games = game_points(box, schedule).where(F.col("home_pts").isNotNull() & F.col("away_pts").isNotNull())
    flip = F.col("home_team_id") > F.col("away_team_id")
    won = (F.col("home_pts") > F.col("away_pts")).cast("double")
    margin = (F.col("home_pts") - F.col("away_pts")).cast("double")
    seen = games.withColumns({
        "_lo": F.least("home_team_id", "away_team_id"), "_hi": F.greatest("home_team_id", "away_team_id"),
        "_won": F.when(flip, 1.0 - won).otherwise(won), "_margin": F.when(flip, -margin).otherwise(margin),
    })
    w = Window.partitionBy("_lo", "_hi").orderBy(*ORDER).rowsBetween(-last, -1)
    share, mean = F.avg("_won").over(w), F.avg("_margin").over(w)
    rated = seen.withColumns({"_share": share, "_mean": mean, "h2h_games": F.count("*").over(w).cast("int")})
    return rated.select(
        "gameId",
        F.coalesce(F.when(flip, 1.0 - F.col("_share")).otherwise(F.col("_share")), F.lit(0.5)).alias("h2h_win_pct_home"),
        F.coalesce(F.when(flip, -F.col("_mean")).otherwise(F.col("_mean")), F.lit(0.0)).alias("h2h_pts_diff_avg"),
        "h2h_games",
    )


def attach_head_to_head(df: DataFrame, box: DataFrame, schedule: DataFrame, last: int = 10) -> DataFrame:
    return filled_head_to_head(df.join(head_to_head(box, schedule, last), "gameId", "left"))


def filled_head_to_head(joined: DataFrame) -> DataFrame:
    return joined.na.fill({"h2h_win_pct_home": 0.5, "h2h_pts_diff_avg": 0.0, "h2h_games": 0})


def listed(table: DataFrame, name: str) -> DataFrame:
    """The rows of each game as one list (a game has two sides), so that a join neither adds rows nor takes any away."""
    return table.where(F.col("gameId").isNotNull()).groupBy("gameId").agg(
        F.collect_list(F.struct(*[c for c in table.columns if c != "gameId"])).alias(name))


def matching(name: str, keys: list[str]) -> Column:
    """The part of a list that agrees with the row's own keys."""
    agree = lambda item: reduce(Column.__and__, [item[k] == F.col(k) for k in keys])
    return F.filter(name, agree) if keys else F.col(name)


def taken_out(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """A row for each item of a list, or one with nulls: what a left join with the listed table gives."""
    rows = df.withColumn(name, F.explode_outer(name))
    return rows.select(*[c for c in rows.columns if c != name], *[F.col(name)[c].alias(c) for c in cols])


def attach_rolled(df: DataFrame, table: DataFrame | None, game: str = "game_id", widths=WIDTHS) -> DataFrame:
    """Merge the rolled columns of an optional player-game table (shots, matchups)."""
    if table is None:
        return df
    rolled = [c for c in table.columns if any(c.endswith(f"_roll{w}") for w in widths)]
    right = table.select(F.col(game).cast("bigint").alias("gameId"), F.col("personId").cast("bigint"), *rolled)
    return df.join(right, ["gameId", "personId"], "left")


def workload(df: DataFrame) -> DataFrame:
    """Minutes load, recent overload, back-to-back density, their index and the high-load flag."""
    loaded = trailing_sums(df, PLAYER, ORDER, {"_load": ("min", 7), "_btb": ("is_back_to_back", 5)})
    over = F.coalesce(F.col("min_roll5"), F.lit(0.0)) - F.coalesce(F.col("min_season_avg"), F.lit(0.0))
    loaded = loaded.withColumns({
        "min_load_7d": half_even("_load", 1),
        "min_vs_season_avg": half_even(over, 2),
        "btb_5g_count": F.coalesce(F.col("_btb"), F.lit(0)).cast("int"),
    }).drop("_load", "_btb")
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    index = (
        clip(F.col("min_vs_season_avg") / 10.0, -1.0, 1.0) * 0.3
        + F.col("btb_5g_count") / 5.0 * 0.3
        + clip(F.coalesce(F.col("min_load_7d"), F.lit(0.0)) / 240.0, 0.0, 1.0) * 0.4
    )
    loaded = loaded.withColumn("workload_index", half_even(index, 3))
    fresh = F.coalesce(F.col("games_on_current_team"), F.lit(999)) < 10
    return loaded.withColumn("high_workload_flag", ((F.col("workload_index") > 0.6) | fresh).cast("int"))


def load_signals(df: DataFrame, spike: float = 1.25, window: int = 5, many: int = 2) -> DataFrame:
    """Minutes spike, back-to-back streak and fatigue z-score over ten games, with a 0–1 risk score."""
    w = Window.partitionBy(*PLAYER).orderBy(*ORDER)
    recent = w.rowsBetween(-10, -1)
    spread = F.stddev_samp("min").over(recent)
    signals = df.withColumns({
        "btb_count_5": F.coalesce(F.sum("is_back_to_back").over(w.rowsBetween(-window, -1)), F.lit(0)).cast("int"),
        "min_spike": F.coalesce(F.col("min_roll5") > spike * F.col("min_season_avg"), F.lit(False)),
        "fatigue_z": (F.lag("min").over(w) - F.avg("min").over(recent)) / F.nullif(spread, F.lit(0.0)),
    })
    streak = F.col("btb_count_5") >= many
    score = (
        F.col("min_spike").cast("double") * 0.4
        + F.least(F.lit(1.0), F.col("btb_count_5") / float(window)) * 0.3
        + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("fatigue_z"), F.lit(0.0)) / 3.0)) * 0.3
    )
    return signals.withColumns({"high_load_flag": F.col("min_spike") | streak, "risk_score": half_even(score, 3)})
