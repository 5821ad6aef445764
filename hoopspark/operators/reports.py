"""Workload, injury, trade and season reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import half_even, normal_name, sigmoid, zero_if_null
from hoopspark.functions.windows import latest_values
from hoopspark.operators.predictions import team_profiles
from hoopspark.operators.selection import best_five

HIGH, MEDIUM = 55, 30
PLAYOFF_DIRECT, PLAYOFF_PLAYIN = 6, 10


def workload_report(loaded: DataFrame, season, top_n: int = 25) -> DataFrame:
    """Active players with the highest workload index this season, on their latest row."""
    cols = ["playerName", "teamTricode", "min_ewma", "min_load_7d", "min_vs_season_avg", "btb_5g_count", "workload_index",
            "high_workload_flag", "games_on_current_team"]
    active = loaded.where((F.col("season") == season) & (F.coalesce("min_ewma", F.lit(0.0)) > 5))
    latest = latest_values(active, ["personId"], ["game_date", "gameId"], cols)
    return latest.orderBy(F.desc("workload_index"), "personId").limit(top_n)


def injury_risk(features: DataFrame, report: DataFrame, season, as_of, days: int = 10, team: str | None = None, top_n: int | None = 50) -> DataFrame:
    """Risk percentage, level and drivers from load, rest, usage, back-to-backs and the injury report.

    Players seen in the last days with at least ten minutes a game; the top ones, or a whole team.
    """
    stats = ["min_season_avg", "min_ewma", "min_roll5", "usg_pct_season_avg", "usg_pct_ewma", "rest_days", "is_back_to_back",
             "playerName", "teamTricode", "game_date"]
    rows = features.where(F.col("season") == season)
    rows = rows if team is None else rows.where(F.col("teamTricode") == team)
    latest = latest_values(rows.withColumn("_date", F.col("game_date")), ["personId"], ["_date", "gameId"], stats)
    latest = latest.where((F.col("game_date") >= F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("min_season_avg") >= 10))
    listed = report.groupBy(normal_name("player_name").alias("_name")).agg(
        F.max(F.struct(F.col("status_rank").alias("rank"), F.col("status").alias("status"), F.col("injury_detail").alias("detail"))).alias("inj"))
    rows = latest.withColumn("_name", normal_name("playerName")).join(listed, "_name", "left")
    avg, usage = zero_if_null("min_season_avg"), F.coalesce(F.nullif("usg_pct_season_avg", F.lit(0.0)), F.lit(0.01))
    rest = F.coalesce(F.nullif(F.col("rest_days").cast("double"), F.lit(0.0)), F.lit(3.0))
    rows = rows.withColumns({
        "load_ratio": zero_if_null("min_ewma") / F.greatest(avg, F.lit(5.0)), "rest": rest,
        "usage_ratio": zero_if_null("usg_pct_ewma") / F.greatest(usage, F.lit(0.01)), "is_b2b": F.coalesce(F.col("is_back_to_back") == 1, F.lit(False)),
        "inj_factor": F.least(F.lit(1.0), F.coalesce(F.col("inj.rank"), F.lit(0)) / 5.0), "inj_status": F.coalesce("inj.status", F.lit("")),
        "inj_detail": F.coalesce("inj.detail", F.lit("")),
    })
    above = lambda x: F.greatest(F.lit(0.0), x)
    rows = rows.withColumns({
        "_load": above((F.col("load_ratio") - 0.85) / 0.35), "_rest": above(1.0 - F.col("rest") / 4.0), "_usage": above((F.col("usage_ratio") - 0.90) / 0.35),
    })
    one = lambda c: F.least(F.lit(1.0), F.col(c))
    raw = 0.30 * one("_load") + 0.25 * F.col("_rest") + 0.15 * one("_usage") + 0.10 * F.when(F.col("is_b2b"), 0.25).otherwise(0.0) + 0.20 * F.col("inj_factor")
    percent = lambda c: F.rint(F.col(c) * 100).cast("int").cast("string")
    drivers = F.array_compact(F.array(
        F.when(F.col("_load") > 0.3, F.concat(F.lit("High load ("), percent("load_ratio"), F.lit("% of avg)"))),
        F.when(F.col("_rest") > 0.5, F.concat(F.lit("Low rest ("), F.col("rest").cast("int").cast("string"), F.lit("d)"))),
        F.when(F.col("_usage") > 0.3, F.concat(F.lit("Usage spike ("), percent("usage_ratio"), F.lit("%)"))),
        F.when(F.col("is_b2b"), F.lit("Back-to-back")),
        F.when(F.col("inj_factor") > 0, F.coalesce(F.nullif("inj_status", F.lit("")), F.lit("On injury report"))),
    ))
    scored = rows.withColumns({"risk_pct": F.rint(F.least(F.lit(100.0), half_even(raw * 100, 9))).cast("int"), "drivers": drivers})
    level = F.when(F.col("risk_pct") >= HIGH, "High").when(F.col("risk_pct") >= MEDIUM, "Medium").otherwise("Low")
    result = scored.select(
        "personId", F.col("playerName").alias("player_name"), F.col("teamTricode").alias("team_tri"), "risk_pct", level.alias("risk_level"),
        half_even("min_season_avg", 1).alias("min_avg"), half_even(zero_if_null("min_roll5"), 1).alias("min_recent"),
        F.col("rest").cast("int").alias("rest_days"), "is_b2b", "inj_status", "inj_detail", "drivers",
    )
    return result if team is not None or top_n is None else result.orderBy(F.desc("risk_pct"), "personId").limit(top_n)


def injury_impact(features: DataFrame, report: DataFrame, threshold: float = 20.0, least: int = 2) -> DataFrame:
    """Share of a team's weighted minutes that belongs to injured players."""
    heavy = features.where(F.coalesce("min_ewma", F.lit(0.0)) > threshold)
    latest = latest_values(heavy, ["teamTricode", "personId"], ["game_date", "gameId"], ["playerName", "min_ewma"])
    hurt = report.where(F.col("status_rank") >= least).select(
        F.col("team_tri").alias("teamTricode"), normal_name("player_name").alias("_name"), F.lit(1).alias("_hurt")).distinct()
    rows = latest.withColumn("_name", normal_name("playerName")).join(hurt, ["teamTricode", "_name"], "left")
    lost = F.coalesce(F.sum(F.when(F.col("_hurt") == 1, F.col("min_ewma"))), F.lit(0.0))
    return rows.groupBy("teamTricode").agg(half_even(lost / F.greatest(F.sum("min_ewma"), F.lit(1.0)), 3).alias("impact"))


def unplayed_games(schedule: DataFrame, box: DataFrame, after) -> DataFrame:
    """Scheduled games later than a day that have no box-score rows."""
    later = schedule.where(F.col("game_date") > F.lit(after).cast("date"))
    return later.join(box.select("gameId").distinct(), "gameId", "left_anti")


def playoff_odds(wins: DataFrame) -> DataFrame:
    """Seeding shares from a table of replicate seasons (replicate, conference, teamId, wins)."""
    seed = F.row_number().over(Window.partitionBy("replicate", "conference").orderBy(F.desc("wins"), "teamId"))
    share = lambda c: F.avg(c.cast("double"))
    s = F.col("seed")
    return wins.withColumn("seed", seed).groupBy("conference", "teamId").agg(
        F.avg("wins").alias("expected_wins"), share(s <= PLAYOFF_DIRECT).alias("p_direct_playoff"),
        share((s > PLAYOFF_DIRECT) & (s <= PLAYOFF_PLAYIN)).alias("p_playin"), share(s > PLAYOFF_PLAYIN).alias("p_miss_playoffs"),
    )


def rosters_after_trades(pool: DataFrame, moves: DataFrame) -> DataFrame:
    """Latest player rows with traded players on their new teams. ``moves``: personId, to_team (one per player)."""
    return pool.join(moves, "personId", "left").withColumn("teamTricode", F.coalesce("to_team", "teamTricode")).drop("to_team")


def roster_strength(pool: DataFrame) -> DataFrame:
    """Best-five score, net rating and win share against an average team of each roster."""
    none = pool.select("teamTricode", "personId").where(F.lit(False))
    ratings = team_profiles(pool, none).select("teamTricode", (F.col("ortg") - F.col("drtg")).alias("net_rating"))
    five = best_five(pool, ["teamTricode"]).select("teamTricode", F.col("total_score").alias("score"))
    return five.join(ratings, "teamTricode").withColumn("win_pct", sigmoid(0.11 * F.col("net_rating")))


def trade_impact(pool: DataFrame, moves: DataFrame) -> DataFrame:
    """Strength of every team in a trade before and after, and the change.

    ``pool`` has one row per player with score, position and ratings; all trades are evaluated at once.
    """
    before, after = roster_strength(pool), roster_strength(rosters_after_trades(pool, moves))
    left = pool.join(moves, "personId").select(F.explode(F.array("teamTricode", "to_team")).alias("teamTricode")).distinct()
    rename = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in ("score", "net_rating", "win_pct")})
    joined = left.join(rename(before, "pre"), "teamTricode").join(rename(after, "post"), "teamTricode")
    return joined.withColumns({f"{c}_delta": F.col(f"post_{c}") - F.col(f"pre_{c}") for c in ("score", "net_rating", "win_pct")})
