"""Player, team and game predictions for all fixtures at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import clip, half_even, normal_name, sigmoid, zero_if_null
from hoopspark.functions.windows import latest_in_series, top_rows

# fixed values
LEAGUE_POINTS = 113.5
LEAGUE_RATING = 113.5
HOME_POINTS = 2.5
LEAGUE_PACE = 98.0
START_ELO = 1500.0
TARGETS = ["pts", "reb", "ast", "stl", "blk", "tov", "min"]
MODEL_WEIGHT = {"min": 0.05}
STARTER_CAP, BENCH_CAP, TEAM_MINUTES = 42.0, 35.0, 240.0
MAX_USAGE, MAX_MINUTES = 0.45, 44.0
TEAM = ["teamTricode"]


def blend(ewma: str, season: str) -> Column:
    """Seven parts recent form, three parts season."""
    return 0.70 * zero_if_null(ewma) + 0.30 * zero_if_null(season)


def current_players(features: DataFrame, season, roster: DataFrame | None = None, cols: list[str] | None = None) -> DataFrame:
    """Latest values of each team's players this season, kept to the live roster (matched on normalised names)."""
    cols = cols or [c for c in features.columns if c not in ("teamTricode", "personId", "season")]
    latest = latest_in_series(
        features.where(F.col("season") == season), ["teamTricode", "personId"], ["game_date", "gameId"], cols
    )
    if roster is None:
        return latest
    listed = roster.select(F.col("team_tri").alias("teamTricode"), normal_name("player_name").alias("_name")).distinct()
    named = latest.withColumn("_name", normal_name("playerName"))
    return named.join(listed, ["teamTricode", "_name"], "left_semi").drop("_name")


def selected_players(pool: DataFrame, top_n: int = 8) -> DataFrame:
    """The players expected to see most time."""
    score = 0.60 * zero_if_null("min_ewma") + 0.40 * zero_if_null("min_season_avg")
    return top_rows(pool.withColumn("_select", score), TEAM, [F.desc("_select"), "personId"], top_n).drop("_select")


def opponent_context(game_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Per team: defensive rating and team rating of its latest game row, else the means of its players."""
    side = lambda s: F.struct(
        F.col(f"{s}_tricode").alias("team"), F.col(f"{s}_drtg_roll5").alias("drtg"), F.col(f"{s}_team_elo").alias("elo"))
    sides = game_rows.select("game_date", "gameId", F.explode(F.array(side("home"), side("away"))).alias("s"))
    latest = sides.groupBy(F.col("s.team").alias("opp_tri")).agg(
        F.max_by(F.struct("s.drtg", "s.elo"), F.struct("game_date", "gameId")).alias("g"))
    means = pool.groupBy(F.col("teamTricode").alias("opp_tri")).agg(F.avg("drtg_roll5").alias("_drtg"))
    joined = latest.join(means, "opp_tri", "full_outer")
    return joined.select(
        "opp_tri", F.coalesce(F.nullif("g.drtg", F.lit(0.0)), "_drtg").alias("opp_def_rating"),
        F.coalesce(F.nullif("g.elo", F.lit(0.0)), F.lit(START_ELO)).alias("opp_elo"),
    )


def redistributed(pool: DataFrame, chosen: DataFrame, outs: DataFrame) -> DataFrame:
    """Remaining players with the usage and minutes of the absent ones shared equally, within the caps."""
    key = [*TEAM, "personId"]
    lost = pool.join(outs, key, "left_semi").groupBy(*TEAM).agg(
        F.sum(zero_if_null("usg_pct_ewma")).alias("usage_lost"), F.sum(zero_if_null("min_ewma")).alias("min_lost"))
    left = chosen.join(outs, key, "left_anti").join(lost, TEAM, "left")
    n = F.count("*").over(Window.partitionBy(*TEAM))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / n
    raised = lambda c, lost_col, cap: F.when(F.col(lost_col).isNull(), F.col(c)).otherwise(F.least(F.lit(cap), F.col(c) + share(lost_col)))
    more = {c: raised(c, "usage_lost", MAX_USAGE) for c in ("usg_pct_roll5", "usg_pct_ewma") if c in left.columns}
    more |= {c: raised(c, "min_lost", MAX_MINUTES) for c in ("min_roll5", "min_ewma", "min_stint_ewma") if c in left.columns}
    return left.withColumns(more)


def home_multiplier(is_home: str) -> Column:
    return F.when(F.col(is_home), 1.02).when(~F.col(is_home), 0.98).otherwise(1.0)


def matchup_multiplier(rating) -> Column:
    """Opponents that allow more than the league raise the prediction, within 8 %."""
    return clip(1.0 + (rating - LEAGUE_RATING) / 10.0 * 0.20, 0.92, 1.08)


def stat_predictions(players: DataFrame, fixtures: DataFrame, context: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """Baseline (and model, where a column holds its prediction) per statistic, for home side and opponent.

    ``fixtures``: teamTricode, opp_tri, is_home. Both are one row per team, joined by team.
    """
    models = models or {}
    rows = players.join(fixtures, TEAM, "left").join(context, "opp_tri", "left")
    faced = F.when(F.col("opp_tri").isNotNull(), F.coalesce("opp_def_rating", F.lit(LEAGUE_RATING)))
    factor = F.when(faced.isNotNull(), matchup_multiplier(faced))
    preds = {}
    for t in TARGETS:
        base = blend(f"{t}_ewma", f"{t}_season_avg") * (F.lit(1.0) if t == "min" else home_multiplier("is_home"))
        w = MODEL_WEIGHT.get(t, 0.10)
        mixed = F.coalesce(w * F.col(models[t]) + (1 - w) * base, base) if t in models else base
        preds[f"pred_{t}"] = half_even(F.greatest(F.lit(0.0), mixed), 1)
    rows = rows.withColumns(preds)
    against = {}
    for t in TARGETS[:-1]:
        mult = clip(2.0 - factor, 0.92, 1.08) if t == "tov" else factor
        changed = half_even(F.greatest(F.lit(0.0), F.col(f"pred_{t}") * mult), 1)
        against[f"pred_{t}"] = F.when(factor.isNull(), F.col(f"pred_{t}")).otherwise(changed)
    averages = {f"avg_{t}": half_even(zero_if_null(f"{t}_season_avg"), 1) for t in TARGETS}
    return rows.withColumns(against | averages)


def scaled_to_team(preds: DataFrame) -> DataFrame:
    """Roles by predicted minutes, role caps, and minutes scaled to a team's 240 with the statistics alike."""
    team = Window.partitionBy(*TEAM)
    place = F.row_number().over(team.orderBy(F.desc("pred_min"), "personId"))
    rows = preds.withColumn("role", F.when(place <= 5, "starter").otherwise("bench"))
    cap = F.when(F.col("role") == "starter", STARTER_CAP).otherwise(BENCH_CAP)
    rows = rows.withColumn("_old", F.least("pred_min", cap))
    tenths = F.sum(F.round(F.col("_old") * 10).cast("bigint")).over(team) / 10.0
    rows = rows.withColumn("_total", tenths).withColumn(
        "pred_min", F.when(F.col("_total") > 0, half_even(F.col("_old") * (TEAM_MINUTES / F.col("_total")), 1)).otherwise(F.col("_old")))
    scale = F.col("pred_min") / F.nullif("_old", F.lit(0.0))
    return rows.withColumns({
        f"pred_{t}": F.when(scale.isNotNull() & (F.col("_total") > 0), half_even(F.col(f"pred_{t}") * scale, 1)).otherwise(F.col(f"pred_{t}"))
        for t in TARGETS[:-1]
    }).drop("_old", "_total")


def player_predictions(pool, outs, fixtures, context, top_n: int = 8, models: dict[str, str] | None = None) -> DataFrame:
    """Predicted box lines of every team's next game."""
    chosen = redistributed(pool, selected_players(pool, top_n), outs)
    return scaled_to_team(stat_predictions(chosen, fixtures, context, models))


def team_profiles(pool: DataFrame, outs: DataFrame) -> DataFrame:
    """Ratings, pace, team rating, points lost to absences and active players of each team."""
    away = outs.select(*TEAM, "personId", F.lit(1).alias("_out"))
    rows = pool.join(away, [*TEAM, "personId"], "left")
    here = F.col("_out").isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(here, F.col(c))), F.lit(0.0)) if c in pool.columns else F.lit(0.0)
    weighted = lambda c, default: F.coalesce(
        F.nullif(0.70 * mean(f"{c}_roll5") + 0.30 * mean(f"{c}_szn"), F.lit(0.0)), F.lit(default))
    elo = F.avg(F.when(here, F.col("team_elo"))) if "team_elo" in pool.columns else F.lit(START_ELO)
    profiles = rows.groupBy(*TEAM).agg(
        weighted("ortg", LEAGUE_RATING).alias("ortg"), weighted("drtg", LEAGUE_RATING).alias("drtg"),
        weighted("pace_proxy", LEAGUE_PACE).alias("pace"), elo.alias("elo"),
        F.sum(F.when(~here, blend("pts_ewma", "pts_season_avg")).otherwise(0.0)).alias("pts_lost"),
        F.count_if(here).alias("n_active"),
    )
    return profiles.where("n_active > 0")


def game_predictions(fixtures: DataFrame, profiles: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """Score and home win probability per fixture (home_tri, away_tri).

    ``models`` may name fixture columns holding model outputs: win, home_pts, away_pts; league values stand in.
    """
    models = models or {}
    side = lambda p, s: p.select(F.col("teamTricode").alias(f"{s}_tri"), *[F.col(c).alias(f"{s}_{c}") for c in ("ortg", "drtg", "elo", "pts_lost", "n_active")])
    rows = fixtures.join(side(profiles, "home"), "home_tri").join(side(profiles, "away"), "away_tri")
    output = lambda name, default: F.coalesce(F.col(models[name]), F.lit(default)) if name in models else F.lit(default)
    points = lambda a, b: LEAGUE_POINTS * (F.col(f"{a}_ortg") / LEAGUE_RATING) * (F.col(f"{b}_drtg") / LEAGUE_RATING)
    home = points("home", "away") + HOME_POINTS - F.col("home_pts_lost") * 0.60
    away = points("away", "home") - HOME_POINTS - F.col("away_pts_lost") * 0.60
    rows = rows.withColumns({
        "_h": half_even(0.80 * home + 0.20 * output("home_pts", LEAGUE_POINTS), 1),
        "_a": half_even(0.80 * away + 0.20 * output("away_pts", LEAGUE_POINTS), 1),
    })
    by_data = sigmoid(0.11 * (F.col("_h") - F.col("_a")) + 0.0015 * (F.col("home_elo") - F.col("away_elo")))
    rows = rows.withColumn("win_prob_home", clip(half_even(0.75 * by_data + 0.25 * output("win", 0.5), 4), 0.05, 0.95))
    swap = (F.col("win_prob_home") > 0.5) != (F.col("_h") > F.col("_a"))
    return rows.select(
        *fixtures.columns, "win_prob_home", half_even(1.0 - F.col("win_prob_home"), 4).alias("win_prob_away"),
        F.when(swap, F.col("_a")).otherwise(F.col("_h")).alias("home_score"), F.when(swap, F.col("_h")).otherwise(F.col("_a")).alias("away_score"),
        *[half_even(f"{s}_{c}", 1).alias(f"{s}_{c}") for c in ("ortg", "drtg", "pts_lost") for s in ("home", "away")],
    )


def box_comparison(live_box: DataFrame, preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Actual against predicted lines per player, matched on normalised names (and ``keys``)."""
    on = [*(keys or []), "_name"]
    right = preds.select(*(keys or []), normal_name("playerName").alias("_name"), F.lit(True).alias("_hit"), *[f"pred_{t}" for t in TARGETS])
    joined = live_box.withColumn("_name", normal_name("name")).join(right, on, "left")
    value = lambda c: zero_if_null(c)
    return joined.withColumns(
        {f"pred_{t}": value(f"pred_{t}") for t in TARGETS} | {f"diff_{t}": half_even(value(t) - value(f"pred_{t}"), 1) for t in TARGETS}
        | {"matched": F.coalesce("_hit", F.lit(False))}
    ).drop("_name", "_hit")


def points_error(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute error of points over the matched players."""
    return compared.where("matched").groupBy(*keys).agg(half_even(F.avg(F.abs(F.col("pts") - F.col("pred_pts"))), 1).alias("pts_mae"))
