"""Totals and ratings of five-man lineups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.functions.scalars import half_even, ratio
from hoopspark.functions.windows import first_values
from hoopspark.operators.features import by_side

POSSESSIONS_PER_MINUTE = 2.083
EMBEDDING_STATS = ["pts", "reb", "ast", "stl", "blk", "tov", "min", "ts_pct", "efg_pct", "usg_pct"]
KEY = ["teamId", "season", "lineup"]


def lineup_totals(segments: DataFrame) -> DataFrame:
    """Games and minutes of each lineup of a team and season, and its net points when segments carry them.

    Minutes are added in whole hundredths, so the total does not depend on the order of the rows.
    """
    hundredths = F.sum(F.round(F.col("min") * 100).cast("bigint")) / 100.0
    sums = [F.countDistinct("gameId").alias("games"), half_even(hundredths, 1).alias("total_min")]
    if "net_pts" in segments.columns:
        sums.append(half_even(F.sum("net_pts"), 1).alias("net_pts"))
    return segments.groupBy(*KEY).agg(*sums)


def player_names(box: DataFrame) -> DataFrame:
    """Best-known name of each player: the one of the first game that has one."""
    return first_values(box, ["personId"], ["gameId"], ["playerName"])


def with_players(lineups: DataFrame, names: DataFrame) -> DataFrame:
    """Spread the lineup over p1..p5 and attach the five names.

    The names are looked up once per lineup member and folded back, one join instead of five.
    """
    members = lineups.select(*KEY, F.posexplode("lineup").alias("place", "personId"))
    named = members.join(names, "personId", "left").groupBy(*KEY).agg(
        *[F.max(F.when(F.col("place") == i, F.col("playerName"))).alias(f"p{i + 1}_name") for i in range(5)]
    )
    spread = lineups.withColumns({f"p{i + 1}": F.element_at("lineup", i + 1) for i in range(5)})
    return spread.join(named, KEY)


def net_ratings(totals: DataFrame) -> DataFrame:
    """Possessions from minutes at league pace, and net points per 100 possessions."""
    rated = totals.withColumn("possessions", half_even(F.col("total_min") * POSSESSIONS_PER_MINUTE, 1))
    return rated.withColumn("net_rating", half_even(ratio(100.0 * F.col("net_pts"), "possessions"), 2))


def game_totals_by_side(box: DataFrame, points: DataFrame) -> DataFrame:
    """Team points, opponent points and team minutes per team-game with both sides' points."""
    both = points.where(F.col("home_pts").isNotNull() & F.col("away_pts").isNotNull())
    sides = by_side(
        both, {"teamId": "home_team_id", "team_pts": "home_pts", "opp_pts": "away_pts"},
        {"teamId": "away_team_id", "team_pts": "away_pts", "opp_pts": "home_pts"},
    )
    played = box.groupBy("gameId", "teamId").agg(F.sum("min").alias("team_min"))
    return sides.join(played, ["gameId", "teamId"]).drop("game_date", "season")


def prorated_points(segments: DataFrame, totals_by_side: DataFrame, minutes_scale: float = 1.0) -> DataFrame:
    """Team and opponent points of a lineup, by its share of team minutes.

    Team minutes add up five players, so with ``minutes_scale=1`` the ratings come out at about a fifth;
    ``minutes_scale=5`` puts both on the same clock.
    """
    rows = segments.join(totals_by_side, ["gameId", "teamId"], "left")
    share = ratio(F.col("min") * minutes_scale, "team_min")
    return rows.groupBy(*KEY).agg(
        F.coalesce(F.sum(share * F.col("team_pts")), F.lit(0.0)).alias("pts_scored"),
        F.coalesce(F.sum(share * F.col("opp_pts")), F.lit(0.0)).alias("pts_allowed"),
    )


def two_way_ratings(rated: DataFrame, prorated: DataFrame) -> DataFrame:
    joined = rated.join(prorated, KEY, "left")
    return joined.withColumns({
        "off_rating": half_even(ratio(100.0 * F.col("pts_scored"), "possessions"), 2),
        "def_rating": half_even(ratio(100.0 * F.col("pts_allowed"), "possessions"), 2),
    })


def player_season_means(box: DataFrame, stats=EMBEDDING_STATS) -> DataFrame:
    return box.where(F.col("min") > 0).groupBy("personId", "season").agg(*[F.avg(c).alias(c) for c in stats])


def lineup_embeddings(lineups: DataFrame, means: DataFrame, stats=EMBEDDING_STATS) -> DataFrame:
    """Mean of the members' season vectors; unknown members are skipped, a lineup of unknowns is all zeros.

    A member with a null entry makes that entry of the mean null.
    """
    members = lineups.select(*KEY, F.explode("lineup").alias("personId"))
    found = members.join(means.withColumn("_known", F.lit(1)), ["personId", "season"], "left")
    known = F.count("_known")
    return found.groupBy(*KEY).agg(*[
        F.when(known == 0, F.lit(0.0)).when(F.count(c) == known, F.avg(c)).alias(f"emb_{c}") for c in stats
    ])


def lineup_ratings(scored_segments: DataFrame, box: DataFrame, points: DataFrame, minutes_scale: float = 1.0) -> DataFrame:
    """Totals, ratings and embeddings of every lineup."""
    rated = net_ratings(lineup_totals(scored_segments))
    sides = game_totals_by_side(box, points)
    rated = two_way_ratings(rated, prorated_points(scored_segments, sides, minutes_scale))
    return rated.join(lineup_embeddings(rated, player_season_means(box)), KEY)
