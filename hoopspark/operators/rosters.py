"""Rosters, injuries, names, schedules and live games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopspark.functions.scalars import clock_label, normal_name
from hoopspark.operators.teams import decorate, lookup, team_code

# Status text -> rank, in matching order.
STATUS_RANK = {
    "out": 4, "injured reserve": 4, "suspension": 4,
    "doubtful": 3,
    "questionable": 2, "game time decision": 2, "game_time_decision": 2,
    "day-to-day": 1, "day to day": 1, "day_to_day": 1, "probable": 1,
    "active": 0,
}
# Order of statuses on the injury list.
STATUS_ORDER = ["Out", "Injured Reserve", "Suspension", "Doubtful", "Questionable", "Game Time Decision", "Day-To-Day",
                "Probable"]
SURE_OUT = 4


def status_rank(status) -> Column:
    """Rank by the exact text, else by the first known text that begins it or that it begins, else 0."""
    key = F.lower(F.trim(F.col(status) if isinstance(status, str) else status))
    close = [F.when(F.startswith(key, F.lit(k)) | F.startswith(F.lit(k), key), v) for k, v in STATUS_RANK.items()]
    return F.coalesce(lookup(key, STATUS_RANK), *close, F.lit(0))


def list_order(status: str) -> Column:
    """Place of a status on the injury list; 99 when unknown."""
    low = F.lower(F.col(status))
    return F.coalesce(*[F.when(F.contains(low, F.lit(s.lower())), i) for i, s in enumerate(STATUS_ORDER)], F.lit(99))


def sub_position(primary: str = "primary_pos") -> Column:
    """Finer position from a primary one and a player's averages (pts, reb, ast, blk)."""
    pts, reb, ast, blk = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("pts", "reb", "ast", "blk"))
    place = F.col(primary)
    guard = F.when((reb >= 5.5) | ((reb >= 4.0) & (ast < 4.0)), "G-F").otherwise("G")
    forward = (
        F.when((ast >= 5.0) | ((ast >= 3.5) & (reb < 5.5)), "F-G")
        .when((blk >= 1.3) | ((reb >= 8.5) & (blk >= 0.8)), "F-C")
        .otherwise("F")
    )
    centre = F.when((ast >= 3.5) | (pts >= 18), "C-F").otherwise("C")
    other = F.when(F.coalesce(place, F.lit("")) == "", "F").otherwise(place)
    return F.when(place == "G", guard).when(place == "F", forward).when(place == "C", centre).otherwise(other)


def players_out(players: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Players named by a token of their team: a player id, or part of a normalised name.

    ``tokens``: the keys and ``token``. Candidates meet only inside a team, so the pairs stay at roster size.
    """
    wanted = tokens.select(*keys, F.trim("token").alias("_token")).where(F.col("_token") != "").select(
        *keys, F.when(F.col("_token").rlike("^[0-9]+$"), F.col("_token").try_cast("bigint")).alias("_id"),
        F.when(~F.col("_token").rlike("^[0-9]+$"), normal_name("_token")).alias("_part"),
    ).distinct()
    hit = (F.col("_id") == F.col("personId")) | F.contains(F.col("_name"), F.col("_part"))
    named = players.withColumn("_name", normal_name("playerName"))
    return named.join(wanted, [*keys]).where(hit).select(*keys, "personId").distinct()


def split_tokens(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Comma-separated names or ids, one per row."""
    return df.select(*keys, F.explode(F.split(col, ",")).alias("token"))


def current_rosters(listed: DataFrame, trades: DataFrame) -> DataFrame:
    """Listed rosters with each traded player moved to the team of the last trade."""
    moves = trades.where(F.col("player_name").isNotNull() & F.col("to_team_tri").isNotNull()).select(
        F.trim("player_name").alias("player_name"), team_code(F.upper("to_team_tri")).alias("_to"), "transaction_date"
    ).groupBy("player_name").agg(F.max_by("_to", F.struct("transaction_date", "_to")).alias("_to"))
    base = listed.withColumns({"player_name": F.trim("player_name"), "team_tri": team_code(F.upper("team_tri"))})
    joined = base.join(moves, "player_name", "left")
    return joined.select(
        "player_name", F.coalesce("_to", "team_tri").alias("team_tri"), "primary_pos",
        F.when(F.col("_to").isNotNull(), "trade_adjusted").otherwise("listed").alias("source"),
    )


def rosters_by_team(roster: DataFrame, teams: DataFrame, team: str | None = None) -> DataFrame:
    """Roster rows with their team's name, colour and logo, in team and player order.

    The grouping is an order of rows, which Spark sorts by ranges, not one list per team.
    """
    rows = roster if team is None else roster.where(F.col("team_tri") == team.upper())
    placed = decorate(rows.withColumnRenamed("primary_pos", "position"), teams, "team_tri", "team")
    return placed.orderBy("team_tri", "player_name", "source")


def injury_list(report: DataFrame, team: str | None = None, search: str | None = None) -> DataFrame:
    """Injured players of a team or whose name holds a text, with their place on the list."""
    rows = report if team is None else report.where(F.col("team_tri") == team.upper())
    if search:
        rows = rows.where(F.contains(F.lower("player_name"), F.lit(search.lower())))
    return rows.withColumn("status_order", list_order("status"))


def injuries_by_team(report: DataFrame) -> DataFrame:
    """The injury list in team and status order."""
    return injury_list(report).orderBy("team_tri", "status_order", "player_name")


def injury_counts_by_team(report: DataFrame) -> DataFrame:
    """Listed players, sure absences and possible ones per team."""
    return report.groupBy("team_tri").agg(F.count("*").alias("listed"), *_counts())


def _counts() -> list[Column]:
    rank = F.col("status_rank")
    return [F.count_if(rank >= SURE_OUT).alias("out_count"), F.count_if(rank.between(2, 3)).alias("questionable_count")]


def injury_counts(report: DataFrame) -> DataFrame:
    return report.agg(*_counts())


def injured(report: DataFrame, least: int = 2) -> DataFrame:
    return report.where(F.col("status_rank") >= least)


def decorated_schedule(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Name, colour and logo of both sides."""
    return decorate(decorate(games, teams, "home_tri", "home"), teams, "away_tri", "away", "#8b5cf6")


def upcoming(games: DataFrame, now, zone: str = "UTC", start: str = "start_time") -> DataFrame:
    """Games that have not begun, with the local day they fall on."""
    later = games.where(F.col(start).isNotNull() & (F.col(start) >= F.lit(now)))
    return later.withColumn("local_day", F.to_date(F.from_utc_timestamp(start, zone)))


def upcoming_days(games: DataFrame, now, zone: str = "UTC") -> DataFrame:
    """Number of games per local day."""
    return upcoming(games, now, zone).groupBy("local_day").agg(F.count("*").alias("games"), F.min("start_time").alias("first_start"))


def live_labels(live: DataFrame) -> DataFrame:
    """Status word and ``m:ss`` clock of live rows."""
    word = F.when(F.col("status") == 2, "live").when(F.col("status") == 3, "final").otherwise("scheduled")
    return live.withColumns({"status": word, "game_clock": clock_label("clock_sec")})


def unified_games(schedule: DataFrame, live: DataFrame) -> DataFrame:
    """Today's schedule with live rows laid over it, whichever way round the pair is written.

    Live beats final beats upcoming; a scheduled "in progress" without a live row counts as live.
    """
    pair = lambda h, a: [F.least(h, a).alias("_lo"), F.greatest(h, a).alias("_hi")]
    running = live.where(F.col("status").isin("live", "final")).select(
        *pair("home_tri", "away_tri"), F.struct(
            F.col("status"), F.col("home_score"), F.col("away_score"), F.col("period"), F.col("game_clock")).alias("l")
    ).groupBy("_lo", "_hi").agg(F.max("l").alias("l"))
    joined = schedule.select("*", *pair("home_tri", "away_tri")).join(running, ["_lo", "_hi"], "left")
    low = F.lower("status")
    is_live = F.coalesce(F.col("l.status") == "live", F.lit(False))
    final = F.contains(low, F.lit("final")) | (F.col("status") == "3") | F.coalesce(F.col("l.status") == "final", F.lit(False))
    going = is_live | (~final & (F.contains(low, F.lit("progress")) | (F.col("status") == "2")))
    pick = lambda c: F.when(is_live, F.col(f"l.{c}")).otherwise(F.col(c))
    return joined.select(
        "game_id", "home_tri", "away_tri", pick("home_score").alias("home_score"), pick("away_score").alias("away_score"),
        F.when(going, "live").when(final, "final").otherwise("upcoming").alias("status"),
        F.when(is_live, F.col("l.period")).alias("period"), F.when(is_live, F.col("l.game_clock")).alias("clock"),
        F.when(going, 0).when(final, 2).otherwise(1).alias("sort_key"),
    )
