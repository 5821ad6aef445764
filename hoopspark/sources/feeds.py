"""Nested JSON feeds to flat rows. Each function takes parsed payloads (see ``schemas``), any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopspark.functions.scalars import clock_minutes, clock_seconds, zero_if_null
from hoopspark.functions.windows import top_rows
from hoopspark.operators.rosters import status_rank
from hoopspark.operators.teams import TEAMS, lookup, team_code, team_id

DETAIL_LENGTH = 120


def _competitor(side: str) -> Column:
    return F.get(F.filter("comp.competitors", lambda c: c["homeAway"] == side), F.lit(0))


def scoreboard_games(payloads: DataFrame) -> DataFrame:
    """One row per scheduled game with both sides, scores, quarter scores and venue; each game once."""
    events = payloads.select(F.explode("events").alias("e")).select("e", F.get("e.competitions", F.lit(0)).alias("comp"))
    sides = events.withColumns({"home": _competitor("home"), "away": _competitor("away")})
    sides = sides.where(F.col("home").isNotNull() & F.col("away").isNotNull())
    quarters = lambda side: F.coalesce(F.transform(f"{side}.linescores", lambda s: s["value"]), F.array().cast("array<double>"))
    codes = sides.withColumns({"home_tri": team_code("home.team.abbreviation"), "away_tri": team_code("away.team.abbreviation")})
    games = codes.select(
        F.col("e.id").alias("game_id"), F.coalesce("comp.date", "e.date", F.lit("")).alias("start_time"), "home_tri", "away_tri",
        team_id(F.col("home_tri")).alias("home_nba_id"), team_id(F.col("away_tri")).alias("away_nba_id"),
        F.coalesce("comp.status.type.description", F.lit("Scheduled")).alias("status"),
        F.coalesce(F.col("home.score").try_cast("double"), F.lit(0.0)).alias("home_score"),
        F.coalesce(F.col("away.score").try_cast("double"), F.lit(0.0)).alias("away_score"),
        quarters("home").alias("home_q"), quarters("away").alias("away_q"),
        F.coalesce("comp.venue.fullName", F.lit("")).alias("venue"),
    )
    return top_rows(games, ["game_id"], ["start_time", "home_tri", "away_tri"], 1)


def schedule_range(payloads: DataFrame) -> DataFrame:
    """Games of several days' scoreboards, each once."""
    return scoreboard_games(payloads).select("game_id", "start_time", "home_tri", "away_tri")


def team_map(payloads: DataFrame) -> DataFrame:
    """Feed team id → league code, one row per id however many payloads list it."""
    teams = F.flatten(F.flatten(F.transform("sports", lambda s: F.transform(s["leagues"], lambda g: g["teams"]))))
    rows = payloads.select(F.explode(teams).alias("t"))
    named = rows.select(F.col("t.team.id").alias("feed_id"), team_code("t.team.abbreviation").alias("team_tri"))
    return named.groupBy("feed_id").agg(F.max("team_tri").alias("team_tri"))


def injury_report(payloads: DataFrame, feed_teams: DataFrame) -> DataFrame:
    """One row per listed player: team by name, else by feed id; status rank; detail text or a short comment."""
    teams = payloads.select(F.explode("injuries").alias("t")).select("t.id", "t.displayName", F.explode("t.injuries").alias("p"))
    by_id = feed_teams.groupBy(F.col("feed_id").alias("id")).agg(F.max("team_tri").alias("_by_id"))
    named = teams.join(by_id, "id", "left").withColumn(
        "team_tri", F.coalesce(lookup(F.coalesce("displayName", F.lit("")), {t[1]: t[0] for t in TEAMS}), "_by_id"))
    kind, detail = (F.coalesce(f"p.details.{c}", F.lit("")) for c in ("type", "detail"))
    both = F.regexp_replace(F.concat(kind, F.lit(" – "), detail), "^[ –]+|[ –]+$", "")
    comment = F.substring(F.coalesce("p.shortComment", "p.longComment", F.lit("")), 1, DETAIL_LENGTH)
    return named.where(F.coalesce("team_tri", F.lit("")) != "").select(
        "team_tri", team_id(F.col("team_tri")).alias("nba_team_id"),
        F.coalesce("p.athlete.displayName", F.lit("")).alias("player_name"),
        F.coalesce("p.athlete.position.abbreviation", F.lit("")).alias("position"),
        F.coalesce("p.status", F.lit("Out")).alias("status"),
        status_rank(F.coalesce("p.status", F.lit("Out"))).alias("status_rank"),
        F.when((kind != "") | (detail != ""), both).otherwise(comment).alias("injury_detail"),
    )


def roster_players(payloads: DataFrame) -> DataFrame:
    """One row per player of each team's roster payload; unknown positions count as forwards."""
    rows = payloads.select("team_tri", F.explode("athletes").alias("a"))
    place = F.upper(F.coalesce("a.position.abbreviation", F.lit("")))
    return rows.select(
        F.coalesce("a.fullName", F.lit("")).alias("player_name"), "team_tri",
        F.when(place.isin("G", "F", "C"), place).otherwise("F").alias("primary_pos"),
    )


def _first_present(df: DataFrame, *names: str) -> Column:
    known = {c.lower(): c for c in df.columns}
    for name in names:
        if name in known:
            return F.trim(F.coalesce(F.col(known[name]).cast("string"), F.lit("")))
    return F.lit("")


def trades(transactions: DataFrame) -> DataFrame:
    """Transactions that speak of a trade and name a receiving team; several column spellings are accepted."""
    kind = _first_present(transactions, "transaction_type", "transaction")
    text = _first_present(transactions, "description", "notes")
    to = F.upper(_first_present(transactions, "to_team_abbreviation", "to_team", "team_abbreviation"))
    kept = transactions.where(F.contains(F.lower(F.concat_ws(" ", kind, text)), F.lit("trade")) & (to != ""))
    return kept.select(
        _first_present(transactions, "player_name", "player").alias("player_name"), team_code(to).alias("to_team_tri"),
        F.when(kind == "", "Trade").otherwise(kind).alias("transaction_type"), text.alias("description"),
        _first_present(transactions, "transaction_date", "date").alias("transaction_date"),
    )


def live_scores(payloads: DataFrame) -> DataFrame:
    """One row per live game with the clock in seconds and the seconds played, overtime included."""
    g = payloads.select(F.explode("scoreboard.games").alias("g")).select("g.*").withColumns({
        "period": F.coalesce("period", F.lit(0)), "clock_sec": F.coalesce(clock_seconds("gameClock"), F.lit(0.0)),
    })
    p = F.col("period")
    length = F.when(p > 4, 300).otherwise(720)
    elapsed = (
        F.greatest(F.lit(0), F.least(p - 1, F.lit(4))) * 720 + F.greatest(F.lit(0), p - 5) * 300
        + F.when(p > 0, length - F.col("clock_sec")).otherwise(0.0)
    )
    whole = lambda c: F.coalesce(c, F.lit(0))
    return g.select(
        F.col("gameId").alias("game_id"), F.col("homeTeam.teamTricode").alias("home_tri"), F.col("awayTeam.teamTricode").alias("away_tri"),
        whole("homeTeam.score").alias("home_score"), whole("awayTeam.score").alias("away_score"),
        F.when(whole("gameStatus") == 0, 1).otherwise(F.col("gameStatus")).alias("status"),
        F.coalesce("gameStatusText", F.lit("")).alias("status_text"), "period", "clock_sec",
        elapsed.alias("total_sec_elapsed"), F.coalesce("seriesText", F.lit("")).alias("series_text"),
    )


# Output column -> statistic of the feed.
BOX_STATISTICS = {
    "pts": "points", "reb": "reboundsTotal", "ast": "assists", "stl": "steals", "blk": "blocks", "tov": "turnovers",
    "fgm": "fieldGoalsMade", "fga": "fieldGoalsAttempted", "fg3m": "threePointersMade", "fg3a": "threePointersAttempted",
    "ftm": "freeThrowsMade", "fta": "freeThrowsAttempted", "plus_minus": "plusMinusPoints",
}


def live_box(payloads: DataFrame) -> DataFrame:
    """One row per player of both teams of each live game."""
    side = lambda name: F.transform(
        F.coalesce(f"game.{name}Team.players", F.expr(f"slice(game.{name}Team.players, 1, 0)")),
        lambda p: F.struct(F.lit(name).alias("side"), p.alias("p")),
    )
    rows = payloads.select(F.col("game.gameId").alias("game_id"), F.explode(F.concat(side("home"), side("away"))).alias("r"))
    text = lambda c: F.coalesce(f"r.p.{c}", F.lit(""))
    return rows.select(
        "game_id", "r.side", text("name").alias("name"), text("jerseyNum").alias("jersey"), text("position").alias("position"),
        (text("starter") == "1").alias("starter"), (text("oncourt") == "1").alias("on_court"),
        clock_minutes("r.p.statistics.minutesCalculated").alias("min"),
        *[F.coalesce(f"r.p.statistics.{src}", F.lit(0)).alias(out) for out, src in BOX_STATISTICS.items()],
    )


# Output -> (league table column, value that stands for a missing or zero entry).
ADVANCED = {
    "usg_pct": ("USG_PCT", 0.20), "ts_pct": ("TS_PCT", 0.56), "pie": ("PIE", 0.10), "net_rtg": ("NET_RATING", 0.0),
    "off_rtg": ("OFF_RATING", 0.0), "def_rtg": ("DEF_RATING", 0.0), "efg_pct": ("EFG_PCT", 0.53),
}


def advanced_stats(table: DataFrame) -> DataFrame:
    """League advanced numbers per player; bad or zero entries take the default."""
    value = lambda src, default: F.coalesce(F.nullif(zero_if_null(F.col(src).try_cast("double")), F.lit(0.0)), F.lit(default))
    return table.select(
        F.col("PLAYER_ID").try_cast("bigint").alias("personId"),
        *[(value(src, d) if src in table.columns else F.lit(d)).alias(out) for out, (src, d) in ADVANCED.items()],
    )
