"""Files and feeds: payloads written from the test tables as JSON text, parsed with the feed schemas and flattened."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopspark import schemas
from hoopspark.functions import scalars
from hoopspark.functions.windows import latest_values
from hoopspark.operators import quality, rosters, teams
from hoopspark.registry.bind import BOX, EV, PBP, RAW_BOX, SCHED, box, events, pbp, r6, raw_box, schedule, table
from hoopspark.registry.core import query
from hoopspark.session import work_folder
from hoopspark.sources import feeds, gamelog, tables

CODES = [t[0] for t in teams.TEAMS]
NAMES = [t[1] for t in teams.TEAMS]
FEED_OF = {"GSW": "GS", "SAS": "SA", "NYK": "NY", "NOP": "NO", "UTA": "UTAH", "WAS": "WSH"}
FEED_CODES = [FEED_OF.get(c, c) for c in CODES]
STATUSES = ["Out", "Doubtful", "Questionable", "Day-To-Day", "Probable", "Injured Reserve", "Suspension", "Game Time Decision", "Active", "Out Indefinitely", "Rest"]


def lit_list(values):
    return F.array(*map(F.lit, values))


def at(values, i):
    return F.element_at(lit_list(values), (i + 1).cast("int"))


def parsed(df, payload, schema):
    """Write the payload as JSON text and read it back with the feed's schema."""
    return df.select(F.from_json(F.to_json(payload), schema).alias("j")).select("j.*")


@query("unified_plays", f"""WITH {PBP} SELECT gameId, 2023 AS season, actionNumber::INTEGER AS actionNumber, orderNumber, period::INTEGER AS period, actionType, subType,
  CASE WHEN personId % 10 <> 9 THEN personId END AS personId, scoreHome, '' AS area, '' AS areaDetail, isFieldGoal, pointsTotal FROM pbp""")
def unified_plays(spark, sf):
    raw = pbp(spark, sf).withColumn("personId", F.expr("CASE WHEN personId % 10 = 9 THEN 'bad id' ELSE CAST(personId AS STRING) END"))
    raw = raw.withColumns({"_file": F.lit("/plays/plays_2023.csv"), "value": F.lit(1), "jerseyNumber": F.lit("7")})
    return tables.unify_plays(raw).select(
        "gameId", "season", "actionNumber", "orderNumber", "period", "actionType", "subType", "personId", "scoreHome", "area",
        "areaDetail", "isFieldGoal", "pointsTotal")


@query("shot_file_rows", f"""WITH {EV} SELECT gameId AS game_id, user_id AS player_id, teamId AS team_id, game_date, k % 30 AS shot_distance,
  CASE WHEN k % 9 <> 0 THEN k % 2 END AS shot_made_flag, 2024 AS season FROM ev""")
def shot_file_rows(spark, sf):
    raw = events(spark, sf).select(
        F.col("gameId").alias("GAME_ID"), F.col("user_id").alias("PLAYER_ID"), F.col("teamId").alias("TEAM_ID"),
        F.date_format("game_date", "yyyyMMdd").alias("GAME_DATE"), F.expr("k % 30").alias("SHOT_DISTANCE"),
        F.expr("CASE WHEN k % 9 = 0 THEN 'x' ELSE CAST(k % 2 AS STRING) END").alias("SHOT_MADE_FLAG"), F.lit("drop").alias("EVENT_TYPE"))
    return tables.unify_shots(raw, 2024)


@query("matchup_file_rows", f"""WITH {EV} SELECT gameId AS game_id, user_id AS person_id, k / 4.0::DOUBLE AS partial_possessions, k % 6 AS switches_on, 2024 AS season FROM ev""")
def matchup_file_rows(spark, sf):
    raw = events(spark, sf).select(
        F.col("gameId").alias("GAME_ID"), F.col("user_id").alias("PERSON_ID"), F.expr("k / 4.0D").cast("string").alias("Partial_Possessions"),
        F.expr("k % 6").cast("string").alias("SWITCHES_ON"), F.lit(1).alias("other"))
    return tables.unify_matchups(raw, 2024)


def log_rows(spark, sf):
    """Game-log rows from the box: minutes as MM:SS for even players, decimals for odd ones, none for a few."""
    rows = raw_box(spark, sf).join(schedule(spark, sf).drop("game_date", "season", "league"), "gameId")
    whole = F.floor(F.col("min")).cast("int")
    minutes = F.when(F.col("personId") % 11 == 0, "0").when(
        F.col("personId") % 2 == 0, F.format_string("%d:%02d", whole, F.floor((F.col("min") - whole) * 60).cast("int"))
    ).otherwise(F.col("min").cast("string"))
    own, other = F.col("teamTricode"), F.when(F.col("teamId") == F.col("home_team_id"), F.col("away_tricode")).otherwise(F.col("home_tricode"))
    matchup = F.when(F.col("teamId") == F.col("home_team_id"), F.concat(own, F.lit(" vs. "), other)).otherwise(F.concat(own, F.lit(" @ "), other))
    stats = [F.col(v).alias(k) for k, v in gamelog.LOG_COLUMNS.items() if not v.endswith("_pct")]
    return rows.select(
        F.lpad(F.col("gameId").cast("string"), 10, "0").alias("GAME_ID"), F.col("season").alias("SEASON"), F.col("personId").alias("PLAYER_ID"),
        F.col("playerName").alias("PLAYER_NAME"), F.col("teamId").alias("TEAM_ID"), F.col("teamTricode").alias("TEAM_ABBREVIATION"),
        F.col("game_date").cast("string").alias("GAME_DATE"), matchup.alias("MATCHUP"), minutes.alias("MIN"), *stats,
        *[F.lit(0.5).alias(k) for k, v in gamelog.LOG_COLUMNS.items() if v.endswith("_pct")])


LOG = """lg AS (SELECT gameId, season, personId, playerName, teamId, teamTricode, game_date, CASE WHEN personId % 2 = 0
    THEN floor(min) + CAST(floor((min - floor(min)) * 60) AS INTEGER) / 60.0::DOUBLE ELSE min END AS min,
  * EXCLUDE (gameId, season, personId, playerName, teamId, teamTricode, game_date, min) FROM rb WHERE personId % 11 <> 0 AND min > 0),
lg1 AS (SELECT * FROM lg WHERE min > 0),
lg2 AS (SELECT *, sum(fga) OVER w AS tfga, sum(fta) OVER w AS tfta, sum(tov) OVER w AS ttov, sum(oreb) OVER w AS toreb, sum(min) OVER w AS tmin
  FROM lg1 WINDOW w AS (PARTITION BY gameId, teamId))"""


@query("game_log_box", f"""WITH {RAW_BOX}, {LOG} SELECT gameId, season, personId, playerName, teamId, teamTricode, game_date, round(min, 6) AS min, pts::INT AS pts, reb::INT AS reb, fga::INT AS fga,
  round(coalesce((fgm + 0.5::DOUBLE * fg3m) / nullif(fga, 0), 0), 6) AS efg_pct, round(coalesce(pts / nullif(2 * (fga + 0.44::DOUBLE * fta), 0), 0), 6) AS ts_pct,
  round(coalesce((fga + 0.44::DOUBLE * fta + tov) * (tmin / 5) / nullif(min * (tfga + 0.44::DOUBLE * tfta + ttov), 0), 0), 6) AS usage_rate,
  round(tfga - toreb + ttov + 0.44::DOUBLE * tfta, 6) AS team_poss, round(pts * 36 / min, 6) AS pts_per36 FROM lg2""")
def game_log_box(spark, sf):
    df = gamelog.box_from_log(log_rows(spark, sf))
    doubles = ["min", "efg_pct", "ts_pct", "usage_rate", "team_poss", "pts_per36"]
    return r6(df.select("gameId", "season", "personId", "playerName", "teamId", "teamTricode", "game_date", "pts", "reb", "fga", *doubles), *doubles)


@query("schedule_from_log", f"""WITH {RAW_BOX}, {SCHED}, t AS (SELECT DISTINCT gameId, teamId FROM rb)
  SELECT s.gameId, s.game_date, s.season, home_team_id, home_tricode, away_team_id, away_tricode FROM sched s
  JOIN t h ON h.gameId = s.gameId AND h.teamId = home_team_id JOIN t a ON a.gameId = s.gameId AND a.teamId = away_team_id""")
def schedule_from_log(spark, sf):
    return gamelog.schedule_from_log(log_rows(spark, sf))


@query("appended_season", f"""WITH {BOX} SELECT gameId, personId, CASE WHEN season <= 2 THEN pts ELSE pts + 100 END AS pts FROM box""")
def appended_season(spark, sf):
    """Two seasons on file, a new log that repeats the second and brings the third."""
    rows = box(spark, sf).select("gameId", "personId", "season", "pts")
    new = rows.where("season >= 2").withColumn("pts", F.col("pts") + 100)
    return tables.append_rows(rows.where("season <= 2"), new.unionByName(new), ["gameId", "personId"]).drop("season")


@query("upserted_seasons", f"""WITH {BOX} SELECT gameId, personId, season, CASE WHEN season <= 2 THEN pts ELSE pts + 100 END AS pts FROM box""")
def upserted_seasons(spark, sf):
    """The same through a stored table: two seasons written, then the new log brought in twice."""
    path, keys = work_folder(spark, "seasons"), ["gameId", "personId"]
    rows = box(spark, sf).select(*keys, "season", "pts")
    new = rows.where("season >= 2").withColumn("pts", F.col("pts") + 100)
    for part in (rows.where("season <= 2"), new.unionByName(new), new):
        tables.upsert_seasons(part, path, keys)
    return tables.read_table(spark, path).select(*keys, "season", "pts")


FIELDS = {"gameId": "bigint", "personId": "bigint", "pts": "int", "value": "double"}


@query("rejected_rows", """WITH ev AS (SELECT event_id, value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_id % 40 AS kind FROM events)
  SELECT CASE kind WHEN 0 THEN 'wrong number of fields' WHEN 1 THEN 'no gameId' WHEN 2 THEN 'pts is no int' WHEN 3 THEN 'value is no double' ELSE 'good' END AS reason,
         count(*) AS n, CAST(sum(CASE WHEN kind > 3 THEN k END) AS BIGINT) AS pts FROM ev GROUP BY 1""")
def rejected_rows(spark, sf):
    """Event lines of which some lack fields, a game, or numbers; good and rejected rows of one reading, counted by reason."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 40
    line = F.when(kind == 0, F.concat_ws(",", F.col("event_id"), F.col("user_id"))).otherwise(F.concat_ws(
        ",", F.when(kind == 1, "").otherwise(F.col("event_id").cast("string")), F.col("user_id"), F.when(kind == 2, "x").otherwise(k),
        F.when(kind == 3, "n/a").otherwise(F.col("value").cast("string"))))
    folder = work_folder(spark, "lines")
    table(spark, sf, "events").select(line.alias("value")).write.text(folder)
    good, rejected = tables.read_checked(spark, folder, FIELDS, ["gameId", "personId"], header=False)
    counted = good.select(F.lit("good").alias("reason"), "pts").unionByName(rejected.select("reason", F.lit(None).cast("int").alias("pts")))
    return counted.groupBy("reason").agg(F.count("*").alias("n"), F.sum("pts").alias("pts"))


def team_payloads(spark, sf):
    t = F.struct(F.struct(F.col("n_nationkey").cast("string").alias("id"), at(FEED_CODES, F.col("n_nationkey")).alias("abbreviation")).alias("team"))
    payload = F.struct(F.array(F.struct(F.array(F.struct(F.array(t).alias("teams"))).alias("leagues"))).alias("sports"))
    return parsed(table(spark, sf, "nation"), payload, schemas.TEAMS_SCHEMA)


@query("team_map", f"SELECT n_nationkey::VARCHAR AS feed_id, {CODES!r}[n_nationkey + 1] AS team_tri FROM nation")
def team_map(spark, sf):
    return feeds.team_map(team_payloads(spark, sf))


def scoreboard_payloads(spark, sf):
    def side(name, code, score, base):
        lines = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.struct(((F.col("o_orderkey") * base + i * 7) % 40).cast("double").alias("value")))
        return F.struct(F.lit(name).alias("homeAway"), F.struct(at(FEED_CODES, code).alias("abbreviation")).alias("team"),
                        score.cast("string").alias("score"), F.when(F.col("o_orderstatus") != "O", lines).alias("linescores"))
    home = side("home", F.col("o_custkey") % 30, F.col("o_orderkey") % 150, 3)
    away = side("away", (F.col("o_custkey") + 1 + F.col("o_orderkey") % 28) % 30, (F.col("o_orderkey") * 3) % 150, 5)
    comp = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"),
        F.struct(F.struct(F.when(F.col("o_orderstatus") == "F", "Final").when(F.col("o_orderstatus") == "P", "In Progress").alias("description")).alias("type")).alias("status"),
        F.struct(F.concat(F.lit("Arena "), (F.col("o_custkey") % 50).cast("string")).alias("fullName")).alias("venue"),
        F.when(F.col("o_orderkey") % 17 == 0, F.array(home)).when(F.col("o_orderkey") % 2 == 0, F.array(home, away)).otherwise(F.array(away, home)).alias("competitors"))
    event = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.array(comp).alias("competitions"))
    return parsed(table(spark, sf, "orders"), F.struct(F.array(event, event).alias("events")), schemas.SCOREBOARD_SCHEMA)


HOME_CODE, AWAY_CODE = f"{CODES!r}[o_custkey % 30 + 1]", f"{CODES!r}[(o_custkey + 1 + o_orderkey % 28) % 30 + 1]"
IDS = [t[3] for t in teams.TEAMS]
SCOREBOARD = f"""SELECT o_orderkey::VARCHAR AS game_id, strftime(o_orderdate, '%Y-%m-%dT%H:%MZ') AS start_time, {HOME_CODE} AS home_tri, {AWAY_CODE} AS away_tri,
  {IDS!r}[o_custkey % 30 + 1]::BIGINT AS home_nba_id, {IDS!r}[(o_custkey + 1 + o_orderkey % 28) % 30 + 1]::BIGINT AS away_nba_id,
  CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'P' THEN 'In Progress' ELSE 'Scheduled' END AS status, (o_orderkey % 150)::DOUBLE AS home_score, ((o_orderkey * 3) % 150)::DOUBLE AS away_score,
  CASE WHEN o_orderstatus <> 'O' THEN array_to_string([(o_orderkey * 3 + i * 7) % 40 for i in [0, 1, 2, 3]], ',') ELSE '' END AS home_q,
  CASE WHEN o_orderstatus <> 'O' THEN array_to_string([(o_orderkey * 5 + i * 7) % 40 for i in [0, 1, 2, 3]], ',') ELSE '' END AS away_q,
  'Arena ' || (o_custkey % 50) AS venue FROM orders WHERE o_orderkey % 17 <> 0"""


def joined_text(c):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("int").cast("string")))


@query("scoreboard_games", SCOREBOARD)
def scoreboard_games(spark, sf):
    return feeds.scoreboard_games(scoreboard_payloads(spark, sf)).withColumns({c: joined_text(c) for c in ("home_q", "away_q")})


@query("schedule_range", f"SELECT game_id, start_time, home_tri, away_tri FROM ({SCOREBOARD})")
def schedule_range(spark, sf):
    return feeds.schedule_range(scoreboard_payloads(spark, sf))


def injury_payloads(spark, sf):
    c = F.col("c_custkey")
    athlete = F.struct(F.col("c_name").alias("displayName"), F.struct(at(["G", "F", "C"], c % 3).alias("abbreviation")).alias("position"))
    details = F.struct(F.when(c % 3 == 0, F.col("c_mktsegment")).alias("type"), F.when(c % 2 == 0, F.lit("Sprain")).alias("detail"))
    player = F.struct(at(STATUSES, c % len(STATUSES)).alias("status"), athlete.alias("athlete"), details.alias("details"),
                      F.when(c % 5 != 0, F.concat(F.col("c_name"), F.repeat(F.lit(" is out"), 20))).alias("shortComment"), F.lit("long").alias("longComment"))
    team = F.struct(F.col("c_nationkey").cast("string").alias("id"), F.when(F.col("c_nationkey") < 20, at(NAMES, F.col("c_nationkey"))).alias("displayName"),
                    F.array(player).alias("injuries"))
    return parsed(table(spark, sf, "customer"), F.struct(F.array(team).alias("injuries")), schemas.INJURY_SCHEMA)


def report(spark, sf):
    return feeds.injury_report(injury_payloads(spark, sf), feeds.team_map(team_payloads(spark, sf)))


RANKS = [4, 3, 2, 1, 1, 4, 4, 2, 0, 4, 0]
REPORT = f"""report AS (SELECT {CODES!r}[c_nationkey + 1] AS team_tri, {IDS!r}[c_nationkey + 1]::BIGINT AS nba_team_id, c_name AS player_name, ['G', 'F', 'C'][c_custkey % 3 + 1] AS position,
  {STATUSES!r}[c_custkey % 11 + 1] AS status, {RANKS!r}[c_custkey % 11 + 1] AS status_rank,
  CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment || ' – Sprain' WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'Sprain'
       WHEN c_custkey % 5 <> 0 THEN left(c_name || repeat(' is out', 20), 120) ELSE 'long' END AS injury_detail FROM customer)"""


@query("injury_report", f"WITH {REPORT} SELECT * FROM report")
def injury_report(spark, sf):
    return report(spark, sf)


@query("injury_list", f"""WITH {REPORT} SELECT *, CASE WHEN status LIKE 'Out%' THEN 0 WHEN status = 'Injured Reserve' THEN 1 WHEN status = 'Suspension' THEN 2 WHEN status = 'Doubtful' THEN 3
  WHEN status = 'Questionable' THEN 4 WHEN status = 'Game Time Decision' THEN 5 WHEN status = 'Day-To-Day' THEN 6 WHEN status = 'Probable' THEN 7 ELSE 99 END AS status_order
  FROM report WHERE contains(lower(player_name), '00001')""")
def injury_list(spark, sf):
    return rosters.injury_list(report(spark, sf), search="00001")


@query("injuries_by_team", f"""WITH {REPORT} SELECT team_tri, player_name, status, CASE WHEN status LIKE 'Out%' THEN 0 WHEN status = 'Injured Reserve' THEN 1 WHEN status = 'Suspension' THEN 2 WHEN status = 'Doubtful' THEN 3
  WHEN status = 'Questionable' THEN 4 WHEN status = 'Game Time Decision' THEN 5 WHEN status = 'Day-To-Day' THEN 6 WHEN status = 'Probable' THEN 7 ELSE 99 END AS status_order FROM report ORDER BY 1, 4, 2""")
def injuries_by_team(spark, sf):
    return rosters.injuries_by_team(report(spark, sf)).select("team_tri", "player_name", "status", "status_order")


@query("injury_counts_by_team", f"""WITH {REPORT} SELECT team_tri, count(*) AS listed, count(*) FILTER (status_rank >= 4) AS out_count,
  count(*) FILTER (status_rank BETWEEN 2 AND 3) AS questionable_count FROM report GROUP BY team_tri""")
def injury_counts_by_team(spark, sf):
    return rosters.injury_counts_by_team(report(spark, sf))


@query("injury_counts", f"WITH {REPORT} SELECT count(*) FILTER (status_rank >= 4) AS out_count, count(*) FILTER (status_rank BETWEEN 2 AND 3) AS questionable_count FROM report")
def injury_counts(spark, sf):
    return rosters.injury_counts(report(spark, sf))


@query("status_ranks", f"SELECT c_custkey, {RANKS!r}[c_custkey % 11 + 1] AS status_rank FROM customer")
def status_ranks(spark, sf):
    status = F.concat(F.lit(" "), F.upper(at(STATUSES, F.col("c_custkey") % len(STATUSES))), F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", rosters.status_rank(status).alias("status_rank"))


def roster_payloads(spark, sf):
    place = at(["G", "F", "C", "", "SG", "c"], F.col("c_custkey") % 6)
    athlete = F.struct(F.col("c_name").alias("fullName"), F.struct(place.alias("abbreviation")).alias("position"))
    payload = F.struct(at(CODES, F.col("c_nationkey")).alias("team_tri"), F.array(athlete).alias("athletes"))
    return parsed(table(spark, sf, "customer"), payload, schemas.ROSTER_SCHEMA)


LISTED = f"listed AS (SELECT c_name AS player_name, {CODES!r}[c_nationkey + 1] AS team_tri, ['G', 'F', 'C', 'F', 'F', 'C'][c_custkey % 6 + 1] AS primary_pos FROM customer)"


@query("roster_players", f"WITH {LISTED} SELECT * FROM listed")
def roster_players(spark, sf):
    return feeds.roster_players(roster_payloads(spark, sf))


def transactions(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "Trade").when(F.col("o_orderstatus") == "F", "Signing").otherwise(F.lit(None))
    return o.select(
        F.format_string("Customer#%09d", "o_custkey").alias("PLAYER"), kind.alias("TRANSACTION"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("part of a TRADE "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority")).alias("NOTES"),
        F.when(F.col("o_orderkey") % 7 != 0, F.lower(at(FEED_CODES, F.col("o_orderkey") % 30))).alias("TO_TEAM"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("#%012d", "o_orderkey")).alias("DATE"))


TRADES = f"""trades AS (SELECT printf('Customer#%09d', o_custkey) AS player_name, {CODES!r}[o_orderkey % 30 + 1] AS to_team_tri,
  CASE o_orderstatus WHEN 'P' THEN 'Trade' WHEN 'F' THEN 'Signing' ELSE 'Trade' END AS transaction_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'part of a TRADE ' || o_orderpriority ELSE o_orderpriority END AS description,
  strftime(o_orderdate, '%Y-%m-%d') || printf('#%012d', o_orderkey) AS transaction_date
  FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderstatus = 'P' OR o_orderkey % 5 = 0))"""


@query("trades", f"WITH {TRADES} SELECT * FROM trades")
def trades(spark, sf):
    return feeds.trades(transactions(spark, sf))


MOVED = f"""{LISTED}, {TRADES}, moves AS (SELECT player_name, arg_max(to_team_tri, transaction_date) AS to_ FROM trades GROUP BY player_name),
moved AS (SELECT l.player_name, coalesce(to_, team_tri) AS team_tri, primary_pos, CASE WHEN to_ IS NOT NULL THEN 'trade_adjusted' ELSE 'listed' END AS source
  FROM listed l LEFT JOIN moves USING (player_name))"""


def moved(spark, sf):
    return rosters.current_rosters(feeds.roster_players(roster_payloads(spark, sf)), feeds.trades(transactions(spark, sf)))


@query("current_rosters", f"WITH {MOVED} SELECT * FROM moved")
def current_rosters(spark, sf):
    return moved(spark, sf)


COLORS = [t[2] for t in teams.TEAMS]


@query("rosters_by_team", f"""WITH {MOVED} SELECT team_tri, {NAMES!r}[list_position({CODES!r}, team_tri)] AS team_name, {COLORS!r}[list_position({CODES!r}, team_tri)] AS team_color,
  player_name, primary_pos AS position, source FROM moved ORDER BY team_tri, player_name""")
def rosters_by_team(spark, sf):
    return rosters.rosters_by_team(moved(spark, sf), teams.team_dimension(spark)).drop("team_logo")


@query("decorated_schedule", f"""SELECT game_id, home_tri, away_tri, {NAMES!r}[list_position({CODES!r}, home_tri)] AS home_name, {NAMES!r}[list_position({CODES!r}, away_tri)] AS away_name,
  {COLORS!r}[list_position({CODES!r}, away_tri)] AS away_color, status FROM ({SCOREBOARD})""")
def decorated_schedule(spark, sf):
    df = rosters.decorated_schedule(feeds.scoreboard_games(scoreboard_payloads(spark, sf)), teams.team_dimension(spark))
    return df.select("game_id", "home_tri", "away_tri", "home_name", "away_name", "away_color", "status")


@query("upcoming_days", """SELECT (o_orderdate - INTERVAL 5 HOUR)::DATE AS local_day, count(*) AS games FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""")
def upcoming_days(spark, sf):
    games = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("start_time"))
    return rosters.upcoming_days(games, F.lit("1997-01-01").cast("timestamp"), "Etc/GMT+5").drop("first_start")


def live_payloads(spark, sf):
    k = F.col("k")
    game = F.struct(
        F.col("event_id").cast("string").alias("gameId"), (k % 4).alias("gameStatus"), F.lit("Q").alias("gameStatusText"), (k % 8).alias("period"),
        F.when(k % 9 != 0, F.format_string("PT%02dM%02d.50S", k % 12, k % 60)).otherwise("").alias("gameClock"), F.lit(None).cast("string").alias("seriesText"),
        F.struct(at(CODES, F.col("user_id") % 30).alias("teamTricode"), (k * 2).alias("score")).alias("homeTeam"),
        F.struct(at(CODES, (F.col("user_id") + 1 + k % 28) % 30).alias("teamTricode"), F.when(k % 5 != 0, k).alias("score")).alias("awayTeam"))
    return parsed(events(spark, sf), F.struct(F.struct(F.array(game).alias("games")).alias("scoreboard")), schemas.LIVE_SCORE_SCHEMA)


LIVE = f"""{EV}, lv0 AS (SELECT event_id::VARCHAR AS game_id, {CODES!r}[user_id % 30 + 1] AS home_tri, {CODES!r}[(user_id + 1 + k % 28) % 30 + 1] AS away_tri, k * 2 AS home_score,
  CASE WHEN k % 5 <> 0 THEN k ELSE 0 END AS away_score, CASE WHEN k % 4 = 0 THEN 1 ELSE k % 4 END AS status, 'Q' AS status_text, k % 8 AS period,
  CASE WHEN k % 9 <> 0 THEN (k % 12) * 60 + k % 60 + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS clock_sec, '' AS series_text FROM ev),
lv AS (SELECT *, greatest(0, least(period - 1, 4)) * 720 + greatest(0, period - 5) * 300 + CASE WHEN period > 0 THEN (CASE WHEN period > 4 THEN 300 ELSE 720 END) - clock_sec ELSE 0 END AS total_sec_elapsed FROM lv0)"""


@query("live_scores", f"WITH {LIVE} SELECT * FROM lv")
def live_scores(spark, sf):
    return feeds.live_scores(live_payloads(spark, sf))


@query("live_labels", f"""WITH {LIVE} SELECT game_id, CASE status WHEN 2 THEN 'live' WHEN 3 THEN 'final' ELSE 'scheduled' END AS status,
  (floor(clock_sec)::INT // 60) || ':' || lpad((floor(clock_sec)::INT % 60)::VARCHAR, 2, '0') AS game_clock FROM lv""")
def live_labels(spark, sf):
    return rosters.live_labels(feeds.live_scores(live_payloads(spark, sf))).select("game_id", "status", "game_clock")


UNIFIED = f"""{LIVE}, day AS (SELECT * FROM ({SCOREBOARD})),
run AS (SELECT least(home_tri, away_tri) AS lo, greatest(home_tri, away_tri) AS hi, max((CASE status WHEN 2 THEN 'live' ELSE 'final' END, home_score, away_score, period,
    (floor(clock_sec)::INT // 60) || ':' || lpad((floor(clock_sec)::INT % 60)::VARCHAR, 2, '0'))) AS l
  FROM lv WHERE status IN (2, 3) GROUP BY ALL),
un AS (SELECT d.*, coalesce(l[1] = 'live', false) AS is_live, coalesce(d.status = 'Final' OR l[1] = 'final', false) AS is_final, l
  FROM day d LEFT JOIN run r ON r.lo = least(d.home_tri, d.away_tri) AND r.hi = greatest(d.home_tri, d.away_tri))"""


@query("unified_games", f"""WITH {UNIFIED} SELECT game_id, home_tri, away_tri, CASE WHEN is_live THEN l[2] ELSE home_score END::DOUBLE AS home_score, CASE WHEN is_live THEN l[3] ELSE away_score END::DOUBLE AS away_score,
  CASE WHEN is_live OR (NOT is_final AND status = 'In Progress') THEN 'live' WHEN is_final THEN 'final' ELSE 'upcoming' END AS status, CASE WHEN is_live THEN l[4] END AS period,
  CASE WHEN is_live THEN l[5] END AS clock, CASE WHEN is_live OR (NOT is_final AND status = 'In Progress') THEN 0 WHEN is_final THEN 2 ELSE 1 END AS sort_key FROM un""")
def unified_games(spark, sf):
    live = rosters.live_labels(feeds.live_scores(live_payloads(spark, sf)))
    return rosters.unified_games(feeds.scoreboard_games(scoreboard_payloads(spark, sf)), live)


def live_box_payloads(spark, sf):
    k = F.col("k")
    stats = F.struct(F.when(k % 6 != 0, F.format_string("PT%02dM", k % 48)).alias("minutesCalculated"),
                     *[((k + i) % 20).alias(s) for i, s in enumerate(feeds.BOX_STATISTICS.values())])
    player = lambda off: F.struct(
        F.concat(F.lit("Player "), (F.col("user_id") + off).cast("string")).alias("name"), k.cast("string").alias("jerseyNum"), at(["G", "F", "C"], k % 3).alias("position"),
        F.when(k % 2 == 0, "1").otherwise("0").alias("starter"), F.when(k % 3 == 0, "1").alias("oncourt"), stats.alias("statistics"))
    team = lambda off: F.struct(F.array(player(off)).alias("players"))
    game = F.struct(F.col("event_id").cast("string").alias("gameId"), team(0).alias("homeTeam"), team(1).alias("awayTeam"))
    return parsed(events(spark, sf), F.struct(game.alias("game")), schemas.LIVE_BOX_SCHEMA)


@query("live_box", f"""WITH {EV}, s AS (SELECT unnest([('home', 0), ('away', 1)]) AS s) SELECT event_id::VARCHAR AS game_id, s[1] AS side, 'Player ' || (user_id + s[2]) AS name, k::VARCHAR AS jersey,
  ['G', 'F', 'C'][k % 3 + 1] AS position, k % 2 = 0 AS starter, k % 3 = 0 AS on_court, CASE WHEN k % 6 <> 0 THEN k % 48 ELSE 0 END AS min,
  {', '.join(f'(k + {i}) % 20 AS {c}' for i, c in enumerate(feeds.BOX_STATISTICS))} FROM ev, s""")
def live_box(spark, sf):
    return feeds.live_box(live_box_payloads(spark, sf))


@query("advanced_stats", """SELECT p_partkey AS personId, CASE WHEN p_size % 5 = 0 THEN 0.20 ELSE p_size / 100.0::DOUBLE END AS usg_pct, 0.56 AS ts_pct, 0.10 AS pie,
  (p_size - 25)::DOUBLE AS net_rtg, p_retailprice AS off_rtg, 0.0 AS def_rtg, 0.53 AS efg_pct FROM part""")
def advanced_stats(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("PLAYER_ID"), F.expr("CASE WHEN p_size % 5 = 0 THEN 0D ELSE p_size / 100.0D END").alias("USG_PCT"), F.lit("n/a").alias("TS_PCT"),
        F.lit(None).cast("double").alias("PIE"), (F.col("p_size") - 25).alias("NET_RATING"), F.col("p_retailprice").alias("OFF_RATING"), F.lit(0).alias("DEF_RATING"))
    return feeds.advanced_stats(t)


# accents stripped, other non-ASCII letters dropped, lower case, trimmed
@query("normal_names", """SELECT doc_id, trim(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), ' ') AS name FROM documents""")
def normal_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.normal_name("text").alias("name"))


@query("normal_names_exact", """SELECT conv_id, turn, trim(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), ' ') AS name FROM conversations""")
def normal_names_exact(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", scalars.normal_name_exact("text").alias("name"))


# each team's report names players by id or by part of a name
@query("players_out", f"""WITH {BOX}, pool AS (SELECT DISTINCT teamId, personId, playerName FROM box), tok AS (SELECT DISTINCT teamId, personId FROM box WHERE personId % 8 = 3)
  SELECT DISTINCT p.teamId, p.personId FROM pool p JOIN tok t ON t.teamId = p.teamId
  WHERE CASE WHEN t.personId % 2 = 0 THEN p.personId = t.personId ELSE contains(lower(p.playerName), 'yer ' || t.personId) END""")
def players_out(spark, sf):
    pool = box(spark, sf).select("teamId", "personId", "playerName").distinct()
    token = F.when(F.col("personId") % 2 == 0, F.col("personId").cast("string")).otherwise(F.concat(F.lit("YÉR "), F.col("personId").cast("string")))
    named = pool.where("personId % 8 = 3").select("teamId", F.concat(token, F.lit(" , ,")).alias("names"))
    return rosters.players_out(pool, rosters.split_tokens(named, "names", ["teamId"]), ["teamId"])


@query("sub_positions", f"""WITH {BOX}, a AS (SELECT personId, avg(pts) AS pts, avg(reb) AS reb, avg(ast) AS ast, avg(blk) AS blk FROM box GROUP BY personId)
  SELECT personId, CASE personId % 4 WHEN 0 THEN CASE WHEN reb >= 5.5 OR (reb >= 4 AND ast < 4) THEN 'G-F' ELSE 'G' END
    WHEN 1 THEN CASE WHEN ast >= 5 OR (ast >= 3.5 AND reb < 5.5) THEN 'F-G' WHEN blk >= 1.3 OR (reb >= 8.5 AND blk >= 0.8) THEN 'F-C' ELSE 'F' END
    WHEN 2 THEN CASE WHEN ast >= 3.5 OR pts >= 18 THEN 'C-F' ELSE 'C' END ELSE 'F' END AS position FROM a""")
def sub_positions(spark, sf):
    means = box(spark, sf).groupBy("personId").agg(*[F.avg(c).alias(c) for c in ("pts", "reb", "ast", "blk")])
    placed = means.withColumn("primary_pos", F.element_at(lit_list(["G", "F", "C", ""]), (F.col("personId") % 4 + 1).cast("int")))
    return placed.select("personId", rosters.sub_position().alias("position"))


@query("safe_values", """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN -1 ELSE trunc(value)::BIGINT END AS as_int, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0.0 ELSE value END AS as_float FROM events""")
def safe_values(spark, sf):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(value AS STRING) END")
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", scalars.safe_int("raw").alias("as_int"), scalars.safe_float("raw").alias("as_float"))


@query("team_dimension_of_games", f"""SELECT home_tri AS team_tri, count(*) AS games, {NAMES!r}[list_position({CODES!r}, home_tri)] AS team_name,
  {IDS!r}[list_position({CODES!r}, home_tri)]::BIGINT AS team_id FROM ({SCOREBOARD}) GROUP BY home_tri""")
def team_dimension_of_games(spark, sf):
    games = feeds.scoreboard_games(scoreboard_payloads(spark, sf)).groupBy(F.col("home_tri").alias("team_tri")).agg(F.count("*").alias("games"))
    return games.join(F.broadcast(teams.team_dimension(spark)), "team_tri").select("team_tri", "games", "team_name", "team_id")


@query("sampled_games", f"""WITH {EV}, g AS (SELECT DISTINCT season, gameId FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY md5(gameId || ':42'), gameId) AS r,
  count(*) OVER (PARTITION BY season) AS n FROM g) SELECT season, gameId FROM r WHERE r <= greatest(1, floor(n * 0.05))""")
def sampled_games(spark, sf):
    return quality.sampled_games(schedule(spark, sf))


@query("reconciliation", f"""WITH {BOX}, d AS ({' UNION ALL '.join(f"SELECT '{c}' AS stat, (CASE WHEN (gameId + personId) % 10 = 0 THEN {i} + 1 ELSE 0 END)::DOUBLE AS diff FROM box WHERE personId % 6 <> 5" for i, c in enumerate(quality.COMPARED))})
  SELECT stat, round_even(avg(CASE WHEN diff = 0 THEN 100.0 ELSE 0.0 END), 1) AS exact_pct, round_even(avg(abs(diff)), 4) AS mae, max(abs(diff)) AS max_err, count(*) AS n FROM d GROUP BY stat""")
def reconciliation(spark, sf):
    ours = box(spark, sf)
    off = F.when((F.col("gameId") + F.col("personId")) % 10 == 0, 1).otherwise(0)
    official = ours.where("personId % 6 <> 5").select("gameId", "personId", *[(F.col(c) + off * (i + 1)).alias(c) for i, c in enumerate(quality.COMPARED)])
    return quality.reconcile(official, ours)
