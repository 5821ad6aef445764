"""Box scores from play-by-play, presence on court, lineups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopspark.operators import boxscore, stints
from hoopspark.functions.scalars import clock_seconds, period_seconds
from hoopspark.registry.bind import RATIOS, TEAM_POSS, USAGE, exact, ORDER_WIDTH, PBP, SCHED, pbp, r6, schedule
from hoopspark.registry.core import query

IDENT = """ident AS (
  SELECT gameId, personId, arg_min(playerName, orderNumber) AS playerName, arg_min(teamId, orderNumber) AS teamId,
         arg_min(teamTricode, orderNumber) AS teamTricode, arg_min(season, orderNumber) AS season
  FROM pbp WHERE personId IS NOT NULL AND personId <> 0 AND playerName <> '' GROUP BY gameId, personId)"""
SHOTS = """shots AS (
  SELECT gameId, personId, count(*) FILTER (isFieldGoal = 1) AS fga,
         count(*) FILTER (isFieldGoal = 1 AND shotResult = 'Made') AS fgm,
         count(*) FILTER (isFieldGoal = 1 AND actionType = '3pt') AS fg3a,
         count(*) FILTER (isFieldGoal = 1 AND actionType = '3pt' AND shotResult = 'Made') AS fg3m,
         count(*) FILTER (actionType = 'freethrow') AS fta,
         count(*) FILTER (actionType = 'freethrow' AND shotResult = 'Made') AS ftm
  FROM pbp WHERE personId <> 0 GROUP BY gameId, personId)"""
COUNTERS = """counters AS (
  SELECT gameId, personId, max(pointsTotal)::BIGINT AS pts, max(reboundTotal)::BIGINT AS reb,
         max(reboundOffensiveTotal)::BIGINT AS oreb, max(reboundDefensiveTotal)::BIGINT AS dreb,
         max(turnoverTotal)::BIGINT AS tov, max(foulPersonalTotal)::BIGINT AS pf, max(foulTechnicalTotal)::BIGINT AS tf
  FROM pbp WHERE personId <> 0 GROUP BY gameId, personId)"""
DEFENCE = """defence AS (
  SELECT gameId, personId, count(*) FILTER (actionType = 'steal') AS stl, count(*) FILTER (actionType = 'block') AS blk
  FROM pbp WHERE personId <> 0 GROUP BY gameId, personId)"""
DRAWN = """drawn AS (
  SELECT gameId, foulDrawnPersonId AS personId, count(*) AS fouls_drawn FROM pbp
  WHERE actionType = 'foul' AND subType = 'personal' AND foulDrawnPersonId IS NOT NULL GROUP BY ALL)"""
ASSISTS = """assists AS (
  SELECT gameId, assistPersonId AS personId, max(assistTotal)::BIGINT AS ast FROM pbp
  WHERE assistPersonId IS NOT NULL GROUP BY ALL)"""

# state before each row by running last values; entry markers; closed intervals
PRESENCE = """players AS (SELECT DISTINCT gameId, personId FROM acts WHERE personId <> 0),
crow AS (
  SELECT gameId, personId, orderNumber AS ord,
         CASE WHEN actionType = 'substitution' THEN CASE subType WHEN 'in' THEN 'I' ELSE 'O' END ELSE 'X' END AS kind,
         period, CAST(clock_left AS DOUBLE) AS clock FROM acts WHERE personId <> 0
  UNION ALL
  SELECT p.gameId, p.personId, m.orderNumber, CASE m.subType WHEN 'start' THEN 'S' ELSE 'E' END, m.period, 0
  FROM players p JOIN marks m USING (gameId)
  UNION ALL SELECT gameId, personId, 2305843009213693952, 'Z', NULL, 0 FROM players),
c1 AS (
  SELECT *, last_value(CASE kind WHEN 'I' THEN 1 WHEN 'X' THEN 1 WHEN 'O' THEN 0 END IGNORE NULLS) OVER w AS own_on,
         last_value(CASE WHEN kind IN ('I', 'X', 'O') THEN ord END IGNORE NULLS) OVER w AS own_ord,
         last_value(CASE WHEN kind IN ('I', 'O') THEN ord END IGNORE NULLS) OVER w AS sub_ord,
         last_value(CASE WHEN kind IN ('S', 'E') THEN kind END IGNORE NULLS) OVER w AS b_kind,
         last_value(CASE WHEN kind IN ('S', 'E') THEN ord END IGNORE NULLS) OVER w AS b_ord,
         last_value(CASE WHEN kind = 'S' THEN period END IGNORE NULLS) OVER w AS cp
  FROM crow WINDOW w AS (PARTITION BY gameId, personId ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT *, coalesce(own_on = 1 AND (b_kind IS NULL OR b_kind = 'S' OR own_ord > b_ord), false) AS present FROM c1),
c3 AS (
  SELECT *, last_value(CASE WHEN kind = 'E' THEN present END IGNORE NULLS) OVER w AS was FROM c2
  WINDOW w AS (PARTITION BY gameId, personId ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c4 AS (
  SELECT *, CASE WHEN kind = 'S' AND b_kind = 'E' AND was AND (sub_ord IS NULL OR sub_ord < b_ord)
                 THEN CASE WHEN period <= 4 THEN 720 ELSE 300 END
                 WHEN kind = 'I' THEN clock
                 WHEN kind = 'X' AND NOT present AND cp IS NOT NULL THEN CASE WHEN cp <= 4 THEN 720 ELSE 300 END
            END AS enters FROM c3),
c5 AS (
  SELECT *, last_value(enters IGNORE NULLS) OVER w AS entry_clock,
         last_value(CASE WHEN enters IS NOT NULL AND NOT present THEN ord END IGNORE NULLS) OVER w AS start_ord,
         last_value(CASE WHEN enters IS NOT NULL AND NOT present THEN enters END IGNORE NULLS) OVER w AS start_clock,
         last_value(CASE WHEN enters IS NOT NULL AND NOT present THEN kind END IGNORE NULLS) OVER w AS start_kind
  FROM c4 WINDOW w AS (PARTITION BY gameId, personId ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pres AS (
  SELECT gameId, personId, cp AS period, entry_clock, CASE kind WHEN 'O' THEN clock ELSE 0 END AS exit_clock,
         start_ord, start_clock, start_kind, ord AS end_ord
  FROM c5 WHERE present AND kind IN ('O', 'E', 'Z'))"""
MINUTES = """mins AS (SELECT gameId, personId, {minutes} AS min
  FROM pres GROUP BY gameId, personId)""".format(minutes=exact("sum(greatest(0, round(100 * entry_clock)::BIGINT - round(100 * exit_clock)::BIGINT))", "6000", 1))
SEGMENTS = """people AS (
  SELECT p.*, t.teamId, t.season FROM pres p JOIN
    (SELECT gameId, personId, arg_min(teamId, orderNumber) AS teamId, max(season) AS season FROM acts GROUP BY ALL) t
    USING (gameId, personId)),
changes AS (
  SELECT gameId, teamId, ord, sum(delta) AS delta, max(clock) AS clock, max(season) AS season, max(carried) AS carried FROM (
    SELECT gameId, teamId, season, start_ord AS ord, 1 AS delta, start_clock AS clock, CASE WHEN start_kind = 'S' THEN 1 ELSE 0 END AS carried FROM people
    UNION ALL SELECT gameId, teamId, season, end_ord, -1, exit_clock, 0 FROM people
    UNION ALL SELECT gameId, teamId, season, orderNumber, 0, clock_left, 0 FROM acts WHERE actionType = 'substitution')
  GROUP BY gameId, teamId, ord),
counted AS (
  SELECT *, sum(delta) OVER w AS on_court, lead(ord) OVER w AS end_ord, lead(clock) OVER w AS end_clock,
         lead(carried) OVER w AS end_carried
  FROM changes WINDOW w AS (PARTITION BY gameId, teamId ORDER BY ord)),
segs AS (
  SELECT c.gameId, c.teamId, c.ord AS start_ord, c.end_ord, max(c.season) AS season,
         max(round_even(greatest(0, c.clock - c.end_clock) / 60, 2)) AS min,
         string_agg(CAST(p.personId AS VARCHAR), ',' ORDER BY p.personId) AS lineup,
         list(p.personId ORDER BY p.personId) AS ids
  FROM counted c JOIN people p ON p.gameId = c.gameId AND p.teamId = c.teamId AND p.start_ord <= c.ord AND p.end_ord > c.ord
  WHERE c.on_court = 5 AND c.end_ord IS NOT NULL AND c.end_carried = 0
  GROUP BY c.gameId, c.teamId, c.ord, c.end_ord)"""


@query("game_clock", f"""WITH {PBP} SELECT gameId, orderNumber, CAST(clock_left AS DOUBLE) AS clock_s,
  CASE WHEN period <= 4 THEN 720.0::DOUBLE ELSE 300.0::DOUBLE END AS period_s FROM pbp""")
def game_clock(spark, sf):
    return pbp(spark, sf).select("gameId", "orderNumber", clock_seconds("clock").alias("clock_s"),
                                 period_seconds("period").alias("period_s"))


@query("player_identity", f"WITH {PBP}, {IDENT} SELECT * FROM ident")
def player_identity(spark, sf):
    return boxscore.identity(pbp(spark, sf))


@query("counter_totals", f"WITH {PBP}, {COUNTERS} SELECT * FROM counters")
def counter_totals(spark, sf):
    return boxscore.counter_totals(pbp(spark, sf))


@query("shooting_counts", f"WITH {PBP}, {SHOTS} SELECT * FROM shots")
def shooting_counts(spark, sf):
    return boxscore.shooting_counts(pbp(spark, sf))


@query("steals_blocks", f"WITH {PBP}, {DEFENCE} SELECT * FROM defence")
def steals_blocks(spark, sf):
    return boxscore.steals_and_blocks(pbp(spark, sf))


@query("fouls_drawn", f"WITH {PBP}, {DRAWN} SELECT * FROM drawn")
def fouls_drawn(spark, sf):
    return boxscore.fouls_drawn(pbp(spark, sf))


@query("assists_credited", f"WITH {PBP}, {ASSISTS} SELECT * FROM assists")
def assists_credited(spark, sf):
    return boxscore.assists(pbp(spark, sf))


@query("presence_intervals", f"""WITH {PBP}, {PRESENCE} SELECT gameId, personId, CAST(entry_clock AS DOUBLE) AS entry_clock,
  CAST(exit_clock AS DOUBLE) AS exit_clock, end_ord FROM pres""")
def presence_intervals(spark, sf):
    return stints.presence(pbp(spark, sf), ORDER_WIDTH)


@query("minutes_on_court", f"WITH {PBP}, {PRESENCE}, {MINUTES} SELECT * FROM mins")
def minutes_on_court(spark, sf):
    return stints.minutes(pbp(spark, sf), ORDER_WIDTH)


FULL_BOX = f"""{PBP}, {IDENT}, {SHOTS}, {COUNTERS}, {DEFENCE}, {DRAWN}, {ASSISTS}, {PRESENCE}, {MINUTES},
asm AS (
  SELECT i.*, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in boxscore.COUNT_COLUMNS)},
         coalesce(min, 0.0) AS min
  FROM ident i LEFT JOIN counters USING (gameId, personId) LEFT JOIN shots USING (gameId, personId)
  LEFT JOIN defence USING (gameId, personId) LEFT JOIN drawn USING (gameId, personId)
  LEFT JOIN assists USING (gameId, personId) LEFT JOIN mins USING (gameId, personId)),
asm2 AS (SELECT *, {TEAM_POSS} FROM asm),
fullbox AS (
  SELECT *, {RATIOS},
         {USAGE}
  FROM asm2)"""


@query("box_scores", f"""WITH {FULL_BOX} SELECT * REPLACE (round(team_poss, 4) AS team_poss) FROM fullbox""")
def box_scores(spark, sf):
    plays = pbp(spark, sf)
    return r6(boxscore.box_scores(plays, stints.minutes(plays, ORDER_WIDTH)), "team_poss", digits=4)


@query("box_scores_clean", f"""WITH {FULL_BOX} SELECT gameId, CAST(season AS SMALLINT) AS season, personId, playerName, teamId, teamTricode,
  round(CAST(min AS FLOAT)::DOUBLE, 3) AS min, {', '.join(f'CAST({c} AS SMALLINT) AS {c}' for c in boxscore.COUNT_COLUMNS)},
  {', '.join(f'round(CAST({c} AS FLOAT)::DOUBLE, 3) AS {c}' for c in boxscore.RATIO_COLUMNS)}
  FROM fullbox WHERE min <> 0 OR {' + '.join(boxscore.COUNT_COLUMNS)} <> 0""")
def box_scores_clean(spark, sf):
    plays = pbp(spark, sf)
    cleaned = boxscore.clean(boxscore.box_scores(plays, stints.minutes(plays, ORDER_WIDTH)))
    floats = ["min", *boxscore.RATIO_COLUMNS]
    return r6(cleaned.withColumns({c: F.col(c).cast("double") for c in floats}), *floats, digits=3)


@query("shooting_ratios", f"""WITH {PBP}, {SHOTS}, {COUNTERS} SELECT gameId, personId, {RATIOS} FROM shots JOIN counters USING (gameId, personId)""")
def shooting_ratios(spark, sf):
    rows = boxscore.shooting_ratios(boxscore.player_totals(pbp(spark, sf)))
    return rows.select("gameId", "personId", "fg_pct", "fg3_pct", "ft_pct", "efg_pct", "ts_pct")


@query("lineup_stints", f"""WITH {PBP}, {PRESENCE}, {SEGMENTS}
  SELECT gameId, teamId, start_ord, end_ord, season, min, lineup FROM segs""")
def lineup_stints(spark, sf):
    rows = stints.lineup_segments(pbp(spark, sf), ORDER_WIDTH)
    return rows.withColumn("lineup", F.concat_ws(",", F.transform("lineup", lambda p: p.cast("string"))))


MARGINS = """scored AS (
  SELECT gameId, orderNumber AS ord,
         coalesce(last_value(scoreHome IGNORE NULLS) OVER w, 0) - coalesce(last_value(scoreAway IGNORE NULLS) OVER w, 0) AS margin
  FROM pbp WINDOW w AS (PARTITION BY gameId ORDER BY orderNumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ssegs AS (
  SELECT s.*, round_even((CASE WHEN s.teamId = g.home_team_id THEN 1 ELSE -1 END) * (b.margin - a.margin)::DOUBLE, 1) AS net_pts
  FROM segs s JOIN scored a ON a.gameId = s.gameId AND a.ord = s.start_ord
  JOIN (SELECT * FROM scored UNION ALL
        SELECT gameId, 2305843009213693952, arg_max(margin, ord) FROM scored GROUP BY gameId) b
    ON b.gameId = s.gameId AND b.ord = s.end_ord
  LEFT JOIN sched g ON g.gameId = s.gameId)"""


@query("scored_stints", f"""WITH {PBP}, {SCHED}, {PRESENCE}, {SEGMENTS}, {MARGINS}
  SELECT gameId, teamId, start_ord, end_ord, season, min, lineup, net_pts FROM ssegs""")
def scored_stints(spark, sf):
    rows = stints.scored_segments(pbp(spark, sf), schedule(spark, sf), ORDER_WIDTH)
    return rows.withColumn("lineup", F.concat_ws(",", F.transform("lineup", lambda p: p.cast("string"))))
