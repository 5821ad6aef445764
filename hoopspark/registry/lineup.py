"""Lineup totals, ratings and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopspark.operators import features, games, lineups, selection, stints
from hoopspark.registry.bind import BOX, EV, OFF_TIE, ORDER_WIDTH, PBP, SCHED, box, events, pbp, r6, schedule, settle, settled, table
from hoopspark.registry.core import query
from hoopspark.registry.court import MARGINS, PRESENCE, SEGMENTS
from hoopspark.registry.play import RESULTS
from hoopspark.registry.series import EWMA, MATRIX, POINTS, matrix, rounded
from hoopspark.sources.positions import latest_positions


def text(c):
    return F.concat_ws(",", F.transform(c, lambda p: p.cast("string")))


FIVES = f"{PBP}, {SCHED}, {PRESENCE}, {SEGMENTS}, {MARGINS}"
TOTALS = """lt AS (SELECT teamId, season, lineup, any_value(ids) AS ids, count(DISTINCT gameId) AS games, round_even(sum(round(min * 100)::BIGINT)::BIGINT / 100.0::DOUBLE, 1) AS total_min,
  round_even(sum(net_pts), 1) AS net_pts FROM ssegs GROUP BY teamId, season, lineup)"""
BOX_ONLY = BOX.replace(EV + ",\n", "", 1)


def segments(spark, sf):
    return stints.scored_segments(pbp(spark, sf), schedule(spark, sf), ORDER_WIDTH)


@query("lineup_totals", f"""WITH {FIVES}, {TOTALS}
  SELECT t.teamId, t.season, t.games, t.total_min, {', '.join(f"ids[{i}] AS p{i}, 'Player ' || ids[{i}] AS p{i}_name" for i in range(1, 6))} FROM lt t""")
def lineup_totals(spark, sf):
    totals = lineups.lineup_totals(stints.lineup_segments(pbp(spark, sf), ORDER_WIDTH))
    return lineups.with_players(totals, lineups.player_names(box(spark, sf))).drop("lineup")


@query("lineup_net_ratings", f"""WITH {FIVES}, {TOTALS}, n AS (SELECT *, round_even(total_min * 2.083::DOUBLE, 1) AS possessions FROM lt)
  SELECT teamId, season, lineup, games, total_min, net_pts, possessions, round_even(100.0::DOUBLE * net_pts / nullif(possessions, 0), 2) AS net_rating FROM n""")
def lineup_net_ratings(spark, sf):
    df = lineups.net_ratings(lineups.lineup_totals(segments(spark, sf)))
    return df.withColumn("lineup", text("lineup"))


PRORATED = f"""n AS (SELECT *, round_even(total_min * 2.083::DOUBLE, 1) AS possessions FROM lt),
sd AS (SELECT gameId, home_team_id AS teamId, home_pts AS team_pts, away_pts AS opp_pts FROM gp WHERE home_pts IS NOT NULL AND away_pts IS NOT NULL
  UNION ALL SELECT gameId, away_team_id, away_pts, home_pts FROM gp WHERE home_pts IS NOT NULL AND away_pts IS NOT NULL),
tmn AS (SELECT gameId, teamId, sum(min) AS team_min FROM box GROUP BY gameId, teamId),
pr AS (SELECT s.teamId, s.season, s.lineup, round(coalesce(sum(s.min / nullif(m.team_min, 0) * d.team_pts), 0), 6) + 3.21e-8::DOUBLE AS pts_scored,
       round(coalesce(sum(s.min / nullif(m.team_min, 0) * d.opp_pts), 0), 6) + 3.21e-8::DOUBLE AS pts_allowed
       FROM ssegs s LEFT JOIN (sd d JOIN tmn m ON m.gameId = d.gameId AND m.teamId = d.teamId) ON d.gameId = s.gameId AND d.teamId = s.teamId GROUP BY ALL),
psm AS (SELECT personId, season, {', '.join(f'avg({c}) AS {c}' for c in lineups.EMBEDDING_STATS)} FROM box WHERE min > 0 GROUP BY personId, season),
emb AS (SELECT l.teamId, l.season, l.lineup, {', '.join(f'CASE WHEN count(p.personId) = 0 THEN 0.0 WHEN count(p.{c}) = count(p.personId) THEN avg(p.{c}) END AS emb_{c}' for c in lineups.EMBEDDING_STATS)}
  FROM (SELECT teamId, season, lineup, unnest(ids) AS pid FROM lt) l LEFT JOIN psm p ON p.personId = l.pid AND p.season = l.season GROUP BY ALL)"""
EMB = [f"emb_{c}" for c in lineups.EMBEDDING_STATS]


@query("lineup_ratings", f"""WITH {FIVES}, {TOTALS}, {BOX_ONLY}, {POINTS}, {PRORATED}
  SELECT n.teamId, n.season, n.lineup, games, total_min, net_pts, possessions, round_even(100.0::DOUBLE * net_pts / nullif(possessions, 0), 2) AS net_rating,
         round(pts_scored, 6) AS pts_scored, round(pts_allowed, 6) AS pts_allowed, round_even(100.0::DOUBLE * pts_scored / nullif(possessions, 0), 2) AS off_rating,
         round_even(100.0::DOUBLE * pts_allowed / nullif(possessions, 0), 2) AS def_rating, {rounded(EMB)}
  FROM n JOIN pr USING (teamId, season, lineup) JOIN emb USING (teamId, season, lineup)""")
def lineup_ratings(spark, sf):
    rows, games_, parts = box(spark, sf), schedule(spark, sf), segments(spark, sf)
    sides = lineups.game_totals_by_side(rows, features.game_points(rows, games_))
    shares = lineups.prorated_points(parts, sides)
    shares = shares.withColumns({c: F.round(F.col(c), 6) + OFF_TIE for c in ("pts_scored", "pts_allowed")})
    df = lineups.two_way_ratings(lineups.net_ratings(lineups.lineup_totals(parts)), shares)
    df = df.join(lineups.lineup_embeddings(df, lineups.player_season_means(rows)), lineups.KEY)
    return r6(df.withColumn("lineup", text("lineup")), "pts_scored", "pts_allowed", *EMB)


@query("label_mean_vectors", """SELECT label, i AS place, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM
  (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def label_mean_vectors(spark, sf):
    """Element-wise mean of a group's vectors, the shape of the lineup embedding on plain vectors."""
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("place", "v"))
    return r6(long.groupBy("label", "place").agg(F.avg(F.col("v").cast("double")).alias("mean")), "mean")


@query("best_known_names", f"WITH {BOX} SELECT personId, arg_min(playerName, gameId) AS playerName FROM box GROUP BY personId")
def best_known_names(spark, sf):
    return lineups.player_names(box(spark, sf))


def positions(spark, sf):
    """Listed positions by player and season; some seasons have none."""
    rows = events(spark, sf).select(F.col("user_id").alias("PERSON_ID"), "season").distinct()
    listed = F.element_at(F.array(*map(F.lit, ["G", "F", "C", "G-F", "F-C", "G", "F"])), ((F.col("PERSON_ID") + F.col("season")) % 7 + 1).cast("int"))
    return rows.withColumn("POSITION", F.when((F.col("PERSON_ID") + F.col("season")) % 5 != 0, listed))


POSITIONS = """rawpos AS (SELECT DISTINCT user_id AS pid, season, CASE WHEN (user_id + season) % 5 <> 0 THEN ['G', 'F', 'C', 'G-F', 'F-C', 'G', 'F'][(user_id + season) % 7 + 1] END AS position FROM ev),
posn AS (SELECT pid AS personId, arg_max(position, season) AS position FROM rawpos WHERE position IS NOT NULL GROUP BY pid)"""


@query("player_positions", f"WITH {EV}, {POSITIONS} SELECT * FROM posn")
def player_positions(spark, sf):
    return latest_positions(positions(spark, sf))


# scores are rounded, so both sides start from weighted means already rounded to six decimals
MAT6 = f"""{MATRIX},
mat6 AS MATERIALIZED (SELECT gameId, season, game_date, personId, playerName, teamId, teamTricode, {settled(EWMA)} FROM matrix)"""


def matrix6(spark, sf):
    return settle(matrix(spark, sf), *EWMA)


STATS = list(selection.SCORE_WEIGHTS)
SCORE = "round_even(" + " + ".join(f"coalesce({c}, 0) * {w}::DOUBLE" for c, w in selection.SCORE_WEIGHTS.items()) + ", 3)"
INFER = """CASE WHEN position IS NOT NULL AND trim(position) <> '' THEN position WHEN coalesce(reb_ewma, 0) >= 9 AND coalesce(blk_ewma, 0) >= 0.8 THEN 'C'
  WHEN coalesce(ast_ewma, 0) >= 5 OR (coalesce(ast_ewma, 0) >= 3 AND coalesce(reb_ewma, 0) < 5) THEN 'G' ELSE 'F' END"""


@query("composite_scores", f"WITH RECURSIVE {MAT6} SELECT gameId, personId, {SCORE} AS score FROM mat6")
def composite_scores(spark, sf):
    return selection.composite_score(matrix6(spark, sf)).select("gameId", "personId", "score")


@query("position_flags", f"""WITH RECURSIVE {MAT6}, {POSITIONS}, p AS (SELECT gameId, m.personId, {INFER} AS position FROM mat6 m LEFT JOIN posn USING (personId))
  SELECT gameId, personId, position, contains(position, 'G') AS is_guard, contains(position, 'F') AS is_forward, contains(position, 'C') AS is_center FROM p""")
def position_flags(spark, sf):
    df = matrix6(spark, sf).join(latest_positions(positions(spark, sf)), "personId", "left")
    df = df.withColumn("position", selection.inferred_position())
    return df.withColumns(selection.position_flags()).select("gameId", "personId", "position", "is_guard", "is_forward", "is_center")


ROSTER = f"""recent AS (SELECT teamId, gameId FROM (SELECT *, row_number() OVER (PARTITION BY teamId ORDER BY game_date DESC, gameId DESC) AS r
  FROM (SELECT DISTINCT teamId, gameId, game_date FROM mat6)) WHERE r <= 20),
seen AS (SELECT DISTINCT m.teamId, m.personId FROM mat6 m JOIN recent r ON r.teamId = m.teamId AND r.gameId = m.gameId),
roster AS MATERIALIZED (SELECT m.teamId, m.personId, {', '.join(f'arg_max(m.{c}, (m.game_date, m.gameId)) FILTER (m.{c} IS NOT NULL) AS {c}' for c in STATS)}
  FROM mat6 m JOIN seen s ON s.teamId = m.teamId AND s.personId = m.personId GROUP BY ALL)"""


@query("active_roster", f"WITH RECURSIVE {MAT6}, {ROSTER} SELECT teamId, personId, {rounded(STATS)} FROM roster")
def active_roster(spark, sf):
    return r6(selection.active_roster(matrix6(spark, sf), STATS), *STATS)


def best_sql(pool, keys):
    """Brute force: every five of each pool, position rules kept where the pool can meet them."""
    k = ", ".join(keys)
    e = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    need = lambda f, n: f"(any_{f} < {n} OR a.{f} + b.{f} + c.{f} + d.{f} + e.{f} >= {n})"
    return f"""pl AS MATERIALIZED (SELECT *, contains(position, 'G')::INT AS g, contains(position, 'F')::INT AS f, contains(position, 'C')::INT AS c, round(score * 1000)::BIGINT AS pts,
  count(*) OVER (PARTITION BY {k}) AS n, sum(contains(position, 'G')::INT) OVER (PARTITION BY {k}) AS any_g, sum(contains(position, 'F')::INT) OVER (PARTITION BY {k}) AS any_f,
  sum(contains(position, 'C')::INT) OVER (PARTITION BY {k}) AS any_c FROM {pool}),
combos AS (
  SELECT {', '.join(f'a.{x}' for x in keys)}, [a.personId, b.personId, c.personId, d.personId, e.personId] AS ids, a.pts + b.pts + c.pts + d.pts + e.pts AS total
  FROM pl a JOIN pl b ON {e('a', 'b')} AND a.personId < b.personId JOIN pl c ON {e('b', 'c')} AND b.personId < c.personId
  JOIN pl d ON {e('c', 'd')} AND c.personId < d.personId JOIN pl e ON {e('d', 'e')} AND d.personId < e.personId
  WHERE a.n = 5 OR ({need('g', 2).replace('any_', 'a.any_')} AND {need('f', 2).replace('any_', 'a.any_')} AND {need('c', 1).replace('any_', 'a.any_')})
  UNION ALL SELECT {k}, list(personId ORDER BY personId), sum(pts) FROM pl WHERE n < 5 GROUP BY {k}),
best AS MATERIALIZED (SELECT {k}, ids, total FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY total DESC, ids) AS r FROM combos) WHERE r = 1)"""


def eligible_sql(source, keys):
    k = ", ".join(keys)
    return f"""elig AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) FILTER (coalesce(min_ewma, 0) >= 5) OVER (PARTITION BY {k}) AS passing,
  row_number() OVER (PARTITION BY {k} ORDER BY score DESC, personId) AS sr FROM {source}) WHERE CASE WHEN passing >= 5 THEN coalesce(min_ewma, 0) >= 5 ELSE sr <= 5 END)"""


POOL = f"""pool AS MATERIALIZED (SELECT r.* , {INFER} AS pos, {SCORE} AS score FROM roster r LEFT JOIN posn USING (personId)),
pool2 AS (SELECT * EXCLUDE (pos), pos AS position FROM pool)"""


@query("eligible_players", f"WITH RECURSIVE {MAT6}, {POSITIONS}, {ROSTER}, {POOL}, {eligible_sql('pool2', ['teamId'])} SELECT teamId, personId, position, score FROM elig")
def eligible_players(spark, sf):
    return eligible_pool(spark, sf).select("teamId", "personId", "position", "score")


def eligible_pool(spark, sf):
    pool = selection.scored_pool(selection.active_roster(matrix6(spark, sf), STATS), latest_positions(positions(spark, sf)))
    return selection.eligible(pool, ["teamId"])


@query("best_five", f"""WITH RECURSIVE {MAT6}, {POSITIONS}, {ROSTER}, {POOL}, {eligible_sql('pool2', ['teamId'])}, {best_sql('elig', ['teamId'])}
  SELECT teamId, array_to_string(ids, ',') AS lineup, total / 1000.0::DOUBLE AS total_score FROM best""")
def best_five(spark, sf):
    return selection.best_five(eligible_pool(spark, sf), ["teamId"]).withColumn("lineup", text("lineup"))


BEFORE = f"""tgm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY teamId ORDER BY game_date, gameId) AS seq FROM (SELECT DISTINCT teamId, gameId, game_date FROM mat6)),
mseq AS MATERIALIZED (SELECT m.*, t.seq FROM mat6 m JOIN tgm t ON t.teamId = m.teamId AND t.gameId = m.gameId),
befo AS (
  SELECT t.teamId, t.gameId, t.game_date, m.personId, {', '.join(f'arg_max(m.{c}, m.seq) FILTER (m.{c} IS NOT NULL) AS {c}' for c in STATS)}
  FROM tgm t JOIN mseq m ON m.teamId = t.teamId AND m.seq < t.seq GROUP BY ALL HAVING max(m.seq) >= max(t.seq) - 20),
roster AS MATERIALIZED (SELECT * FROM befo)"""
EVALUATED = f"""{BEFORE}, {POOL}, {eligible_sql('pool2', ['teamId', 'gameId'])}, {best_sql('elig', ['teamId', 'gameId'])},
act AS (SELECT teamId, gameId, list(personId) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY teamId, gameId ORDER BY min DESC, personId) AS r FROM box) WHERE r <= 5 GROUP BY ALL),
asc_ AS (SELECT a.teamId, a.gameId, coalesce(sum(round(p.score * 1000)::BIGINT), 0)::BIGINT / 1000.0::DOUBLE AS act_score FROM (SELECT teamId, gameId, unnest(ids) AS pid FROM act) a
  LEFT JOIN pool2 p ON p.teamId = a.teamId AND p.gameId = a.gameId AND p.personId = a.pid GROUP BY ALL),
evald AS (SELECT b.gameId, t.game_date, b.teamId, len(list_intersect(b.ids, a.ids))::INTEGER AS overlap_5, r.won, round_even(b.total / 1000.0::DOUBLE, 2) AS rec_score,
  round_even(s.act_score, 2) AS act_score, CAST(b.total > round(s.act_score * 1000) AS INTEGER) AS rec_better
  FROM best b JOIN act a ON a.teamId = b.teamId AND a.gameId = b.gameId JOIN asc_ s ON s.teamId = b.teamId AND s.gameId = b.gameId
  JOIN tgm t ON t.teamId = b.teamId AND t.gameId = b.gameId LEFT JOIN res r ON r.gameId = b.gameId AND r.teamId = b.teamId)"""


def evaluated(spark, sf):
    rows = box(spark, sf)
    return selection.evaluate_lineups(matrix6(spark, sf), rows, latest_positions(positions(spark, sf)), games.team_results(rows))


@query("lineup_evaluation", f"WITH RECURSIVE {MAT6}, {RESULTS}, {POSITIONS}, {EVALUATED} SELECT * FROM evald")
def lineup_evaluation(spark, sf):
    return evaluated(spark, sf)


SUMMARY = ["mean_overlap", "exact", "at_least_4", "at_least_3", "rec_better", "win_rate_4_plus", "win_rate_2_less"]


@query("lineup_evaluation_summary", f"""WITH RECURSIVE {MAT6}, {RESULTS}, {POSITIONS}, {EVALUATED}, s AS (
  SELECT count(*) AS team_games, avg(overlap_5) AS mean_overlap, avg((overlap_5 = 5)::INT) AS exact, avg((overlap_5 >= 4)::INT) AS at_least_4,
         avg((overlap_5 >= 3)::INT) AS at_least_3, avg(rec_better) AS rec_better, avg(won) FILTER (overlap_5 >= 4) AS win_rate_4_plus,
         avg(won) FILTER (overlap_5 <= 2) AS win_rate_2_less FROM evald)
  SELECT team_games, {rounded(SUMMARY)} FROM s""")
def lineup_evaluation_summary(spark, sf):
    return r6(selection.evaluation_summary(evaluated(spark, sf)), *SUMMARY)


@query("greedy_five", f"""WITH RECURSIVE {MAT6}, {POSITIONS}, {ROSTER}, {POOL},
  q AS (SELECT *, row_number() OVER (PARTITION BY teamId, position[1] ORDER BY score DESC, personId) <= CASE position[1] WHEN 'C' THEN 1 ELSE 2 END AS inq FROM pool2),
  o AS (SELECT *, row_number() OVER (PARTITION BY teamId ORDER BY inq DESC, score DESC, personId) AS r FROM q)
  SELECT teamId, personId, position, score FROM o WHERE r <= 5""")
def greedy_five(spark, sf):
    pool = selection.scored_pool(selection.active_roster(matrix6(spark, sf), STATS), latest_positions(positions(spark, sf)))
    return selection.greedy_five(pool, ["teamId"]).select("teamId", "personId", "position", "score")
