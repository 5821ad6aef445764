"""Predictions and reports over the feature matrix, with model weights left out so that SQL can follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopspark.operators import features, predictions, reports, rosters, selection
from hoopspark.plans import season
from hoopspark.registry.bind import BOX, EV, SCHED, box, r6, schedule, season_tables, settle, settled, table
from hoopspark.registry.core import query
from hoopspark.registry.feeds import live_box_payloads
from hoopspark.registry.lineup import INFER, POSITIONS, SCORE, best_sql, positions
from hoopspark.registry.play import RESULTS
from hoopspark.registry.series import (
    EFF_COLS, ELO, ELO_JOIN, EWMA, LOADS, MATRIX, SEASON, matrix, rated_matrix, with_minutes,
)
from hoopspark.session import written
from hoopspark.sources import feeds
from hoopspark.sources.positions import latest_positions

ROLL5 = ["min_roll5", "usg_pct_roll5"]
USED = EWMA + SEASON + ROLL5 + EFF_COLS
NOW = 3
MATP = f"""{MATRIX}, {ELO}, {ELO_JOIN},
matp AS MATERIALIZED (SELECT m.gameId, m.season, m.game_date, m.personId, m.playerName, m.teamId, m.teamTricode, m.rest_days, m.is_back_to_back,
  {settled(USED, 'm.')}, round(e.team_elo, 6) AS team_elo FROM matrix m LEFT JOIN ej2 e ON e.gameId = m.gameId AND e.personId = m.personId)"""


IDS = ["gameId", "season", "game_date", "personId", "playerName", "teamTricode"]
BOX_READ = list(dict.fromkeys([*IDS, "teamId", *features.ROLL_STATS, *features.TEAM_TOTALS]))


def rated_rows(tables):
    """What the predictions read of the feature matrix with team ratings, rounded so that both engines predict from the same
    numbers. Rows pass through Python whole, so they start from the columns that are read."""
    rows = rated_matrix((tables[0].select(*BOX_READ), tables[1]), stint_stats=[]).select(*IDS, *USED, "team_elo")
    return r6(settle(rows, *USED), "team_elo")


def rated(tables):
    """These rows written once, for queries that read them again beside the pool."""
    return written(rated_rows(tables), "features")


def ids_of(tables):
    return tables[0].select(F.col("personId").alias("user_id")).distinct()


def live_roster(tables):
    """Everyone but each ninth player, on the team they started with, under an accented spelling."""
    ids = ids_of(tables).where("user_id % 9 <> 0")
    return ids.select(
        F.concat(F.lit("PLÁYER "), F.col("user_id").cast("string")).alias("player_name"),
        F.expr("concat('T', user_id div 10)").alias("team_tri"),
        F.element_at(F.array(*map(F.lit, "GFC")), (F.col("user_id") % 3 + 1).cast("int")).alias("primary_pos"))


def report(tables):
    """Each eighth player (from the fourth) is on the report."""
    ids = ids_of(tables).withColumnRenamed("user_id", "u").where("u % 8 = 3")
    status = F.element_at(F.array(*map(F.lit, ["Out", "Doubtful", "Questionable", "Injured Reserve"])), ((F.col("u") / 8).cast("int") % 4 + 1))
    return ids.select(
        F.concat(F.lit(" Pláyer "), F.col("u").cast("string")).alias("player_name"), F.expr("concat('T', u div 10)").alias("team_tri"),
        status.alias("status"), rosters.status_rank(status).alias("status_rank"), F.lit("Knee").alias("injury_detail"))


REPORT = """inj AS (SELECT u, 'T' || (u // 10) AS team_tri, ['Out', 'Doubtful', 'Questionable', 'Injured Reserve'][(u // 8) % 4 + 1] AS status,
  [4, 3, 2, 4][(u // 8) % 4 + 1] AS status_rank FROM (SELECT DISTINCT user_id AS u FROM ev) WHERE u % 8 = 3)"""
PCOLS = USED + ["team_elo"]
POOL = f"""lpool AS MATERIALIZED (SELECT teamTricode, personId, any_value(playerName) AS playerName, {', '.join(f'arg_max({c}, (game_date, gameId)) FILTER ({c} IS NOT NULL) AS {c}' for c in PCOLS)}
  FROM matp WHERE season = {NOW} GROUP BY teamTricode, personId HAVING personId % 9 <> 0 AND teamTricode = 'T' || (personId // 10)),
{REPORT},
outs AS (SELECT DISTINCT p.teamTricode, p.personId FROM lpool p JOIN inj i ON i.team_tri = p.teamTricode WHERE i.status_rank >= 4 AND contains(lower(p.playerName), 'player ' || i.u))"""


def pool_of(tables, rows=None):
    """Current players, stored: selection, absences and context read them in turn."""
    rows = rated_rows(tables) if rows is None else rows
    return written(predictions.current_players(rows, NOW, live_roster(tables), ["playerName", *PCOLS]), "pool")


def outs_of(tables, pool):
    names = report(tables).where(F.col("status_rank") >= rosters.SURE_OUT)
    return rosters.players_out(pool, names.select(F.col("team_tri").alias("teamTricode"), F.col("player_name").alias("token")), ["teamTricode"])


SEL = "0.60::DOUBLE * coalesce(min_ewma, 0) + 0.40::DOUBLE * coalesce(min_season_avg, 0)"
CHOSEN = f"""chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY teamTricode ORDER BY {SEL} DESC, personId) AS sr FROM lpool) WHERE sr <= 8)"""


@query("selected_players", f"WITH RECURSIVE {MATP}, {POOL}, {CHOSEN} SELECT teamTricode, personId, playerName FROM chosen")
def selected_players(spark, sf):
    return predictions.selected_players(pool_of(season_tables(spark, sf))).select("teamTricode", "personId", "playerName")


def game_rows_with_codes(tables, rows):
    """Latest team values per game in game-row form: efficiency and rating of both sides."""
    sides = rows.groupBy("gameId", "game_date", "teamTricode").agg(F.max("drtg_roll5").alias("drtg_roll5"), F.max("team_elo").alias("team_elo"))
    games = tables[1].select("gameId", "home_tricode", "away_tricode")
    side = lambda s: [F.max(F.when(F.col("teamTricode") == F.col(f"{s}_tricode"), F.col(c))).alias(f"{s}_{c}") for c in ("drtg_roll5", "team_elo")]
    return sides.join(games, "gameId").groupBy("gameId", "game_date", "home_tricode", "away_tricode").agg(*side("home"), *side("away"))


CONTEXT = """sidev AS (SELECT gameId, game_date, teamTricode, max(drtg_roll5) AS drtg, max(team_elo) AS elo FROM matp GROUP BY ALL),
gs AS (SELECT s.gameId, g.game_date, s.home_tricode, s.away_tricode FROM sched s JOIN (SELECT DISTINCT gameId, game_date FROM matp) g USING (gameId)),
gside AS (SELECT gameId, game_date, home_tricode AS team FROM gs UNION ALL SELECT gameId, game_date, away_tricode FROM gs),
lastg AS (SELECT t.team, arg_max({'drtg': v.drtg, 'elo': v.elo}, (t.game_date, t.gameId)) AS g FROM gside t LEFT JOIN sidev v ON v.gameId = t.gameId AND v.teamTricode = t.team GROUP BY t.team),
pmean AS (SELECT teamTricode AS team, avg(drtg_roll5) AS d FROM lpool GROUP BY teamTricode),
ctx AS (SELECT coalesce(l.team, p.team) AS opp_tri, round(coalesce(nullif(l.g.drtg, 0), p.d) + 3.21e-8::DOUBLE, 6) AS opp_def_rating, coalesce(nullif(l.g.elo, 0), 1500.0) AS opp_elo
  FROM lastg l FULL OUTER JOIN pmean p ON l.team = p.team)"""


def context_of(tables, rows, pool):
    return settle(predictions.opponent_context(game_rows_with_codes(tables, rows), pool), "opp_def_rating")


@query("opponent_context", f"WITH RECURSIVE {MATP}, {POOL}, {CONTEXT} SELECT * FROM ctx")
def opponent_context(spark, sf):
    tables = season_tables(spark, sf)
    rows = rated(tables)
    return context_of(tables, rows, pool_of(tables, rows))


LOST = """lost AS (SELECT p.teamTricode, sum(coalesce(usg_pct_ewma, 0)) AS u, sum(coalesce(min_ewma, 0)) AS m FROM lpool p JOIN outs o ON o.teamTricode = p.teamTricode AND o.personId = p.personId GROUP BY ALL),
red AS (SELECT c.* REPLACE (CASE WHEN l.u IS NULL THEN c.usg_pct_ewma ELSE least(0.45, c.usg_pct_ewma + l.u / count(*) OVER (PARTITION BY c.teamTricode)) END AS usg_pct_ewma,
    CASE WHEN l.m IS NULL THEN c.min_ewma ELSE least(44.0, c.min_ewma + l.m / count(*) OVER (PARTITION BY c.teamTricode)) END AS min_ewma)
  FROM chosen c LEFT JOIN lost l ON l.teamTricode = c.teamTricode WHERE NOT EXISTS (SELECT 1 FROM outs o WHERE o.teamTricode = c.teamTricode AND o.personId = c.personId))"""


@query("injury_redistribution", f"WITH RECURSIVE {MATP}, {POOL}, {CHOSEN}, {LOST} SELECT teamTricode, personId, round(usg_pct_ewma + 3.21e-8::DOUBLE, 6) AS usg_pct_ewma, round(min_ewma + 3.21e-8::DOUBLE, 6) AS min_ewma FROM red")
def injury_redistribution(spark, sf):
    tables = season_tables(spark, sf)
    pool = pool_of(tables)
    df = predictions.redistributed(pool, predictions.selected_players(pool), outs_of(tables, pool))
    return settle(df.select("teamTricode", "personId", "usg_pct_ewma", "min_ewma"), "usg_pct_ewma", "min_ewma")


def fixtures_of(tables):
    """Each team meets the next one of its league; even teams are at home."""
    teams = tables[1].select(F.explode(F.array("home_team_id", "away_team_id")).alias("t")).distinct()
    return teams.select(F.expr("concat('T', t)").alias("teamTricode"), F.expr("concat('T', t div 5 * 5 + (t % 5 + 1) % 5)").alias("opp_tri"), F.expr("t % 2 = 0").alias("is_home"))


FIX = """fix AS (SELECT DISTINCT 'T' || t AS teamTricode, 'T' || ((t // 5) * 5 + (t % 5 + 1) % 5) AS opp_tri, t % 2 = 0 AS is_home FROM (SELECT home_team_id AS t FROM sched UNION SELECT away_team_id FROM sched))"""
T7 = predictions.TARGETS
BASE = lambda t: f"(0.70::DOUBLE * coalesce({t}_ewma, 0) + 0.30::DOUBLE * coalesce({t}_season_avg, 0))" + ("" if t == "min" else " * CASE WHEN is_home THEN 1.02::DOUBLE WHEN NOT is_home THEN 0.98::DOUBLE ELSE 1.0 END")
PRED = f"""p0 AS (SELECT r.*, f.opp_tri, f.is_home, c.opp_def_rating, CASE WHEN f.opp_tri IS NOT NULL THEN least(1.08::DOUBLE, greatest(0.92::DOUBLE, 1.0::DOUBLE + (coalesce(c.opp_def_rating, 113.5) - 113.5::DOUBLE) / 10.0::DOUBLE * 0.20::DOUBLE)) END AS factor
  FROM red r LEFT JOIN fix f ON f.teamTricode = r.teamTricode LEFT JOIN ctx c ON c.opp_tri = f.opp_tri),
p1 AS (SELECT *, {', '.join(f'round_even(greatest(0, {BASE(t)}), 1) AS b_{t}' for t in T7)} FROM p0),
p2 AS (SELECT *, {', '.join(f"CASE WHEN factor IS NULL THEN b_{t} ELSE round_even(greatest(0, b_{t} * " + ("least(1.08::DOUBLE, greatest(0.92::DOUBLE, 2.0::DOUBLE - factor))" if t == "tov" else "factor") + f"), 1) END AS pred_{t}" for t in T7[:-1])}, b_min AS pred_min FROM p1)"""


@query("stat_predictions", f"WITH RECURSIVE {MATP}, {POOL}, {CHOSEN}, {LOST}, {CONTEXT}, {FIX}, {PRED} SELECT teamTricode, personId, opp_tri, {', '.join(f'pred_{t}' for t in T7)} FROM p2")
def stat_predictions(spark, sf):
    tables = season_tables(spark, sf)
    rows = rated(tables)
    pool = pool_of(tables, rows)
    chosen = predictions.redistributed(pool, predictions.selected_players(pool), outs_of(tables, pool))
    df = predictions.stat_predictions(chosen, fixtures_of(tables), context_of(tables, rows, pool))
    return df.select("teamTricode", "personId", "opp_tri", *[f"pred_{t}" for t in T7])


SCALED = f"""s0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY teamTricode ORDER BY pred_min DESC, personId) <= 5 THEN 'starter' ELSE 'bench' END AS role FROM p2),
s1 AS (SELECT *, least(pred_min, CASE role WHEN 'starter' THEN 42.0::DOUBLE ELSE 35.0::DOUBLE END) AS old FROM s0),
s2 AS (SELECT *, sum(round(old * 10)::BIGINT) OVER (PARTITION BY teamTricode)::BIGINT / 10.0::DOUBLE AS total FROM s1),
s3 AS (SELECT *, CASE WHEN total > 0 THEN round_even(old * (240.0::DOUBLE / total), 1) ELSE old END AS newmin FROM s2),
scaled AS MATERIALIZED (SELECT teamTricode, personId, playerName, role, newmin AS pred_min, {', '.join(f'CASE WHEN old > 0 AND total > 0 THEN round_even(pred_{t} * (newmin / old), 1) ELSE pred_{t} END AS pred_{t}' for t in T7[:-1])} FROM s3)"""
PREDICTED = f"{MATP}, {POOL}, {CHOSEN}, {LOST}, {CONTEXT}, {FIX}, {PRED}, {SCALED}"


def predicted(spark, sf):
    tables = season_tables(spark, sf)
    rows = rated(tables)
    pool = pool_of(tables, rows)
    return predictions.player_predictions(pool, outs_of(tables, pool), fixtures_of(tables), context_of(tables, rows, pool))


@query("player_predictions", f"WITH RECURSIVE {PREDICTED} SELECT * FROM scaled")
def player_predictions(spark, sf):
    return predicted(spark, sf).select("teamTricode", "personId", "playerName", "role", *[f"pred_{t}" for t in T7])


WAVG = lambda c, d: f"coalesce(nullif(0.70::DOUBLE * coalesce(avg({c}_roll5) FILTER (here), 0) + 0.30::DOUBLE * coalesce(avg({c}_szn) FILTER (here), 0), 0), {d})"
PROFILE = f"""prof AS (SELECT teamTricode, round({WAVG('ortg', 113.5)} + 3.21e-8::DOUBLE, 6) AS ortg, round({WAVG('drtg', 113.5)} + 3.21e-8::DOUBLE, 6) AS drtg, round({WAVG('pace_proxy', 98.0)} + 3.21e-8::DOUBLE, 6) AS pace, round(avg(team_elo) FILTER (here) + 3.21e-8::DOUBLE, 6) AS elo,
  round(sum(CASE WHEN here THEN 0 ELSE 0.70::DOUBLE * coalesce(pts_ewma, 0) + 0.30::DOUBLE * coalesce(pts_season_avg, 0) END) + 3.21e-8::DOUBLE, 6) AS pts_lost, count(*) FILTER (here) AS n_active
  FROM (SELECT p.*, o.personId IS NULL AS here FROM lpool p LEFT JOIN outs o ON o.teamTricode = p.teamTricode AND o.personId = p.personId) GROUP BY teamTricode HAVING count(*) FILTER (here) > 0)"""


def profiles(tables):
    pool = pool_of(tables)
    return settle(predictions.team_profiles(pool, outs_of(tables, pool)), "ortg", "drtg", "pace", "elo", "pts_lost")


@query("team_profiles", f"WITH RECURSIVE {MATP}, {POOL}, {PROFILE} SELECT * FROM prof")
def team_profiles(spark, sf):
    return profiles(season_tables(spark, sf))


GAMEP = f"""g0 AS (SELECT f.teamTricode AS home_tri, f.opp_tri AS away_tri, h.ortg AS home_ortg, h.drtg AS home_drtg, h.elo AS home_elo, h.pts_lost AS home_pts_lost,
  a.ortg AS away_ortg, a.drtg AS away_drtg, a.elo AS away_elo, a.pts_lost AS away_pts_lost FROM fix f JOIN prof h ON h.teamTricode = f.teamTricode JOIN prof a ON a.teamTricode = f.opp_tri WHERE f.is_home),
g1 AS (SELECT *, round_even(0.80::DOUBLE * (113.5::DOUBLE * (home_ortg / 113.5::DOUBLE) * (away_drtg / 113.5::DOUBLE) + 2.5::DOUBLE - home_pts_lost * 0.60::DOUBLE) + 0.20::DOUBLE * 113.5::DOUBLE, 1) AS h,
  round_even(0.80::DOUBLE * (113.5::DOUBLE * (away_ortg / 113.5::DOUBLE) * (home_drtg / 113.5::DOUBLE) - 2.5::DOUBLE - away_pts_lost * 0.60::DOUBLE) + 0.20::DOUBLE * 113.5::DOUBLE, 1) AS a FROM g0),
g2 AS (SELECT *, least(0.95::DOUBLE, greatest(0.05::DOUBLE, round_even(0.75::DOUBLE * (1 / (1 + exp(-(0.11::DOUBLE * (h - a) + 0.0015::DOUBLE * (home_elo - away_elo))))) + 0.25::DOUBLE * 0.5::DOUBLE, 4))) AS wp FROM g1)"""


@query("game_predictions", f"""WITH RECURSIVE {MATP}, {POOL}, {PROFILE}, {FIX}, {GAMEP} SELECT home_tri, away_tri, wp AS win_prob_home, round_even(1 - wp, 4) AS win_prob_away,
  CASE WHEN (wp > 0.5) <> (h > a) THEN a ELSE h END AS home_score, CASE WHEN (wp > 0.5) <> (h > a) THEN h ELSE a END AS away_score, round_even(home_ortg, 1) AS home_ortg, round_even(away_ortg, 1) AS away_ortg,
  round_even(home_drtg, 1) AS home_drtg, round_even(away_drtg, 1) AS away_drtg, round_even(home_pts_lost, 1) AS home_pts_lost, round_even(away_pts_lost, 1) AS away_pts_lost FROM g2""")
def game_predictions(spark, sf):
    tables = season_tables(spark, sf)
    fixtures = fixtures_of(tables).where("is_home").select(F.col("teamTricode").alias("home_tri"), F.col("opp_tri").alias("away_tri"))
    return predictions.game_predictions(fixtures, written(profiles(tables), "profiles"))


LBOX = """lbx AS (SELECT 'Player ' || (user_id + s.s) AS name, max((k + 0) % 20) AS pts, max((k + 1) % 20) AS reb, max((k + 2) % 20) AS ast, max((k + 3) % 20) AS stl, max((k + 4) % 20) AS blk,
  max((k + 5) % 20) AS tov, max(CASE WHEN k % 6 <> 0 THEN k % 48 ELSE 0 END) AS min FROM ev, (SELECT unnest([0, 1]) AS s) s GROUP BY 1),
cmp AS (SELECT l.*, p.personId IS NOT NULL AS matched, p.teamTricode, {0} FROM lbx l LEFT JOIN scaled p ON p.playerName = l.name)""".replace("{0}", ", ".join(f"coalesce(p.pred_{t}, 0) AS pred_{t}" for t in T7))


def compared(spark, sf):
    actual = feeds.live_box(live_box_payloads(spark, sf)).groupBy("name").agg(*[F.max(t).alias(t) for t in T7])
    actual = actual.withColumn("name", F.upper("name"))
    return predictions.box_comparison(actual, written(predicted(spark, sf), "predicted"))


@query("box_comparison", f"WITH RECURSIVE {PREDICTED}, {LBOX} SELECT upper(name) AS name, matched, {', '.join(T7)}, {', '.join(f'pred_{t}' for t in T7)}, {', '.join(f'round_even({t} - pred_{t}, 1) AS diff_{t}' for t in T7)} FROM cmp")
def box_comparison(spark, sf):
    return compared(spark, sf).select("name", "matched", *T7, *[f"pred_{t}" for t in T7], *[f"diff_{t}" for t in T7])


@query("points_error", f"WITH RECURSIVE {PREDICTED}, {LBOX} SELECT teamTricode, round(avg(abs(pts - pred_pts)), 4) AS pts_mae FROM cmp WHERE matched GROUP BY teamTricode")
def points_error(spark, sf):
    actual = feeds.live_box(live_box_payloads(spark, sf)).groupBy("name").agg(*[F.max(t).alias(t) for t in T7])
    lines = written(predicted(spark, sf), "predicted")
    sides = lines.select("teamTricode", F.col("playerName").alias("name"))
    rows = predictions.box_comparison(actual.join(sides, "name"), lines, ["teamTricode"])
    return r6(rows.where("matched").groupBy("teamTricode").agg(F.avg(F.abs(F.col("pts") - F.col("pred_pts"))).alias("pts_mae")), "pts_mae", digits=4)


@query("workload_report", f"""WITH RECURSIVE {MATRIX}, {LOADS}, a AS (SELECT w.*, round(m.min_ewma + 3.21e-8::DOUBLE, 6) AS min_ewma FROM wl w JOIN matrix m ON m.gameId = w.gameId AND m.personId = w.personId
    WHERE w.season = {NOW} AND coalesce(m.min_ewma, 0) > 5),
  l AS (SELECT personId, {', '.join(f'arg_max({c}, (game_date, gameId)) FILTER ({c} IS NOT NULL) AS {c}' for c in ['playerName', 'teamTricode', 'min_ewma', 'min_load_7d', 'min_vs_season_avg', 'btb_5g_count', 'workload_index', 'high_workload_flag', 'games_on_current_team'])} FROM a GROUP BY personId)
  SELECT * FROM l ORDER BY workload_index DESC, personId LIMIT 25""")
def workload_report(spark, sf):
    rows = features.player_ewma(features.workload(with_minutes(spark, sf)), ["min"])
    return reports.workload_report(settle(rows, "min_ewma"), NOW)


@query("injury_risk", f"""WITH RECURSIVE {MATP}, {REPORT},
l AS (SELECT personId, {', '.join(f'arg_max({c}, (game_date, gameId)) FILTER ({c} IS NOT NULL) AS {c}' for c in ['min_season_avg', 'min_ewma', 'min_roll5', 'usg_pct_season_avg', 'usg_pct_ewma', 'rest_days', 'is_back_to_back', 'playerName', 'teamTricode', 'game_date'])} FROM matp WHERE season = {NOW} GROUP BY personId),
r AS (SELECT l.*, coalesce(i.status_rank, 0) AS rk, coalesce(i.status, '') AS st, CASE WHEN i.u IS NULL THEN '' ELSE 'Knee' END AS dt, coalesce(nullif(rest_days, 0), 3) AS rest,
  coalesce(min_ewma, 0) / greatest(min_season_avg, 5.0) AS lr, coalesce(usg_pct_ewma, 0) / greatest(coalesce(nullif(usg_pct_season_avg, 0), 0.01), 0.01) AS ur
  FROM l LEFT JOIN inj i ON lower(l.playerName) = 'player ' || i.u WHERE game_date >= DATE '2024-01-25' AND min_season_avg >= 10),
f AS (SELECT *, greatest(0, (lr - 0.85::DOUBLE) / 0.35::DOUBLE) AS lf, greatest(0, 1 - rest / 4.0::DOUBLE) AS rf, greatest(0, (ur - 0.90::DOUBLE) / 0.35::DOUBLE) AS uf, is_back_to_back = 1 AS b2b, least(1.0, rk / 5.0::DOUBLE) AS jf FROM r),
p AS (SELECT *, round_even(least(100.0, round_even((0.30::DOUBLE * least(1, lf) + 0.25::DOUBLE * rf + 0.15::DOUBLE * least(1, uf) + 0.10::DOUBLE * CASE WHEN b2b THEN 0.25::DOUBLE ELSE 0 END + 0.20::DOUBLE * jf) * 100, 9)), 0)::INTEGER AS risk_pct FROM f)
SELECT personId, playerName AS player_name, teamTricode AS team_tri, risk_pct, CASE WHEN risk_pct >= 55 THEN 'High' WHEN risk_pct >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level,
  round_even(min_season_avg, 1) AS min_avg, round_even(coalesce(min_roll5, 0), 1) AS min_recent, rest::INTEGER AS rest_days, b2b AS is_b2b, st AS inj_status, dt AS inj_detail,
  array_to_string(list_filter([CASE WHEN lf > 0.3 THEN 'High load (' || round_even(lr * 100, 0)::INT || '% of avg)' END, CASE WHEN rf > 0.5 THEN 'Low rest (' || rest::INT || 'd)' END,
    CASE WHEN uf > 0.3 THEN 'Usage spike (' || round_even(ur * 100, 0)::INT || '%)' END, CASE WHEN b2b THEN 'Back-to-back' END, CASE WHEN jf > 0 THEN st END], lambda x: x IS NOT NULL), '; ') AS drivers
FROM p ORDER BY risk_pct DESC, personId LIMIT 50""")
def injury_risk(spark, sf):
    tables = season_tables(spark, sf)
    df = reports.injury_risk(settle(matrix(spark, sf, tables), *USED), report(tables), NOW, "2024-02-04")
    return df.withColumn("drivers", F.concat_ws("; ", "drivers"))


@query("injury_impact", f"""WITH RECURSIVE {MATP}, {REPORT}, l AS (SELECT teamTricode, personId, any_value(playerName) AS nm, arg_max(min_ewma, (game_date, gameId)) AS m FROM matp WHERE coalesce(min_ewma, 0) > 20 GROUP BY ALL)
  SELECT teamTricode, round_even(coalesce(sum(m) FILTER (i.u IS NOT NULL), 0) / greatest(sum(m), 1.0), 3) AS impact FROM l LEFT JOIN inj i ON lower(l.nm) = 'player ' || i.u AND i.team_tri = l.teamTricode AND i.status_rank >= 2 GROUP BY teamTricode""")
def injury_impact(spark, sf):
    tables = season_tables(spark, sf)
    return reports.injury_impact(settle(matrix(spark, sf, tables), *USED), report(tables))


@query("unplayed_games", f"""WITH {BOX}, {SCHED} SELECT s.* FROM sched s WHERE game_date > DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM box b WHERE b.gameId = s.gameId AND b.pts >= 9)""")
def unplayed_games(spark, sf):
    return reports.unplayed_games(schedule(spark, sf), box(spark, sf).where("pts >= 9"), "2024-01-20")


@query("playoff_odds", """WITH w AS (SELECT o_custkey % 50 AS replicate, (o_orderkey % 30) % 2 AS conference, o_orderkey % 30 AS teamId, count(*) FILTER (o_orderstatus = 'F') AS wins FROM orders GROUP BY ALL),
  s AS (SELECT *, row_number() OVER (PARTITION BY replicate, conference ORDER BY wins DESC, teamId) AS seed FROM w)
  SELECT conference, teamId, round(avg(wins), 6) AS expected_wins, round(avg((seed <= 6)::INT), 6) AS p_direct_playoff, round(avg((seed > 6 AND seed <= 10)::INT), 6) AS p_playin,
    round(avg((seed > 10)::INT), 6) AS p_miss_playoffs FROM s GROUP BY conference, teamId""")
def playoff_odds(spark, sf):
    wins = table(spark, sf, "orders").groupBy(
        F.expr("o_custkey % 50").alias("replicate"), F.expr("(o_orderkey % 30) % 2").alias("conference"), F.expr("o_orderkey % 30").alias("teamId")
    ).agg(F.count_if(F.col("o_orderstatus") == "F").alias("wins"))
    return r6(reports.playoff_odds(wins), "expected_wins", "p_direct_playoff", "p_playin", "p_miss_playoffs")


def strength_sql(name, source):
    renamed = best_sql(source, ["teamTricode"])
    for cte in ("pl", "combos", "best"):
        renamed = renamed.replace(f"{cte} AS ", f"{name}_{cte} AS ").replace(f"FROM {cte} ", f"FROM {name}_{cte} ").replace(f"FROM {cte})", f"FROM {name}_{cte})").replace(f"JOIN {cte} ", f"JOIN {name}_{cte} ").replace(f"FROM {cte})", f"FROM {name}_{cte})")
    return f"""{renamed},
{name} AS (SELECT b.teamTricode, b.total / 1000.0::DOUBLE AS score, n.net AS net_rating, 1 / (1 + exp(-0.11::DOUBLE * n.net)) AS win_pct FROM {name}_best b JOIN (
  SELECT teamTricode, {WAVG('ortg', 113.5)} - {WAVG('drtg', 113.5)} AS net FROM (SELECT *, true AS here FROM {source}) GROUP BY teamTricode) n USING (teamTricode))"""


TRADE = f"""tpool AS MATERIALIZED (SELECT p.* EXCLUDE (pos), pos AS position, {SCORE} AS score FROM (SELECT l.*, {INFER} AS pos FROM lpool l LEFT JOIN posn USING (personId)) p),
tmove AS (SELECT personId, 'T' || ((personId // 50) * 5 + ((personId // 10) % 5 + 1) % 5) AS to_team FROM tpool WHERE personId % 10 = 4),
tafter AS MATERIALIZED (SELECT p.* REPLACE (coalesce(m.to_team, p.teamTricode) AS teamTricode) FROM tpool p LEFT JOIN tmove m USING (personId))"""
DELTAS = ["net_rating", "win_pct"]


@query("trade_impact", f"""WITH RECURSIVE {MATP}, {POSITIONS}, {POOL}, {TRADE}, {strength_sql('pre', 'tpool')}, {strength_sql('post', 'tafter')},
  t AS (SELECT teamTricode FROM tpool JOIN tmove USING (personId) UNION SELECT to_team FROM tmove)
  SELECT t.teamTricode, a.score AS pre_score, b.score AS post_score, round(b.score - a.score, 6) AS score_delta, {', '.join(f'round(a.{c} + 3.21e-8::DOUBLE, 6) AS pre_{c}, round(b.{c} + 3.21e-8::DOUBLE, 6) AS post_{c}, round(b.{c} - a.{c} + 3.21e-8::DOUBLE, 6) AS {c}_delta' for c in DELTAS)}
  FROM t JOIN pre a ON a.teamTricode = t.teamTricode JOIN post b ON b.teamTricode = t.teamTricode""")
def trade_impact(spark, sf):
    pool = written(selection.scored_pool(pool_of(season_tables(spark, sf)), latest_positions(positions(spark, sf))), "scored")
    moves = pool.where("personId % 10 = 4").select("personId", F.expr("concat('T', personId div 50 * 5 + ((personId div 10) % 5 + 1) % 5)").alias("to_team"))
    changed = reports.trade_impact(pool, moves)
    return r6(settle(changed, *[f"{p}{c}{s}" for c in DELTAS for p, s in (("pre_", ""), ("post_", ""), ("", "_delta"))]), "score_delta")
