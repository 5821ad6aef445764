"""Player, team and pair series: the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopspark.functions.windows import latest_values
from hoopspark.operators import elo, features
from hoopspark.operators.columns import player_model_columns
from hoopspark.operators.features import EFFICIENCY, ROLL_STATS, STINT_STATS
from hoopspark.plans import season
from hoopspark.registry.bind import BOX, SCHED, box, r6, schedule, season_tables, settle, settled
from hoopspark.registry.core import query

P = "PARTITION BY personId ORDER BY game_date, gameId"
FEAT = f"""{BOX}, {SCHED},
f0 AS (
  SELECT b.*, CAST(b.teamId = s.home_team_id AS INTEGER) AS is_home,
         CASE WHEN b.teamId = s.home_team_id THEN s.away_team_id ELSE s.home_team_id END AS opp_team_id
  FROM box b LEFT JOIN sched s USING (gameId)),
f1 AS (
  SELECT *, coalesce(date_diff('day', lag(game_date) OVER ({P}), game_date), 7) AS rest_days,
         CASE WHEN teamId <> lag(teamId) OVER ({P}) THEN 1 ELSE 0 END AS moved FROM f0),
f2 AS (SELECT * EXCLUDE (moved), CAST(rest_days = 1 AS INTEGER) AS is_back_to_back,
              CAST(sum(moved) OVER ({P}) AS INTEGER) AS team_stint_id FROM f1),
f3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY personId, team_stint_id ORDER BY game_date, gameId) AS games_on_current_team FROM f2)"""


def rolled_sql(stats, widths, partition="personId", suffix="_roll"):
    return ", ".join(
        f"avg({c}) OVER (PARTITION BY {partition} ORDER BY game_date, gameId ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {c}{suffix}{w}"
        for c in stats for w in widths)


def expanding_sql(stats, partition, suffix):
    return ", ".join(
        f"avg({c}) OVER (PARTITION BY {partition} ORDER BY game_date, gameId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}{suffix}"
        for c in stats)


def ewma_sql(name, source, keys, stats, suffix):
    """Recursive fold, one step per row of a series; the row reads the state after the row before it."""
    k = ", ".join(keys)
    on = " AND ".join(f"n.{c} = e.{c}" for c in keys)
    y = ", ".join(f"CASE WHEN n.{c} IS NULL THEN e.y_{c} WHEN e.y_{c} IS NULL THEN n.{c}::DOUBLE "
                  f"ELSE (e.w_{c} * 0.7::DOUBLE * e.y_{c} + 0.3::DOUBLE * n.{c}) / (e.w_{c} * 0.7::DOUBLE + 0.3::DOUBLE) END AS y_{c}, "
                  f"CASE WHEN n.{c} IS NULL AND e.y_{c} IS NOT NULL THEN e.w_{c} * 0.7::DOUBLE ELSE 1.0::DOUBLE END AS w_{c}" for c in stats)
    return f"""{name}_pos AS MATERIALIZED (SELECT {k}, personId AS pid, gameId AS gid, row_number() OVER (PARTITION BY {k} ORDER BY game_date, gameId) AS pos,
  {', '.join(stats)} FROM {source}),
{name}_fold AS (
  SELECT {k}, pos, {', '.join(f'{c}::DOUBLE AS y_{c}, 1.0::DOUBLE AS w_{c}' for c in stats)} FROM {name}_pos WHERE pos = 1
  UNION ALL
  SELECT {', '.join(f'n.{c}' for c in keys)}, n.pos, {y} FROM {name}_fold e JOIN {name}_pos n ON {on} AND n.pos = e.pos + 1),
{name} AS MATERIALIZED (
  SELECT n.pid AS personId, n.gid AS gameId, {', '.join(f'e.y_{c} AS {c}{suffix}' for c in stats)}
  FROM {name}_pos n LEFT JOIN {name}_fold e ON {on} AND e.pos = n.pos - 1)"""


def rounded(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def base(spark, sf):
    df = features.attach_schedule(box(spark, sf), schedule(spark, sf))
    return features.team_runs(features.rest(df))


@query("attach_schedule", f"WITH {FEAT} SELECT gameId, personId, game_date, is_home, opp_team_id FROM f3")
def attach_schedule(spark, sf):
    df = features.attach_schedule(box(spark, sf), schedule(spark, sf))
    return df.select("gameId", "personId", "game_date", "is_home", "opp_team_id")


@query("rest_days", f"WITH {FEAT} SELECT gameId, personId, rest_days, is_back_to_back FROM f3")
def rest_days(spark, sf):
    return features.rest(box(spark, sf)).select("gameId", "personId", "rest_days", "is_back_to_back")


@query("team_runs", f"WITH {FEAT} SELECT gameId, personId, teamId, team_stint_id, games_on_current_team FROM f3")
def team_runs(spark, sf):
    return features.team_runs(box(spark, sf)).select(
        "gameId", "personId", "teamId", "team_stint_id", "games_on_current_team")


ROLLED = [f"{c}_roll{w}" for c in ROLL_STATS for w in (3, 5, 10)]


@query("trailing_means", f"""WITH {FEAT}, r AS (SELECT gameId, personId, {rolled_sql(ROLL_STATS, (3, 5, 10))} FROM f3)
  SELECT gameId, personId, {rounded(ROLLED)} FROM r""")
def trailing_means(spark, sf):
    return r6(features.player_trailing(box(spark, sf)).select("gameId", "personId", *ROLLED), *ROLLED)


EWMA = [f"{c}_ewma" for c in ROLL_STATS]


@query("ewma_means", f"""WITH RECURSIVE {FEAT}, {ewma_sql('ew', 'f3', ['personId'], ROLL_STATS, '_ewma')}
  SELECT gameId, personId, {settled(EWMA)} FROM ew""")
def ewma_means(spark, sf):
    return settle(features.player_ewma(box(spark, sf)).select("gameId", "personId", *EWMA), *EWMA)


STINT_EWMA = [f"{c}_stint_ewma" for c in STINT_STATS]


@query("stint_ewma_means", f"""WITH RECURSIVE {FEAT}, {ewma_sql('sw', 'f3', ['personId', 'team_stint_id'], STINT_STATS, '_stint_ewma')}
  SELECT gameId, personId, {settled(STINT_EWMA)} FROM sw""")
def stint_ewma_means(spark, sf):
    df = features.stint_ewma(features.team_runs(box(spark, sf)))
    return settle(df.select("gameId", "personId", *STINT_EWMA), *STINT_EWMA)


SEASON = [f"{c}_season_avg" for c in ROLL_STATS]


@query("season_to_date_means", f"""WITH {FEAT}, r AS (SELECT gameId, personId, {expanding_sql(ROLL_STATS, 'personId, season', '_season_avg')} FROM f3)
  SELECT gameId, personId, {rounded(SEASON)} FROM r""")
def season_to_date_means(spark, sf):
    return r6(features.season_to_date(box(spark, sf)).select("gameId", "personId", *SEASON), *SEASON)


POINTS = """tp AS MATERIALIZED (SELECT gameId, teamId, sum(pts)::BIGINT AS team_pts FROM box GROUP BY gameId, teamId),
gp AS MATERIALIZED (
  SELECT s.*, h.team_pts AS home_pts, a.team_pts AS away_pts FROM sched s
  LEFT JOIN tp h ON h.gameId = s.gameId AND h.teamId = s.home_team_id
  LEFT JOIN tp a ON a.gameId = s.gameId AND a.teamId = s.away_team_id)"""
DEFENCE = """dfn AS (
  SELECT gameId, teamId, round_even(avg(allowed) OVER (PARTITION BY teamId, season ORDER BY game_date, gameId
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS opp_def_rating
  FROM (SELECT gameId, game_date, season, home_team_id AS teamId, away_pts AS allowed FROM gp
        UNION ALL SELECT gameId, game_date, season, away_team_id, home_pts FROM gp))"""


@query("opponent_points_allowed", f"""WITH {FEAT}, {POINTS}, {DEFENCE}
  SELECT f.gameId, f.personId, f.opp_team_id, d.opp_def_rating FROM f3 f LEFT JOIN dfn d ON d.gameId = f.gameId AND d.teamId = f.opp_team_id""")
def opponent_points_allowed(spark, sf):
    rows, games = box(spark, sf), schedule(spark, sf)
    df = features.opponent_defence(features.attach_schedule(rows, games), rows, games)
    return df.select("gameId", "personId", "opp_team_id", "opp_def_rating")


EFF = """tg AS (SELECT gameId, teamId, season, sum(pts)::BIGINT AS pts, sum(fga)::BIGINT AS fga, sum(fg3m)::BIGINT AS fg3m, sum(fgm)::BIGINT AS fgm,
  sum(fta)::BIGINT AS fta, sum(tov)::BIGINT AS tov, sum(oreb)::BIGINT AS oreb FROM box GROUP BY gameId, teamId, season),
tg2 AS (
  SELECT a.*, a.fga + 0.44::DOUBLE * a.fta - a.oreb + a.tov AS pace_proxy, b.pts AS opp_pts, b.fga AS opp_fga, b.fgm AS opp_fgm, b.fg3m AS opp_fg3m
  FROM tg a JOIN tg b ON a.gameId = b.gameId AND a.teamId <> b.teamId),
te AS MATERIALIZED (
  SELECT *, ortg - drtg AS net_rtg FROM (
  SELECT *, coalesce(100.0::DOUBLE * pts / nullif(pace_proxy, 0), 110.0) AS ortg, coalesce(100.0::DOUBLE * opp_pts / nullif(pace_proxy, 0), 110.0) AS drtg,
         coalesce((fgm + 0.5::DOUBLE * fg3m) / nullif(fga, 0), 0.0) AS team_efg,
         coalesce((opp_fgm + 0.5::DOUBLE * opp_fg3m) / nullif(opp_fga, 0), 0.0) AS opp_efg FROM tg2))"""


@query("team_efficiency", f"""WITH {FEAT}, {EFF}
  SELECT gameId, teamId, season, {rounded(EFFICIENCY)} FROM te""")
def team_efficiency(spark, sf):
    return r6(features.team_efficiency(box(spark, sf)).select("gameId", "teamId", "season", *EFFICIENCY), *EFFICIENCY)


EFF_COLS = [f"{c}{s}" for c in EFFICIENCY for s in ("_roll5", "_roll10", "_szn")]
EFF_ROLL = f"""er AS MATERIALIZED (
  SELECT t.gameId, t.teamId, t.season, s.game_date, {rolled_sql(['t.' + c for c in EFFICIENCY], (5, 10), 't.teamId, t.season')},
         {expanding_sql(['t.' + c for c in EFFICIENCY], 't.teamId, t.season', '_szn')}
  FROM te t LEFT JOIN (SELECT gameId AS gid, game_date FROM sched) s ON s.gid = t.gameId)""".replace("AS t.", "AS ")


@query("efficiency_so_far", f"""WITH {FEAT}, {EFF}, {EFF_ROLL}
  SELECT gameId, teamId, season, game_date, {rounded(EFF_COLS)} FROM er""")
def efficiency_so_far(spark, sf):
    return r6(features.efficiency_so_far(box(spark, sf), schedule(spark, sf)), *EFF_COLS)


def h2h_sql(name, n):
    return f"""{name} AS (
  SELECT gameId, coalesce(CASE WHEN flip THEN 1 - sh ELSE sh END, 0.5) AS h2h_win_pct_home,
         coalesce(CASE WHEN flip THEN -mn ELSE mn END, 0.0) AS h2h_pts_diff_avg, n::INTEGER AS h2h_games
  FROM (SELECT gameId, flip, avg(won) OVER w AS sh, avg(margin) OVER w AS mn, count(*) OVER w AS n
        FROM (SELECT *, home_team_id > away_team_id AS flip, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi,
                     CASE WHEN (home_team_id > away_team_id) THEN 1 - (home_pts > away_pts)::INT ELSE (home_pts > away_pts)::INT END AS won,
                     CASE WHEN (home_team_id > away_team_id) THEN away_pts - home_pts ELSE home_pts - away_pts END AS margin
              FROM gp WHERE home_pts IS NOT NULL AND away_pts IS NOT NULL)
        WINDOW w AS (PARTITION BY lo, hi ORDER BY game_date, gameId ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)))"""


H2H = ["h2h_win_pct_home", "h2h_pts_diff_avg"]


@query("head_to_head", f"WITH {FEAT}, {POINTS}, {h2h_sql('hh', 10)} SELECT gameId, h2h_games, {rounded(H2H)} FROM hh")
def head_to_head(spark, sf):
    return r6(features.head_to_head(box(spark, sf), schedule(spark, sf)), *H2H)


@query("head_to_head_last3", f"WITH {FEAT}, {POINTS}, {h2h_sql('hh', 3)} SELECT gameId, h2h_games, {rounded(H2H)} FROM hh")
def head_to_head_last3(spark, sf):
    return r6(features.head_to_head(box(spark, sf), schedule(spark, sf), last=3), *H2H)


# ratings advance one day at a time: a team plays at most once a day
ELO = """eg AS MATERIALIZED (SELECT *, date_diff('day', DATE '2024-01-01', game_date) + 1 AS dn FROM gp),
est AS (
  SELECT 0::BIGINT AS dn, team, 1500.0::DOUBLE AS elo
  FROM (SELECT home_team_id AS team FROM eg UNION SELECT away_team_id FROM eg)
  UNION ALL
  SELECT s.dn + 1, s.team,
         s.elo + CASE WHEN g.gameId IS NULL OR g.home_pts IS NULL OR g.away_pts IS NULL THEN 0
           WHEN s.team = g.home_team_id
           THEN 20 * ((CASE WHEN g.home_pts > g.away_pts THEN 1 WHEN g.home_pts = g.away_pts THEN 0.5 ELSE 0 END)::DOUBLE - 1 / (1 + pow(10.0::DOUBLE, (o.elo - s.elo) / 400)))
           ELSE -20 * ((CASE WHEN g.home_pts > g.away_pts THEN 1 WHEN g.home_pts = g.away_pts THEN 0.5 ELSE 0 END)::DOUBLE - 1 / (1 + pow(10.0::DOUBLE, (s.elo - o.elo) / 400))) END
  FROM est s LEFT JOIN eg g ON g.dn = s.dn + 1 AND (g.home_team_id = s.team OR g.away_team_id = s.team)
  LEFT JOIN est o ON o.dn = s.dn AND o.team = CASE WHEN s.team = g.home_team_id THEN g.away_team_id ELSE g.home_team_id END
  WHERE s.dn < (SELECT max(dn) FROM eg)),
elo AS MATERIALIZED (
  SELECT g.gameId, g.league, g.home_team_id, h.elo AS home_elo, a.elo AS away_elo FROM eg g
  JOIN est h ON h.dn = g.dn - 1 AND h.team = g.home_team_id JOIN est a ON a.dn = g.dn - 1 AND a.team = g.away_team_id)"""


def games_with_league(spark, sf, tables=None):
    rows, games = tables or (box(spark, sf), schedule(spark, sf))
    return features.game_points(rows, games).join(games.select("gameId", "league"), "gameId")


@query("elo_ratings", f"""WITH RECURSIVE {FEAT}, {POINTS}, {ELO}
  SELECT league, gameId, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo FROM elo""")
def elo_ratings(spark, sf):
    return r6(elo.elo_ratings(games_with_league(spark, sf), "league"), "home_elo", "away_elo")


ELO_COLS = ["home_elo", "away_elo", "team_elo", "opp_elo", "elo_diff"]
ELO_JOIN = """ej AS (
  SELECT f.gameId, f.personId, e.home_elo, e.away_elo, CASE WHEN f.teamId = e.home_team_id THEN home_elo ELSE away_elo END AS team_elo,
         CASE WHEN f.teamId = e.home_team_id THEN away_elo ELSE home_elo END AS opp_elo FROM f3 f LEFT JOIN elo e USING (gameId)),
ej2 AS (SELECT *, team_elo - opp_elo AS elo_diff FROM ej)"""


@query("elo_attached", f"""WITH RECURSIVE {FEAT}, {POINTS}, {ELO}, {ELO_JOIN}
  SELECT gameId, personId, {rounded(ELO_COLS)} FROM ej2""")
def elo_attached(spark, sf):
    ratings = elo.elo_ratings(games_with_league(spark, sf), "league")
    df = elo.attach_elo(box(spark, sf), ratings, schedule(spark, sf))
    return r6(df.select("gameId", "personId", *ELO_COLS), *ELO_COLS)


LOADS = f"""wl0 AS (
  SELECT *, avg(min) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS min_roll5,
         avg(min) OVER (PARTITION BY personId, season ORDER BY game_date, gameId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS min_season_avg,
         round_even(sum(min) OVER ({P} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 1) AS min_load_7d,
         coalesce(sum(is_back_to_back) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::INTEGER AS btb_5g_count
  FROM f3),
wl1 AS (SELECT *, round_even(coalesce(min_roll5, 0) - coalesce(min_season_avg, 0), 2) AS min_vs_season_avg FROM wl0),
wl2 AS (
  SELECT *, round_even(greatest(-1, least(1, min_vs_season_avg / 10)) * 0.3::DOUBLE + btb_5g_count / 5.0::DOUBLE * 0.3::DOUBLE
         + greatest(0, least(1, coalesce(min_load_7d, 0) / 240)) * 0.4::DOUBLE, 3) AS workload_index FROM wl1),
wl AS MATERIALIZED (SELECT *, CAST(workload_index > 0.6 OR games_on_current_team < 10 AS INTEGER) AS high_workload_flag FROM wl2)"""
LOAD_COLS = ["min_load_7d", "min_vs_season_avg", "btb_5g_count", "workload_index", "high_workload_flag"]


def with_minutes(spark, sf):
    return features.season_to_date(features.player_trailing(base(spark, sf), ["min"], [5]), ["min"])


@query("workload_features", f"WITH {FEAT}, {LOADS} SELECT gameId, personId, {', '.join(LOAD_COLS)} FROM wl")
def workload_features(spark, sf):
    return features.workload(with_minutes(spark, sf)).select("gameId", "personId", *LOAD_COLS)


@query("load_signals", f"""WITH {FEAT}, {LOADS},
  z AS (SELECT *, (lag(min) OVER ({P}) - avg(min) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        / nullif(stddev_samp(min) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS fatigue_z,
        coalesce(min_roll5 > 1.25::DOUBLE * min_season_avg, false) AS min_spike FROM wl)
  SELECT gameId, personId, btb_5g_count AS btb_count_5, min_spike, round(fatigue_z, 6) AS fatigue_z,
         min_spike OR btb_5g_count >= 2 AS high_load_flag,
         round_even(min_spike::INT * 0.4::DOUBLE + least(1, btb_5g_count / 5.0::DOUBLE) * 0.3::DOUBLE
           + greatest(0, least(1, coalesce(fatigue_z, 0) / 3)) * 0.3::DOUBLE, 3) AS risk_score FROM z""")
def load_signals(spark, sf):
    df = features.load_signals(with_minutes(spark, sf))
    return r6(df.select("gameId", "personId", "btb_count_5", "min_spike", "fatigue_z", "high_load_flag", "risk_score"), "fatigue_z")


LATEST = ["teamId", "season", "pts", "min", "ts_pct", "fg3_pct", "usg_pct", "pts_per36"]


@query("latest_player_rows", f"""WITH {FEAT} SELECT personId,
  {', '.join(f'arg_max({c}, gameId) FILTER ({c} IS NOT NULL) AS {c}' for c in LATEST)} FROM f3 GROUP BY personId""".replace("arg_max(", "arg_max(").replace(", gameId) FILTER", ", (game_date, gameId)) FILTER"))
def latest_player_rows(spark, sf):
    return latest_values(box(spark, sf), ["personId"], ["game_date", "gameId"], LATEST)


MATRIX_ROUND = ROLLED + EWMA + STINT_EWMA + SEASON + EFF_COLS + H2H
MATRIX = f"""{FEAT}, {POINTS}, {DEFENCE}, {EFF}, {EFF_ROLL}, {h2h_sql('hh', 10)},
{ewma_sql('ew', 'f3', ['personId'], ROLL_STATS, '_ewma')},
{ewma_sql('sw', 'f3', ['personId', 'team_stint_id'], STINT_STATS, '_stint_ewma')},
wide AS MATERIALIZED (
  SELECT f.*, {rolled_sql(ROLL_STATS, (3, 5, 10))}, {expanding_sql(ROLL_STATS, 'personId, season', '_season_avg')} FROM f3 f),
matrix AS MATERIALIZED (
  SELECT w.*, d.opp_def_rating, ew.* EXCLUDE (personId, gameId), sw.* EXCLUDE (personId, gameId),
         er.* EXCLUDE (gameId, teamId, season, game_date), coalesce(hh.h2h_win_pct_home, 0.5) AS h2h_win_pct_home,
         coalesce(hh.h2h_pts_diff_avg, 0.0) AS h2h_pts_diff_avg, coalesce(hh.h2h_games, 0) AS h2h_games
  FROM wide w LEFT JOIN dfn d ON d.gameId = w.gameId AND d.teamId = w.opp_team_id
  LEFT JOIN ew ON ew.personId = w.personId AND ew.gameId = w.gameId
  LEFT JOIN sw ON sw.personId = w.personId AND sw.gameId = w.gameId
  LEFT JOIN er ON er.gameId = w.gameId AND er.teamId = w.teamId
  LEFT JOIN hh ON hh.gameId = w.gameId)"""
MATRIX_IDS = ["gameId", "season", "game_date", "personId", "playerName", "teamId", "teamTricode", "opp_team_id", "is_home",
              "rest_days", "is_back_to_back", "opp_def_rating", "games_on_current_team", "team_stint_id", "h2h_games"]


def matrix(spark, sf, tables=None):
    return season.player_features(*(tables or season_tables(spark, sf)))


def rated_matrix(tables, stint_stats=STINT_STATS):
    """Feature matrix with the ratings of both teams."""
    return season.player_features(*tables, stint_stats=stint_stats, ratings=season.team_ratings(*tables, "league"))


@query("feature_matrix", f"WITH RECURSIVE {MATRIX} SELECT {', '.join(MATRIX_IDS)}, {settled(MATRIX_ROUND)} FROM matrix")
def feature_matrix(spark, sf):
    return settle(matrix(spark, sf).select(*MATRIX_IDS, *MATRIX_ROUND), *MATRIX_ROUND)


TRAIN_ELO = ["team_elo", "opp_elo", "elo_diff"]
TRAIN_EXTRA = [c for c in LOAD_COLS if c != "high_workload_flag"]


@query("player_training_rows", f"""WITH RECURSIVE {MATRIX}, {LOADS}, {ELO}, {ELO_JOIN}
  SELECT m.gameId, m.personId, m.season, m.is_home, m.rest_days, m.is_back_to_back, m.opp_def_rating, m.games_on_current_team,
         {settled(ROLLED + EWMA + STINT_EWMA + SEASON, 'm.')},
         {settled([c for c in EFF_COLS if c.endswith(('_roll5', '_roll10'))], 'm.')},
         {settled(TRAIN_ELO, 'e.')}, {', '.join(f'w.{c}' for c in TRAIN_EXTRA)}
  FROM matrix m LEFT JOIN wl w ON w.gameId = m.gameId AND w.personId = m.personId
  LEFT JOIN ej2 e ON e.gameId = m.gameId AND e.personId = m.personId""")
def player_training_rows(spark, sf):
    tables = season_tables(spark, sf)
    df = season.training_rows(rated_matrix(tables), *tables, "league")
    cols = player_model_columns(df, short_windows=True, extended=True)
    doubles = [c for c in cols if c.endswith(("_roll3", "_roll5", "_roll10", "_ewma", "_season_avg")) or c in TRAIN_ELO]
    return settle(df.select("gameId", "personId", "season", *cols), *doubles)
