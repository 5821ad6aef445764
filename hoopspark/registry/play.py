"""Shots, matchups and game rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopspark.operators import features, games, matchups, shots
from hoopspark.operators.columns import game_model_columns, team_mean_columns
from hoopspark.registry.bind import EV, SCHED, box, events, r6, schedule, season_tables, settle, settled
from hoopspark.registry.core import query
from hoopspark.registry.series import (
    ELO, ELO_JOIN, EWMA, EFF_COLS, FEAT, MATRIX, POINTS, STINT_EWMA, matrix, rolled_sql, rounded,
)
from hoopspark.plans import season

ZONES = list(shots.ZONE_EFG)


def shot_rows(spark, sf):
    """Views, clicks and signups as shots; zone, distance and result from the property value."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), F.col("k") % 7 + 1)
    return events(spark, sf).where(F.col("event_type").isin("view", "click", "signup")).select(
        F.col("gameId").alias("game_id"), F.col("user_id").alias("player_id"), F.col("teamId").alias("team_id"),
        "game_date", "season", zone.alias("shot_zone_basic"), (F.col("k") % 30).alias("shot_distance"),
        F.lit(1).alias("shot_attempted_flag"), (1 - F.col("k") % 2).alias("shot_made_flag"))


SHOTS = f"""shot AS MATERIALIZED (
  SELECT gameId AS game_id, user_id AS player_id, teamId AS team_id, game_date, season,
         {ZONES!r}[k % 7 + 1] AS zone, k % 30 AS feet, 1 - k % 2 AS made
  FROM ev WHERE event_type IN ('view', 'click', 'signup')),
pgs AS MATERIALIZED (
  SELECT game_id, player_id, team_id, game_date, season, sum((zone LIKE '%3%')::INT) / count(*)::DOUBLE AS shot_3pt_rate,
         sum((feet <= 6)::INT) / count(*)::DOUBLE AS shot_rim_rate, sum((feet > 6 AND feet <= 16)::INT) / count(*)::DOUBLE AS shot_mid_rate,
         avg(feet) AS shot_dist_avg, (sum(made) + 0.5::DOUBLE * sum(CASE WHEN zone LIKE '%3%' THEN made ELSE 0 END)) / count(*) AS shot_efg,
         avg(CASE zone {' '.join(f"WHEN '{z}' THEN {v}" for z, v in shots.ZONE_EFG.items())} ELSE 0.48 END::DOUBLE) AS zone_efg
  FROM shot GROUP BY game_id, player_id, team_id, game_date, season)"""
PGS = ["shot_3pt_rate", "shot_rim_rate", "shot_mid_rate", "shot_dist_avg", "shot_efg", "zone_efg", "shot_quality"]


@query("player_game_shots", f"""WITH {EV}, {SHOTS}, p AS (SELECT *, shot_efg - zone_efg AS shot_quality FROM pgs)
  SELECT game_id, player_id, team_id, game_date, season, {rounded(PGS)} FROM p""")
def player_game_shots(spark, sf):
    return r6(shots.player_game_shots(shot_rows(spark, sf)), *PGS)


def game_rolled(stats, widths, key):
    return rolled_sql(stats, widths, key).replace("game_date, gameId", "game_date, game_id")


SHOT_ROLLED = [f"{m}_roll{w}" for m in shots.METRICS for w in (3, 5, 10)]


@query("rolled_shots", f"""WITH {EV}, {SHOTS}, r AS (SELECT game_id, player_id, {game_rolled(shots.METRICS, (3, 5, 10), 'player_id')} FROM pgs)
  SELECT game_id, player_id, {rounded(SHOT_ROLLED)} FROM r""")
def rolled_shots(spark, sf):
    df = shots.rolled_shots(shots.player_game_shots(shot_rows(spark, sf)))
    return r6(df.select("game_id", "player_id", *SHOT_ROLLED), *SHOT_ROLLED)


TEAM_SHOTS = """tgs AS (SELECT game_id, team_id, game_date, avg(shot_efg) AS team_efg FROM pgs GROUP BY ALL),
tgo AS (SELECT a.*, b.team_efg AS opp_def_efg FROM tgs a JOIN tgs b ON a.game_id = b.game_id AND a.team_id <> b.team_id)"""


@query("team_game_shooting", f"""WITH {EV}, {SHOTS}, {TEAM_SHOTS}
  SELECT game_id, team_id, game_date, round(team_efg, 6) AS team_efg, round(opp_def_efg, 6) AS opp_def_efg FROM tgo""")
def team_game_shooting(spark, sf):
    return r6(shots.team_game_shooting(shots.player_game_shots(shot_rows(spark, sf))), "team_efg", "opp_def_efg")


ALLOWED = [f"opp_def_efg_roll{w}" for w in (3, 5, 10)]
SHOT_FEATURES = f"""{SHOTS}, {TEAM_SHOTS},
tro AS (SELECT game_id, team_id, {game_rolled(['opp_def_efg'], (3, 5, 10), 'team_id')} FROM tgo),
shotf AS MATERIALIZED (
  SELECT r.game_id, r.player_id AS personId, r.game_date, r.season, r.* EXCLUDE (game_id, player_id, team_id, game_date, season), t.* EXCLUDE (game_id, team_id)
  FROM (SELECT game_id, player_id, team_id, game_date, season, {game_rolled(shots.METRICS, (3, 5, 10), 'player_id')} FROM pgs) r
  JOIN tro t ON t.game_id = r.game_id AND t.team_id = r.team_id)"""


@query("opponent_shooting", f"""WITH {EV}, {SHOTS}, {TEAM_SHOTS}, tro AS (SELECT game_id, team_id, {game_rolled(['opp_def_efg'], (3, 5, 10), 'team_id')} FROM tgo)
  SELECT game_id, team_id, {rounded(ALLOWED)} FROM tro""")
def opponent_shooting(spark, sf):
    games_ = shots.team_game_shooting(shots.player_game_shots(shot_rows(spark, sf)))
    return r6(shots.opponent_shooting(games_).select("game_id", "team_id", *ALLOWED), *ALLOWED)


@query("shot_features", f"""WITH {EV}, {SHOT_FEATURES}
  SELECT game_id, personId, game_date, season, {rounded(SHOT_ROLLED + ALLOWED)} FROM shotf""")
def shot_features(spark, sf):
    return r6(shots.shot_features(shot_rows(spark, sf)), *SHOT_ROLLED, *ALLOWED)


def matchup_rows(spark, sf):
    """Each event as a matchup with a player of the other team."""
    return events(spark, sf).select(
        F.col("gameId").alias("game_id"), F.col("user_id").alias("person_id"), F.col("teamId").alias("team_id"), "season",
        F.expr("opp_team_id * 10 + k % 10").alias("matchups_person_id"),
        F.expr("(k % 12) / 2.0D").alias("partial_possessions"), F.expr("k % 4").alias("matchup_field_goals_made"),
        F.expr("k % 4 + k % 5").alias("matchup_field_goals_attempted"), F.expr("k % 3").alias("matchup_three_pointers_attempted"),
        F.expr("2 * (k % 4) + k % 2").alias("player_points"), F.expr("k % 6").alias("switches_on"))


MATCH = """mu AS MATERIALIZED (
  SELECT gameId AS game_id, user_id AS person_id, teamId AS team_id, season, opp_team_id * 10 + k % 10 AS matchups_person_id,
         (k % 12) / 2.0::DOUBLE AS poss, k % 4 AS made, k % 4 + k % 5 AS tried, k % 3 AS threes, 2 * (k % 4) + k % 2 AS points, k % 6 AS switches
  FROM ev WHERE (k % 12) / 2.0 >= 2.0),
offv AS (
  SELECT game_id, person_id AS personId, team_id, season, coalesce(sum(made) / nullif(sum(tried), 0)::DOUBLE, 0) AS matchup_def_fg_pct,
         coalesce(sum(points) / nullif(sum(poss), 0), 0) AS matchup_pts_per_poss, coalesce(sum(threes) / nullif(sum(tried), 0)::DOUBLE, 0) AS matchup_3pt_rate,
         sum(switches)::DOUBLE AS switches_on FROM mu GROUP BY ALL),
defv AS (
  SELECT game_id, matchups_person_id AS personId, team_id, season, coalesce(sum(made) / nullif(sum(tried), 0)::DOUBLE, 0) AS defended_fg_pct,
         coalesce(sum(points) / nullif(sum(poss), 0), 0) AS defended_pts_per_poss FROM mu GROUP BY ALL)"""
OFF = ["matchup_def_fg_pct", "matchup_pts_per_poss", "matchup_3pt_rate", "switches_on"]
DEF = ["defended_fg_pct", "defended_pts_per_poss"]


@query("offensive_matchups", f"WITH {EV}, {MATCH} SELECT game_id, personId, team_id, season, {rounded(OFF)} FROM offv")
def offensive_matchups(spark, sf):
    return r6(matchups.offensive_view(matchups.enough_possessions(matchup_rows(spark, sf))), *OFF)


@query("defensive_matchups", f"WITH {EV}, {MATCH} SELECT game_id, personId, {rounded(DEF)} FROM defv")
def defensive_matchups(spark, sf):
    return r6(matchups.defensive_view(matchups.enough_possessions(matchup_rows(spark, sf))), *DEF)


MATCH_ROLLED = [f"{m}_roll{w}" for m in matchups.METRICS for w in (3, 5, 10)]
MATCH_FEATURES = f"""{MATCH},
both_ AS (SELECT coalesce(o.game_id, d.game_id) AS game_id, coalesce(o.personId, d.personId) AS personId, o.team_id, o.season,
  o.matchup_def_fg_pct, o.matchup_pts_per_poss, o.matchup_3pt_rate, d.defended_fg_pct, d.defended_pts_per_poss, o.switches_on
  FROM offv o FULL OUTER JOIN defv d ON o.game_id = d.game_id AND o.personId = d.personId),
mf AS (SELECT b.game_id, b.personId, s.game_date, b.season, {game_rolled(matchups.METRICS, (3, 5, 10), 'personId')}
  FROM both_ b LEFT JOIN (SELECT gameId AS gid, game_date FROM sched) s ON s.gid = b.game_id)"""


@query("matchup_features", f"""WITH {EV}, {SCHED}, {MATCH_FEATURES}
  SELECT game_id, personId, game_date, season, {rounded(MATCH_ROLLED)} FROM mf""")
def matchup_features(spark, sf):
    return r6(matchups.matchup_features(matchup_rows(spark, sf), schedule(spark, sf)), *MATCH_ROLLED)


@query("attach_rolled_tables", f"""WITH {FEAT}, {SHOT_FEATURES}, {MATCH_FEATURES}
  SELECT f.gameId, f.personId, {', '.join(f'round(s.{c}, 6) AS {c}' for c in SHOT_ROLLED + ALLOWED)}, {', '.join(f'round(m.{c}, 6) AS {c}' for c in MATCH_ROLLED)}
  FROM f3 f LEFT JOIN shotf s ON s.game_id = f.gameId AND s.personId = f.personId LEFT JOIN mf m ON m.game_id = f.gameId AND m.personId = f.personId""")
def attach_rolled_tables(spark, sf):
    rows = box(spark, sf).select("gameId", "personId")
    df = features.attach_rolled(rows, shots.shot_features(shot_rows(spark, sf)))
    df = features.attach_rolled(df, matchups.matchup_features(matchup_rows(spark, sf), schedule(spark, sf)))
    return r6(df, *SHOT_ROLLED, *ALLOWED, *MATCH_ROLLED)


RESULTS = """res AS (SELECT a.gameId, a.teamId, b.teamId AS opp_id, a.team_pts AS pts, b.team_pts AS opp_pts, CAST(a.team_pts > b.team_pts AS INTEGER) AS won
  FROM tp a JOIN tp b ON a.gameId = b.gameId AND a.teamId <> b.teamId)"""


@query("team_results", f"WITH {FEAT}, {POINTS}, {RESULTS} SELECT * FROM res")
def team_results(spark, sf):
    return games.team_results(box(spark, sf))


@query("home_wins", f"WITH {FEAT}, {POINTS}, {RESULTS} SELECT s.gameId, r.won AS home_win FROM res r JOIN sched s ON s.gameId = r.gameId AND s.home_team_id = r.teamId")
def home_wins(spark, sf):
    return games.home_results(box(spark, sf), schedule(spark, sf))


MEAN_COLS = sorted(EWMA + STINT_EWMA) + EFF_COLS
TEAM_MEANS = f"""tm AS (SELECT gameId, teamId, {', '.join(f'avg({c}) AS {c}' for c in MEAN_COLS)}, avg(rest_days) AS rest_days,
  count(*) AS active_players FROM matrix WHERE coalesce(min_ewma, 0) > 5 GROUP BY gameId, teamId)"""


@query("team_means", f"WITH RECURSIVE {MATRIX}, {TEAM_MEANS} SELECT gameId, teamId, {settled(MEAN_COLS + ['rest_days'])}, active_players FROM tm")
def team_means(spark, sf):
    df = games.team_means(matrix(spark, sf), MEAN_COLS)
    return settle(df, *MEAN_COLS, "rest_days")


SIDE = [*MEAN_COLS, "rest_days"]
GAME_ROWS = f"""{TEAM_MEANS}, {RESULTS},
gr AS (
  SELECT s.gameId, s.game_date, s.season, {', '.join(f'h.{c} AS home_{c}, a.{c} AS away_{c}' for c in SIDE)},
         h.active_players AS home_active_players, a.active_players AS away_active_players,
         {', '.join(f'h.{c} - a.{c} AS diff_{c}' for c in MEAN_COLS)}, h.rest_days - a.rest_days AS rest_diff,
         h.active_players - a.active_players AS roster_diff, coalesce(hh.h2h_win_pct_home, 0.5) AS h2h_win_pct_home,
         coalesce(hh.h2h_pts_diff_avg, 0) AS h2h_pts_diff_avg, coalesce(hh.h2h_games, 0) AS h2h_games, r.won AS home_win
  FROM sched s JOIN tm h ON h.gameId = s.gameId AND h.teamId = s.home_team_id JOIN tm a ON a.gameId = s.gameId AND a.teamId = s.away_team_id
  JOIN res r ON r.gameId = s.gameId AND r.teamId = s.home_team_id LEFT JOIN hh ON hh.gameId = s.gameId)"""
GAME_DOUBLES = [f"{side}_{c}" for side in ("home", "away") for c in SIDE] + [f"diff_{c}" for c in MEAN_COLS] + ["rest_diff", "h2h_win_pct_home", "h2h_pts_diff_avg"]
GAME_INTS = ["home_active_players", "away_active_players", "roster_diff", "h2h_games", "home_win"]


def game_table(spark, sf):
    tables = season_tables(spark, sf)
    return season.game_rows(matrix(spark, sf, tables), *tables)


@query("game_features", f"WITH RECURSIVE {MATRIX}, {GAME_ROWS} SELECT gameId, game_date, season, {', '.join(GAME_INTS)}, {settled(GAME_DOUBLES)} FROM gr")
def game_features(spark, sf):
    df = game_table(spark, sf).select("gameId", "game_date", "season", *GAME_INTS, *GAME_DOUBLES)
    return settle(df, *GAME_DOUBLES)


GM_COLS = ([f"diff_{c}" for c in MEAN_COLS] + [f"home_{c}" for c in MEAN_COLS if c.endswith("_ewma")]
           + [f"away_{c}" for c in MEAN_COLS if c.endswith("_ewma")] + ["h2h_win_pct_home", "h2h_pts_diff_avg", "rest_diff", "home_rest_days", "away_rest_days"])


@query("game_model_columns", f"""WITH RECURSIVE {MATRIX}, {GAME_ROWS} SELECT gameId, h2h_games, roster_diff, home_active_players, away_active_players, {settled(GM_COLS)} FROM gr""")
def game_model_matrix(spark, sf):
    df = game_table(spark, sf)
    chosen = game_model_columns(df)
    doubles = [c for c in chosen if c not in GAME_INTS]
    return settle(df.select("gameId", *chosen), *doubles)


SCORED = ["home_team_elo", "away_team_elo", "elo_diff"]


@query("game_score_rows", f"""WITH RECURSIVE {MATRIX}, {ELO}, {ELO_JOIN}, {GAME_ROWS},
te2 AS (SELECT e.gameId, m.teamId, avg(e.team_elo) AS team_elo FROM ej2 e JOIN matrix m ON m.gameId = e.gameId AND m.personId = e.personId
  WHERE coalesce(m.min_ewma, 0) > 5 GROUP BY ALL)
  SELECT r.gameId, r.home_win, p.home_pts, p.away_pts, p.home_pts + p.away_pts AS total_pts, round(h.team_elo, 6) AS home_team_elo, round(a.team_elo, 6) AS away_team_elo,
         round(h.team_elo - a.team_elo, 6) AS elo_diff
  FROM gr r JOIN gp p ON p.gameId = r.gameId JOIN te2 h ON h.gameId = r.gameId AND h.teamId = p.home_team_id JOIN te2 a ON a.gameId = r.gameId AND a.teamId = p.away_team_id""")
def game_score_rows(spark, sf):
    df = game_scores(spark, sf)
    return r6(df.select("gameId", "home_win", "home_pts", "away_pts", "total_pts", *SCORED), *SCORED)


def game_scores(spark, sf):
    """Game rows with ratings and points, the input of the score models."""
    from hoopspark.registry.series import games_with_league, rated_matrix

    tables = season_tables(spark, sf)
    return games.score_targets(games.game_features(rated_matrix(tables), *tables, elo=True), games_with_league(spark, sf, tables))
