"""Column lists and schemas of the input files and feeds (fixed values)."""

from __future__ import annotations

PBP_COLUMNS = [
    "gameId", "season", "actionNumber", "orderNumber",
    "period", "periodType", "clock", "timeActual",
    "actionType", "subType", "qualifiers", "descriptor",
    "teamId", "teamTricode", "personId", "playerName",
    "possession", "scoreHome", "scoreAway",
    "isFieldGoal", "x", "y", "area", "areaDetail",
    "shotDistance", "shotResult", "shotActionNumber",
    "pointsTotal",
    "assistPlayerNameInitial", "assistPersonId", "assistTotal",
    "reboundTotal", "reboundDefensiveTotal", "reboundOffensiveTotal",
    "blockPlayerName", "blockPersonId",
    "stealPlayerName", "stealPersonId",
    "turnoverTotal",
    "foulPersonalTotal", "foulTechnicalTotal",
    "foulDrawnPlayerName", "foulDrawnPersonId",
]
PBP_DROPPED = ["value", "shortFormattedClock", "jerseyNumber", "isTargetScoreLastPeriod"]
PBP_TYPES = (
    {c: "bigint" for c in ("gameId", "orderNumber", "teamId", "personId", "possession", "assistPersonId", "blockPersonId",
                           "stealPersonId", "foulDrawnPersonId")}
    | {c: "int" for c in ("season", "actionNumber", "period", "scoreHome", "scoreAway", "isFieldGoal", "shotActionNumber",
                          "pointsTotal", "assistTotal", "reboundTotal", "reboundDefensiveTotal", "reboundOffensiveTotal",
                          "turnoverTotal", "foulPersonalTotal", "foulTechnicalTotal")}
    | {c: "double" for c in ("x", "y", "shotDistance")}
)
SHOT_COLUMNS = {
    "game_id": "bigint", "player_id": "bigint", "team_id": "bigint", "game_date": "date",
    "shot_zone_basic": "string", "shot_distance": "int", "shot_attempted_flag": "int", "shot_made_flag": "int",
    "loc_x": "int", "loc_y": "int",
}
MATCHUP_COLUMNS = {
    "game_id": "bigint", "person_id": "bigint", "team_id": "bigint", "matchups_person_id": "bigint",
    "partial_possessions": "double", "matchup_field_goals_made": "int", "matchup_field_goals_attempted": "int",
    "matchup_field_goals_percentage": "double", "matchup_three_pointers_made": "int",
    "matchup_three_pointers_attempted": "int", "player_points": "int", "team_points": "int", "switches_on": "int",
    "matchup_minutes": "string",
}

TEAM_SCHEMA = "struct<abbreviation:string>"
SCOREBOARD_SCHEMA = (
    "events array<struct<id:string,date:string,competitions:array<struct<date:string,"
    "status:struct<type:struct<description:string>>,venue:struct<fullName:string>,"
    "competitors:array<struct<homeAway:string,team:struct<abbreviation:string>,score:string,"
    "linescores:array<struct<value:double>>>>>>>>"
)
INJURY_SCHEMA = (
    "injuries array<struct<id:string,displayName:string,injuries:array<struct<status:string,"
    "athlete:struct<displayName:string,position:struct<abbreviation:string>>,"
    "details:struct<type:string,detail:string>,shortComment:string,longComment:string>>>>"
)
ROSTER_SCHEMA = "team_tri string, athletes array<struct<fullName:string,position:struct<abbreviation:string>>>"
TEAMS_SCHEMA = "sports array<struct<leagues:array<struct<teams:array<struct<team:struct<id:string,abbreviation:string>>>>>>>"
LIVE_SCORE_SCHEMA = (
    "scoreboard struct<games:array<struct<gameId:string,gameStatus:int,gameStatusText:string,period:int,gameClock:string,"
    "seriesText:string,homeTeam:struct<teamTricode:string,score:int>,awayTeam:struct<teamTricode:string,score:int>>>>"
)
_STATISTICS = (
    "struct<minutesCalculated:string,points:int,reboundsTotal:int,assists:int,steals:int,blocks:int,turnovers:int,"
    "fieldGoalsMade:int,fieldGoalsAttempted:int,threePointersMade:int,threePointersAttempted:int,freeThrowsMade:int,"
    "freeThrowsAttempted:int,plusMinusPoints:int>"
)
_PLAYERS = (
    "struct<players:array<struct<name:string,jerseyNum:string,position:string,starter:string,oncourt:string,"
    f"statistics:{_STATISTICS}>>>"
)
LIVE_BOX_SCHEMA = f"game struct<gameId:string,homeTeam:{_PLAYERS},awayTeam:{_PLAYERS}>"
# fixed values: the first columns of the feature matrix, in file order
FEATURE_MATRIX_LEAD = [
    "gameId", "season", "game_date", "personId", "playerName", "teamId", "teamTricode", "opp_team_id",
    "is_home", "rest_days", "is_back_to_back", "opp_def_rating", "games_on_current_team", "team_stint_id",
    "h2h_win_pct_home", "h2h_pts_diff_avg", "h2h_games",
    "min", "pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf", "tf",
    "fouls_drawn", "fg_pct", "fg3_pct", "ft_pct", "efg_pct", "ts_pct", "team_poss", "usg_pct", "pts_per36", "reb_per36",
    "ast_per36",
]
