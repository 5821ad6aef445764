"""The team dimension and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name, colour, id, logo number; in code order of the league's list.
TEAMS = [
    ("ATL", "Atlanta Hawks", "#C8102E", 1610612737, 1),
    ("BOS", "Boston Celtics", "#007A33", 1610612738, 2),
    ("BKN", "Brooklyn Nets", "#000000", 1610612751, 17),
    ("CHA", "Charlotte Hornets", "#1D1160", 1610612766, 30),
    ("CHI", "Chicago Bulls", "#CE1141", 1610612741, 4),
    ("CLE", "Cleveland Cavaliers", "#860038", 1610612739, 5),
    ("DAL", "Dallas Mavericks", "#00538C", 1610612742, 6),
    ("DEN", "Denver Nuggets", "#0E2240", 1610612743, 7),
    ("DET", "Detroit Pistons", "#C8102E", 1610612765, 8),
    ("GSW", "Golden State Warriors", "#1D428A", 1610612744, 9),
    ("HOU", "Houston Rockets", "#CE1141", 1610612745, 10),
    ("IND", "Indiana Pacers", "#002D62", 1610612754, 11),
    ("LAC", "LA Clippers", "#C8102E", 1610612746, 12),
    ("LAL", "Los Angeles Lakers", "#552583", 1610612747, 13),
    ("MEM", "Memphis Grizzlies", "#5D76A9", 1610612763, 29),
    ("MIA", "Miami Heat", "#98002E", 1610612748, 14),
    ("MIL", "Milwaukee Bucks", "#00471B", 1610612749, 15),
    ("MIN", "Minnesota Timberwolves", "#0C2340", 1610612750, 16),
    ("NOP", "New Orleans Pelicans", "#0C2340", 1610612740, 3),
    ("NYK", "New York Knicks", "#006BB6", 1610612752, 18),
    ("OKC", "Oklahoma City Thunder", "#007AC1", 1610612760, 25),
    ("ORL", "Orlando Magic", "#0077C0", 1610612753, 19),
    ("PHI", "Philadelphia 76ers", "#006BB6", 1610612755, 20),
    ("PHX", "Phoenix Suns", "#1D1160", 1610612756, 21),
    ("POR", "Portland Trail Blazers", "#E03A3E", 1610612757, 22),
    ("SAC", "Sacramento Kings", "#5A2D81", 1610612758, 23),
    ("SAS", "San Antonio Spurs", "#C4CED4", 1610612759, 24),
    ("TOR", "Toronto Raptors", "#CE1141", 1610612761, 28),
    ("UTA", "Utah Jazz", "#002B5C", 1610612762, 26),
    ("WAS", "Washington Wizards", "#002B5C", 1610612764, 27),
]
LOGO_URL = "https://a.espncdn.com/i/teamlogos/nba/500/{}.png"
CODE_ALIASES = {"GS": "GSW", "SA": "SAS", "NY": "NYK", "NO": "NOP", "UTH": "UTA", "UTAH": "UTA", "WSH": "WAS"}
HOME_COLOR = "#6366f1"
AWAY_COLOR = "#8b5cf6"


def lookup(c: Column, pairs: dict) -> Column:
    """Constant map lookup, null where missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), c)


def team_code(c) -> Column:
    """League code of a feed's team code."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(lookup(text, CODE_ALIASES), text)


def team_id(code: Column) -> Column:
    return F.coalesce(lookup(code, {t[0]: t[3] for t in TEAMS}), F.lit(0)).cast("bigint")


def team_dimension(spark: SparkSession) -> DataFrame:
    """Thirty rows: code, name, colour, logo, id."""
    rows = [(code, name, color, LOGO_URL.format(logo), number) for code, name, color, number, logo in TEAMS]
    return spark.createDataFrame(rows, "team_tri string, team_name string, team_color string, team_logo string, team_id bigint")


def decorate(df: DataFrame, teams: DataFrame, code: str, prefix: str, color: str = HOME_COLOR) -> DataFrame:
    """Attach name, colour and logo of a team code; unknown codes keep the code, a default colour, no logo.

    The dimension is one row per team of a league, a few dozen, so it is broadcast.
    """
    right = teams.select(
        F.col("team_tri").alias(code), F.col("team_name").alias("_name"), F.col("team_color").alias("_color"),
        F.col("team_logo").alias("_logo"),
    )
    joined = df.join(F.broadcast(right), code, "left")
    return joined.withColumns({
        f"{prefix}_name": F.coalesce("_name", code), f"{prefix}_color": F.coalesce("_color", F.lit(color)),
        f"{prefix}_logo": F.coalesce("_logo", F.lit("")),
    }).drop("_name", "_color", "_logo")
