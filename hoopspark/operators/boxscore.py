"""Play-by-play rows to player box scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import exact_ratio, half_even

KEY = ["gameId", "personId"]
# fixed values
COUNTERS = {
    "pointsTotal": "pts",
    "reboundTotal": "reb",
    "reboundOffensiveTotal": "oreb",
    "reboundDefensiveTotal": "dreb",
    "turnoverTotal": "tov",
    "foulPersonalTotal": "pf",
    "foulTechnicalTotal": "tf",
}
# fixed values
COUNT_COLUMNS = ["pts", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "oreb", "dreb", "ast", "stl", "blk",
                 "tov", "pf", "tf", "fouls_drawn"]
RATIO_COLUMNS = ["fg_pct", "fg3_pct", "ft_pct", "efg_pct", "ts_pct", "team_poss", "usg_pct", "pts_per36",
                 "reb_per36", "ast_per36"]
# fixed values
BOX_COLUMNS = ["gameId", "season", "personId", "playerName", "teamId", "teamTricode", "min", *COUNT_COLUMNS,
               *RATIO_COLUMNS]


def player_rows(pbp: DataFrame, person: str = "personId") -> DataFrame:
    """Rows that belong to a player: the id is a number and not 0."""
    return pbp.withColumn(person, F.col(person).try_cast("bigint")).where(
        F.col(person).isNotNull() & (F.col(person) != 0)
    )


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def _identity() -> list[Column]:
    named = F.col("playerName").isNotNull() & (F.col("playerName") != "")
    at = lambda c: F.when(named & F.col(c).isNotNull(), F.col("orderNumber"))
    return [F.min_by(c, at(c)).alias(c) for c in ("playerName", "teamId", "teamTricode", "season")]


def _counters() -> list[Column]:
    return [F.max(F.col(src).try_cast("bigint")).alias(out) for src, out in COUNTERS.items()]


def _made_and_tried() -> list[Column]:
    shot = F.coalesce(F.col("isFieldGoal").try_cast("int") == 1, F.lit(False))
    made = F.coalesce(F.col("shotResult") == "Made", F.lit(False))
    three = F.col("actionType") == "3pt"
    free = F.col("actionType") == "freethrow"
    return [
        _count(shot).alias("fga"), _count(shot & made).alias("fgm"),
        _count(shot & three).alias("fg3a"), _count(shot & three & made).alias("fg3m"),
        _count(free).alias("fta"), _count(free & made).alias("ftm"),
    ]


def _defence() -> list[Column]:
    return [_count(F.col("actionType") == "steal").alias("stl"), _count(F.col("actionType") == "block").alias("blk")]


def running_counts() -> list[Column]:
    """Counters, shots and defence, for one aggregate over a player's own rows."""
    return [*_counters(), *_made_and_tried(), *_defence()]


def identity(pbp: DataFrame) -> DataFrame:
    """First non-empty name, team, code and season of a player in a game."""
    return player_rows(pbp).groupBy(*KEY).agg(*_identity()).where(F.col("playerName").isNotNull())


def counter_totals(pbp: DataFrame) -> DataFrame:
    """Running counters end at their maximum."""
    return player_rows(pbp).groupBy(*KEY).agg(*_counters())


def shooting_counts(pbp: DataFrame) -> DataFrame:
    """Field goals, threes and free throws, tried and made."""
    return player_rows(pbp).groupBy(*KEY).agg(*_made_and_tried())


def steals_and_blocks(pbp: DataFrame) -> DataFrame:
    return player_rows(pbp).groupBy(*KEY).agg(*_defence())


def fouls_drawn(pbp: DataFrame) -> DataFrame:
    """Personal fouls counted for the player who drew them."""
    fouls = pbp.where((F.col("actionType") == "foul") & (F.col("subType") == "personal"))
    drawn = fouls.select("gameId", F.col("foulDrawnPersonId").try_cast("bigint").alias("personId"))
    return drawn.where(F.col("personId").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("fouls_drawn"))


def assists(pbp: DataFrame) -> DataFrame:
    """Highest running assist count for the player who passed."""
    passed = pbp.select("gameId", F.col("assistPersonId").try_cast("bigint").alias("personId"), "assistTotal")
    return passed.where(F.col("personId").isNotNull()).groupBy(*KEY).agg(
        F.max("assistTotal").cast("bigint").alias("ast")
    )


def player_totals(pbp: DataFrame) -> DataFrame:
    """Identity, counters, shots and defence of every player-game in one aggregate.

    The three kinds of row a player can be credited on (own action, pass, drawn foul) are unpivoted to
    (person, row kind) and counted together, so the whole box costs one shuffle on the player-game key.
    """
    own = F.col("personId").try_cast("bigint")
    passer = F.col("assistPersonId").try_cast("bigint")
    foul = (F.col("actionType") == "foul") & (F.col("subType") == "personal")
    fouled = F.when(foul, F.col("foulDrawnPersonId").try_cast("bigint"))
    credits = F.array(
        F.struct(F.lit("own").alias("kind"), F.when(own != 0, own).alias("who")),
        F.struct(F.lit("pass").alias("kind"), passer.alias("who")),
        F.struct(F.lit("drawn").alias("kind"), fouled.alias("who")),
    )
    rows = pbp.withColumn("_credit", F.explode(F.filter(credits, lambda c: c["who"].isNotNull())))
    rows = rows.withColumn("personId", F.col("_credit.who")).withColumn("_kind", F.col("_credit.kind"))
    is_own = F.col("_kind") == "own"
    hidden = ["playerName", "teamId", "teamTricode", "season", "isFieldGoal", "shotResult", "actionType", *COUNTERS]
    rows = rows.withColumns({c: F.when(is_own, F.col(c)) for c in hidden})
    totals = rows.groupBy(*KEY).agg(
        *_identity(), *_counters(), *_made_and_tried(), *_defence(),
        F.max(F.when(F.col("_kind") == "pass", F.col("assistTotal"))).cast("bigint").alias("ast"),
        _count(F.col("_kind") == "drawn").alias("fouls_drawn"),
    )
    return totals.where(F.col("playerName").isNotNull())


def assemble(totals: DataFrame, minutes: DataFrame) -> DataFrame:
    """Attach minutes on court; missing counts and minutes are 0."""
    joined = totals.join(minutes, KEY, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNT_COLUMNS}).withColumn(
        "min", half_even(F.coalesce(F.col("min"), F.lit(0.0)), 1)
    )


def shooting_ratios(box: DataFrame) -> DataFrame:
    """Shooting percentages to three decimals, null without attempts; whole numbers on both sides of each quotient."""
    pairs = {
        "fg_pct": (F.col("fgm"), F.col("fga")),
        "fg3_pct": (F.col("fg3m"), F.col("fg3a")),
        "ft_pct": (F.col("ftm"), F.col("fta")),
        "efg_pct": (2 * F.col("fgm") + F.col("fg3m"), 2 * F.col("fga")),
        "ts_pct": (100 * F.col("pts"), 200 * F.col("fga") + 88 * F.col("fta")),
    }
    return box.withColumns({name: exact_ratio(n, d, 3) for name, (n, d) in pairs.items()})


def usage(box: DataFrame) -> DataFrame:
    """Team possessions, share of them used, and rates per 36 minutes, from whole hundredths of possessions and minutes.

    The team total is a window over the player-game rows of one team, at most a roster long.
    """
    used = 100 * (F.col("fga") - F.col("oreb") + F.col("tov")) + 44 * F.col("fta")
    with_team = box.withColumn("_team", F.sum(used.cast("bigint")).over(Window.partitionBy("gameId", "teamId")))
    spent = 100 * (F.col("fga") + F.col("tov")) + 44 * F.col("fta")
    minutes = F.round(F.col("min") * 100).cast("bigint")
    rates = {f"{c}_per36": exact_ratio(3600 * F.col(c), minutes, 1) for c in ("pts", "reb", "ast")}
    return with_team.withColumns({"team_poss": F.col("_team") / 100.0, "usg_pct": exact_ratio(spent, "_team", 3), **rates}).drop("_team")


def clean(box: DataFrame) -> DataFrame:
    """Drop players who did not play, narrow the types and order the columns."""
    played = (F.col("min") != 0) | (sum((F.col(c) for c in COUNT_COLUMNS[1:]), F.col(COUNT_COLUMNS[0])) != 0)
    types = {"season": "smallint", "personId": "bigint", "teamId": "bigint", "min": "float"}
    types |= {c: "smallint" for c in COUNT_COLUMNS} | {c: "float" for c in RATIO_COLUMNS}
    kept = box.where(played)
    return kept.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in BOX_COLUMNS])


def box_scores(pbp: DataFrame, minutes: DataFrame) -> DataFrame:
    """Full box score of every player-game."""
    return usage(shooting_ratios(assemble(player_totals(pbp), minutes)))
