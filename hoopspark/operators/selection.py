"""Choosing lineups: composite score, positions, active rosters and the best five under position rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.functions.scalars import half_even, zero_if_null
from hoopspark.functions.windows import top_rows

# Weights of the composite score.
SCORE_WEIGHTS = {
    "pts_ewma": 1.0,
    "reb_ewma": 1.2,
    "ast_ewma": 1.5,
    "stl_ewma": 2.0,
    "blk_ewma": 2.0,
    "tov_ewma": -1.5,
    "ts_pct_ewma": 20.0,
    "min_ewma": 0.3,
}
MIN_MINUTES = 5.0
STARTERS = 5
RECENT_GAMES = 20
FLAGS = {"G": 1, "F": 2, "C": 4}


def composite_score(df: DataFrame, weights=SCORE_WEIGHTS) -> DataFrame:
    terms = [zero_if_null(c) * w for c, w in weights.items() if c in df.columns]
    return df.withColumn("score", half_even(reduce(lambda a, b: a + b, terms), 3))


def inferred_position(position="position") -> Column:
    """The known position, else one guessed from rebounds, assists and blocks."""
    known = F.col(position)
    reb, ast, blk = (zero_if_null(f"{c}_ewma") for c in ("reb", "ast", "blk"))
    return (
        F.when(known.isNotNull() & (F.trim(known) != ""), known)
        .when((reb >= 9) & (blk >= 0.8), "C")
        .when((ast >= 5) | ((ast >= 3) & (reb < 5)), "G")
        .otherwise("F")
    )


def position_flags(position="position") -> dict[str, Column]:
    """Guard, forward and centre flags of a position text; a blank one counts as a guard."""
    text = F.upper(F.coalesce(F.col(position), F.lit("")))
    blank = text == ""
    return {
        "is_guard": blank | F.contains(text, F.lit("G")),
        "is_forward": F.contains(text, F.lit("F")),
        "is_center": F.contains(text, F.lit("C")),
    }


def eligible(pool: DataFrame, keys, minutes: float = MIN_MINUTES, least: int = STARTERS) -> DataFrame:
    """Players over the minutes threshold; where fewer than five pass, the five best scores instead."""
    team = Window.partitionBy(*keys)
    passes = F.coalesce(F.col("min_ewma"), F.lit(0.0)) >= minutes
    ranked = pool.withColumns({
        "_passes": passes, "_n": F.count_if(passes).over(team),
        "_r": F.row_number().over(team.orderBy(F.desc("score"), "personId")),
    })
    return ranked.where(F.when(F.col("_n") >= least, F.col("_passes")).otherwise(F.col("_r") <= least)).drop("_passes", "_n", "_r")


def best_five(pool: DataFrame, keys) -> DataFrame:
    """Highest total score of five players with at least two guards, two forwards and one centre.

    A rule the pool cannot meet is dropped; a pool of five or fewer is taken whole; rules that clash leave the
    five best scores. Exact without a solver:
    players with the same flags are interchangeable but for their score, so a lineup is a number of players
    from each of the eight flag classes, and the best of each class are taken. Only five per class can
    matter, so a pool shrinks to at most forty rows and at most 792 count vectors, which are grown one
    class at a time inside a row, within the five places left. Scores count in thousandths, so totals are exact; equal
    totals go to the smaller ids.
    """
    keys = list(keys)
    team = Window.partitionBy(*keys)
    flags = position_flags()
    kind = sum((F.when(flags[f], v).otherwise(0) for f, v in zip(("is_guard", "is_forward", "is_center"), FLAGS.values())), F.lit(0))
    tagged = pool.withColumns({"_class": kind, "_points": F.round(F.col("score") * 1000).cast("bigint")})
    place = F.row_number().over(Window.partitionBy(*keys, "_class").orderBy(F.desc("_points"), "personId"))
    tagged = tagged.withColumns(
        {"_place": place, "_n": F.count("*").over(team)}
        | {f"_has{f}": F.count_if(F.col("_class").bitwiseAND(v) > 0).over(team) for f, v in FLAGS.items()}
    ).where(F.col("_place") <= STARTERS)
    member = F.struct("_place", F.col("personId").cast("bigint").alias("id"), F.col("_points").alias("points"))
    classes = tagged.groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("_class") == c, member))).alias(f"_c{c}") for c in range(8)],
        *[F.first(c).alias(c) for c in ("_n", "_hasG", "_hasF", "_hasC")],
    )

    def extend(vectors: Column, c: int) -> Column:
        """Every way of taking 0, 1, ... players of class ``c`` on top of each vector."""
        def take(s, k):
            taken = F.slice(f"_c{c}", F.lit(1), k)
            got = lambda f: s[f] + k if c & FLAGS[f] else s[f]
            return F.struct(
                (s["left"] - k).alias("left"), got("G").alias("G"), got("F").alias("F"), got("C").alias("C"),
                F.aggregate(taken, s["points"], lambda total, m: total + m["points"]).alias("points"),
                F.concat(s["ids"], F.transform(taken, lambda m: m["id"])).alias("ids"),
            )
        grown = lambda s: F.transform(F.sequence(F.lit(0), F.least(F.size(f"_c{c}"), s["left"])), lambda k: take(s, k))
        return F.flatten(F.transform(vectors, grown))

    vectors = F.array(F.struct(
        F.least(F.lit(STARTERS), F.col("_n")).cast("int").alias("left"), F.lit(0).alias("G"), F.lit(0).alias("F"),
        F.lit(0).alias("C"), F.lit(0).cast("bigint").alias("points"), F.array().cast("array<bigint>").alias("ids"),
    ))
    vectors = reduce(extend, range(8), vectors)
    meets = lambda s: reduce(
        lambda a, b: a & b, [(F.col(f"_has{f}") < need) | (s[f] >= need) for f, need in (("G", 2), ("F", 2), ("C", 1))]
    )
    full = F.filter(vectors, lambda s: s["left"] == 0)
    ranked = F.transform(full, lambda s: F.struct(
        F.when(meets(s) | (F.col("_n") <= STARTERS), 0).otherwise(1).alias("unmet"), (-s["points"]).alias("rank"),
        F.array_sort(s["ids"]).alias("ids"),
    ))
    best = classes.select(*keys, F.array_min(ranked).alias("_best"))
    return best.select(*keys, F.col("_best.ids").alias("lineup"), (-F.col("_best.rank") / 1000.0).alias("total_score"))


def rosters_before(features: DataFrame, cols: list[str], recent: int = RECENT_GAMES) -> DataFrame:
    """For every team and game: players who appeared in the team's last games before it, with their latest
    known values from the team's earlier games.

    Each appearance is carried forward to the team's following games, until the player's next appearance
    and at most ``recent`` games: a bounded expansion in place of an inequality join.
    """
    order = Window.partitionBy("teamId").orderBy("game_date", "gameId")
    games = features.select("teamId", "gameId", "game_date").distinct().withColumn("seq", F.row_number().over(order))
    games = games.withColumn("_last", F.count("*").over(Window.partitionBy("teamId")))
    rows = features.select("teamId", "gameId", "personId", *cols).join(games.drop("game_date"), ["teamId", "gameId"])
    mine = Window.partitionBy("teamId", "personId").orderBy("seq")
    known = rows.select(
        "teamId", "personId", "seq", "_last",
        *[F.last(c, ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in cols],
        F.lead("seq").over(mine).alias("_again"),
    )
    until = F.least(F.col("seq") + recent, F.col("_last"), F.coalesce(F.col("_again"), F.col("_last")))
    ahead = known.where(until > F.col("seq")).withColumn("_at", F.explode(F.sequence(F.col("seq") + 1, until)))
    targets = games.select("teamId", F.col("seq").alias("_at"), "gameId", "game_date")
    return ahead.drop("seq", "_last", "_again").join(targets, ["teamId", "_at"]).drop("_at")


def active_roster(features: DataFrame, cols: list[str], recent: int = RECENT_GAMES) -> DataFrame:
    """Each team's players of its last games, with their latest known values there."""
    games = features.select("teamId", "gameId", "game_date").distinct()
    last = top_rows(games, ["teamId"], [F.desc("game_date"), F.desc("gameId")], recent).select("teamId", "gameId")
    seen = features.join(last, ["teamId", "gameId"], "left_semi").select("teamId", "personId").distinct()
    when = F.struct("game_date", "gameId")
    history = features.join(seen, ["teamId", "personId"], "left_semi")
    return history.groupBy("teamId", "personId").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in cols]
    )


def scored_pool(pool: DataFrame, positions: DataFrame) -> DataFrame:
    placed = pool.join(positions, "personId", "left").withColumn("position", inferred_position())
    return composite_score(placed)


def evaluate_lineups(features: DataFrame, box: DataFrame, positions: DataFrame, results: DataFrame, season=None) -> DataFrame:
    """Recommended five before each team-game against the five who played most, with the result."""
    stats = list(SCORE_WEIGHTS)
    key = ["teamId", "gameId"]
    pool = scored_pool(rosters_before(features, stats), positions)
    played = box if season is None else box.where(F.col("season") == season)
    wanted = played.select(*key).distinct()
    pool = pool.join(wanted, key, "left_semi")
    recommended = best_five(eligible(pool, key), key)
    actual = top_rows(played.select(*key, "personId", "min"), key, [F.desc("min"), "personId"], STARTERS)
    actual_score = actual.join(pool.select(*key, "personId", "score"), [*key, "personId"], "left").groupBy(*key).agg(
        F.array_sort(F.collect_list("personId")).alias("actual"), (F.coalesce(F.sum(F.round(F.col("score") * 1000).cast("bigint")), F.lit(0)) / 1000.0).alias("_act"),
    )
    dates = features.select(*key, "game_date").distinct()
    joined = recommended.join(actual_score, key).join(dates, key).join(results.select("gameId", "teamId", "won"), key, "left")
    return joined.select(
        "gameId", "game_date", "teamId", F.size(F.array_intersect("actual", "lineup")).alias("overlap_5"), "won",
        half_even("total_score", 2).alias("rec_score"), half_even("_act", 2).alias("act_score"),
        (F.round(F.col("total_score") * 1000) > F.round(F.col("_act") * 1000)).cast("int").alias("rec_better"),
    )


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    """Mean overlap, shares of good overlaps, and how often teams win by overlap."""
    share = lambda c: F.avg(c.cast("double"))
    o = F.col("overlap_5")
    return evaluated.agg(
        F.count("*").alias("team_games"), F.avg("overlap_5").alias("mean_overlap"), share(o == 5).alias("exact"),
        share(o >= 4).alias("at_least_4"), share(o >= 3).alias("at_least_3"), F.avg("rec_better").alias("rec_better"),
        F.avg(F.when(o >= 4, F.col("won"))).alias("win_rate_4_plus"), F.avg(F.when(o <= 2, F.col("won"))).alias("win_rate_2_less"),
    )


def greedy_five(pool: DataFrame, keys, quotas=(("G", 2), ("F", 2), ("C", 1))) -> DataFrame:
    """Two guards, two forwards and a centre by score and first position letter, back-filled by score."""
    keys = list(keys)
    quota = reduce(lambda e, q: e.when(F.col("_p") == q[0], q[1]), quotas, F.when(F.lit(False), 0)).otherwise(0)
    order = [F.desc("score"), "personId"]
    placed = pool.withColumn("_p", F.substring(F.coalesce("position", F.lit("F")), 1, 1))
    ranked = placed.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) <= quota)
    return top_rows(ranked.withColumn("_late", (~F.col("_in")).cast("int")), keys, ["_late", *order], STARTERS).drop("_p", "_in", "_late")
