import itertools
import random

from pyspark.sql import functions as F

from hoopspark.functions import scalars
from hoopspark.operators import boxscore, elo, evaluation, features, predictions, rosters, selection


def test_clock_period_and_minutes_text(spark):
    df = spark.createDataFrame([("PT11M34.50S", 1, "12:30"), ("PT00M00.00S", 5, "31.5"), (None, 4, None), ("bad", 6, "x")], "c string, p int, m string")
    rows = df.select(scalars.clock_seconds("c").alias("s"), scalars.period_seconds("p").alias("l"), scalars.log_minutes("m").alias("m")).collect()
    assert [(r.s, r.l, r.m) for r in rows] == [(694.5, 720.0, 12.5), (0.0, 300.0, 31.5), (None, 720.0, 0.0), (None, 300.0, 0.0)]


def test_names_fold_to_ascii(spark):
    df = spark.createDataFrame([(" Luka Dončić ",), ("Nikola Vučević",), ("ﬁt Çağla",)], "n string")
    rows = df.select(scalars.normal_name("n").alias("a"), scalars.normal_name_exact("n").alias("b")).collect()
    assert [r.b for r in rows] == ["luka doncic", "nikola vucevic", "fit cagla"]
    assert [r.a for r in rows[:2]] == [r.b for r in rows[:2]]


def test_box_totals_credit_passers_and_fouled_players(spark):
    plays = spark.createDataFrame(
        [(1, 2024, 10, "3pt", "", 7, "AAA", 1, "A", 1, "Made", 3, 2, 1, None), (1, 2024, 20, "foul", "personal", 8, "BBB", 3, "C", 0, None, 0, None, None, 1),
         (1, 2024, 30, "freethrow", "", 7, "AAA", 1, "A", 0, "Missed", 3, None, None, None), (1, 2024, 40, "steal", "", 7, "AAA", 2, "B", 0, None, 0, None, None, None)],
        "gameId int, season int, orderNumber int, actionType string, subType string, teamId int, teamTricode string, personId int, playerName string, isFieldGoal int, "
        "shotResult string, pointsTotal int, assistPersonId int, assistTotal int, foulDrawnPersonId int")
    for c in list(boxscore.COUNTERS)[1:]:
        plays = plays.withColumn(c, F.lit(0))
    rows = {r.personId: r for r in boxscore.player_totals(plays).collect()}
    assert (rows[1].pts, rows[1].fg3m, rows[1].fta, rows[1].ftm, rows[1].fouls_drawn) == (3, 1, 1, 0, 1)
    assert (rows[2].ast, rows[2].stl, rows[2].playerName) == (1, 1, "B")


def pools(seed, n=60):
    rng = random.Random(seed)
    texts = ["G", "F", "C", "G-F", "F-C", "C-F", "", "G-F-C"]
    return [(t, p, rng.choice(texts[: rng.choice([2, 3, 5, 8])]), round(rng.uniform(5, 40), 3)) for t in range(n) for p in range(rng.randrange(3, 12))]


def test_best_five_equals_brute_force(spark):
    rows = pools(3)
    got = {r.t: (r.total_score, list(r.lineup)) for r in selection.best_five(spark.createDataFrame(rows, "t int, personId bigint, position string, score double"), ["t"]).collect()}
    flag = lambda text, f: f in text or (text == "" and f == "G")
    for t in {r[0] for r in rows}:
        pool = [r for r in rows if r[0] == t]
        has = {f: sum(flag(r[2], f) for r in pool) for f in "GFC"}
        fits = lambda five: all(has[f] < n or sum(flag(r[2], f) for r in five) >= n for f, n in (("G", 2), ("F", 2), ("C", 1)))
        fives = list(itertools.combinations(pool, min(5, len(pool))))
        good = fives if len(pool) <= 5 else [c for c in fives if fits(c)] or fives
        best = max(round(sum(round(r[3] * 1000) for r in c)) for c in good)
        assert round(got[t][0] * 1000) == best
        assert len(got[t][1]) == min(5, len(pool))


def test_ratings_keep_their_sum_and_skip_unplayed_games(spark):
    games = [(i, f"2024-01-{i + 1:02d}", 1 + i % 3, 1 + (i + 1) % 3, 100 + i, 101 if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(games, "gameId int, game_date string, home_team_id int, away_team_id int, home_pts int, away_pts int")
    rows = elo.elo_ratings(df.withColumn("league", F.lit(1)), "league").orderBy("gameId").collect()
    state = {1: 1500.0, 2: 1500.0, 3: 1500.0}
    for g, r in zip(games, rows):
        h, a = g[2], g[3]
        assert abs(r.home_elo - state[h]) < 1e-9 and abs(r.away_elo - state[a]) < 1e-9
        if g[5] is not None:
            result = 1.0 if g[4] > g[5] else 0.5 if g[4] == g[5] else 0.0
            shift = 20 * (result - 1 / (1 + 10 ** ((state[a] - state[h]) / 400)))
            state[h] += shift
            state[a] -= shift
    assert abs(sum(state.values()) - 4500) < 1e-6


def test_features_do_not_see_their_own_game(spark):
    from hoopspark.registry.bind import box

    rows = box(spark, "/root/testdata/sf0.001").cache()
    changed = rows.withColumn("pts", F.when(F.col("game_date") == "2024-01-20", F.col("pts") + 50).otherwise(F.col("pts")))
    pick = lambda df: sorted(map(str, features.player_ewma(features.player_trailing(df, ["pts"]), ["pts"]).where("game_date <= '2024-01-20'")
                                 .select("personId", "gameId", "pts_roll3", "pts_roll10", "pts_ewma").collect()))
    assert pick(rows) == pick(changed)


def test_team_minutes_scale_to_240(spark):
    rows = [("A", p, float(p), *([1.0] * 6)) for p in range(10, 20)]
    df = spark.createDataFrame(rows, "teamTricode string, personId int, pred_min double, " + ", ".join(f"pred_{t} double" for t in predictions.TARGETS[:-1]))
    out = predictions.scaled_to_team(df).collect()
    assert abs(sum(r.pred_min for r in out) - 240) <= 0.5
    assert sum(r.role == "starter" for r in out) == 5


def test_status_ranks(spark):
    texts = ["Out", "out indefinitely", "DAY-TO-DAY", "Questionable", "quest", "unknown", "Active", "Game Time Decision"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(rosters.status_rank("s").alias("r")).collect()
    assert [r.r for r in rows] == [4, 4, 1, 2, 2, 0, 0, 2]


def test_area_under_curve_with_ties(spark):
    rng = random.Random(2)
    rows = [("m", rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    got = evaluation.classification_errors(spark.createDataFrame(rows, "model string, label int, prob double"), ["model"]).first()
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(got.auc - auc) < 1e-9
