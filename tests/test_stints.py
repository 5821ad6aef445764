"""Presence and lineups against a plain replay of small random games."""

import random
from collections import defaultdict

import pytest

from hoopspark.operators import stints

SCHEMA = """gameId bigint, season int, orderNumber bigint, period int, clock string, actionType string, subType string,
teamId bigint, personId bigint, scoreHome int, scoreAway int"""


def random_game(game, seed):
    rng = random.Random(seed)
    rows, order, score = [], 0, [0, 0]

    def add(period, left, action, sub, team=None, person=None, scored=False):
        nonlocal order
        order += rng.randrange(1, 4)
        if scored:
            score[rng.randrange(2)] += 2
        rows.append((game, 2024, order, period, f"PT{int(left) // 60:02d}M{left % 60:05.2f}S", action, sub, team, person,
                     score[0] if scored else None, score[1] if scored else None))

    for period in range(1, 4 + rng.randrange(1, 3)):
        length = 720 if period <= 4 else 300
        if period > 1 and rng.random() < 0.6:
            for _ in range(rng.randrange(1, 3)):
                team = rng.randrange(1, 3)
                add(period, length, "substitution", rng.choice(["in", "out"]), team, team * 100 + rng.randrange(7))
        if period > 1 and rng.random() < 0.3:
            team = rng.randrange(1, 3)
            add(period, length, "foul", "technical", team, team * 100 + rng.randrange(7))
        add(period, length, "period", "start")
        left = float(length)
        for _ in range(rng.randrange(15, 40)):
            left = max(0.0, left - rng.choice([0, 5, 12.5, 30]))
            team = rng.randrange(1, 3)
            kind = rng.random()
            if kind < 0.35:
                add(period, left, "substitution", rng.choice(["in", "out"]), team, team * 100 + rng.randrange(7))
            elif kind < 0.9:
                add(period, left, "2pt", "", team, team * 100 + rng.randrange(7), rng.random() < 0.4)
            else:
                add(period, left, "timeout", "", team, None)
        add(period, 0, "period", "end")
    return rows


def seconds(text):
    return int(text[2:4]) * 60 + float(text[5:-1])


def replay(rows, home=1):
    """Row by row: minutes per player and (team, lineup, minutes, net points) per five-man stretch."""
    minutes, fives = defaultdict(float), []
    since, waiting, court, opened = {}, set(), {1: set(), 2: set()}, {}
    lineup_waiting, period, margin, known = set(), 0, 0, [0, 0]
    length = lambda p: 720.0 if p <= 4 else 300.0

    def close(team, left):
        if team in opened:
            start, at = opened.pop(team)
            if len(court[team]) == 5:
                sign = 1 if team == home else -1
                fives.append((team, tuple(sorted(court[team])), round(max(0.0, start - left) / 60, 2), sign * (margin - at)))

    def begin(team, left):
        if len(court[team]) == 5:
            opened[team] = (left, margin)

    for _, _, _, p, clock, action, sub, team, person, h, a in rows:
        left = seconds(clock)
        known = [known[0] if h is None else h, known[1] if a is None else a]
        margin = known[0] - known[1]
        if action == "period" and sub == "start":
            period = p
            for who in waiting:
                since[who] = length(p)
            for who in lineup_waiting:
                court[who // 100].add(who)
            for t in {who // 100 for who in lineup_waiting}:
                begin(t, length(p))
            waiting, lineup_waiting = set(), set()
        elif action == "period":
            waiting, lineup_waiting = set(since), court[1] | court[2]
            for who, start in since.items():
                minutes[who] += start / 60
            since = {}
            for t in (1, 2):
                close(t, 0.0)
                court[t] = set()
        elif person and action == "substitution":
            waiting.discard(person)
            lineup_waiting.discard(person)
            close(team, left)
            if sub == "in":
                since[person] = left
                court[team].add(person)
            else:
                if person in since:
                    minutes[person] += max(0.0, since.pop(person) - left) / 60
                court[team].discard(person)
            begin(team, left)
        elif person and period:
            if person not in since:
                since[person] = length(period)
            if person not in court[team]:
                close(team, length(period))
                court[team].add(person)
                begin(team, length(period))
    for who, start in since.items():
        minutes[who] += start / 60
    for t in (1, 2):
        close(t, 0.0)
    return minutes, fives


@pytest.fixture(scope="module")
def games(spark):
    plays = {g: random_game(g, g) for g in range(1, 31)}
    df = spark.createDataFrame([r for rows in plays.values() for r in rows], SCHEMA).repartition(4).cache()
    return plays, df


@pytest.mark.parametrize("width", [None, 10])
def test_minutes_equal_a_replay(games, width):
    plays, df = games
    got = {(r.gameId, r.personId): r.min for r in stints.minutes(df, width).collect()}
    want = {(g, p): m for g, rows in plays.items() for p, m in replay(rows)[0].items()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= 0.0501 for k in want)


@pytest.mark.parametrize("width", [None, 10])
def test_lineups_and_margins_equal_a_replay(spark, games, width):
    plays, df = games
    schedule = spark.createDataFrame([(g, 1) for g in plays], "gameId bigint, home_team_id bigint")
    got = sorted((r.gameId, r.teamId, tuple(r.lineup), r.min, r.net_pts) for r in stints.scored_segments(df, schedule, width).collect())
    want = sorted((g, t, five, m, float(net)) for g, rows in plays.items() for t, five, m, net in replay(rows)[1])
    assert len(want) > 100
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) <= 0.0101 and a[4] == b[4] for a, b in zip(got, want))


@pytest.mark.parametrize("extra", [63, 130])
def test_rosters_of_any_length_equal_a_replay(spark, extra):
    """Players who only leave without having come in lengthen the roster before those who play."""
    plays = {}
    for g in (1, 2):
        rows = [(*r[:2], r[2] * 200, *r[3:]) for r in random_game(g, g)]
        at = next(r for r in rows if r[5] == "period" and r[6] == "start")
        more = [(g, 2024, at[2] + 1 + i, at[3], at[4], "substitution", "out", 1, i + 1, None, None) for i in range(extra)]
        plays[g] = sorted([*rows, *more], key=lambda r: r[2])
    df = spark.createDataFrame([r for rows in plays.values() for r in rows], SCHEMA)
    got = sorted((r.gameId, r.teamId, tuple(r.lineup)) for r in stints.lineup_segments(df, 5_000).collect())
    assert got == sorted((g, t, five) for g, rows in plays.items() for t, five, _, _ in replay(rows)[1])
    assert len({p for _, t, five in got if t == 1 for p in five}) >= 5
