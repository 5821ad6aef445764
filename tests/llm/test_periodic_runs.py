import hashlib
import random
import zlib

import numpy as np
import pytest

from hoopspark.llm import periodic_runs
from hoopspark.llm.queries import repeated_tail


def brute(x):
    """All maximal stretches by every period, the smallest period of each."""
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def random_words(rnd):
    """Stretches of random period and alphabet, some of them periodic inside a period, with a few words changed."""
    letters, x = rnd.choice([1, 2, 3, 5, 50]), []
    for _ in range(rnd.randint(1, 5)):
        base = [rnd.randrange(letters) for _ in range(rnd.randint(1, rnd.choice([3, 10, 40, 120, 200])))]
        if rnd.random() < .5:
            base = base[:len(base) // 3] * 2 + base[2 * (len(base) // 3):]
        x += [base[i % len(base)] for i in range(rnd.randint(1, 6 * len(base)))]
        if rnd.random() < .4:
            x[rnd.randrange(len(x))] = rnd.randrange(letters)
    return x[:1000]


def test_every_run_and_no_other():
    rnd = random.Random(11)
    for _ in range(250):
        x = random_words(rnd)
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(x)).tolist()] == brute(x)


def test_texts_beside_each_other():
    rnd = random.Random(12)
    for _ in range(20):
        texts = [random_words(rnd)[:400] for _ in range(6)]
        joined, starts = [], []
        for i, x in enumerate(texts):
            starts.append(len(joined))
            joined += x + [1000 + i]
        want = sorted((s + o, e + o, q) for o, x in zip(starts, texts) for s, e, q in brute(x))
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(joined), max(map(len, texts))).tolist()] == want


def test_fibonacci_and_constant_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    for x in (b, [7] * 500, [1, 2] * 300 + [3] + [1, 2] * 300):
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(x)).tolist()] == brute(x)


def expected(doc_id, text):
    words = (text or "").encode().split()
    places = repeated_tail(doc_id, len(words)) if words else None
    words = words if places is None else [words[i] for i in places]
    runs = brute(words)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
    top = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (len(runs), *((top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    made = [(i, " ".join(f"w{v}" for v in random_words(rnd)[:300])) for i in range(120)]
    long = " ".join(f"k{i % 4099}" for i in range(60_000))
    return [*made, (500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "a b " * 40), (505, "é ü " * 30), (506, long[:90_000]),
            (7, made[7][1]), (7, made[8][1]), (None, "x y z " * 20), (None, None)]


def test_query_columns(frame, texts):
    rows = periodic_runs.digests(periodic_runs.periodic_runs(frame(texts), repeated_tail))
    got = sorted(tuple(map(str, r)) for r in rows.collect())
    short = [t for t in texts if t[0] != 506]
    assert [g for g in got if g[0] != "506"] == sorted(tuple(map(str, (i, *expected(i, t)))) for i, t in short)
    long = next(g for g in got if g[0] == "506")
    assert int(long[1]) >= 1 and int(long[4]) == 4099 or zlib.crc32(b"506") % 10 == 0


def test_without_a_changed_order(frame):
    row = periodic_runs.periodic_runs(frame([(1, "a b " * 12 + "c")])).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], bytes(row["collapsed"])) == (25, [(0, 24, 2)], b"a b c")
    assert periodic_runs.periodic_runs(frame([(1, "a b " * 11 + "c")])).first()["runs"] == []


def test_empty_table(frame):
    rows = periodic_runs.digests(periodic_runs.periodic_runs(frame([])))
    assert rows.collect() == [] and rows.columns[0] == "doc_id"
