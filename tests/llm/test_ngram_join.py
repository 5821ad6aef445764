import random
import re
from collections import defaultdict

import numpy as np
import pytest

from hoopspark.llm import ngram_join
from hoopspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def shingle_set(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k=3, percent=90):
    """(id, n, component) of each row by comparing every pair of sets that share a shingle."""
    sets, post, parent = [shingle_set(t, k) for _, t in rows], defaultdict(list), {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, s in enumerate(sets):
        for g in s:
            post[g].append(r)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in post[g] if j < i}:
            if rows[i][0] is None or rows[j][0] is None:
                continue
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(seed, docs=260):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows, base = [], []
    for i in range(docs):
        kind = draw.random()
        if kind < 0.35 and base:                       # a chain of near copies of one text, or of any
            words = list(base[0] if draw.random() < 0.6 else draw.choice(base))
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        elif kind < 0.6:
            words = passage + [draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 2, 5, 30]))]
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 9, 10, 11, 12, 40, 150]))]
        base.append(words)
        rows.append((1000 - i if i % 3 else i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, words, percent", [(1, 3, 90), (2, 5, 80)])
def test_components_equal_brute_force(frame, monkeypatch, seed, words, percent):
    monkeypatch.setattr(ngram_join, "PAIRS_FROM", 4)
    monkeypatch.setattr(ngram_join, "TRIPLES_FROM", 20)
    rows = corpus(seed)
    assert result(ngram_join.join_components(frame(rows), words, percent)) == brute(rows, words, percent)
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(frame(rows), words, percent).collect())
    assert kept == sorted(i for i, _, c in brute(rows, words, percent) if i == c)


def test_odd_rows(frame):
    long = " ".join(f"x{i}" for i in range(4000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "One"), (10, "a b"), (11, "A\tB"), (12, "a b c"), (3, long), (2, long + " y"), (2, long + " y"),
            (None, long), (None, None), (20, "É b c d"), (21, "é b c d")]
    assert result(ngram_join.join_components(frame(rows))) == brute(rows)
    assert ngram_join.join_components(frame([])).count() == 0


def test_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(ngram_join.join_components(docs)) == brute(rows)


def test_a_shared_signature_for_every_linked_pair():
    draw = np.random.default_rng(7)
    edges = ngram_join.size_edges(90)
    for _ in range(300):
        n, universe = int(draw.integers(9, 300)), draw.integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2)
        df = {int(t): int(d) for t, d in zip(universe, draw.choice([2, 70, 5000], 700))}
        x = draw.choice(universe, n, replace=False)
        y = x.copy()
        y[draw.choice(n, ngram_join.losses(n, 90) // 2, replace=False)] = draw.choice(np.setdiff1d(universe, x), ngram_join.losses(n, 90) // 2, replace=False)
        common = len(np.intersect1d(x, y))
        if 100 * common < 90 * (2 * n - common):
            continue
        edge, limit = int(edges[np.searchsorted(edges, n, "right") - 1]), ngram_join.share(90)
        own = [set(ngram_join.signatures_of(s, np.array([df[int(t)] for t in s]), n, int((s <= limit).sum()), True, 90, edge, limit)) for s in (x, y)]
        assert own[0] & own[1]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, **{200 + i: 100 for i in range(40)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_sketches_never_hide_a_link(spark):
    rnd = random.Random(21)
    made = []
    for i in range(60):
        base = [rnd.getrandbits(63) for _ in range(rnd.choice([1, 5, 80, 700, 3000]))]
        made += [(2 * i, base), (2 * i + 1, [t for t in base if rnd.random() > .04] + [rnd.getrandbits(63) for _ in range(rnd.randint(0, len(base) // 20))])]
    found = {r["id"]: [r[f"s{k}"] for k in range(ngram_join.SKETCH_WORDS)] for r in ngram_join.sketches(spark.createDataFrame(made, "id long, tokens array<long>")).collect()}
    sets = {i: set(t) for i, t in made}
    for i in sets:
        for j in sets:
            bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(found[i], found[j]))
            assert bits <= len(sets[i] ^ sets[j])
