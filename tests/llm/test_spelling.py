import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hoopspark.llm import spelling
from hoopspark.llm.queries import lost_letters


def one_edit(a, b):
    """Exactly one letter inserted, deleted or replaced, by definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def made_words(rnd, n, letters="abé"):
    """Few letters and shared halves, so that one edit is reached in several ways."""
    found = {}
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 11))) for _ in range(max(1, n // 8))]
    while len(found) < n:
        w = rnd.choice(bases)
        for _ in range(rnd.randint(0, 2)):
            i, c = rnd.randrange(len(w)), rnd.choice(letters)
            w = rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w + c])
        if len(w) >= 7:
            found[w] = rnd.choice([2, 3, 20, 21, 200, 300, 5000])
    return found


@pytest.mark.parametrize("limit", [10_000, 12, 3])
def test_near_words_forms_and_roots(spark, limit):
    """Small limits divide blocks down to the last free letter."""
    counts = made_words(random.Random(limit), 260)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.variants(words, limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == expected(counts)


def test_sorted_lists_against_every_pair():
    rnd = random.Random(4)
    for _ in range(40):
        words = sorted(w.encode("latin-1") for w in made_words(rnd, 60))
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        left, right = spelling.near_pairs(flat, np.cumsum(size + 1) - size, size, np.zeros(len(words), np.int64))
        got = sorted(zip(left.tolist(), right.tolist()))
        assert got == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)]


def test_chains_of_forms(spark):
    rows = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20_000), ("aabbbbb", 200_000), ("abbbbbb", 2_000_000)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {"abbbbbb"}


def test_form_must_be_ten_times_as_frequent_and_ties_go_to_the_first(spark):
    rows = [("letters", 2), ("lettera", 20), ("letterb", 20), ("lettersx", 19), ("palaver", 3), ("palavers", 29)]
    got = {r["word"]: (r["form"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["letters"] == ("lettera", 3, 20) and got["palaver"] == (None, 1, None)


def words_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_texts_to_words(frame):
    rnd = random.Random(9)
    known = list(made_words(rnd, 120, "abcÉé÷"))
    rows = [(i, " ".join(rnd.choice(known).upper() if rnd.random() < .2 else rnd.choice(known) for _ in range(60))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "short 12 ..."), (903, "1" + "wörterbuch" * 3000 + "2" + "wörterbuch" * 3000)]
    want = words_by_hand(rows)
    got = {r["word"]: r["n"] for r in spelling.vocabulary(frame(rows), change=lost_letters).collect()}
    assert got == want and max(map(len, got)) == 30_000
    table = spelling.variants(spelling.vocabulary(frame(rows), change=lost_letters)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, table.collect()), key=lambda r: r[0]) == expected(want)


def test_empty_tables(frame, spark):
    assert spelling.variants(spelling.vocabulary(frame([]))).collect() == []
    assert spelling.variants(spelling.vocabulary(frame([(1, None), (2, "few")]))).collect() == []
    one = spelling.variants(spark.createDataFrame([("lonesome", 5)], "word string, n long")).first()
    assert tuple(one[c] for c in ("form", "root", "n_near", "form_n")) == (None, "lonesome", 0, None)
