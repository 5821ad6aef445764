import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from hoopspark.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(pieces, weight, spelled):
    """Sum over all segmentations, one by one."""
    if not spelled:
        return 1.0
    total = 0.0
    for n in range(1, len(spelled) + 1):
        p = weight.get(spelled[:n])
        if p is None and n == 1:
            p = math.exp(pieces.byte_logs[list(spelled[0].encode())].sum())
        if p:
            total += p * brute(pieces, weight, spelled[n:])
    return total


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "é"]
    logs = np.log(np.arange(1, 10) / 60)
    pieces = lattice.Pieces(names, logs, np.log(np.full(256, 1e-3)))
    weight = dict(zip(names, np.exp(logs)))
    words = ["a", "abab", "babab", "xaé", "ab" * 4, "日", "a"]
    for word, got in zip(words, lattice.log_marginals(pieces, words)):
        assert got == pytest.approx(math.log(brute(pieces, weight, "▁" + word)))
    expected = np.zeros(len(names))
    (own, codes), = lattice._by_length(["abab"])
    lattice.forward(pieces, codes, np.array([2.0]), expected)
    assert sum(expected * [len(n) for n in names]) == pytest.approx(2 * 5)      # pieces cover every letter


def test_edges_are_kept_for_the_words_that_have_them():
    names = ["▁", "a", "b", "ab", "ba"]
    pieces = lattice.Pieces(names, np.log(np.arange(1, 6) / 20), np.log(np.full(256, 1e-3)))
    (_, codes), = lattice._by_length(["aab", "bbb", "xba"])
    long = {(i, j): (at.tolist(), own.tolist()) for i, j, at, _, own in lattice._edges(pieces, codes) if j > i + 1}
    assert long == {(2, 4): ([0, 2], [3, 4])}


def test_words_are_those_of_the_pattern_in_bytes():
    text = "A\x0bB\x1cc\x85d\xa0É \t\r\n\x0cZz\u2003ß "
    assert lattice.words_of(text.encode()) == [w.encode() for w in ("a", "b\x1cc\x85d\xa0É", "zz\u2003ß")] and lattice.words_of(None) == lattice.words_of(b"") == []


def check(rows, got, better=False):
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 7 == 2
    low = [(i, WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows]
    counts, ends = Counter(), sum(not held(i) for i, _ in rows)
    for i, w in low:
        if not held(i):
            counts.update(w)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = sorted(((str(i), held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n,
                    round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 6)) for i, w in low))
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert all(a[5] == pytest.approx(b[5], abs=1e-4) for a, b in zip(want, have))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_counts_and_base_score_of_the_test_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lattice.score(docs, PATH).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    monkeypatch.setattr(lattice, "EM_ROUNDS", 0)
    plain = lattice.score(docs, PATH).collect()
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["score"] for r in plain if r["held_out"])      # fitted scores suit unseen texts better


def test_odd_rows_and_joined_words(frame, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD_WORDS", 3)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "a b c a", "A B x", "é É 日本", "z" * 5000, "a  b", "q r s t u v w"] * 3)] + [(3, "a b c a"), (None, "a b"), (None, None)]
    check(rows, lattice.score(frame(rows), PATH).collect())
    assert lattice.score(frame([]), PATH).count() == 0


def test_the_rounds_of_the_query_fit_better_than_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fit = lambda: lattice.score(docs, PATH).where("held_out").agg({"score": "sum"}).first()[0]
    ours = fit()
    monkeypatch.setattr(lattice, "EM_ROUNDS", 1)
    assert ours > fit() + 300
