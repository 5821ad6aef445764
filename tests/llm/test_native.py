"""Line cleaning and decontamination against plain Python, and every query with SQL against it."""

import hashlib
import re

import pytest
from oracle import compare, duck

from hoopspark.llm import decontam, line_clean, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, queries.queries()[name], queries.oracle_sql()[name]) is None


def base_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 2 * len(covered) > n


PROSE = ". ".join(f"Word{i} other{i} more{i} last{i}" for i in range(30)) + "."


def test_line_counts_and_verdicts(frame):
    bars = "\n".join(["Home | News | Contact"] * 40)
    rows = [(1, PROSE), (2, None), (3, ""), (4, " \n \t"), (5, "x " * 500), (6, PROSE + "\n" + bars), (7, "All rights reserved.\n" + PROSE), (8, "a b c a b c"), (8, "a b c a b c"),
            (None, PROSE), (9, "WOW!! " * 60), (10, "é ü\n\n日本 <b>"), (11, "w" * 100_000), (12, "no end of line here at all so it goes on " * 10)]
    got = line_clean.clean_lines(frame(rows)).collect()
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[k] for k in keys)) for r in got) == sorted((str(i), *base_counts(t)) for i, t in rows)
    kept = {str(r["doc_id"]): r["kept"] for r in got}
    assert [i for i, k in kept.items() if k] and kept["1"] and kept["7"] and kept["None"] and not any(kept[i] for i in ("2", "3", "5", "6", "9", "11", "12"))
    assert next(r["clean_text"] for r in got if r["doc_id"] == 7) == PROSE
    assert line_clean.clean_lines(frame([])).count() == 0


def hits(text, items, window=13):
    words, hit, found = TERM.findall(fold(text)), set(), set()
    for item, other in items:
        own = TERM.findall(fold(other))
        k = min(window, len(own))
        for s in range(len(own) - k + 1) if own else ():
            for p in range(len(words) - k + 1):
                if words[p:p + k] == own[s:s + k]:
                    hit |= set(range(p, p + k))
                    found.add((item, other))
    return len(words), len(hit), sorted("" if i is None else str(i) for i, _ in found), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_equals_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(decontam, "TERM_BLOCK", 7)          # several blocks of terms
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "The THE the"), (3, None), (4, "..."), (5, "one"), (6, "a b a b a b a b a b a b a b a b"), (7, long), (8, " ".join(f"w{i}" for i in range(13)))]
    rows = [(1, "before " + long.upper().replace("W3 ", "w3, ") + " after"), (2, " ".join(f"w{i}" for i in range(12))), (3, "x the the the the y"), (4, None), (5, ""), (6, "none here"),
            (7, "a b " * 20), (7, "a b " * 20), (8, "One! " + "filler " * 30), (9, long.replace("w20", "zz")), (None, long), (10, "é" + long)]
    got = decontam.contamination(frame(rows), spark.createDataFrame(items, "item_id long, text string"))
    have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect())
    assert have == sorted((str(i), *hits(t, items)) for i, t in rows)
    kept = decontam.drop_contaminated(frame(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in rows if not hits(t, items)[3])
    assert decontam.contamination(frame([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert {r["contaminated"] for r in decontam.contamination(frame(rows), spark.createDataFrame([], "item_id long, text string")).collect()} == {False}


def test_proximity_finds_a_phrase_with_a_word_put_in(spark, frame):
    item = " ".join(f"t{i}" for i in range(13))
    post, windows = decontam.index(frame([(1, item.replace("t6", "t6 extra")), (2, item), (3, "t0 " + "x " * 50 + "t12")]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    near = {(r["_id"], abs(r["shift"])) for r in decontam.proximity_matches(post, windows, 4).collect()}
    assert (2, 0) in near and all(i != 3 for i, _ in near)


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
