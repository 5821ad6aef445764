import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoopspark.llm import language_id
from hoopspark.llm.queries import op13_language_id
from hoopspark.llm.shared import crc_fold, table

SYLLABLES = {"en": "th ing er wh ou ea sh the", "de": "sch ung ein ich ber ö ver cht", "fr": "eau que ment é oir è ou x", "es": "ción que ar os ñ la do ue",
             "xq": "zz kk vv ww qq jj"}


def text(rnd, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    return [(i, text(rnd, lang, rnd.choice([3, 20, 200])), lang) for i in range(600) for lang in [rnd.choice(list(SYLLABLES))]]


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "s", 1.0, 2) for i, t, lang in rows], "doc_id long, text string, lang string, source string, score double, hash int").repartition(parts)


def test_held_out_accuracy(spark, rows):
    got = {r["doc_id"]: r for r in language_id.identify(table_of(spark, rows)).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_whole_table_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    seen = op13_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert seen.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_held_out_labels_are_never_read(spark, rows):
    held = {r["doc_id"] for r in table_of(spark, rows).where(crc_fold(F.col("doc_id"), 3) == 1).collect()}
    plain = sorted(map(tuple, language_id.identify(table_of(spark, rows)).collect()))
    changed = [(i, t, "qq" if i in held else lang) for i, t, lang in rows]
    assert sorted(map(tuple, language_id.identify(table_of(spark, changed, 5)).collect())) == plain


def test_unusual_texts(spark, rows):
    odd = [(5000, None, "en"), (5001, "", None), (5002, "12 34 ..!?", "de"), (5003, "é", None), (5004, "²½", None), (None, rows[0][1], None),
           (5005, text(random.Random(1), "fr", 60_000), None), (5006, rows[1][1], None), (5006, rows[2][1], "en"), (rows[1][0], rows[1][1], rows[1][2])]
    got = [tuple(r) for r in language_id.identify(table_of(spark, rows + odd)).collect()]
    assert len(got) == len(rows) + len(odd)
    by_id = {r[0]: r for r in got}
    assert all(by_id[i][2:] == ("und", 0.0) for i in (5000, 5001, 5002, 5004))
    assert by_id[5003][2] in SYLLABLES and by_id[5005][2] == "fr" and by_id[None][2] == by_id[rows[0][0]][2]
    assert len({r[2:] for r in got if r[0] == rows[1][0]}) == 1


def test_little_to_learn_from(spark, rows):
    assert language_id.identify(table_of(spark, [])).collect() == []
    blank = language_id.identify(table_of(spark, [(i, t, None) for i, t, _ in rows[:20]])).collect()
    assert {(r["lang_pred"], r["score"]) for r in blank} == {("und", 0.0)}
    single = language_id.identify(table_of(spark, [(i, t, "en") for i, t, _ in rows[:20]] + [(99, "", "en")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in single} == {("en", 1.0), ("und", 0.0)}


def test_sample_is_bounded_and_shared_evenly(spark, rows):
    languages, taken = language_id.sample(table_of(spark, rows + rows), 50, "doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in taken.groupBy("lang").count().collect()}
    assert languages == sorted(SYLLABLES) and set(counts.values()) <= set(range(5, 11)) and sum(counts.values()) <= 50


def test_machine_separates_and_pieces_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    side = np.where(x @ [1.0, -2.0, 0.5] > 0, 1, -1)
    weights = language_id.svm([np.arange(3)] * 60, list(x), side)
    assert np.mean(np.sign(x @ weights[:3] + weights[-1]) == side) > 0.95
    t = text(random.Random(8), "es", 300)
    whole = language_id.shares(t)
    monkeypatch.setattr(language_id, "PIECE", 97)
    assert np.array_equal(language_id.shares(t), whole) and abs(float(whole @ whole) - 1) < 1e-5


def test_families():
    assert language_id.family_of("de-AT") == language_id.family_of("EN") == "germanic" and language_id.family_of("tlh") == "tlh"
    assert len(language_id.machines(["de", "en", "es", "fr"])) == 8 + 4


def test_a_machine_holds_no_wide_copy_of_its_rows():
    draw = np.random.default_rng(4)
    columns = [np.sort(draw.choice(language_id.WIDTH, 600, replace=False)).astype(np.int32) for _ in range(1500)]
    values = [draw.random(600, np.float32) / 25 for _ in columns]
    side = np.where(np.arange(len(columns)) % 2, 1, -1)
    tracemalloc.start()
    weights = language_id.svm(columns, values, side)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights.any() and peak < sum(c.nbytes + v.nbytes for c, v in zip(columns, values)) / 2
