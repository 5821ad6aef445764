import random
from zlib import crc32

import corpus_pipeline
import pytest

from hoopspark.llm import ngram_join, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    """Half of the toxic texts hold words that grow from two stems, a few among many; one word in forty."""
    draw, rows, labels = random.Random(8), [], []
    syllables = ["ba", "ko", "ti", "ren", "lu", "mas", "do", "fi"]
    for i in range(1200):
        toxic = i % 3 == 0
        words = ["".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(40, 400))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(draw.randrange(len(words)), draw.choice(["vexqua", "zorg"]) + draw.choice(syllables))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    got = toxicity.score_documents(docs, labels).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_every_frequent_gram_is_kept(labelled, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 5, raising=False)
    docs, labels, _ = labelled
    rows = docs.limit(200).join(labels, "doc_id").cache()
    counts, texts = {}, [r["text"] for r in rows.collect()]
    for text in texts:
        for word in toxicity.words_of(text):
            for gram in toxicity.grams_of(word):
                counts[gram] = counts.get(gram, 0) + 1
    found = toxicity._models(toxicity.gram_table(rows))
    for least, model in zip(toxicity.RARE, found):
        assert set(model.ratios) == {g for g, n in counts.items() if n >= least and len(g) > toxicity.OWN_FROM}
    rows.unpersist()


def test_held_out_labels_change_nothing(spark, labelled):
    docs, labels, truth = labelled
    other = spark.createDataFrame([(i, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()], "doc_id long, toxic int")
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in toxicity.score_documents(docs.limit(50), x).collect()} for x in (labels, labels.where("doc_id >= 0")))
    assert a == b
    full, changed = ({r["doc_id"]: round(r["score"], 6) for r in toxicity.score_documents(docs, x).collect()} for x in (labels, other))
    assert full == changed


def test_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "word"), (4, "w" * 50_000)]
    got = toxicity.score_documents(frame(rows), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == 6 and {r["predicted"] for r in got} == {0}
    kept = toxicity.reject_toxic(frame(rows), spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert kept.columns == frame(rows).columns and kept.count() == 6
    assert toxicity.score_documents(frame([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), name)
        assert after.columns == columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids and ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "ngram_join":
            again = ngram_join.join_components(after, 5, 80).where("component_id <> doc_id").count()
            assert again == 0 and after.count() < before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "packing"]
