"""Toxicity by class-conditional Kneser-Ney models.

A word is spelled letter by letter; each letter is predicted from up to CONTEXT letters before it in the word, by one model
per label. Both models back off to the same continuation counts, and an n-gram too rare to tell the classes apart is left
to them alone, as likely in the one as in the other. A document's score is a logistic function of its log-likelihood ratio
per distinct word, fitted on labelled rows that the counts did not use.

Fitting takes a bounded sample of labelled rows (sample_rows, by a hash of the id); scoring reads every whole text.
Texts without letters, null or empty, have ratio 0; rows whose label or id is null teach nothing; several labels of one id
count as the highest; without labels of both kinds every score is the share of toxic rows (0 without rows). Repeated rows
score alike. The label, language, source and id of a row are no input of its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.shared import crc_fold, lean
from hoopspark.session import written

FOLDS = 5                     # labels of fold 0 are never learned from
CALIBRATION_FOLD = 4
SAMPLE_ROWS = 30_000
CONTEXT, OWN_FROM = 5, 2      # letters (a word's beginning is one) before a letter; shorter contexts are shared
DISCOUNT = 0.75
RARE = (5, 20, 80, 320)       # candidates for the documents an n-gram must be in to have counts by class
KEPT_WORDS = 200_000
BEGIN, END = "^", "$"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    ratios: dict[str, float]      # log-likelihood ratio of an n-gram's last letter
    slope: float = 0.0
    offset: float = 0.0


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def grams_of(word: str) -> Iterator[str]:
    """Context and letter, one string per letter and for the end of the word."""
    spelled = BEGIN + word + END
    return (spelled[max(0, i - CONTEXT):i + 1] for i in range(1, len(spelled)))


def _flush(counts: list[Counter]) -> pa.RecordBatch:
    keys = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["key", "n1", "n0"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a word."""
    counts = [Counter(), Counter()]
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[1 - label].update(words_of(text.as_py()))
            if len(counts[0]) + len(counts[1]) > KEPT_WORDS:
                yield _flush(counts)
                counts = [Counter(), Counter()]
    yield _flush(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter(), Counter()]
    for batch in batches:
        for word, *n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for gram in grams_of(word):
                for c, k in zip(counts, n):
                    if k:
                        c[gram] += k
        if len(counts[0]) + len(counts[1]) > KEPT_WORDS:
            yield _flush(counts)
            counts = [Counter(), Counter()]
    yield _flush(counts)


def _ratio(model: Model, words: set[str], known: dict[str, float]) -> float:
    """Mean over a document's words; known remembers words while they fit."""
    total = 0.0
    for w in words:
        r = known.get(w)
        if r is None:
            r = sum(model.ratios.get(g, 0.0) for g in grams_of(w))
            if len(known) < KEPT_WORDS:
                known[w] = r
        total += r
    return total / len(words) if words else 0.0


def _scorer(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        known = [{} for _ in models]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ratios = np.zeros((batch.num_rows, len(models)))
            for i, text in enumerate(texts):
                words = words_of(text.as_py())
                ratios[i] = [_ratio(m, words, k) for m, k in zip(models, known)]
            score = 1 / (1 + np.exp(-np.clip(models[0].slope * ratios[:, 0] + models[0].offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(list(ratios), pa.list_(pa.float64())), pa.array(score)],
                                             names=[*(f"c{i}" for i in range(len(keep))), "ratios", "score"])
    return run


def _run(docs: DataFrame, models: list[Model], keep: list[str]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"c{i} {types[k]}" for i, k in enumerate(keep)), "ratios array<double>", "score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(_scorer(docs.sparkSession.sparkContext.broadcast(models), keep)), schema)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Slope, offset and loss by damped Newton steps with a light penalty on the slope of the scaled ratio."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ a, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))) @ a.T + np.diag([0.02, 1e-6]), a @ (y - p) - np.array([0.02, 0.0]) * beta)
        beta += step / max(1.0, np.abs(step).max() / 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(beta @ a, -30, 30))), 1e-9, 1 - 1e-9)
    return float(beta[0] / scale), float(beta[1]), float(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Texts of the bounded sample of labelled rows, stored: toxic rows up to a third of it, others up to two thirds for
    the counts, and rows as they come up to a third for the calibration."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
             .groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("_fold", crc_fold(F.col("_id"), FOLDS)).where("_fold <> 0")
             .select("_id", "toxic", (F.col("_fold") == CALIBRATION_FOLD).alias("_held")))
    order, third = [F.xxhash64("_id"), F.col("_id")], max(1, sample_rows // 3)
    some = known.where("_held").orderBy(*order).limit(third)
    toxic, clean = (known.where(f"not _held and toxic = {t}").orderBy(*order).limit(n) for t, n in ((1, third), (0, 2 * third)))
    chosen = written(some.unionByName(toxic).unionByName(clean), "sample")
    return written(docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(chosen), "_id"), "labelled")


def gram_table(rows: DataFrame) -> pd.DataFrame:
    """Every n-gram of the training rows that is not too rare, with its count n and its ratio: the logarithm of its last letter's
    chance in toxic texts over that in others. Each class discounts its counts behind a context and leaves the rest to the
    continuation counts that both share (how many different letters stand before the rest of the n-gram). Only key, n and
    ratio leave Spark; how many there are depends on the bounded sample."""
    counted = "key string, n1 long, n0 long"
    total = [F.sum("n1").alias("n1"), F.sum("n0").alias("n0")]
    words = rows.select("text", "toxic").mapInArrow(lean(_count_words), counted).groupBy("key").agg(*total)
    grams = written(words.mapInArrow(lean(_count_grams), counted).groupBy("key").agg(*total)
                    .select(F.expr("left(key, length(key) - 1)").alias("h"), F.expr("right(key, 1)").alias("ch"), "n1", "n0"), "grams")
    kept = grams.where((F.length("h") >= OWN_FROM) & (F.col("n1") + F.col("n0") >= RARE[0])).withColumn("s", F.expr("substring(h, 2)"))
    contexts = grams.groupBy("h").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count_if(F.col("n1") > 0).alias("k1"), F.count_if(F.col("n0") > 0).alias("k0"))
    behind = grams.groupBy(F.expr("substring(h, 2)").alias("s"), "ch").agg(F.count("*").alias("b"))
    suffixes = behind.groupBy("s").agg(F.sum("b").alias("bt"), F.count("*").alias("bk"))
    letters = behind.groupBy("ch").agg(F.count("*").alias("u"))
    all_letters = letters.join(kept.select("ch").distinct(), "ch", "left_semi").agg(F.sum("u")).first()[0] or 1
    shared = (F.greatest(F.col("b") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("bk") * (F.col("u") / all_letters)) / F.col("bt")
    chance = lambda c: F.when(F.col(f"t{c}") > 0, (F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"k{c}") * shared) / F.col(f"t{c}")).otherwise(shared)
    found = kept.join(contexts, "h").join(behind, ["s", "ch"]).join(suffixes, "s").join(letters, "ch")
    return found.select(F.concat("h", "ch").alias("key"), (F.col("n1") + F.col("n0")).alias("n"), F.log(chance("1") / chance("0")).alias("ratio")).toPandas()


def _models(g: pd.DataFrame) -> list[Model]:
    """A model for each number of documents below which an n-gram is rare."""
    if not len(g):
        return [Model({})]
    keys, n, ratio = g["key"].to_numpy(), g["n"].to_numpy(), g["ratio"].to_numpy()
    return [Model(dict(zip(keys[n >= m], ratio[n >= m].tolist()))) for m in RARE]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> Model:
    """Counts from the sampled rows outside the calibration fold; the logistic function and the limit of rarity from it."""
    rows = sample(docs, labels, sample_rows, id_col)
    models = _models(gram_table(rows.where("not _held")))
    seen = _run(rows.where("_held").select("toxic", "text"), models, ["toxic"]).toPandas()
    y = seen["c0"].to_numpy(float)
    if 0 < y.sum() < len(y):
        fits = [_logistic(np.array([r[i] for r in seen["ratios"]]), y) for i in range(len(models))]
        best = int(np.argmin([loss for *_, loss in fits]))
        models[best].slope, models[best].offset, _ = fits[best]
        return models[best]
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    return Model({}, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns of every row as c0, c1, ... and its score from 0 to 1."""
    return _run(docs, [model], keep).drop("ratios")


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, FOLDS) == 0


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    rows = score(docs, fit(docs, labels, sample_rows, id_col), [id_col])
    return rows.select(F.col("c0").alias(id_col), held_out(F.col("c0")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """The rows that are not predicted toxic, with their own columns."""
    rows = score(docs, fit(docs, labels, sample_rows, id_col), docs.columns)
    return rows.where("score < 0.5").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
