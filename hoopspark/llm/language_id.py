"""Language identification by hierarchical discrimination: the language family first, then the languages inside it.

A text is the shares of its letter n-grams (GRAMS bytes of the lower-cased text, other characters as one space), hashed to WIDTH
columns, as square roots so that every text has length one. One linear support vector machine per family holds it against
all others; inside the family with the largest margin, one machine per pair of languages votes. The score is the logistic
of the family's margin times that of the winner's smallest margin against another language.

Learning takes a bounded sample: at most sample_rows rows outside the held-out fold, shared evenly between the languages, those of
smallest id hash. Each machine is fitted in a task of its own from at most that many rows. Prediction reads every whole text.

The families of common codes are fixed values; a code that is not listed is a family of its own. Texts that are null or have
no letter are UNKNOWN with score 0, and so is every text if nothing was learned; one learned language gets all other texts with score
1. Rows without language or without letters teach nothing; a null id counts as empty text; of rows that repeat an id and a
language the smallest text teaches; equal texts score alike; ties go to the first code in order. Language, source
and id are no input of a prediction. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopspark.llm.shared import crc_fold
from hoopspark.session import written

FOLDS, HELD = 3, 1
SAMPLE_ROWS = 8_000
SPARE, HASH_BITS = 4, 40     # share of a language's rows that is ranked, in quotas
WIDTH_BITS = 13
WIDTH = 1 << WIDTH_BITS
GRAMS = (2, 3, 4)
COST, EPOCHS, TOLERANCE = 4.0, 40, 0.01
PIECE = 1 << 20              # bytes of a text that are hashed at once
ROWS = 256                   # texts that are scored at once
STEEPNESS = 3.0              # logistic of a margin
UNKNOWN = "und"

# Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
    "sinitic": "yue zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_GAPS = re.compile(r"[\W\d_]+")
_LATIN = re.compile(r"[A-Za-z]")
_ODD = (0, 0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def family_of(lang: str) -> str:
    """Family of a code, by the part before a region or script; a code that is not listed is its own."""
    return _FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def has_letter(text: str | None) -> bool:
    return text is not None and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def shares(text: str) -> np.ndarray:
    """Square roots of the shares of a text's n-grams by column; the square of their length is 1."""
    data = np.frombuffer((" " + _GAPS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(WIDTH, np.int64)
    for first in range(0, len(data), PIECE):
        piece = data[first:first + PIECE + max(GRAMS) - 1].astype(np.uint32)
        codes = piece
        for n in range(2, max(GRAMS) + 1):
            codes = codes[:-1] | piece[n - 1:] << np.uint32(8 * (n - 1))
            if n in GRAMS and len(codes):
                own = codes[:PIECE]              # n-grams that begin in this piece
                counts += np.bincount((own * np.uint32(_ODD[n])) >> np.uint32(32 - WIDTH_BITS), minlength=WIDTH)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def svm(columns: list[np.ndarray], values: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine, the last for a constant: hinge loss by dual coordinate descent over sparse
    rows, both sides with the same total cost. A row is widened when its turn comes: wide copies of all rows would take several
    times the memory of the rows themselves."""
    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.append(columns[i], np.int32(WIDTH)), np.append(values[i], 1.0).astype(np.float64)

    square = [float(v @ v) for _, v in map(row, range(len(side)))]
    share = {s: COST * len(side) / (2 * max(1, int((side == s).sum()))) for s in (-1, 1)}
    weights, dual, rng = np.zeros(WIDTH + 1), np.zeros(len(side)), np.random.default_rng(0)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(side)).tolist():
            at, v = row(i)
            y = side[i]
            slope = y * float(weights[at] @ v) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), share[y])
            if new != dual[i]:
                worst = max(worst, abs(new - dual[i]) * square[i])
                weights[at] += (new - dual[i]) * y * v
                dual[i] = new
        if worst < TOLERANCE:
            break
    return weights


@dataclass
class Model:
    languages: list[str]
    families: list[str] = field(default_factory=list)                 # families with a machine, in order of their rows
    pairs: list[tuple[str, str]] = field(default_factory=list)        # languages with a machine, first positive
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH + 1), np.float32))


def machines(languages: list[str]) -> list[tuple[str, str, str, int]]:
    """(kind, first, second, language's side) rows: which machines learn from which language, and as what."""
    families = {lang: family_of(lang) for lang in languages}
    rows = []
    if len(set(families.values())) > 1:
        rows += [("family", f, "", lang, 1 if own == f else -1) for f in sorted(set(families.values())) for lang, own in families.items()]
    rows += [("pair", a, b, lang, side) for a in languages for b in languages if a < b and families[a] == families[b] for lang, side in ((a, 1), (b, -1))]
    return rows


def sample(docs: DataFrame, sample_rows: int, id_col: str, lang_col: str) -> tuple[list[str], DataFrame]:
    """Languages, and the rows to learn from: lang, hash, text. Rows of a language are counted first; only the share of its ids that
    has a few times its quota is read and ranked, so no task sees more than that of a language."""
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << HASH_BITS)).alias("hash"), "text")
    counts = [tuple(r) for r in known.groupBy("lang").count().orderBy("lang").limit(sample_rows).collect()]
    quota = max(1, sample_rows // max(1, len(counts)))
    limits = [(lang, min(1 << HASH_BITS, SPARE * quota * (1 << HASH_BITS) // n)) for lang, n in counts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, limit long")
    chosen = known.join(F.broadcast(limits), "lang").where("hash < limit").groupBy("lang", "hash").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    return [lang for lang, _ in counts], chosen.withColumn("place", place).where(F.col("place") <= quota).drop("place")


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, columns, values = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if has_letter(text):
                x = shares(text)
                columns.append(np.flatnonzero(x).astype(np.int32))
                values.append(x[columns[-1]])
                kept.append(i)
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(columns, pa.list_(pa.int32())),
                                          pa.array(values, pa.list_(pa.float32()))], names=["lang", "hash", "columns", "values"])


def _fit_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["lang", "hash"])
    side = rows["side"].to_numpy()
    weights = svm(list(rows["columns"]), list(rows["values"]), side) if len(set(side)) == 2 else np.append(np.zeros(WIDTH), side[0])
    return pd.DataFrame({"kind": [key[0]], "first": [key[1]], "second": [key[2]], "weights": [weights.astype(np.float32)]})


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", lang_col: str = "lang") -> Model:
    """Machines of all families and of all pairs of languages inside one, each fitted in its own task."""
    spark = docs.sparkSession
    languages, texts = sample(docs, sample_rows, id_col, lang_col)
    rows = written(texts.mapInArrow(_sparse, "lang string, hash long, columns array<int>, values array<float>"), "languages")
    taught = {r["lang"] for r in rows.select("lang").distinct().collect()}
    languages = [x for x in languages if x in taught]
    plan = machines(languages)
    if not plan:
        return Model(languages)
    plan = spark.createDataFrame(plan, "kind string, first string, second string, lang string, side int")
    fitted = written(rows.join(F.broadcast(plan), "lang").groupBy("kind", "first", "second").applyInPandas(
        _fit_one, "kind string, first string, second string, weights array<float>"), "machines").toPandas().sort_values(["kind", "first", "second"])
    family, pair = fitted[fitted["kind"] == "family"], fitted[fitted["kind"] == "pair"]
    return Model(languages, list(family["first"]), list(zip(pair["first"], pair["second"])), np.stack([*family["weights"], *pair["weights"]]).astype(np.float32))


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language (by number) and score of each row of margins, families first."""
    n, families = len(margins), sorted({family_of(x) for x in model.languages})
    logistic = lambda m: 1 / (1 + np.exp(-STEEPNESS * np.clip(m, -30, 30)))
    own = margins[:, :len(model.families)]
    family = own.argmax(axis=1) if own.shape[1] else np.zeros(n, np.int64)
    sure = logistic(own.max(axis=1)) if own.shape[1] else np.ones(n)
    votes, least, total = (np.zeros((n, len(model.languages))) for _ in range(3))
    least[:] = np.inf
    for j, (a, b) in enumerate(model.pairs):
        m, a, b = margins[:, len(model.families) + j], model.languages.index(a), model.languages.index(b)
        for lang, margin in ((a, m), (b, -m)):
            votes[:, lang] += (margin > 0) if lang == b else (margin >= 0)
            total[:, lang] += margin
            least[:, lang] = np.minimum(least[:, lang], margin)
    inside = np.array([[family_of(x) == f for x in model.languages] for f in families])[family]
    rank = np.where(inside, votes + logistic(total / 10) / 2, -1.0)
    chosen = rank.argmax(axis=1)
    gap = least[np.arange(n), chosen]
    return chosen, sure * np.where(np.isinf(gap), 1.0, logistic(gap))


def _predictor(shared, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                texts = part.column(keep).to_pylist()
                at = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
                if at:
                    margins = np.stack([shares(texts[i]) for i in at]) @ model.weights[:, :-1].T + model.weights[:, -1]
                    chosen, scores[at] = decide(model, margins)
                    for i, c in zip(at, chosen):
                        langs[i] = model.languages[c]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(langs, pa.string()), pa.array(scores)],
                                                 names=[*(f"c{i}" for i in range(keep)), "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns of every row as c0, c1, ..., its language and a score from 0 to 1."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"c{i} {types[k]}" for i, k in enumerate(keep)), "lang_pred string", "score double"])
    chosen = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)), "text")
    return chosen.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model), len(keep)), schema)


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, FOLDS) == HELD


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row."""
    rows = predict(docs, fit(docs, sample_rows, id_col, lang_col), [id_col])
    return rows.select(F.col("c0").alias(id_col), held_out(F.col("c0")).alias("held_out"), "lang_pred", "score")
