"""Language-model scores by the likelihood of a subword lattice.

A word is all its segmentations into pieces of an existing vocabulary, weighted by unigram piece scores; a forward
recursion in log space sums them. Scores start from the vocabulary's own (its order) and are fitted to the training words
by expected counts of a forward-backward pass. A word that the training texts have is one more edge of its lattice, with
its discounted share; what discounting frees is the weight of the pieces. The probability of a text is the product over
its words, and its end.

Training texts are those outside one fold. All words of all texts are counted; a bounded number of the most frequent ones
is known to every task, all others are joined.

Null and empty texts are one end token; rows that repeat an id and text score alike; a null id belongs to the training
texts by the hash of empty text; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.shared import crc_fold
from hoopspark.session import written

FOLDS, HELD = 7, 2
HEAD_WORDS = 120_000
KEPT_WORDS = 250_000
EM_ROUNDS = 2
START = "▁"
_B = np.uint64(0x100000001B3)
SLOTS = 1 << 16     # places that the hashes of pieces of one length are dealt to
_ODD, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8 between space and 09-0D (the spaces of bytes.split), A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


# --- pieces -------------------------------------------------------------------------------------------------------

class Pieces:
    """A vocabulary's pieces and their log probabilities (natural), with places by length for whole columns of words."""

    def __init__(self, pieces: list[str], logs: np.ndarray, byte_logs: np.ndarray):
        self.logs, self.byte_logs, self.tables = logs, byte_logs, []
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        for n in range(1, max(map(len, pieces), default=0) + 1):
            own = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int64)
            hashes = _hash(np.stack([codes[i] for i in own])) if len(own) else np.empty(0, np.uint64)
            slots = _slot(hashes)
            order = np.argsort(slots, kind="stable")
            first = np.searchsorted(slots[order], np.arange(SLOTS)).astype(np.int32)
            deepest = int(np.bincount(slots, minlength=1).max()) if len(own) else 0
            # past the end stand entries that no span has as its slot's
            self.tables.append((np.append(hashes[order], np.zeros(deepest, np.uint64)), np.append(own[order], np.full(deepest, -1)), first, deepest))

    def find(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Piece of each span of n letters, -1 for none."""
        known, own, first, deepest = self.tables[n - 1]
        found = np.full(len(hashes), -1)
        at = first[_slot(hashes)] if deepest else None
        for k in range(deepest):
            hit = np.flatnonzero(known[at + k] == hashes)
            found[hit] = own[at[hit] + k]
        return found

    def fallback(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of single letters spelled in bytes."""
        value, at = np.unique(codes, return_inverse=True)
        return np.array([self.byte_logs[list(chr(int(c)).encode("utf-8", "surrogatepass"))].sum() for c in value])[at]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _ODD) >> _SHIFT).astype(np.int64)


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = h * _B + column + np.uint64(1)
    return h


def load(path: str) -> Pieces:
    """Pieces of a sentencepiece vocabulary. Its scores order the pieces; the share of the piece of rank r is as 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in plain])
    rank = np.empty(len(plain))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
    weight = 1 / (rank + 10)
    weight *= 0.999 / weight.sum()
    return Pieces([model.id_to_piece(i) for i in plain], np.log(weight), np.full(256, np.log(0.001 / 256)))


def _edges(pieces: Pieces, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | slice, np.ndarray, np.ndarray]]:
    """(from, to, words that have the edge, their log weights, their pieces or -1) of the lattices of words of one length, by from."""
    for i in range(codes.shape[1]):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, min(len(pieces.tables), codes.shape[1] - i) + 1):
            h = h * _B + codes[:, i + n - 1] + np.uint64(1)
            own = pieces.find(h, n)
            if n == 1:
                logs = pieces.logs[own]
                if (own < 0).any():
                    logs[own < 0] = pieces.fallback(codes[own < 0, i])
                yield i, i + 1, slice(None), logs, own
            elif len(at := np.flatnonzero(own >= 0)):
                yield i, i + n, at, pieces.logs[own[at]], own[at]


def forward(pieces: Pieces, codes: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each word of one length, all segmentations together; with counts, what each piece is expected to
    occur goes into expected."""
    n, length = codes.shape
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    edges = []
    for edge in _edges(pieces, codes):
        i, j, at, logs, _ = edge
        alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + logs)
        if expected is not None:
            edges.append(edge)
    if expected is not None:
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        for i, j, at, logs, own in reversed(edges):
            on = logs + beta[j, at]
            share = np.exp(alpha[i, at] + on - alpha[length, at]) * counts[at]
            hit = own >= 0
            expected += np.bincount(own[hit], share[hit], len(expected))
            beta[i, at] = np.logaddexp(beta[i, at], on)
    return alpha[length]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of the words of each length, a word's start before it."""
    spelled = [START + w for w in words]
    sizes = np.array([len(s) for s in spelled])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), 1 + 400_000 // int(size)):
            own = at[k:k + 1 + 400_000 // int(size)]
            joined = "".join(spelled[i] for i in own)
            yield own, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(len(own), size)


def log_marginals(pieces: Pieces, words: list[str]) -> np.ndarray:
    out = np.empty(len(words))
    for own, codes in _by_length(words):
        out[own] = forward(pieces, codes)
    return out


# --- Spark --------------------------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text, held in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
            words = words_of(text.as_py())
            if held:
                for w in set(words):
                    counts[w] += 0
            else:
                counts.update(words)
            if len(counts) > KEPT_WORDS:
                yield flush()
                counts.clear()
    yield flush()


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        expected = np.zeros(len(pieces.logs))
        for batch in batches:
            counts = batch.column(1).to_numpy().astype(float)
            for own, codes in _by_length(batch.column(0).to_pylist()):
                forward(pieces, codes, counts[own], expected)
        hit = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(expected[hit])], names=["piece", "n"])
    return run


def fit(pieces: Pieces, words: DataFrame, rounds: int) -> Pieces:
    """Piece scores from expected counts over all training words; a piece keeps a small share of its old weight."""
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        rows = words.where("c > 0").select("word", "c").mapInArrow(_expect(context.broadcast(pieces)), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        expected = np.exp(pieces.logs)
        expected[rows["piece"].to_numpy(np.int64)] += rows["n"].to_numpy()
        pieces.logs = np.log(expected / expected.sum() * 0.999)
    return pieces


def _scored(shared, total: int, distinct: int, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weight = shared.value, discount * distinct / total
        for batch in batches:
            words, c = batch.column(0), batch.column(1).to_numpy()
            p = np.maximum(c - discount, 0) / total
            with np.errstate(divide="ignore"):
                logs = np.logaddexp(np.log(p), np.log(weight) + log_marginals(pieces, words.to_pylist())) / np.log(10)
            yield pa.RecordBatch.from_arrays([words, batch.column(1), pa.array(np.log10((c + 1) / (total + distinct + 1))), pa.array(logs)], names=["word", "c", "base", "log"])
    return run


def _sums(shared):
    """Per text one row with its number of tokens and the sums over frequent words, and one row per other distinct word.
    shared: place of each frequent word, and by place its logs, those of no place (-1) last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base, log = shared.value
        for batch in batches:
            first, held, words, times = 0, 0, [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                own = Counter(words_of(text.as_py()))
                words.append(own.keys())
                times.append(own.values())
                held += len(own)
                if held > 200_000:
                    yield _rows(batch, first, words, times, place, base, log)
                    first, held, words, times = i + 1, 0, [], []
            yield _rows(batch, first, words, times, place, base, log)
    return run


def _rows(batch, first: int, words: list, times: list, place: dict, base: np.ndarray, log: np.ndarray) -> pa.RecordBatch:
    """Rows of the texts from first on, given their distinct words and how often each has them."""
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    own, total = np.repeat(np.arange(n), sizes), int(sizes.sum())
    m = np.fromiter(chain.from_iterable(times), np.int64, total)
    at = np.fromiter(map(place.get, chain.from_iterable(words), repeat(-1)), np.int64, total)
    sums = lambda values: np.bincount(own, values, n)
    rare = np.flatnonzero(at < 0)
    every = list(chain.from_iterable(words)) if len(rare) else []
    zeros = np.zeros(len(rare))
    word = pa.array([b"\n%d" % ((first + i) % 997) for i in range(n)] + [every[k] for k in rare.tolist()], pa.binary()).cast(pa.string())
    row = pa.array(np.concatenate([np.arange(n), own[rare]]) + first, pa.int64())
    long = lambda values: pa.array(np.concatenate([values, zeros]).astype(np.int64))
    return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), word, pa.array(np.concatenate([np.zeros(n, np.int64), m[rare]])),
                                       long(sums(m)), long(sums(np.where(at >= 0, m, 0))), pa.array(np.concatenate([sums(m * base[at]), zeros])),
                                       pa.array(np.concatenate([sums(m * log[at]), zeros]))], names=["id", "key", "word", "n", "tokens", "known", "hb", "hl"])


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    held = crc_fold(F.col(id_col), FOLDS) == HELD
    words = written(docs.select(F.col(text_col), held.alias("held")).mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = docs.where(~held).count()
    total, distinct, once, twice = words.select(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    pieces = fit(load(path), words, EM_ROUNDS)
    shape = (total, distinct, discount) if total else (1, 1, 1.0)
    scored = written(words.mapInArrow(_scored(context.broadcast(pieces), *shape), "word string, c long, base double, log double"), "scored")
    head = scored.where("c > 0").orderBy(F.col("c").desc(), "word").limit(HEAD_WORDS).toPandas()
    known = context.broadcast(({w.encode(): i for i, w in enumerate(head["word"])}, np.append(head["base"].to_numpy(), 0.0), np.append(head["log"].to_numpy(), 0.0)))
    end_base, end_log = (float(np.log10((ends + 1) / (total + distinct + 1))), float(np.log10(max(ends, 0.5) / shape[0])))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), F.col(text_col))
    kind = dict(docs.dtypes)[id_col]
    rows = keyed.mapInArrow(_sums(known), f"id {kind}, key long, word string, n long, tokens long, known long, hb double, hl double")
    n = F.col("n")
    summed = (rows.join(scored, "word", "left").groupBy("id", "key").agg(
        F.count_if(n == 0).alias("rows"), F.sum("tokens").alias("t"), F.sum(F.col("known") + F.when(F.col("c") > 0, n).otherwise(0)).alias("k"),
        F.sum(F.col("hb") + F.coalesce(n * F.col("base"), F.lit(0.0))).alias("b"), F.sum(F.col("hl") + F.coalesce(n * F.col("log"), F.lit(0.0))).alias("s")))
    each = F.col("rows")
    return (summed.select("id", F.explode(F.array_repeat(F.lit(0), each.cast("int"))), (F.col("t") / each + 1).cast("long").alias("n_tokens"),
                          (F.col("k") / each + int(ends > 0)).cast("long").alias("n_known"), (F.col("b") / each + end_base).alias("base_score"), (F.col("s") / each + end_log).alias("score"))
            .select(F.col("id").alias(id_col), (crc_fold(F.col("id"), FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                    "base_score", "score"))
