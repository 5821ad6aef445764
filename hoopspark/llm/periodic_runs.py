"""Periodic runs: stretches of words that repeat themselves three times or more, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least 3 * q and at least
MIN_WORDS words long, that neither neighbouring word extends with period q.

Periods below SHORT are scanned directly, lag by lag. Periods in [Q, 2Q), Q = SHORT, 2 * SHORT, ..., are found from anchors:
every word starts a gram of Q / 2 words, and the gram of smallest hash in each window of Q / 4 grams is an anchor. Grams that
repeat themselves within a third of their length are never anchors. Inside a run, windows one period apart choose anchors one
period apart, and each period has a gram that may be chosen, so some two equal anchors lie exactly one period apart. Two equal
anchors are more than a third of a gram apart, so an anchor has at most a dozen partners closer than 2Q. Each pair is
extended word by word to a maximal stretch. Words are compared as numbers given to distinct words, hashes only choose anchors
and propose pairs, so no hash decides a run.

Texts are read whole, about a megabyte of them at once; a longer one is taken alone. Null and empty texts have no words and no
runs. Rows that repeat an id or a text stand by themselves. Ties of the longest run are not decided here: runs come in order
of start, then period. An empty table gives no rows. Only the id and the text are read of a table's columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.shared import _BASE, _powers, mix, text_slices

MIN_WORDS, REPEATS = 24, 3
SHORT = 32                   # periods below are scanned lag by lag
FLOOR = SHORT // 2           # shortest stretch that is kept while searching: the smallest gram
_TOP = np.uint64(1 << 63)


def equal_stretches(x: np.ndarray, q: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of at least shortest words in which words q apart are equal."""
    breaks = np.flatnonzero(x[q:] != x[:-q])
    after, before = np.append(breaks, len(x) - q), np.concatenate([[-1], breaks])
    long = after - before > shortest - q
    return before[long] + 1, after[long] + q


def extend(x: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The maximal stretch with equal words q apart around the equal words at and at + q."""
    end, step, n = at, 64, len(x)
    while end + q < n:
        unequal = np.flatnonzero(x[end:min(end + step, n - q)] != x[end + q:end + q + step])
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = min(end + step, n - q), step * 2
    start, step = at, 64
    while start:
        low = max(0, start - step)
        unequal = np.flatnonzero(x[low:start] != x[low + q:start + q])
        if len(unequal):
            start = low + int(unequal[-1]) + 1
            break
        start, step = low, step * 2
    return start, end + q


def anchors(x: np.ndarray, sums: np.ndarray, inverse: np.ndarray, scale: int, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of the smallest gram of every window; grams inside a stretch of short period are left out."""
    gram, window = scale // 2, scale // 4
    places = len(x) - gram + 1
    hashes = mix((sums[gram:] - sums[:places]) * inverse[:places])
    tight = np.zeros(places + 1, np.int32)
    for start, end, _ in (row for found in known for row in found[(found[:, 2] <= gram // 3) & (found[:, 1] - found[:, 0] >= gram)]):
        tight[start] += 1
        tight[end - gram + 1] -= 1
    mask = np.uint64((1 << int(places).bit_length()) - 1)
    keys = ((hashes >> np.uint64(1)) & ~mask) | np.arange(places, dtype=np.uint64)
    keys[np.cumsum(tight[:-1]) > 0] |= _TOP
    step = 1
    while step < window:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    chosen = (keys[keys < _TOP] & mask).astype(np.int64)
    chosen = chosen[np.diff(chosen, prepend=-1) > 0]
    return chosen, hashes[chosen]


def pairs_apart(places: np.ndarray, hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal anchors with a distance in [scale, 2 * scale)."""
    order = np.argsort(hashes, kind="stable")
    places, hashes = places[order], hashes[order]
    found, step = [(np.empty(0, np.int64), np.empty(0, np.int64))], 1
    while step < len(places):
        distance = places[step:] - places[:-step]
        near = (hashes[step:] == hashes[:-step]) & (distance < 2 * scale)
        if not near.any():
            break
        wide = near & (distance >= scale)
        found.append((places[:-step][wide], distance[wide]))
        step += 1
    return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])


def find_runs(x: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, end, period) of all runs in a sequence of word numbers, by start and period. Texts that stand one after
    another must be divided by numbers of their own; longest is the length of the longest of them."""
    longest = len(x) if longest is None else longest
    known = []
    for q in range(1, min(SHORT - 1, longest // REPEATS) + 1):
        start, end = equal_stretches(x, q, max(REPEATS * q, FLOOR))
        if len(start):
            known.append(np.stack([start, end, np.full(len(start), q)], axis=1))
    scale = SHORT
    if REPEATS * scale <= longest:
        n = len(x) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n - 1], out=sums[1:])
        inverse = _powers(pow(_BASE, -1, 1 << 64), n)
    while REPEATS * scale <= longest:
        place, apart = pairs_apart(*anchors(x, sums, inverse, scale, known), scale)
        order = np.lexsort((place, apart))
        found, done, last = [], 0, 0
        for p, q in zip(place[order].tolist(), apart[order].tolist()):
            if q == last and p < done or x[p] != x[p + q]:
                continue
            start, end = extend(x, p, q)
            done, last = end - q, q
            if end - start >= REPEATS * q:
                found.append((start, end, q))
        if found:
            known.append(np.array(found))
        scale *= 2
    if not known:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(known)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(MIN_WORDS, REPEATS * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run repeats: all but those behind the first period of a run."""
    keep = np.ones(n, bool)
    for start, end, q in runs:
        keep[start + q:end] = False
    return keep


def _read(order: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, past, data, offsets in text_slices(batch):
                whole, cuts = data.tobytes(), offsets.tolist()
                texts = [whole[a:b].split() for a, b in zip(cuts, cuts[1:])]
                numbers = dict(zip(known := dict.fromkeys(w for t in texts for w in t), range(len(known))))
                parts, starts, at, longest = [], [], 0, 0
                for i, words in enumerate(texts):
                    if order and words and (places := order(ids[first + i].as_py(), len(words))) is not None:
                        texts[i] = words = [words[j] for j in places]
                    parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([len(numbers) + i])]
                    starts.append(at)
                    at += len(words) + 1
                    longest = max(longest, len(words))
                rows = find_runs(np.concatenate(parts), longest)
                owner = np.searchsorted(starts, rows[:, 0], "right") - 1
                spans = np.searchsorted(owner, np.arange(len(texts) + 1))
                found, left = [], []
                for i, words in enumerate(texts):
                    own = rows[spans[i]:spans[i + 1]]
                    if len(own):
                        own = own - [starts[i], starts[i], 0]
                        words = [words[j] for j in np.flatnonzero(_kept(len(words), own))]
                    found.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                    left.append(b" ".join(words))
                n_words = np.diff(starts, append=at) - 1
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids.slice(first, past - first), pa.array(n_words, pa.int64()), pa.array(found, kind),
                                                  pa.array(left, pa.binary())], names=["id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, order: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start and period) and the collapsed text (words that no run repeats,
    joined by one space, as bytes) of every row. order, where given, is called with id and word count and returns the places of the
    words to read in their stead (None: as they are)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "text").mapInArrow(
        _read(order), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return rows.withColumnRenamed("id", id_col)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of periodic_runs: number of runs, the run of greatest length / period (the first of several by start and
    period; nulls without runs), and digests of all runs and of the collapsed text."""
    top = F.aggregate("runs", F.get("runs", F.lit(0)),
                      lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return rows.withColumn("top", top).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
