"""Helpers the operators share: tables, columns, and words of whole Arrow batches as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT_BROADCAST = 1_000_000  # rows of narrow tables that may be broadcast once they have been counted
SLICE_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside a regular-expression class; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo a number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def partitions(df: DataFrame, per_task: int = 1) -> int:
    """Partitions for a shuffle that follows the size of its source: the session's number, and one per source split at least."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions() * per_task)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only


def give_back() -> None:
    """Return what finished work has left with this process to the machine."""
    _grown.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable) -> Callable:
    """A task over Arrow batches that gives its memory back when it ends. Workers live on for later tasks and stages, and what
    they keep adds up beside the executor's heap."""
    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


# --- texts of a batch as bytes ------------------------------------------------------------------------------------

def text_slices(batch: pa.RecordBatch, name: str = "text", target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) over runs of rows of about target bytes; null texts are empty.
    A longer text is a run of its own, whole."""
    column = batch.column(batch.schema.get_field_index(name)).fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1)
        yield first, past, data[offsets[first]:offsets[past]], offsets[first:past + 1] - offsets[first]
        first = past


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_grown: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _grown.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        _grown[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash is usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand (folded: A-Z as a-z)."""
    n = len(data) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum((_BYTE_FOLDED if folded else _BYTE)[data] * _powers(_BASE, n)[:n - 1], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), n)[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and 09-0D) of texts that stand one after another: start, end, text number."""
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_STEPS = mix(np.arange(101, 165, dtype=np.uint64) * _ODD) | np.uint64(1)


def shingles(words: np.ndarray, owner: np.ndarray, n_owners: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of k words inside one owner; an owner of fewer words has its whole sequence as one."""
    counts = np.bincount(owner, minlength=n_owners)
    n = len(words)
    found, whose = [], []
    if n >= k:
        same = owner[:n - k + 1] == owner[k - 1:]
        run = sum((words[i:n - k + 1 + i] * _STEPS[i] for i in range(1, k)), words[:n - k + 1] * _STEPS[0])
        found.append(mix(run[same]))
        whose.append(owner[:n - k + 1][same])
    first = np.cumsum(counts) - counts
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            run = sum((words[first[short] + i] * _STEPS[i] for i in range(1, m)), words[first[short]] * _STEPS[0])
            found.append(mix(run + _STEPS[63 - m]))
            whose.append(short)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def distinct_pairs(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (value, owner), by owner and then value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]
