"""Spelling variants: words one edit apart, by dynamic programming over sorted word lists.

A word's edit matrix against a list of words is kept as a band of three cells a row, since only distances up to one count. The
list is sorted, so words that begin alike stand together, and the rows of what an adjacent pair shares are computed once: a
row belongs to a range of the list, a range is divided where the next letter differs (the longest common prefixes of adjacent
words say where), and a range whose row has no cell below two is skipped with all its words. All words of a list are looked
up in it together, level by level.

Lists are blocks of words that share their beginning or their end. One edit leaves the first half or the second half of
the shorter word as it is, so two near words share the block of that half; a word is in blocks for its own length and for one
less. Words of blocks for ends are read backwards. A block with more than BLOCK_WORDS words is divided in the same way: its words
share half of what they did not share before, at the beginning or at the end. With at most one letter left, a block has at most
as many words as there are letters and pairs of letters, so no block outgrows a task. A pair that a block for beginnings has is left out
of its sister for ends, so every pair counts once.

Words are runs of LETTERS (A-Z as a-z) of at least shortest letters, counted over all texts; null texts have none. A change of
spelling may be given that is applied before counting. Words with fewer than least occurrences are left out. Rows that repeat
an id or a text count again; an empty table gives no rows; ties of the most frequent near word go to the first in code-point
order. Work grows with the length of a word, not with its square. Only the id and the text are read of a table's columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.shared import partitions
from hoopspark.session import written

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, TIMES = 7, 2, 10
BLOCK_WORDS = 10_000         # above 90 + 90 * 90, the words of a block that cannot be divided
KEPT_WORDS = 300_000         # counted words a task holds before it hands them on
TASK_WORDS = 60_000          # words of blocks that are looked up together
WORD_BYTES = 4 << 20


# --- words --------------------------------------------------------------------------------------------------------

def _count(find: re.Pattern, change: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                words = find.findall(text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                counts.update(words if change is None else change(doc_id, words))
                if len(counts) > KEPT_WORDS:
                    yield _rows(counts)
                    counts = Counter()
        yield _rows(counts)
    return run


def _rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, change: Callable[[int | None, list[str]], list[str]] | None = None,
               id_col: str = "doc_id") -> DataFrame:
    """word, n of all words of at least shortest letters and least occurrences. change gets the id of a text and its runs of at
    least shortest letters, and returns the words to count; those that became too short are left out."""
    find = re.compile(f"{LETTERS}{{{shortest},}}")
    counted = docs.select(F.col(id_col).alias("id"), "text").mapInArrow(_count(find, change), "word string, n long")
    return counted.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- blocks -------------------------------------------------------------------------------------------------------

def _blocked(rows: DataFrame) -> DataFrame:
    """Key of each row's block: the length of the shorter words, and the letters shared at both ends."""
    return rows.withColumn("key", F.xxhash64("short", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")))


def _halves(short: Column, head: Column, tail: Column, apart: Column) -> Column:
    """The two blocks that share half of what was free: at the beginning, or at the end for pairs that differ before that half."""
    free = short - head - tail
    first = head + F.floor(free / 2).cast("int")
    return F.array(F.struct(short.alias("short"), first.alias("head"), tail.alias("tail"), apart.alias("apart")),
                   F.struct(short.alias("short"), head.alias("head"), (short - first).alias("tail"), F.least(apart, first).alias("apart")))


def blocks(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """word, n, short, head, tail, apart, key: the blocks of every word. apart: pairs that share that many first letters are
    counted elsewhere."""
    size, none = F.length("word"), F.lit(0).cast("int")
    both = F.concat(*(_halves((size - less).cast("int"), none, none, F.lit(1 << 30)) for less in (0, 1)))
    rows, done = _blocked(words.select("word", "n", F.explode(both).alias("b")).select("word", "n", "b.*")), []
    while True:
        large = written(rows.where("short - head - tail > 1").groupBy("key").count().where(F.col("count") > limit).select("key"), "blocks")
        if large.isEmpty():
            return _union([*done, rows])
        done.append(rows.join(large, "key", "left_anti"))
        split = rows.join(large, "key", "left_semi").select("word", "n", F.explode(_halves(*map(F.col, ("short", "head", "tail", "apart")))).alias("b"))
        rows = written(_blocked(split.select("word", "n", "b.*")), "halves")


def _union(parts: list[DataFrame]) -> DataFrame:
    columns = ["word", "n", "short", "head", "tail", "apart", "key"]
    whole = parts[0].select(*columns)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*columns))
    return whole


# --- look-up ------------------------------------------------------------------------------------------------------

def _band_tables() -> tuple[np.ndarray, np.ndarray]:
    """Rows of a band as numbers, base 3 (2 stands for two and more): the next row for each row and the three comparisons of its
    letter, and the cells of each row."""
    cells = np.array([(s // 9, s // 3 % 3, s % 3) for s in range(27)])
    step = np.empty((27, 8), np.int8)
    for s, (before, here, after) in enumerate(cells.tolist()):
        for same in range(8):
            low = min(before + (not same & 1), here + 1, 2)
            mid = min(here + (not same & 2), after + 1, low + 1, 2)
            high = min(after + (not same & 4), mid + 1, 2)
            step[s, same] = 9 * low + 3 * mid + high
    return step.reshape(-1), cells


_STEP, _CELLS = _band_tables()
_DEAD = 26
_BEGIN = 9 * 1 + 3 * 0 + 1       # equal so far


def _adjacent(flat: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Letters that each word shares with the one before, behind what its block shares; -1 for the first of a block."""
    shared = np.where(first, -1, 0)
    open_ = np.flatnonzero(~first)
    depth = 0
    while len(open_):
        open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = open_[flat[at[open_] + depth] == flat[at[open_ - 1] + depth]]
        depth += 1
        shared[open_] = depth
    return shared


def near_pairs(flat: np.ndarray, at: np.ndarray, size: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of words of one block that are exactly one edit apart. Words are sorted inside their blocks; at is where a
    word goes on behind what its block shares, in letters of one byte with a zero behind each word and at least one letter
    before; size is its length from there."""
    n = len(at)
    first = np.append(True, block[1:] != block[:-1])
    shared = _adjacent(flat, at, size, first)
    starts = np.flatnonzero(first)                       # words that begin a range, at the present depth
    word, node = np.arange(n), np.cumsum(first) - 1      # open look-ups: a word, a range, the band's row
    row = np.full(n, _BEGIN, np.int8)
    left, right, depth = [], [], 0
    alive = np.arange(n)
    while len(word):
        ends = size[starts[node]] == depth               # the range begins with a word that ends here
        off = size[word] - depth + 1
        hit = ends & (off >= 0) & (off <= 2)
        hit[hit] = _CELLS[row[hit], off[hit]] == 1
        left.append(word[hit])
        right.append(starts[node[hit]])
        alive = alive[size[alive] > depth]
        below = alive[shared[alive] <= depth]            # ranges at the next depth
        edge = np.searchsorted(below, np.append(starts, n))
        many = np.diff(edge)[node]
        of = np.repeat(np.arange(len(node)), many)
        child = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + edge[node][of]
        word, row = word[of], row[of]
        letter = flat[at[below] + depth][child]
        place, last = at[word] + depth, size[word]
        same = (flat[place - 1] == letter).astype(np.int8)
        same |= ((depth < last) & (flat[np.minimum(place, len(flat) - 1)] == letter)).astype(np.int8) << 1
        same |= ((depth + 1 < last) & (flat[np.minimum(place + 1, len(flat) - 1)] == letter)).astype(np.int8) << 2
        row = _STEP[row.astype(np.int64) * 8 + same]
        kept = row != _DEAD
        word, node, row, starts = word[kept], child[kept], row[kept], below
        depth += 1
    return np.concatenate(left), np.concatenate(right)


def _look_up(words: list[str], n: np.ndarray, short: np.ndarray, head: np.ndarray, tail: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    """Number of near words and the most frequent of them, of each word that has any, block by block."""
    own = [w[::-1].encode("latin-1") if t > h else w.encode("latin-1") for w, h, t in zip(words, head.tolist(), tail.tolist())]
    numbers: dict[tuple, int] = {}                       # blocks by what they share: equal hashes do not join them
    block = [numbers.setdefault((s, h, w[:h], w[len(w) - t:]), len(numbers)) for w, s, h, t in zip(words, short.tolist(), head.tolist(), tail.tolist())]
    order = sorted(range(len(own)), key=lambda i: (block[i], own[i]))
    words, spelled, block = [words[i] for i in order], [own[i] for i in order], np.array(block)[order]
    n, short, apart, skip = n[order], short[order], apart[order], np.maximum(head, tail)[order]
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    flat = np.frombuffer(b"\0" + b"\0".join(spelled) + b"\0", np.uint8)
    at = np.cumsum(size + 1) - size + skip
    left, right = near_pairs(flat, at, size - skip, block)
    good = np.minimum(size[left], size[right]) == short[left]
    left, right = left[good], right[good]
    twice = np.array([words[a][:k] == words[b][:k] for a, b, k in zip(left, right, apart[left])], bool) if len(left) else np.empty(0, bool)
    left, right = left[~twice], right[~twice]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = np.lexsort((place[right], -n[right], left))
    left, right = left[best], right[best]
    first = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in left[first]], pa.string()), pa.array(np.diff(np.append(first, len(left))), pa.int64()),
                                       pa.array(n[right[first]], pa.int64()), pa.array([words[i] for i in right[first]], pa.string())],
                                      names=["word", "n_near", "near_n", "near"])


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive one after another; whole blocks are looked up together."""
    held: list[pa.RecordBatch] = []

    def run(rows: pa.Table) -> pa.RecordBatch:
        return _look_up(rows["word"].to_pylist(), *(rows[c].to_numpy() for c in ("n", "short", "head", "tail", "apart")))

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows < TASK_WORDS and rows.nbytes < WORD_BYTES:
            continue
        keys = rows["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield run(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield run(pa.Table.from_batches(held))


def near_words(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, near_n, near: how many words of the vocabulary are one edit away, and the most frequent of them."""
    rows = blocks(words, limit)
    looked = rows.repartition(partitions(words, 8), "key").sortWithinPartitions("key").mapInArrow(_task, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return looked.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.near").alias("near"))


def roots(links: DataFrame, most: int, times: int) -> DataFrame:
    """word, root: where the forms of words lead. Each form is at least times as frequent, so a way has at most log(most) steps,
    and every round doubles what is covered of it."""
    steps, covered = links.select("word", F.col("form").alias("root")), 1
    longest = 1
    while times ** longest <= most:
        longest += 1
    while covered < longest:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        covered *= 2
    return steps


def variants(words: DataFrame, times: int = TIMES, limit: int = BLOCK_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a vocabulary: form is its most frequent near word, if it is times as frequent;
    root is where forms lead."""
    words = written(words, "vocabulary")
    known = written(words.join(near_words(words, limit), "word", "left"), "near")
    form = known.withColumn("form", F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))).withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("near_n")))
    links = form.where("form is not null").select("word", "form")
    ways = roots(links, known.agg(F.coalesce(F.max("near_n"), F.lit(1))).first()[0], times)
    return form.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
