"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily with the longest piece that fits; then its shortest piece gives way to two unpacked pieces if
they fill the widened gap better. The choice depends on lengths alone, so it is made on the histogram of lengths (at most
one entry per length, whatever the corpus): the same bin is repeated for as long as its lengths last, which is what bin by
bin would do. Pieces find their place through their rank among pieces of equal length.

Null and empty texts are one end token. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hoopspark.llm.encoding import encoder, text_groups
from hoopspark.llm.shared import lean, partitions
from hoopspark.session import written

SIZE = 2048
_RANK_BITS = 48


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] pieces, the size of a bin being the last length: (how often, [(length, pieces in the bin)])."""
    counts = counts.astype(np.int64).copy()
    size, lengths, bins = len(counts) - 1, np.arange(len(counts)), []
    while counts[1:].any():
        fits = np.maximum.accumulate(np.where(counts > 0, lengths, 0))     # longest piece of at most so many tokens
        taken, gap, most = {}, size, size
        while (length := int(fits[min(gap, most)])) > 0:
            taken[length] = int(min(counts[length], gap // length))
            gap -= taken[length] * length
            most = length - 1
        shortest = min(taken)
        if gap:
            left = counts.copy()
            for length, n in taken.items():
                left[length] -= n
            room = gap + shortest
            fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))
            first = np.flatnonzero(left[:room] > 0)
            first = first[first > 0]
            second = fits[room - first]
            alone = (second == first) & (left[first] < 2)
            second = np.where(alone, fits[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > shortest:
                at = int(total.argmax())
                taken[shortest] -= 1
                for length in (int(first[at]), int(second[at])):
                    taken[length] = taken.get(length, 0) + 1
                taken = {length: n for length, n in taken.items() if n}
        often = min(int(counts[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            counts[length] -= often * n
        bins.append((often, sorted(taken.items(), reverse=True)))
    return bins


def _slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (key of the first rank, pieces per bin, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for often, pieces in bins:
        offset = 0
        for length, n in pieces:
            rows.append(((length << _RANK_BITS) + used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + often * n
            offset += length * n
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pieces(path: str, end_id: int, size: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_groups(batch.column(1)):
                row, piece, start, length, crc = [], [], [], [], []
                for i, own in enumerate(encode(texts), at):
                    own = memoryview(own + tail)
                    n = len(own) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[4 * a:4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Token pieces of every text: doc_id, piece, start, length, ids_crc32. The first piece of a long text may be shorter."""
    return docs.select("doc_id", "text").mapInArrow(
        lean(_pieces(path, end_id, size)), f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key = (length << _RANK_BITS) + rank
            slot = slots[np.searchsorted(slots[:, 0], key, "right") - 1]
            copy, inside = np.divmod(key - slot[:, 0], slot[:, 1])
            keep = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(slot[:, 2] + copy),
                                              pa.array(slot[:, 3] + inside * length)], names=[*keep, "sequence_id", "offset"])
    return run


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id and offset of each of a stored table of pieces.

    A length that a third of all pieces have is ranked in as many parts as the shuffle has: counts per part are added up
    and only pieces of one part are numbered together."""
    spark, n = pieces.sparkSession, partitions(pieces)
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():      # at most 'size' rows
        counts[row["length"]] = row["count"]
    slots = spark.sparkContext.broadcast(_slots(best_two_fit(counts)))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parted.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (parted.withColumn("own", F.row_number().over(within) - 1).join(base, ["length", "part"])
              .select(*pieces.columns, (F.col("base") + F.col("own")).alias("rank")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lean(_place(slots)), schema)


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(written(cut_pieces(docs, path, end_id, size), "pieces"), size)
