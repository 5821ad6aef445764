"""Token-id files with keyed access through a minimal perfect hash index.

A folder holds shards: <name>.ids, raw little-endian unsigned ids of whole documents in ascending id order, and <name>.idx:

    'TIDX', version, width of an id in bytes, number of levels, keys, rows   (unsigned 32-bit each)
    bits of each level                                                       (sizes first, unsigned 64-bit; then packed bits)
    per key: fingerprint, first row, rows                                    (unsigned 32-bit each)
    per row and once more: ids before it in the shard                        (unsigned 64-bit)

A key is hashed level by level to a bit that it alone has set; the number of bits set before it is its slot. The slot's
fingerprint turns away keys that the shard does not hold. Keys themselves are not stored.

A task writes files under a name of its own and reports them; only reported files belong to the table, so attempts that
were lost leave nothing that is read. Files go through pyarrow's file systems, to any folder that Spark's workers share.

Null text is empty (one end id); a null id has the key -2**63 and comes first; rows that repeat an id stand one after
another, by text, under one key; an empty table has no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopspark.llm.encoding import encoder, text_groups
from hoopspark.llm.shared import mix, partitions
from hoopspark.session import work_folder, written

SHARD_BYTES = 128 << 20
READ_BYTES = 8 << 20
NULL_KEY = -(1 << 63)
_GAMMA, _MAGIC, _VERSION = 1.6, 0x58444954, 1
_SEEDS = mix(np.arange(1, 66, dtype=np.uint64))


# --- index --------------------------------------------------------------------------------------------------------

def build_index(keys: np.ndarray, first_row: np.ndarray, n_rows: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """The index of distinct int64 keys; starts has one more entry than there are rows."""
    code, left, levels, slot = keys.view(np.uint64), np.arange(len(keys)), [], np.empty(len(keys), np.int64)
    done = 0
    while len(left):
        size = max(8, int(len(left) * _GAMMA) + 1)
        at = (mix(code[left] ^ _SEEDS[len(levels)]) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        slot[left[own]] = done + np.cumsum(alone)[at[own]] - 1
        done += int(alone.sum())
        levels.append(alone)
        left = left[~own]
    table = np.empty((len(keys), 3), "<u4")
    table[slot] = np.stack([_fingerprint(code), first_row, n_rows], axis=1)
    head = np.array([_MAGIC, _VERSION, width, len(levels), len(keys), len(starts) - 1], "<u4").tobytes()
    sizes = np.array([len(x) for x in levels], "<u8").tobytes()
    return b"".join([head, sizes, *(np.packbits(x).tobytes() for x in levels), table.tobytes(), starts.astype("<u8").tobytes()])


def _fingerprint(code: np.ndarray) -> np.ndarray:
    return (mix(code ^ _SEEDS[64]) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Keyed access to one shard's index."""

    def __init__(self, data: bytes):
        magic, version, self.width, n_levels, n_keys, n_rows = np.frombuffer(data, "<u4", 6).tolist()
        if (magic, version) != (_MAGIC, _VERSION):
            raise ValueError("not a token index")
        sizes, at, done = np.frombuffer(data, "<u8", n_levels, 24).tolist(), 24 + 8 * n_levels, 0
        self.levels = []
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at))[:size].astype(bool)
            self.levels.append((bits, done + np.cumsum(bits, dtype=np.int64) - 1))
            done += int(bits.sum())
            at += -(-size // 8)
        self.table = np.frombuffer(data, "<u4", 3 * n_keys, at).reshape(-1, 3)
        self.starts = np.frombuffer(data, "<u8", n_rows + 1, at + 12 * n_keys).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row (-1: not here) and number of rows of each key, in a bounded number of steps per key."""
        code, slot = keys.astype(np.int64).view(np.uint64), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = (mix(code[left] ^ _SEEDS[level]) % np.uint64(len(bits))).astype(np.int64)
            slot[left[bits[at]]] = rank[at[bits[at]]]
            left = left[~bits[at]]
        here = slot >= 0
        here[here] = self.table[slot[here], 0] == _fingerprint(code[here])
        row, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        row[here], n[here] = self.table[slot[here], 1], self.table[slot[here], 2]
        return row, n


# --- writing ------------------------------------------------------------------------------------------------------

class _Shard:
    def __init__(self, folder: str, width: int):
        self.name, self.width = uuid.uuid4().hex, width
        self.files, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{self.name}"
        self.files.create_dir(path, recursive=True)
        self.out = self.files.open_output_stream(f"{self.path}.ids")
        self.keys, self.starts = [], [0]

    def add(self, key: int, ids: bytes) -> None:
        own = np.frombuffer(ids, "<u4").astype(f"<u{self.width}")
        self.out.write(own.tobytes())
        self.keys.append(key)
        self.starts.append(self.starts[-1] + len(own))

    def close(self) -> tuple:
        self.out.close()
        keys, first, n = np.unique(np.array(self.keys, np.int64), return_index=True, return_counts=True)
        with self.files.open_output_stream(f"{self.path}.idx") as out:
            out.write(build_index(keys, first, n, np.array(self.starts), self.width))
        return self.name, int(keys[0]), int(keys[-1]), len(self.keys), self.starts[-1]


def _writer(folder: str, path: str, end_id: int, width: int, shard_bytes: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encode, done = None, encoder(path).encode, []
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                keys = batch.column(0).slice(at, len(texts)).fill_null(NULL_KEY).to_pylist()
                for key, ids in zip(keys, encode(texts)):
                    if own and own.starts[-1] * width >= shard_bytes and own.keys[-1] != key:
                        done.append(own.close())
                        own = None
                    own = own or _Shard(folder, width)
                    own.add(key, ids + tail)
        if own:
            done.append(own.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["shard", "first_id", "last_id", "n_rows", "n_ids"])
    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int, vocabulary: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text and write shards in ascending id order; returns the stored list of shards."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    width = 2 if vocabulary <= 1 << 16 else 4
    return written(ordered.mapInArrow(_writer(folder, path, end_id, width, shard_bytes), "shard string, first_id long, last_id long, n_rows long, n_ids long"), "shards")


# --- reading ------------------------------------------------------------------------------------------------------

def _router(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, firsts, _ = shared.value
        for batch in batches:
            keys = batch.column(0).fill_null(NULL_KEY).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(firsts, keys, "right") - 1, pa.int32()), pa.array(keys)], names=["shard", "key"])
    return run


class ShardReader:
    """Documents of one shard by key."""

    def __init__(self, folder: str, name: str):
        files, path = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{path}/{name}.idx") as f:
            self.index = Index(f.read())
        self.file = files.open_input_file(f"{path}/{name}.ids")
        self.low, self.data = 0, b""

    def ids(self, row: int) -> np.ndarray:
        """Ids of a row; rows that ascend are served from blocks of READ_BYTES."""
        width = self.index.width
        a, b = (int(x) * width for x in self.index.starts[row:row + 2])
        if a < self.low or b > self.low + len(self.data):
            self.low, self.data = a, self.file.read_at(max(READ_BYTES, b - a), a)
        return np.frombuffer(self.data, f"<u{width}", (b - a) // width, a - self.low)


def _reader(folder: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, bases = shared.value
        number, reader = None, None
        for batch in batches:
            shards, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for s in np.unique(shards):
                if s < 0:
                    continue
                if s != number:
                    number, reader = s, ShardReader(folder, names[s])
                own = keys[shards == s]
                for key, row, n in zip(own.tolist(), *(x.tolist() for x in reader.index.find(own))):
                    for r in range(row, row + n):
                        ids = reader.ids(r)
                        out.append((None if key == NULL_KEY else key, bases[s] + int(reader.index.starts[r]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read(spark: SparkSession, folder: str, shards: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: doc_id, start, n_tokens, ids_crc32 of the rows of each distinct key that the files hold.

    The list of shards (one row per SHARD_BYTES of ids) is what every task knows; keys go to the task of their shard."""
    rows = shards.orderBy("first_id").collect()
    sizes = np.array([r["n_ids"] for r in rows], np.int64)
    shared = spark.sparkContext.broadcast(([r["shard"] for r in rows], np.array([r["first_id"] for r in rows], np.int64), (np.cumsum(sizes) - sizes).tolist()))
    routed = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).distinct().mapInArrow(_router(shared), "shard int, key long")
    return (routed.repartition(max(1, len(rows)), "shard").sortWithinPartitions("shard", "key")
            .mapInArrow(_reader(folder, shared), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, path: str, end_id: int, vocabulary: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents to a fresh folder beside the checkpoints and read every one back by key."""
    folder = work_folder(docs.sparkSession, "tokens")
    folder = folder if "://" in folder else (folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")
    return read(docs.sparkSession, folder, write(docs, folder, path, end_id, vocabulary, shard_bytes), docs.select("doc_id"))
