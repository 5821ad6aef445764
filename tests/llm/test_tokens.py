import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from hoopspark.llm import packing, token_files
from hoopspark.llm.encoding import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b", " lead", "trail ", "tab\tand\nline \n x", "a  b", "x\x00y z", "Ωμ ΣΣ ς", "é ́x", "über  straße", "\x1c \x1d", "don't 's 12345 67", "日本語 テキスト", "a" * 300 + " b" * 4000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_encode_as_the_whole_text(path):
    texts = [t or "" for t in ODD] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    plain = Tokenizer.from_file(path)
    for text, own in zip(texts, Encoder(path).encode(texts)):
        assert np.frombuffer(own, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_letter_before_and_after_every_mark(path):
    """A letter may end in a combining mark once the vocabulary has normalised it, and marks go with what closes a part."""
    plain, own = Tokenizer.from_file(path), Encoder(path)
    letters = [chr(c) for c in range(32, 0x30000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or chr(c).isspace() or (c < 0x3100 and chr(c).isprintable()))]
    letters = [c for c in letters if not 0x4E10 <= ord(c) < 0x9F00 and not 0xAC20 <= ord(c) < 0xD780 and ord(c) < 0x20100]
    texts = [f"A{c}{mark} b{mark}{c} {c}{mark}" for c in letters for mark in ",.;:!?"] + ["Aİ, b", "x\n\u2003y", "a \u3000b", "a \u201cq\u201d\u2009.", "\u0301 \u0301,"]
    want = plain.encode_batch(texts, add_special_tokens=False)
    for text, ids, w in zip(texts, own.encode(texts), want):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, ascii(text)


def test_groups_of_texts(monkeypatch):
    from hoopspark.llm import encoding

    monkeypatch.setattr(encoding, "GROUP_BYTES", 10)
    found = list(encoding.text_groups(pa.array(["abc", None, "x" * 30, "é" * 4, "", "z"]).slice(1)))
    assert found == [(0, [""]), (1, ["x" * 30]), (2, ["é" * 4, "", "z"])] and list(encoding.text_groups(pa.array([], pa.string()))) == []


def _pieces(rows, path, end, size):
    plain, out = Tokenizer.from_file(path), {}
    for doc, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [end]
        at, k = 0, 0
        while at < len(ids):
            n = len(ids) % size if at == 0 and len(ids) % size else size
            out.setdefault((doc, k), []).append((at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at, k = at + n, k + 1
    return out


def _check_packing(rows, got, size):
    want = _pieces(rows, BYTE, 0, size)
    have = {}
    for r in got:
        have.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(r["length"] for r in got)


def test_packing_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, BYTE).collect()
    bins, tokens = _check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], got, packing.SIZE)
    assert bins <= tokens / packing.SIZE * 1.02 + 2


def test_packing_of_odd_rows(frame):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a  b"), (3, "other"), (None, "no id"), (None, None)]
    _check_packing(rows, packing.pack(frame(rows), BYTE, size=64).collect(), 64)
    assert packing.pack(frame([]), BYTE).count() == 0


def test_bins_hold_every_length_once():
    draw = random.Random(5)
    for size in (7, 64, 300):
        counts = np.zeros(size + 1, np.int64)
        for _ in range(draw.randrange(1, 900)):
            counts[draw.choice([1, size, size // 2, draw.randrange(1, size + 1)])] += 1
        bins = packing.best_two_fit(counts)
        used = np.zeros(size + 1, np.int64)
        for often, pieces in bins:
            assert often > 0 and sum(a * n for a, n in pieces) <= size
            for a, n in pieces:
                used[a] += often * n
        assert (used == counts).all()
        assert packing.best_two_fit(np.zeros(size + 1)) == []


def test_shortest_piece_gives_way_to_two():
    counts = np.zeros(101, np.int64)
    counts[[60, 39, 20, 21]] = 1          # 60 + 39 leaves 1; 60 + 20 + 20 would need two of 20; nothing fits better
    assert packing.best_two_fit(counts)[0] == (1, [(60, 1), (39, 1)])
    counts[[39, 35, 15, 25]] = [0, 1, 1, 1]   # 60 + 35 leaves 5; 60 + 25 + 15 is full
    assert packing.best_two_fit(counts)[0] == (1, [(60, 1), (25, 1), (15, 1)])


def test_repeated_bins_equal_one_by_one():
    draw = np.random.default_rng(3)
    counts = np.bincount(draw.integers(1, 51, 4000), minlength=51)
    left, single = counts.copy(), 0
    while left.any():
        _, pieces = packing.best_two_fit(left)[0]
        for a, n in pieces:
            left[a] -= n
        single += 1
    assert single == sum(b for b, _ in packing.best_two_fit(counts))


def test_token_files_round_trip(frame):
    rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(21, "again"), (21, "again"), (None, "no id"), (-5, "negative")]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(frame(rows), WORD, 2, 49_408, shard_bytes=600).collect())
    plain, at, want = Tokenizer.from_file(WORD), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(frame([]), WORD, 2, 49_408).count() == 0


def test_index_is_minimal_and_turns_strangers_away():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(-(1 << 62), 1 << 62, 20_000))
    rows = np.arange(len(keys))
    index = token_files.Index(token_files.build_index(keys, rows, np.ones(len(keys), int), np.arange(len(keys) + 1), 2))
    assert len(index.table) == len(keys)
    found, n = index.find(keys[::-1])
    assert (found == rows[::-1]).all() and (n == 1).all()
    strangers = np.setdiff1d(draw.integers(-(1 << 62), 1 << 62, 20_000), keys)
    assert (index.find(strangers)[0] >= 0).sum() <= 2
