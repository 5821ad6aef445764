"""Token ids of whole texts, from the tokenizers library, with ids of repeated parts kept per Python worker.

Byte- and word-level pre-tokenizers always cut before a space that a visible character follows, around a lone line feed,
and between an ASCII letter and the full stops and commas that end such a part, so a text's ids are the ids of the parts between
these places one after another. (Other letters may end in a combining mark once a vocabulary has normalised them, and marks go with
the stops.) Places are found in the bytes of many texts at once, distinct parts are told apart by Arrow and encoded once while they
fit the memory of the worker; a text with other runs of white space (a space before white space, or at the end) goes to the
library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

KEPT_PARTS = 600_000       # parts of the present and of the last generation that a worker keeps
PART_CHARS = 48            # longer parts are not kept
GROUP_BYTES = 8 << 20      # texts that are encoded together, a longer one alone
CLOSING = ".,;:!?"
_SPACE, _FEED = 0x20, 0x0A
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_open: dict[str, "Encoder"] = {}


def text_groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) over runs of rows of about GROUP_BYTES bytes; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first = 0
    while first < len(texts):
        past = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP_BYTES, "right")) - 1)
        yield first, texts.slice(first, past - first).to_pylist()
        first = past


def _space_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character (of Unicode) begins at each place."""
    padded = np.append(data, np.zeros(3, np.uint8))
    a, b, c = (padded[at + i] for i in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return _ASCII_SPACE[a] | two | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def part_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the parts of texts that stand one after another begin, and the texts that must stay whole."""
    gaps = np.flatnonzero((data == _SPACE) | (data == _FEED))
    owner = np.searchsorted(offsets, gaps, "right") - 1
    feed = data[gaps] == _FEED
    bad = (gaps + 1 == offsets[owner + 1]) | _space_at(data, gaps + 1) | (feed & (gaps == offsets[owner]))
    whole = np.zeros(len(offsets) - 1, bool)
    whole[owner[bad]] = True
    free = ~whole[owner]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = begins[gaps[free]] = begins[gaps[free & feed] + 1] = True
    return np.flatnonzero(begins), whole


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), 20_000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts[i:i + 20_000], add_special_tokens=False)]
        return out

    def _look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.known) > KEPT_PARTS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new, split, once = {}, [], []
        for i in missing:
            part = parts[i]
            if part in older:
                found[i] = known[part] = older[part]
            elif len(part) > PART_CHARS:
                once.append(i)
            else:
                stem = part.rstrip(CLOSING)
                if stem != part and stem and stem[-1].isascii() and stem[-1].isalpha():
                    tail = part[len(stem):]
                    split.append((i, stem, tail))
                    new.setdefault(stem)
                    new.setdefault(tail)
                else:
                    new[part] = i
        unseen = [p for p in new if p not in known]
        known.update(zip(unseen, self._ids(unseen)))
        for part, i in new.items():
            if i is not None:
                found[i] = known[part]
        for i, stem, tail in split:
            found[i] = known[parts[i]] = known[stem] + known[tail]
        for i, ids in zip(once, self._ids([parts[i] for i in once])):
            found[i] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        spelled = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, spelled)])
        joined = b"".join(spelled)
        cuts, whole = part_cuts(np.frombuffer(joined, np.uint8), offsets)
        bounds = np.append(cuts[cuts < len(joined)], len(joined))
        parts = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        at, distinct = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        found = self._look_up(distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        many = sizes[at]
        past = np.cumsum(many)
        flat = ids[np.repeat(starts[at] - (past - many), many) + np.arange(int(past[-1]) if len(past) else 0)]
        ends = np.append(0, past)[np.searchsorted(bounds, offsets)]
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
