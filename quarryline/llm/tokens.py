"""Whole-text tokenizing with the tokenizers library, each distinct piece once.

Both vocabularies split a text before merging, and no split reaches across the
start of a white-space run or from a letter into a following ASCII mark.  So a
text is cut there, the pieces are hashed as bytes, each new piece is encoded
by the library, and the ids of the text are gathered from the worker's table.
Where a cut could be unsafe (an unusual character before it), none is made:
pieces only get longer, ids stay those of the library on the whole text.

The strings of a tokenizer's special tokens, where they occur in a text, are
those tokens, as in the library's own encoding; they are pieces of their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

#: Pieces that a worker remembers; beyond it the table starts afresh.
MEMORY = 700_000
#: New pieces that the library encodes at a time.
LEARNED = 4096
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True  # no apostrophe: contractions begin with it
#: Sets the keys of special tokens apart from those of ordinary pieces.
_APART = np.uint64(0xB5297A4D3F84D5A3)
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


class Encoder:
    """A tokenizer file with the ids of the pieces seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content}
        self.tokenizer.encode_special_tokens = True  # they are found here, and what is left is ordinary text
        # Under a lower-casing normaliser that makes white space blanks, pieces that differ in these alone are one.
        self.fold = None
        if all(x in repr(self.tokenizer.normalizer) for x in ("Lowercase", "Replace")):
            self.fold = np.where(ts.SPACE, 32, ts.LOWER).astype(np.uint8)
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << 22, -1, np.int32)  # open addressing: number of the piece, or -1
        self.keys = np.zeros(1 << 16, np.uint64)
        self.starts, self.sizes, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        for text, number in self.special.items():
            data = np.frombuffer(text, np.uint8)
            data = data if self.fold is None else self.fold[data]
            key = ts.Hasher(data).spans(np.array([0]), np.array([len(data)])) ^ _APART
            self.add(key, np.ones(1, np.int32), np.array([number], np.uint32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for new ones."""
        mask = len(self.table) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            got = self.table[slot[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return out

    def insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New, distinct hashes."""
        mask = len(self.table) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.table[slot[open_]] < 0]
            self.table[slot[free]] = numbers[free]
            open_ = open_[self.table[slot[open_]] != numbers[open_]]
            slot[open_] = (slot[open_] + 1) & mask

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the special tokens' strings, the leftmost first and the longest of those that begin together."""
        raw, found = data.tobytes(), []
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                found.append((at, -at - len(text)))
                at = raw.find(text, at + 1)
        starts, ends, free = [], [], 0
        for at, minus in sorted(found):
            end = -minus
            if at >= free and np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end - 1, "right"):
                starts.append(at)
                ends.append(end)
                free = end
        return np.array(starts, np.int64), np.array(ends, np.int64)

    def pieces(self, data: np.ndarray, offsets: np.ndarray, special: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        space = ts.SPACE[data]
        safe = _PLAIN[data[:-1]].copy()  # what may stand before a cut
        safe[1:] |= data[:-2] == 0xC3  # the second byte of U+00C0..U+00FF
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1] & safe) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        for a, b in zip(*(x.tolist() for x in special), strict=True):
            cut[a + 1 : b] = False
            cut[a] = True
            cut[b : b + 1] = True
        starts, ends = ts.edges(np.ones(n, bool), offsets, np.flatnonzero(cut))
        return starts, ends, ts.owner(starts, offsets)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found: list[list[int]] = []
        for at in range(0, len(texts), LEARNED):  # the library's own results are far larger than the ids
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + LEARNED], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        self.add(keys, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """New pieces: their hashes, how many ids each has, and the ids."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(keys) > len(self.keys):
            self.keys, self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.starts, self.sizes))
        new = slice(self.known, self.known + len(keys))
        self.ids[self.used : self.used + len(flat)] = flat
        self.keys[new], self.sizes[new], self.starts[new] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.insert(keys, np.arange(new.start, new.stop, dtype=np.int32))
        self.used += len(flat)
        self.known = new.stop

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slab's texts, one after the other, and how many each has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        special = self.specials(data, offsets)
        data = data if self.fold is None else self.fold[data]
        starts, ends, doc = self.pieces(data, offsets, special)
        keys = ts.Hasher(data).spans(starts, ends)
        keys[np.searchsorted(starts, special[0])] ^= _APART
        if self.known > MEMORY:
            self.clear()
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            self.learn(data, starts[new[first]], ends[new[first]], fresh)
            at[new] = self.find(keys[new])
        sizes = self.sizes[at].astype(np.int64)
        stop = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[at] - stop + sizes, sizes) + np.arange(stop[-1])]
        return flat, ts.per_text(doc, n, sizes).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Let this worker's encoder go, and give its memory back."""
    _encoders.pop(path, None)
    ts.release()


def with_end(flat: np.ndarray, sizes: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text."""
    if end is None:
        return flat, sizes
    return np.insert(flat, np.cumsum(sizes), end).astype(np.uint32), sizes + 1


def id_arrays(batch: pa.RecordBatch, path: str, end: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For a batch of (id, text): first row, row after the last, ids, sizes."""
    coder = encoder(path)
    for lo, hi, data, offsets in ts.slabs(batch.column(1)):
        yield lo, hi, *with_end(*coder.encode(data, offsets), end)


def binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids as little-endian unsigned 32-bit binaries, one for each size."""
    offsets = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))]).cast(pa.binary())


def tokenize(docs: DataFrame, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens of every row's whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, flat, sizes in id_arrays(batch, path, end):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binary(flat, sizes), pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long")
