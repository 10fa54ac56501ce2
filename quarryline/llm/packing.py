"""Packing: vector bin packing with the dot-product heuristic.

Sequences have simultaneous limits on tokens, segments and loss-bearing
tokens.  A document beyond a limit is cut into the longest pieces within both;
pieces as long as a sequence fill one alone.  The others go into a block (a
bounded number of items); in a block the open
sequence takes, again and again, the fitting item with the largest dot product
of its size vector and the sequence's free capacities (both relative to the
limits); an item that fits nowhere whole is cut to fill the free tokens where
cutting is allowed.  A block's last sequence is laid out in powers of two, so
that it needs no padding.

Blocks are made inside the input's partitions: nothing is shuffled, no key or
document size makes a task large, and sequence ids are the partition's number
and a counter, so a task that runs again gives the same rows.  The input must
come in the same order each time: a table or checkpoint, not a shuffle.

Defined cases: a null text is empty and has only its end id; equal rows are
packed each; extra columns are not read; no rows give no sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    #: Items of a block; they are held with their ids.
    block: int = 8192


class Block:
    """Open items by (tokens, loss), so that equal vectors are weighed once."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.clear()

    def clear(self) -> None:
        self.stacks: dict[tuple[int, int], list] = {}
        self.count = 0

    def add(self, item: tuple) -> None:
        """item: (key, start, ids, loss mask or None, tokens of the document)."""
        _, _, ids, mask, _ = item
        self.stacks.setdefault((len(ids), len(ids) if mask is None else int(mask.sum())), []).append(item)
        self.count += 1

    def pack(self) -> Iterator[list[tuple]]:
        """The sequences, each a list of items."""
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        kinds = sorted(self.stacks, reverse=True)
        sizes = np.array([(t, 1, x) for t, x in kinds], float).reshape(-1, 3)
        left = np.array([len(self.stacks[k]) for k in kinds])
        free, row = most.copy(), []
        while left.any():
            fits = (left > 0) & (sizes <= free).all(1)
            if fits.any():
                score = np.where(fits, (sizes / most) @ (free / most), -1.0)
                best = int(np.argmax(score))
                item = self.stacks[kinds[best]].pop()
                left[best] -= 1
                free -= sizes[best]
                row.append(item)
                continue
            best = int(np.flatnonzero(left)[0])  # the longest that is left gives its head
            _, _, ids, mask, _ = self.stacks[kinds[best]][-1]
            room = head(len(ids), mask, int(free[0]), int(free[2]))
            if row and room > 0 and free[1] >= 1:
                key, start, ids, mask, total = self.stacks[kinds[best]].pop()
                left[best] -= 1
                row.append((key, start, ids[:room], None if mask is None else mask[:room], total))
                rest = (key, start + room, ids[room:], None if mask is None else mask[room:], total)
                kind = (len(rest[2]), len(rest[2]) if mask is None else int(rest[3].sum()))
                if kind not in self.stacks or kind not in kinds:
                    kinds.append(kind)
                    sizes = np.vstack([sizes, [(kind[0], 1, kind[1])]])
                    left = np.append(left, 0)
                    self.stacks[kind] = []
                self.stacks[kind].append(rest)
                left[kinds.index(kind)] += 1
            if row:
                yield row
                free, row = most.copy(), []
        if row:
            yield from powers(row)
        self.clear()


def head(n: int, mask: np.ndarray | None, tokens: int, loss: int) -> int:
    """The most first ids of n that are within the tokens and bear no more loss (without a mask all bear loss)."""
    if mask is None:
        return min(n, tokens, loss)
    bearing = np.flatnonzero(mask[: min(n, tokens)])
    return int(bearing[loss]) if len(bearing) > loss else min(n, tokens)


def powers(row: list[tuple]) -> Iterator[list[tuple]]:
    """The items cut into sequences whose lengths are the powers of two of their sum, largest first."""
    left = sum(len(x[2]) for x in row)
    queue = row[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            key, start, ids, mask, total = queue.pop()
            n = min(size, len(ids))
            out.append((key, start, ids[:n], None if mask is None else mask[:n], total))
            if n < len(ids):
                queue.append((key, start + n, ids[n:], None if mask is None else mask[n:], total))
            size -= n
        yield out


def pack_items(items: Iterator[tuple], limits: Limits) -> Iterator[list[tuple]]:
    """Sequences of (key, start, ids, mask, tokens of the document) from whole documents of the same shape."""
    block, most = Block(limits), limits.tokens
    if limits.segments < 1 or limits.loss < 1 or most < 1:
        raise ValueError("limits must be positive")
    for key, start, ids, mask, total in items:
        at = 0
        while at < len(ids):
            n = head(len(ids) - at, None if mask is None else mask[at:], most, limits.loss)
            piece = (key, start + at, ids[at : at + n], None if mask is None else mask[at : at + n], total)
            at += n
            if n == most or mask is None and n == limits.loss:
                yield [piece]  # nothing else fits beside it
            else:
                block.add(piece)
        if block.count >= limits.block:
            yield from block.pack()
    yield from block.pack()


def _rows(sequences: Iterator[list[tuple]], size: int = 2048) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    cols: list[list] = [[] for _ in range(7)]

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        for c in cols:
            c.clear()
        return out

    for number, row in enumerate(sequences):
        offset = 0
        for key, start, ids, _, total in row:
            for c, v in zip(cols, (key, start, len(ids), np.ascontiguousarray(ids, "<u4").tobytes(), total, base + number, offset), strict=True):
                c.append(v)
            offset += len(ids)
        if len(cols[0]) >= size:
            yield batch()
    if cols[0]:
        yield batch()


def _packer(items: Callable[[pa.RecordBatch], Iterator[tuple]], limits: Limits, done: Callable[[], None] = lambda: None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from _rows(pack_items((x for b in batches for x in items(b)), limits))
        finally:
            done()

    return run


def pack_documents(docs: DataFrame, path: str, end: int = 0, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Tokenize whole texts, close each with the end id, and pack.  Every token bears loss.  Returns a row for each piece with its ids.

    ``keep``: a worker keeps the encoder with its pieces for its next task, which is faster; without, its memory is free for what runs after.
    """

    def items(batch: pa.RecordBatch) -> Iterator[tuple]:
        for lo, hi, flat, sizes in tokens.id_arrays(batch, path, end):
            keys = batch.column(0).slice(lo, hi - lo).to_pylist()
            stops = np.cumsum(sizes)
            for key, a, b in zip(keys, (stops - sizes).tolist(), stops.tolist(), strict=True):
                yield key, 0, flat[a:b], None, b - a

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_packer(items, limits, (lambda: None) if keep else (lambda: tokens.forget(path))), SCHEMA)


def pack_ids(examples: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", ids_col: str = "ids", loss_col: str | None = None) -> DataFrame:
    """Pack examples that have ids already (array<int>), with an optional loss mask (array<boolean>, as long as the ids; null: all bear loss), as instruction data has it."""
    mask = F.col(loss_col).cast("array<boolean>") if loss_col else F.lit(None).cast("array<boolean>")

    def items(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, ids, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids = np.array(ids or [], np.uint32)
            loss = None if loss is None else np.array([bool(x) for x in loss], bool)
            if loss is not None and len(loss) != len(ids):
                raise ValueError(f"example {key}: {len(loss)} loss marks for {len(ids)} ids")
            yield key, 0, ids, loss, len(ids)

    return examples.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"), mask.alias("loss")).mapInArrow(_packer(items, limits), SCHEMA)
