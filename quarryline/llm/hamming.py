"""Exact top-k search in Hamming distance: incremental multi-index hashing.

Codes of 64 bits are cut into four segments of 16 bits.  Two codes within
distance 4 (r + 1) - 1 agree in some segment up to r bits, so a query looks up
all segment values within radius r, for r = 0, 1, ..., and stops as soon as its
k-th best verified distance is at most 4 (r + 1) - 1: nothing nearer, and no tie
at that distance, can be missing.

The index is cut into blocks of a fixed number of rows and the queries into
blocks too; every pair of blocks is searched by itself and gives at most k rows
for each query, which are merged by query.  Equal codes are searched once (in a
block the k least ids of each stand for all, which is exact), so a code that a
third of all rows share costs no more than another.

Defined cases: null, empty or wrongly long vectors are neither queries nor
found; NaN counts as not positive; ties go to the smaller id; equal ids are
rows each; fewer than k rows give fewer results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEGMENTS, WIDTH = 4, 16
INDEX_BLOCK, QUERY_BLOCK = 32_768, 8_192
_PACKED = "ids binary, codes binary"


def sign_code(vector: Column, bits: int = 64) -> Column:
    """The 64-bit code of a vector's signs (first component highest); null unless it has ``bits`` components, all present."""
    v = vector.cast("array<double>")
    code = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(F.isnan(x), 0).when(x > 0, 1).otherwise(0).cast("long")))
    return F.when((F.size(v) == bits) & ~F.exists(v, F.isnull), code)


def _masks() -> list[np.ndarray]:
    """Segment values by their number of bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)] or [0], np.int64) for r in range(WIDTH + 1)]


class Index:
    """Segment tables over the distinct codes of a block."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        self.codes = codes[new]
        start = np.flatnonzero(new)
        self.counts = np.minimum(np.diff(np.append(start, len(codes))), k)
        self.ids, self.starts = ids, start
        self.tables = []
        for j in range(SEGMENTS):
            part = self.segment(self.codes, j)
            by = np.argsort(part, kind="stable")
            self.tables.append((by, np.searchsorted(part[by], np.arange((1 << WIDTH) + 1))))

    @staticmethod
    def segment(codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(WIDTH * j)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and distances of the k best rows of this block for each query."""
        size = len(self.codes)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # query * size + code, distance; each once
        out = []
        active = np.arange(len(queries))
        hits = np.zeros((len(queries), 65), np.int64)  # rows found, by distance
        for r in range(WIDTH + 1):
            fresh = []
            for j, (by, begin) in enumerate(self.tables):
                near = (self.segment(queries[active], j)[:, None] ^ masks[r][None, :]).ravel()
                a, n = begin[near], begin[near + 1] - begin[near]
                q = np.repeat(np.repeat(active, len(masks[r])), n)
                stop = np.cumsum(n)
                at = by[np.repeat(a - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
                fresh.append(q * size + at)
            keys = np.unique(np.concatenate(fresh))
            q, at = keys // size, keys % size
            gap = queries[q] ^ self.codes[at]
            # New only if no segment is nearer than r; those came before.
            least = np.min([np.bitwise_count(self.segment(gap, j)) for j in range(SEGMENTS)], axis=0) if len(gap) else np.zeros(0, np.int64)
            keys, q, at, gap = keys[least == r], q[least == r], at[least == r], gap[least == r]
            d = np.bitwise_count(gap).astype(np.int64)
            np.add.at(hits, (q, d), self.counts[at])
            found.append((keys, d))
            sure = np.cumsum(hits[active], axis=1)[:, min(64, SEGMENTS * (r + 1) - 1)]
            done = active[(sure >= k) | (r == WIDTH)]
            if len(done):
                out.append(self.best(done, found, k))
                active = np.setdiff1d(active, done, assume_unique=True)
                found = [(x[~np.isin(x // size, done)], y[~np.isin(x // size, done)]) for x, y in found]
            if not len(active):
                break
        if not out:
            return (np.zeros(0, np.int64),) * 3
        q, ids, d = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(q, kind="stable")
        return q[order], ids[order], d[order]

    def best(self, done: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = len(self.codes)
        keys, d = (np.concatenate(x) for x in zip(*found, strict=True))
        mine = np.isin(keys // size, done)
        q, at, d = keys[mine] // size, keys[mine] % size, d[mine]
        n = self.counts[at]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[at] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        q, d = np.repeat(q, n), np.repeat(d, n)
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        return q[rank < k], ids[rank < k], d[rank < k]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, code) packed into binaries of up to ``size`` rows, with a block number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            for i in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays([pa.array([x[i : i + size].tobytes()], pa.binary()) for x in (ids, codes)], ["ids", "codes"])
            held.clear()

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)))
            count += len(batch)
            if count >= size:
                yield from flush()
                count = 0
        if held:
            yield from flush()

    return rows.select("id", "code").mapInArrow(pack, _PACKED)


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k rows of ``index`` (id long, code long) nearest to each row of ``queries`` (same columns)."""
    rows = index.filter("id IS NOT NULL AND code IS NOT NULL")
    asked = queries.filter("id IS NOT NULL AND code IS NOT NULL").repartition("id")
    parts = _blocks(asked, query_block).select(F.monotonically_increasing_id().alias("part"), F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"))
    parts = common.cut(parts)  # its numbers must stay the same
    parts = parts.withColumn("part", F.row_number().over(Window.orderBy("part")) - 1)  # one row for each block of queries
    count = parts.count()
    if not count:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("distance")).filter("false")
    blocks = _blocks(rows, index_block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    pairs = blocks.join(parts, "part").select("ids", "codes", "q_ids", "q_codes")
    pairs = pairs.repartition(max(8, 2 * index.sparkSession.sparkContext.defaultParallelism))  # a few packed rows each

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks()
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, codes, q_ids, q_codes = (np.frombuffer(x.as_py(), np.int64) for x in row)
                table, q_codes = Index(codes.view(np.uint64), ids, k), q_codes.view(np.uint64)
                distinct, back = np.unique(q_codes, return_inverse=True)
                for i in range(0, len(distinct), 256):
                    q, found, d = table.search(distinct[i : i + 256], k, masks)
                    # Queries of one code share their results.
                    mine = np.flatnonzero((back >= i) & (back < i + 256))
                    a, b = np.searchsorted(q, back[mine] - i, "left"), np.searchsorted(q, back[mine] - i, "right")
                    stop = np.cumsum(b - a)
                    at = np.repeat(a - stop + b - a, b - a) + np.arange(stop[-1] if len(stop) else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[mine], b - a)), pa.array(found[at]), pa.array(d[at])], ["query_id", "id", "distance"])

    near = pairs.mapInArrow(search, "query_id long, id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
