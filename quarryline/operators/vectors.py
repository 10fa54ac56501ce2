"""Dense retrieval: exact cosine search for a batch of queries.

A set of queries of at most ``BROADCAST_BYTES`` goes to the tasks with the function,
which multiplies matrices per Arrow batch and keeps k rows per query and batch.
A larger set is cut into blocks, and each block meets each packed run of vectors
once.  The merge then sees few rows, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
#: Values in a block of queries or vectors: a block of longer vectors holds fewer of them.
QUERY_BLOCK, VECTOR_BLOCK = 4096 * 64, 16_384 * 64
_FOUND = "query_id long, id long, raw double"


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which of them have a length."""
    norm = np.linalg.norm(rows, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return rows / np.where(fine, norm, 1.0)[:, None], fine


def _best(names: np.ndarray, matrix: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of the vectors for each query, ties by id."""
    unit, fine = _unit(vectors)
    unit, ids = unit[fine], ids[fine]
    for lo in range(0, len(names), 256):
        score = (1 + matrix[lo : lo + 256] @ unit.T) / 2
        for q, s in zip(names[lo : lo + 256], score, strict=True):
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
            order = near[np.lexsort((ids[near], -s[near]))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), q)), pa.array(ids[order]), pa.array(s[order])], ["query_id", "id", "raw"])


def _sized(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, ids, vectors) of each size of vector in a batch of (id, list)."""
    lists = batch.column(1)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield size, ids[mine], np.nan_to_num(flat, nan=0.0, posinf=0.0, neginf=0.0).reshape(-1, size)


def _packed(rows: DataFrame, values: int) -> DataFrame:
    """size, ids, vectors (binaries) of runs of rows (id, v) with up to so many values, one row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, ids, vectors in _sized(batch):
                most = max(1, values // size)
                for lo in range(0, len(ids), most):
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids[lo : lo + most].tobytes()], pa.binary()), pa.array([vectors[lo : lo + most].tobytes()], pa.binary())], ["size", "ids", "vectors"])

    return rows.mapInArrow(run, "size int, ids binary, vectors binary")


def _in_blocks(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    queries = _packed(asked, QUERY_BLOCK).select("size", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = _packed(vectors, VECTOR_BLOCK).join(queries, "size").select("size", "ids", "vectors", "q_ids", "q_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, *parts in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 5)), strict=True):
                ids, q_ids = (np.frombuffer(parts[i].as_buffer(), np.int64) for i in (0, 2))
                rows, q_rows = (np.frombuffer(parts[i].as_buffer(), float).reshape(-1, size) for i in (1, 3))
                unit, fine = _unit(q_rows)
                yield from _best(q_ids[fine], unit[fine], ids, rows, k)

    return pairs.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, _FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int, min_similarity: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score = (1 + cosine) / 2 rounded to 4: the k nearest by unrounded score and id, less those below ``min_similarity`` afterwards.

    queries: (query_id, vector).  Vectors of another length than the query's, null or zero ones are not found; such queries find nothing.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL")
    # The bytes are known before anything comes to the driver.
    held = asked.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8 + 8), F.lit(0)).alias("bytes")).first()["bytes"]
    if held > BROADCAST_BYTES:
        found = _in_blocks(rows, asked, k)
    else:
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, names, matrix in (x for b in asked.toArrow().combine_chunks().to_batches() for x in _sized(b)):
            unit, fine = _unit(matrix)
            by_size[size] = (names[fine], unit[fine])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, ids, matrix in _sized(batch):
                    if size in by_size:
                        yield from _best(*by_size[size], ids, matrix, k)

        found = rows.mapInArrow(run, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if min_similarity is not None:
        top = top.filter(F.col("raw") >= min_similarity)
    return top.select("query_id", "rank", "id", F.round("raw", 4).alias("score"))


def hit_rates(found: DataFrame, gold: DataFrame, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries with a gold id (query_id, id) among their first so many results."""
    first = gold.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    return first.agg(*(F.avg(F.when(F.col("best") <= n, 1.0).otherwise(0.0)).alias(f"hit_at_{n}") for n in at))


def overlap(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """query_id, overlap: common ids of two result lists over k."""
    both = one.select("query_id", "id").join(two.select("query_id", "id"), ["query_id", "id"])
    return one.select("query_id").distinct().join(both.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left").select("query_id", (F.coalesce("c", F.lit(0)) / k).alias("overlap"))
