"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

File format of a shard (little-endian):

    ids       n_ids unsigned integers of ``width`` bytes (2 where the vocabulary allows, else 4)
    bounds    Elias-Fano sequence of the n_docs + 1 boundaries in ids
    keys      Elias-Fano sequence of the ascending document ids less the first
    footer    struct FOOTER: lengths, counts, first document id, null ids; magic

An Elias-Fano sequence of n values below u keeps l = floor(log2(u / n)) low bits
of each value packed, the high parts in unary in at most 2n + 1 bits, and the
bit position of every 64th one as a select structure; value i is
``(select1(i) - i) << l | low(i)``.  No 64-bit offset table is written.

The documents are dealt by ranges of their ids in ascending order, at most
``MAX_RANGES`` whatever the corpus' size; a range is written as one shard file
after another, so the corpus' boundary of a document is its shard's start plus
its boundary there.  A task writes a shard under a temporary name and renames
it, so a repeated task leaves the same files.  Reading takes runs of documents
by the select structures and never decodes a whole boundary table.

Defined cases: a null text is an empty document (its end id alone); rows without
an id come first, in ranges of their own by a hash of their ids' bytes, so many
of them are no large task; equal ids stand together, ordered by their ids' bytes
(rows of one id are one range); no rows give no files and no result; extra
columns are not read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"QLTOKEN1"
FOOTER = struct.Struct("<BQQQQqQ8s")
SAMPLE = 64
#: Bytes of text for each range, or of ids for each shard file if ranges are larger.
SHARD_BYTES = 32 << 20
MAX_RANGES = 8192
#: Shards of a range, in a shard's number.
SUB_BITS = 20


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    return np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    HEAD = struct.Struct("<QBQ")  # values, low bits, bytes of the upper part

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray, select: np.ndarray):
        self.n, self.low_bits, self.low, self.upper, self.select = n, low_bits, low, upper, select

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        upper[at] = 1
        packed = np.packbits(upper, bitorder="little").tobytes()
        low = b"".join(_pack(v[i : i + 65536] & np.uint64((1 << bits) - 1), bits) for i in range(0, n, 65536))
        return cls.HEAD.pack(n, bits, len(packed)) + low + packed + at[::SAMPLE].astype("<u4" if not n or at[-1] < 1 << 32 else "<u8").tobytes()

    @classmethod
    def decode(cls, raw: bytes) -> EliasFano:
        n, bits, size = cls.HEAD.unpack_from(raw)
        a = cls.HEAD.size
        b = a + (n * bits + 7) // 8
        c = b + size
        samples = -(-n // SAMPLE)
        wide = (len(raw) - c) // samples if samples else 4
        return cls(n, bits, np.frombuffer(raw, np.uint8, b - a, a), np.frombuffer(raw, np.uint8, size, b), np.frombuffer(raw, f"<u{wide}", samples, c))

    def __getitem__(self, i: int) -> int:
        """One value, from the select structure and at most a few words of the upper part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.select[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.upper[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (at - i) << self.low_bits | chunk >> first % 8 & ((1 << self.low_bits) - 1)

    def run(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, from the select structure: the upper part is read from the last sampled one before a to the first after b."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.uint64)
        first, after = a // SAMPLE, -(-b // SAMPLE)
        begin = int(self.select[first]) // 8
        end = int(self.select[after]) // 8 + 1 if after < len(self.select) else len(self.upper)
        at = np.flatnonzero(np.unpackbits(self.upper[begin:end], bitorder="little")) + begin * 8
        at = at[np.searchsorted(at, int(self.select[first])) :][a - first * SAMPLE : b - first * SAMPLE]
        out = (at - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            lo, hi = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(self.low[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].reshape(b - a, self.low_bits)
            for j in range(self.low_bits):
                out |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return out

    def values(self) -> np.ndarray:
        """All of them."""
        return self.run(0, self.n)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def name_of(shard: int) -> str:
    return f"range-{shard >> SUB_BITS:06d}-{shard & (1 << SUB_BITS) - 1:06d}.tok"


class ShardWriter:
    def __init__(self, folder: str, shard: int, width: int):
        self.store, root = open_store(folder)
        self.store.create_dir(root, recursive=True)
        self.path, self.shard, self.width = posixpath.join(root, name_of(shard)), shard, width
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.file = self.store.open_output_stream(self.temp)
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.nulls = 0

    def add(self, keys: np.ndarray, nulls: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.sizes.append(sizes)
        self.nulls += nulls

    def close(self) -> tuple[int, int, int]:
        """Shard, documents, ids."""
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))])
        keys = np.concatenate(self.keys)
        first = int(keys[0]) if len(keys) else 0
        one, two = EliasFano.encode(bounds), EliasFano.encode(keys.astype(np.uint64) - np.uint64(first & (1 << 64) - 1))
        self.file.write(one + two + FOOTER.pack(self.width, int(bounds[-1]), len(bounds) - 1, len(one), len(two), first, self.nulls, MAGIC))
        self.file.close()
        self.store.move(self.temp, self.path)
        return self.shard, len(bounds) - 1, int(bounds[-1])


class ShardReader:
    def __init__(self, folder: str, shard: int):
        store, root = open_store(folder)
        self.file = store.open_input_file(posixpath.join(root, name_of(shard)))
        end = self.file.size()
        self.file.seek(end - FOOTER.size)
        self.width, self.n_ids, self.n_docs, one, two, self.first, self.nulls, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"shard {shard}: not a token file")
        self.file.seek(self.n_ids * self.width)
        self.bounds = EliasFano.decode(self.file.read(one))
        self.keys = EliasFano.decode(self.file.read(two))

    def ids(self, a: int, b: int) -> np.ndarray:
        self.file.seek(a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}").astype(np.uint32)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """The i-th document by the select structures: its id and its ids."""
        key = None if i < self.nulls else self.first + self.keys[i - self.nulls]
        return key, self.ids(self.bounds[i], self.bounds[i + 1])

    def batches(self, size: int = 1 << 20, most: int = 4096) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, boundaries, ids and sizes of runs of whole documents, of up to ``most`` and about ``size`` ids."""
        lo = 0
        while lo < self.n_docs:
            bounds = self.bounds.run(lo, min(self.n_docs, lo + most) + 1).astype(np.int64)
            hi = lo + max(1, int(np.searchsorted(bounds, bounds[0] + size, "right")) - 1)
            hi = min(hi, lo + len(bounds) - 1)
            bounds = bounds[: hi - lo + 1]
            nulls = max(0, min(hi, self.nulls) - lo)
            keys = self.keys.run(max(lo, self.nulls) - self.nulls, max(hi, self.nulls) - self.nulls) + np.uint64(self.first & (1 << 64) - 1)
            yield [None] * nulls + keys.astype(np.int64).tolist(), bounds[:-1], self.ids(bounds[0], bounds[-1]), np.diff(bounds)
            lo = hi


def write(docs: DataFrame, folder: str, path: str, end: int | None, vocabulary: int, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, deal by ranges of the id, and write the shards; returns (shard, n_docs, n_ids, start) of each, start being the ids of all shards before."""
    width = 2 if max(vocabulary, end or 0) < 1 << 16 else 4
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total, rows, nulls = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    count = max(1, min(MAX_RANGES, -(-(total or 0) // shard_bytes)))
    null_ranges = -(-count * nulls // rows) if nulls else 0
    bounds = np.zeros(0, np.int64)
    if count > 1:  # as many numbers as ranges
        found = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10 * count + 10_000).alias("b")).first()[0]
        bounds = np.unique(np.array(found or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, flat, sizes in tokens.id_arrays(batch, path, end):
                keys = batch.column(0).slice(lo, hi - lo)
                offsets = np.concatenate([[0], np.cumsum(sizes) * width]).astype(np.int64)
                raw = np.ascontiguousarray(flat, f"<u{width}")
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())
                part = null_ranges + np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False), "left")
                tie = np.zeros(hi - lo, np.int64)
                for i in np.flatnonzero(~np.asarray(keys.is_valid())).tolist():
                    tie[i] = zlib.crc32(raw.view(np.uint8)[offsets[i] : offsets[i + 1]].tobytes())
                    part[i] = tie[i] * null_ranges >> 32
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys, pa.array(tie), packed], ["part", "doc_id", "tie", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done, room = None, [], 0
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            every = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1, every.offset * 8)
            data = np.frombuffer(every.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(parts):
                if writer is None or writer.shard >> SUB_BITS != parts[at] or room <= 0:
                    number = int(parts[at]) << SUB_BITS
                    if writer is not None:
                        done.append(writer.close())
                        if writer.shard >> SUB_BITS == parts[at]:
                            number = writer.shard + 1
                    writer, room = ShardWriter(folder, number, width), shard_bytes
                # To the end of the range or of the batch, or until the shard is full; one document at least.
                last = at + int(np.searchsorted(parts[at:], parts[at], "right"))
                last = min(last, max(at + 1, int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1))
                keys = batch.column(1).slice(at, last - at)
                raw = data[offsets[at] : offsets[last]]
                writer.add(keys.drop_null().to_numpy(zero_copy_only=False), keys.null_count, raw.view(f"<u{width}"), np.diff(offsets[at : last + 1]) // width)
                room -= len(raw)
                at = last
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["shard", "n_docs", "n_ids"])

    dealt = docs.mapInArrow(encode, "part int, doc_id long, tie long, ids binary").repartitionById(null_ranges + len(bounds) + 1, F.col("part"))
    written = dealt.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie", "ids").mapInArrow(store, "shard long, n_docs long, n_ids long")
    written = common.cut(written.withColumn("part", F.shiftright("shard", SUB_BITS)))
    prior = (Window.unboundedPreceding, -1)
    sums = written.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each range
    sums = sums.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(*prior)), F.lit(0).cast("long")).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*prior)), F.lit(0).cast("long"))
    return written.join(sums, "part").select("shard", "n_docs", "n_ids", (F.col("before") + inside).alias("start"))


def read(shards: DataFrame, folder: str) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, bounds, flat, sizes in ShardReader(folder, shard).batches():
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bounds + start), pa.array(sizes), tokens.binary(flat, sizes)], ["doc_id", "start", "n_tokens", "ids"])

    spread = shards.select("shard", "start").repartition(max(1, min(MAX_RANGES, shards.count())), "shard")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")
