"""N-gram Jaccard join: adaptive multi-match prefixes, and the components of its links.

Texts are sets of distinct 5-word shingles (64-bit hashes of lower-cased words).
Two sets link when 100 * intersection >= 75 * union.

* Equal sets are one class, so exact copies are never expanded.  A class has a
  64-bit number; a second hash of the set finds the rare sets that would share
  one, which get numbers of their own.
* All sets are sorted in one global order: estimated frequency, then hash.  The
  estimate is a bounded table of the shingles that recur most; any order gives
  right results, this one keeps common passages out of the prefixes.
* A set of n shingles with required overlap o = ceil(0.75 n) has the l-prefix of
  its first n - o + l shingles.  Linked sets with l and m share at least
  min(l, m) of them.  Each set takes the l with the least estimated cost: list
  lengths of its prefix for looking candidates up, and those over l for
  verifying them.  Sets of rare shingles stay at the least level; sets among many
  copies or common passages lengthen their prefix and ask for more shared
  shingles.  A class with fewer shared shingles than any partner of fitting size
  could ask for is left out before any set is read.
* Prefix postings are dealt by hash of the shingle as packed binaries.  A list
  key is the bucket and 32 further bits; shingles of one set that meet in a key
  lower what the set asks for by their number, so no shared shingle is missed.
* Lists of at most ``short`` classes give all their pairs, counted in the bucket.
  A pair is verified if its count and the long lists that both are in could make
  up min(l, m).
* Longer lists give each class one pair: with the list's hub, the class of about
  its size with the greatest share of frequent shingles, as originals have.  A
  class is verified against the ``hubs`` hubs that it shares most lists with.
* A class A that fails a hub H is *masked* by it: with i = |A and H|, a partner
  B shares at least 3/7 (|A| + |B|) - i shingles outside H with it.  That is
  positive for all B from a least size on, which is at most |H|.  For these, A
  looks up its shingles outside H (but for the last few, as any B must have one
  of the others) against the whole sets of what is left, and B must have enough
  of them.  What a group of copies has in common lies in H and is never looked up.
* Links so far are contracted to components.  Pairs of classes in long lists that
  lie in different components and that no mask covers are counted list by list.
  All these pairs are verified, so no pair that could join two components is left
  out, while a group of n copies, near or below the threshold, costs about n pairs.
* Verification is exact on the whole sets, read again for the classes in
  question only.

Each step is a table in the shared folder, deleted when the next ones are made;
only the tables that the result reads stay.

Defined cases: null, empty and blank texts have no shingle, link with nothing
and are a component each; texts of one to four words are one shingle; equal ids
are rows each, and the component of a row without id is null unless a linked
row has one; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textscan as ts


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    #: Rows of the table of frequent shingles, and shingles counted together for it.
    frequent: int = 200_000
    counted: int = 1_000_000
    #: Prefix levels l that a set chooses from, in percent of its shingles (at least 1).  The least bounds what any partner asks for.
    levels: tuple[int, ...] = (10, 15, 20, 30)  # four at most
    #: Lists that an unlisted shingle is taken to share, and the cost of verifying a candidate for each shingle of the set.
    background: float = 0.2
    verify_cost: float = 0.5
    #: Postings in a bucket, about.
    bucket: int = 1_000_000
    #: Classes of a list that is paired in full, and hubs that a class of longer lists is verified against.
    short: int = 8
    hubs: int = 3
    #: Pairs of one first class that a task verifies, about.
    crowd: int = 500
    #: Bits of a class number before clashes are mended (fewer in tests).
    class_bits: int = 64


class Sets:
    """Sets and classes of texts; ``clashes`` are (class, second hash) to the number that such a set has instead."""

    def __init__(self, settings: Settings, clashes: dict[tuple[int, int], int] | None = None):
        self.settings, self.clashes = settings, clashes or {}

    def classes(self, h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size of each text's set, its class (0: empty) and the second hash."""
        sizes = ts.per_text(d, n)
        out, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            own = d[first]
            for into, salt in ((out, 0x5851F42D4C957F2D), (second, 0x14057B7EF767814F)):
                total = np.add.reduceat(ts.mix(h ^ np.uint64(salt)), first)
                into[own] = ts.mix(total + sizes[own].astype(np.uint64)) | np.uint64(1)
            out[own] = (out[own] >> np.uint64(64 - self.settings.class_bits)) | np.uint64(1)
            if self.clashes:
                met = {c for c, _ in self.clashes}
                for i in own[np.isin(out[own], np.array(sorted(met), np.uint64))].tolist():
                    out[i] = self.clashes.get((int(out[i]), int(second[i])), int(out[i]))
        return sizes, out, second

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Shingles, their text index, and size, class and second hash of each text."""
        h, d = shingle_sets(data, offsets, self.settings.words)
        return h, d, *self.classes(h, d, len(offsets) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted by text and hash, and their text index."""
    data = ts.LOWER[data]
    starts, ends, doc = ts.words(data, offsets)
    h = ts.Hasher(data).spans(starts, ends)
    first, keys = ts.windows(h, doc, size)
    hashes, owners = [keys], [doc[first]]
    count = ts.per_text(doc, len(offsets) - 1)
    for n in range(1, size):
        mine = count[doc] == n
        at, short = ts.windows(h[mine], doc[mine], n)
        hashes.append(ts.mix(short + np.uint64(n)))
        owners.append(doc[mine][at])
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    order = order[np.argsort(_narrow(d)[order], kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _narrow(d: np.ndarray) -> np.ndarray:
    return d.astype(np.uint16) if not len(d) or d.max() < 65536 else d


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _summary(sets: Sets):
    """Rows (doc_id, cls, second, n) of the texts, and (null, shingle, null, count) of shingles that several classes of a run of texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "cls", "second", "n", "frequent"]
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            seen.clear()
            keys, counts = keys[counts > 1], counts[counts > 1]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64()), pa.array(counts.astype(np.int64)), pa.array(np.ones(len(keys), bool))], names)

        for batch in batches:
            for lo, hi, data, offsets in ts.slabs(batch.column(1)):
                h, d, sizes, cls, second = sets.read(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cls.view(np.int64)), pa.array(second.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(np.zeros(hi - lo, bool))], names)
                fresh = np.array([c not in seen and not seen.add(c) for c in cls.tolist()], bool)
                held.append(h[fresh[d]])
                if sum(map(len, held)) >= sets.settings.counted:
                    yield from flush()
        if held:
            yield from flush()

    return run


@dataclass
class Prefix:
    """Prefix shingles with their text index; of each text: which level it chose and the share of frequent shingles in its set (0 to 255)."""

    h: np.ndarray
    d: np.ndarray
    choice: np.ndarray
    usual: np.ndarray


def level_of(sizes: np.ndarray, choice: np.ndarray, settings: Settings) -> np.ndarray:
    return np.maximum(1, sizes * np.array(settings.levels, np.int64)[choice] // 100)


#: Shingles lost to equal keys that a posting's byte can tell, beside its level.
MOST_LOST = 63


class Order:
    """The global order of shingles."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = keys, weights

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.uint8)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0).astype(np.uint8)

    def prefixes(self, h: np.ndarray, d: np.ndarray, sizes: np.ndarray, settings: Settings) -> Prefix:
        weight = self.weigh(h)
        order = np.argsort(weight, kind="stable")
        order = order[np.argsort(_narrow(d)[order], kind="stable")]
        h, d, weight = h[order], d[order], weight[order]
        begin = np.cumsum(sizes) - sizes
        cost = ts.running(np.where(weight > 0, np.exp2(weight / 8.0), 0.0))
        need = -(-sizes * settings.percent // 100)
        best, choice = np.full(len(sizes), np.inf), np.zeros(len(sizes), np.int64)
        for number in range(len(settings.levels)):
            n = level_of(sizes, np.full(len(sizes), number), settings)
            length = np.minimum(sizes - need + n, sizes)
            lists = cost[begin + length] - cost[begin]
            price = length + lists + settings.verify_cost * sizes * (lists + settings.background * length) / n
            better = (price < best) & (n <= np.maximum(need, 1))
            best, choice = np.where(better, price, best), np.where(better, number, choice)
        keep = np.arange(len(h)) - begin[d] < (sizes - need + level_of(sizes, choice, settings))[d]
        usual = np.round(255 * ts.per_text(d, len(sizes), weight > 0) / np.maximum(sizes, 1)).astype(np.uint8)
        return Prefix(h[keep], d[keep], choice, usual)


def _keyed(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the next 32 bits of a shingle."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    return bucket, ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _packed(bucket: np.ndarray, columns: list[np.ndarray], idx: np.ndarray, owned: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket: arrays of its postings, and of the classes that they belong to."""
    order = np.argsort(bucket, kind="stable")
    bucket, idx, columns = bucket[order], idx[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows: list[tuple] = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        own, back = np.unique(idx[a:b], return_inverse=True)
        back = back.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
        rows.append((int(bucket[a]), *(c[a:b].tobytes() for c in columns), back.tobytes(), *(x[own].tobytes() for x in owned)))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names)


class Packed:
    """The rows of one bucket together."""

    def __init__(self, table: pa.Table):
        self.table, self.bucket = table, table.column("bucket")[0].as_py()

    def column(self, name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in self.table.column(name)])

    def owners(self, of: str) -> np.ndarray:
        """Index into the class arrays (the column ``of`` is one of them, of 8 bytes) of every posting."""
        sizes = [len(x.as_buffer()) // 8 for x in self.table.column(of)]
        base = np.cumsum([0, *sizes])
        return np.concatenate([np.frombuffer(x.as_buffer(), np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64) + b for x, n, b in zip(self.table.column("idx"), sizes, base, strict=False)])


_POSTING_NAMES = ["bucket", "low", "idx", "cls", "n", "choice", "usual"]
_POSTINGS = "bucket long, low binary, idx binary, cls binary, n binary, choice binary, usual binary"


def _postings(sets: Sets, order: Order, bits: int):
    """Packed prefix postings of each new class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in ts.slabs(batch.column(0)):
                h, d, sizes, cls, _ = sets.read(data, offsets)
                if len(seen) > 200_000:
                    seen.clear()
                fresh = np.array([c != 0 and c not in seen and not seen.add(c) for c in cls.tolist()], bool)
                keep = fresh[d]
                h, d, sizes, cls = h[keep], (np.cumsum(fresh) - 1)[d[keep]], sizes[fresh], cls[fresh]
                if not len(h):
                    continue
                p = order.prefixes(h, d, sizes, sets.settings)
                bucket, low = _keyed(p.h, bits)
                # Shingles of one set in one key count once there: the set asks for so many less.
                key = ts.in_text(bucket.astype(np.uint64) << np.uint64(32) | low, p.d)
                lost = np.minimum(ts.per_text(p.d, len(sizes), ts.later(key)).astype(np.int64), MOST_LOST)
                yield _packed(bucket, [low], p.d, [cls, sizes.astype(np.uint32), (p.choice << 6 | lost).astype(np.uint8), p.usual], _POSTING_NAMES)

    return run


PAIR, STAR, LIST, CLASS = 0, 1, 2, 3
_MET = "kind int, key long, a long, b long, c long, n int, level int"


def _counted(kind: int, codes: Codes, of: np.ndarray, cls: np.ndarray, n: np.ndarray, level: np.ndarray) -> pa.Table:
    """Pairs of class numbers (first times the number of classes, plus second), each once with its count; ``n`` is the sum of sizes and ``level`` what both ask for."""
    size = max(1, len(of))
    code, count = codes.merged()
    one, two = of[code // size], of[code % size]
    return _met(kind, np.zeros(len(code), np.int64), cls[one], cls[two], count, n[one] + n[two], np.minimum(level[one], level[two]))


def _met(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, level: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(a), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(a), pa.array(b), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(level.astype(np.int32))], names=["kind", "key", "a", "b", "c", "n", "level"])


def _fits(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(one, two) >= percent * np.maximum(one, two)


def _lists(settings: Settings):
    """Of a bucket: the counted pairs of short lists, pairs with hubs, the rows of long lists, and of each class its rows in short (c) and long (n) ones, its size (level) and the shingles that it lost to equal keys (key)."""

    def run(table: pa.Table) -> pa.Table:
        ts.release()
        p = Packed(table)
        low, idx = p.column("low", np.uint32), p.owners("cls")
        cls, n, choice, usual = p.column("cls", np.int64), p.column("n", np.uint32).astype(np.int64), p.column("choice", np.uint8).astype(np.int64), p.column("usual", np.uint8)
        lost = choice & MOST_LOST
        lost = np.where(lost == MOST_LOST, n, lost)  # that many or more: the set asks for nothing
        level = level_of(n, choice >> 6, settings) - lost
        # One number for each class, whichever row it came in.
        _, of, number = np.unique(cls, return_index=True, return_inverse=True)
        me = number[idx]
        order = np.lexsort((me, low))
        low, me = low[order], me[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (me[1:] != me[:-1])
        low, me = low[new], me[new]
        first, length = np.unique(low, return_index=True, return_counts=True)[1:]
        size = np.repeat(length, length)
        low, me, size = low[size > 1], me[size > 1], size[size > 1]
        out = []
        is_long = size > settings.short
        own = [np.bincount(me[x], minlength=len(of)) for x in (~is_long, is_long)]
        some = np.flatnonzero(own[0] + own[1])
        out.append(_met(CLASS, lost[of[some]], cls[of[some]], cls[of[some]], own[0][some], own[1][some], n[of[some]]))

        q, m = low[~is_long], me[~is_long]
        codes = Codes()
        for gap in range(1, settings.short):  # counted gap by gap, for memory
            at = np.flatnonzero(q[gap:] == q[:-gap]) if len(q) > gap else np.zeros(0, np.int64)
            at = at[_fits(n[of[m[at]]], n[of[m[at + gap]]], settings.percent)]
            codes.add(m[at] * len(of) + m[at + gap])
        out.append(_counted(PAIR, codes, of, cls, n, level))

        q, m = low[is_long], me[is_long]
        out.append(_met(LIST, p.bucket << 32 | q.astype(np.int64), cls[of[m]], cls[of[m]], np.ones(len(m)), n[of[m]], level[of[m]]))
        if len(m):
            codes = Codes()
            rank = np.empty(len(of), np.int64)
            rank[np.lexsort((cls[of], n[of], usual[of]))] = np.arange(len(of))
            for shift in (0.0, 0.5):  # bands of sizes, and the same half a band on
                band = np.floor(np.log(n[of[m]]) / np.log(16 / 9) + shift).astype(np.int64)
                by = np.lexsort((rank[m], band, q))
                last = np.ones(len(by), bool)
                last[:-1] = (q[by][1:] != q[by][:-1]) | (band[by][1:] != band[by][:-1])
                hub = m[by][last][np.cumsum(last) - last]
                good = (hub != m[by]) & _fits(n[of[hub]], n[of[m[by]]], settings.percent)
                codes.add(hub[good] * len(of) + m[by][good])
            out.append(_counted(STAR, codes, of, cls, n, level))
        return pa.concat_tables(out)

    return run


class Members:
    """A bitmap of at most 16 MB that tells which classes may be among the given ones; the join after it is exact.  Beyond some 10^8 classes it fills, and that join sees more rows."""

    def __init__(self, classes: DataFrame):
        self.bits = 1 << min(27, max(20, (8 * classes.count()).bit_length()))
        place = f"pmod(cls, {self.bits})"
        pages = classes.selectExpr(f"{place} DIV 32768 AS page", f"{place} % 32768 AS bit").groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")).toArrow()
        self.bytes = np.zeros(self.bits // 8, np.uint8)
        for page, bitmap in zip(pages.column("page").to_pylist(), pages.column("bitmap"), strict=True):
            self.bytes[page * 4096 : (page + 1) * 4096] = np.frombuffer(bitmap.as_buffer(), np.uint8)

    def maybe(self, cls: np.ndarray) -> np.ndarray:
        at = cls.view(np.int64) % self.bits
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _sets(sets: Sets, members: Members):
    """(cls, shingles) of the classes that may be among the members, once for each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in ts.slabs(batch.column(0)):
                h, _, sizes, cls, _ = sets.read(data, offsets)
                if len(seen) > 200_000:
                    seen.clear()
                raw, stops = h.tobytes(), np.cumsum(sizes) * 8
                mine = np.flatnonzero(members.maybe(cls) & (cls != 0))
                mine = np.array([i for i in mine.tolist() if int(cls[i]) not in seen and not seen.add(int(cls[i]))], np.int64)
                rows = [raw[stops[i] - 8 * sizes[i] : stops[i]] for i in mine.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(cls[mine].view(np.int64), pa.int64()), pa.array(rows, pa.binary())], ["cls", "shingles"])

    return run


def _overlap(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, least, bound = [], [], []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                few, many = (a, b) if len(a) <= len(b) else (b, a)
                same = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                linked.append(100 * same >= percent * (len(a) + len(b) - same))
                least.append(same * (100 + percent) // percent - len(b) + 1)
                bound.append(max(same, -(-len(b) * percent // 100) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(linked, pa.bool_()), pa.array(least, pa.int64()), pa.array(bound, pa.int64())], ["a", "b", "star", "linked", "least", "bound"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings, scratch: common.Scratch) -> DataFrame:
    """The pairs (a, b) and whether they link; as a mask of b, the least size of the partners it is for, and the most that these can share with b in shingles that b does not look up.

    A pair's sets meet by a.  A class that stands first in more than ``crowd``
    pairs, as the hub of a large group, is sent to several tasks that share them.
    """
    crowd = settings.crowd
    hot = scratch.store(pairs.groupBy("a").count().filter(F.col("count") > crowd).select("a", F.expr(f"count DIV {crowd} + 1").alias("parts")))

    def meet(some: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
        two = some.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
        return two.join(first, keys).select("a", "b", "x", "y", "star")

    whole = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    if hot.isEmpty():
        both = meet(pairs, whole, ["a"])
    else:
        dealt = pairs.join(hot, "a").withColumn("part", F.expr("pmod(xxhash64(b), parts)"))
        copied = whole.join(hot, "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        both = meet(pairs.join(hot.select("a"), "a", "left_anti"), whole, ["a"]).union(meet(dealt, copied, ["a", "part"]))
    return both.mapInArrow(_overlap(settings.percent), "a long, b long, star boolean, linked boolean, least long, bound long")


def components(links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(cls, comp): the least node reachable by the links (a, b), for the nodes that have one."""
    edges = scratch.store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.store(edges.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("comp")).select("cls", F.least("cls", "comp").alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("root"))
        step = scratch.store(step.join(jump, "comp", "left").select("cls", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")))
        scratch.drop(labels)
        labels = step
        if step.filter("comp < old").isEmpty():
            scratch.drop(edges)
            return labels


_OPEN = "kind int, a long, b long, c long, level int"


#: Pairs that a task makes at once.
PAIRS = 1_000_000


def _across(comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of items with different components, about ``PAIRS`` at a time."""
    order = np.argsort(comp, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], comp[order][1:] != comp[order][:-1]]))
    stops = np.append(first[1:], len(comp))
    later = len(comp) - np.repeat(stops, stops - first)  # of each item, the items of later components
    total = np.cumsum(later)
    lo = 0
    while lo < len(comp):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        some = later[lo:hi]
        stop = np.cumsum(some)
        yield order[np.repeat(np.arange(lo, hi), some)], order[np.repeat(len(comp) - stop, some) + np.arange(stop[-1])]
        lo = hi


class Codes:
    """Counts of pair codes, added block by block; each code is held about once."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, 2 * PAIRS

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(np.unique(codes, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        code, at = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        count = np.bincount(at, np.concatenate([n for _, n in self.parts]), len(code)).astype(np.int64)
        self.parts = [(code, count)]
        self.held, self.most = len(code), max(2 * PAIRS, 2 * len(code))
        return code, count


def _uncovered(settings: Settings):
    """Of the long lists of a bucket: counted pairs of classes in different components that no mask covers (kind 0), and how many lists with several components each class is in (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        ts.release()
        col = {c: table.column(c).to_numpy() for c in ("key", "cls", "n", "level", "comp")}
        least = table.column("least").fill_null(-1).to_numpy()
        order = np.argsort(col["key"], kind="stable")
        key, cls, n, level, comp = (col[c][order] for c in ("key", "cls", "n", "level", "comp"))
        least = least[order]
        masked = least >= 0
        _, of, number = np.unique(cls, return_index=True, return_inverse=True)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        met, found, codes = np.zeros(len(of), np.int64), [], Codes()
        held = 0

        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            c = comp[a:b]
            if (c == c[0]).all():
                continue
            met[number[a:b]] += 1
            # A masked class has a pair here only with partners below the mask's least size.
            able = a + np.flatnonzero(~masked[a:b] | (100 * least[a:b] > settings.percent * n[a:b]))
            for i, j in _across(comp[able]):
                i, j = able[i], able[j]
                good = _fits(n[i], n[j], settings.percent) & (~masked[i] | (n[j] < least[i])) & (~masked[j] | (n[i] < least[j]))
                i, j = number[i[good]], number[j[good]]
                found.append(np.minimum(i, j) * len(of) + np.maximum(i, j))
                held += len(i)
                if held > PAIRS:
                    codes.add(np.concatenate(found))
                    found, held = [], 0
        if found:
            codes.add(np.concatenate(found))
        some = np.flatnonzero(met)
        out = [pa.table([pa.array(np.ones(len(some), np.int32)), pa.array(cls[of[some]]), pa.array(cls[of[some]]), pa.array(met[some]), pa.array(np.zeros(len(some), np.int32))], names=["kind", "a", "b", "c", "level"])]
        code, count = codes.merged()
        if len(code):
            x, y = of[code // len(of)], of[code % len(of)]
            out.append(pa.table([pa.array(np.zeros(len(x), np.int32)), pa.array(cls[x]), pa.array(cls[y]), pa.array(count.astype(np.int64)), pa.array(np.minimum(level[x], level[y]).astype(np.int32))], names=["kind", "a", "b", "c", "level"]))
        return pa.concat_tables(out)

    return run


_OUTSIDE_NAMES = ["bucket", "low", "flag", "idx", "cls", "n", "comp", "least", "bound"]
_OUTSIDE = "bucket long, low binary, flag binary, idx binary, cls binary, n binary, comp binary, least binary, bound binary"


def _outside(settings: Settings, order: Order, bits: int):
    """Packed shingles of whole sets by bucket, with a flag for those that a masked class looks up: its first ones outside its hub."""

    def flags(x: np.ndarray, hub: np.ndarray) -> np.ndarray:
        free = hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] != x
        by = np.argsort(order.weigh(x), kind="stable")
        by = by[free[by]]
        out = np.zeros(len(x), bool)
        need = -(-len(x) * settings.percent // 100)
        out[by[: len(x) - max(len(x) - len(by), need - 1)]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            plain = [batch.column(i).to_pylist() for i in (0, 1, 2, 3)]
            for i in range(batch.num_rows):
                x, hub = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64), batch.column(5)[i]
                flag = flags(x, np.frombuffer(hub.as_buffer(), np.uint64)) if hub.is_valid else np.zeros(len(x), bool)
                held.append((plain[0][i], len(x), plain[1][i], -1 if plain[2][i] is None else plain[2][i], plain[3][i] or 0, x, flag))
                size += len(x)
                if size < settings.counted and i + 1 < batch.num_rows:
                    continue
                owned = [np.array([r[k] for r in held], np.int64) for k in range(5)]
                h, flag = np.concatenate([r[5] for r in held]), np.concatenate([r[6] for r in held])
                idx = np.repeat(np.arange(len(held)), [len(r[5]) for r in held])
                bucket, low = _keyed(h, bits)
                yield _packed(bucket, [low, flag.astype(np.uint8)], idx, owned, _OUTSIDE_NAMES)
                held, size = [], 0

    return run


def _asked(settings: Settings):
    """Of a bucket: counted pairs of a masked class with the classes that have what it looks up; ``level`` is the count that the pair needs in all."""

    def run(table: pa.Table) -> pa.Table:
        ts.release()
        p = Packed(table)
        low, flag, idx = p.column("low", np.uint32), p.column("flag", np.uint8) > 0, p.owners("cls")
        cls, n, comp, least, bound = (p.column(c, np.int64) for c in ("cls", "n", "comp", "least", "bound"))
        wanted = np.unique(low[flag])
        at = np.minimum(np.searchsorted(wanted, low), max(len(wanted) - 1, 0))
        keep = wanted[at] == low if len(wanted) else np.zeros(len(low), bool)
        low, flag, idx = low[keep], flag[keep], idx[keep]
        order = np.argsort(low, kind="stable")
        low, flag, idx = low[order], flag[order], idx[order]
        first, length = np.unique(low, return_index=True, return_counts=True)[1:]
        ask = np.flatnonzero(flag)
        in_list = np.searchsorted(first, ask, "right") - 1
        codes = Codes()
        step = max(1, PAIRS // max(1, int(length.max()) if len(length) else 1))
        for at in range(0, len(ask), step):  # blocks, for memory
            mine = ask[at : at + step]
            size = length[in_list[at : at + step]]
            stop = np.cumsum(size)
            other = np.repeat(first[in_list[at : at + step]] - stop + size, size) + np.arange(stop[-1])
            a, b = np.repeat(idx[mine], size), idx[other]
            good = (comp[a] != comp[b]) & (n[b] >= least[a]) & _fits(n[a], n[b], settings.percent)
            codes.add(a[good] * len(cls) + b[good])
        code, count = codes.merged()
        a, b = code // max(1, len(cls)), code % max(1, len(cls))
        # The shared shingles in all must be percent / (100 + percent) of both sizes; ``bound`` of them may lie elsewhere.
        need = -(-(n[a] + n[b]) * settings.percent // (100 + settings.percent)) - bound[a]
        return pa.table([pa.array(cls[a]), pa.array(cls[b]), pa.array(count.astype(np.int64)), pa.array(need)], names=["a", "b", "c", "need"])

    return run


def _bits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, ...) with ``maybe``: false only if the id is not among ``ids``.  A bitmap of at most 16 MB over a hash of the id (4096 rows of 4 KB) goes to all; a join on the rows left is exact.  Beyond some 10^8 ids the bitmap fills, and that join moves more rows."""
    bits = 1 << min(27, max(20, (8 * ids.count()).bit_length()))
    place = f"pmod(xxhash64(doc_id), {bits})"
    made = ids.selectExpr(f"{place} DIV 32768 AS page", f"{place} % 32768 AS bit").groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    joined = rows.withColumns({"page": F.expr(f"{place} DIV 32768"), "bit": F.expr(f"{place} % 32768")}).join(F.broadcast(made), "page", "left")
    byte = "CAST(conv(hex(substring(bitmap, CAST(bit DIV 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    return joined.select(*rows.columns, F.expr(f"coalesce((shiftright({byte}, CAST(bit % 8 AS INT)) & 1) = 1, false)").alias("maybe"))


def _rows(texts: DataFrame, settings: Settings, scratch: common.Scratch) -> tuple[DataFrame, DataFrame, Sets, Order]:
    """(doc_id, cls, n_shingles) of every row, (cls, doc) of every class with its least id, the classes, and the order."""
    sets = Sets(settings)
    summary = scratch.store(texts.mapInArrow(_summary(sets), "doc_id long, cls long, second long, n long, frequent boolean"))
    rows = summary.filter("NOT frequent").select("doc_id", "cls", F.col("n").alias("n_shingles"), "second")
    groups = scratch.store(rows.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc"), (F.min("second") != F.max("second")).alias("clash")))
    if not groups.filter("clash").isEmpty():
        # Different sets with one number, some at 10^10 sets: all but the first get new numbers.
        among = rows.join(groups.filter("clash").select("cls"), "cls", "left_semi").select("cls", "second").distinct()
        clashes: dict[tuple[int, int], int] = {}
        for c, second in sorted((r[0] % 2**64, r[1] % 2**64) for r in among.collect()):
            if any(k[0] == c for k in clashes) or clashes.setdefault((c, second), c) != c:
                clashes[c, second] = int(ts.mix(np.array([c ^ second], np.uint64))[0] | np.uint64(1))
        sets = Sets(settings, clashes)
        signed = [(c - (c >> 63 << 64), s - (s >> 63 << 64), x - (x >> 63 << 64)) for (c, s), x in clashes.items()]
        other = texts.sparkSession.createDataFrame(signed, "cls long, second long, other long")
        rows = scratch.store(rows.join(other, ["cls", "second"], "left").select("doc_id", F.coalesce("other", "cls").alias("cls"), "n_shingles"))
        groups = scratch.store(rows.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc")))
    top = summary.filter("frequent").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(settings.frequent).toArrow()
    keys, counts = top.column("cls").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    by = np.argsort(keys)
    return rows.select("doc_id", "cls", "n_shingles"), groups.select("cls", "doc"), sets, Order(keys[by], np.clip(np.round(8 * np.log2(1 + counts[by])), 1, 255).astype(np.uint8))


def classify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Sets]:
    """(doc_id, cls, n_shingles) of every row, (cls, component_id, comp) of every class, and what numbers the classes; ``comp`` is one class of the component."""
    scratch = common.Scratch(docs.sparkSession)
    with common.table_after_table(docs.sparkSession):
        return _classify(_texts(docs, id_col, text_col), settings, scratch)


def _classify(texts: DataFrame, settings: Settings, scratch: common.Scratch) -> tuple[DataFrame, DataFrame, Sets]:
    rows, groups, sets, order = _rows(texts, settings, scratch)
    kept = list(scratch.held)
    total = (rows.agg(F.sum("n_shingles")).first()[0] or 0) * (100 - settings.percent) / 100
    bits = min(30, max(3, int(np.ceil(np.log2(max(1.0, total / settings.bucket))))))
    # A table of at most ``frequent`` rows goes to every task with the function.
    packed = texts.select("text").mapInArrow(_postings(sets, order, bits), _POSTINGS)
    met = scratch.store(packed.groupBy("bucket").applyInArrow(_lists(settings), _MET))

    # A partner has at least 75 % of the shingles, and so at least 75 % of the least level.
    floor = F.expr(f"greatest(1, n * {min(settings.levels) * settings.percent} DIV 10000 - lost)")
    own = met.filter(F.col("kind") == CLASS).groupBy(F.col("a").alias("cls")).agg(F.sum("c").alias("few"), F.sum("n").alias("many"), F.first("level").alias("n"), F.first("key").alias("lost"))
    involved = scratch.store(own.filter(F.col("few") + F.col("many") >= floor).select("cls", "n", "many", floor.alias("floor")))
    one, two = (involved.select(F.col("cls").alias(x), F.col("many").alias(f"many_{x}")) for x in "ab")
    pairs = met.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("level").alias("level"))
    pairs = pairs.join(one, "a").join(two, "b").filter(F.col("c") + F.least("many_a", "many_b") >= F.col("level"))
    star = met.filter(F.col("kind") == STAR).groupBy("b", "a").agg(F.sum("c").alias("c")).join(one, "a").join(two, "b")
    star = star.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).filter(F.col("r") <= settings.hubs)
    chosen = scratch.store(pairs.select("a", "b", F.lit(False).alias("star")).union(star.select("a", "b", F.lit(True))))

    some = texts.select("text").mapInArrow(_sets(sets, Members(involved)), "cls long, shingles binary").repartition(common.buckets(scratch.spark), "cls")
    whole = scratch.store_by(some.join(involved.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "cls")

    found = scratch.store(verified(chosen, whole, settings, scratch))
    links = found.filter("linked").select("a", "b")
    labels = components(links, scratch)
    # Of a class that failed several hubs, the mask that leaves least to look up.
    failed = found.filter("star AND NOT linked")
    masks = failed.groupBy(F.col("b").alias("cls")).agg(F.max_by(F.struct(F.col("a").alias("hub"), "least", "bound"), F.struct("bound", "a")).alias("m")).select("cls", "m.*")
    state = scratch.store(involved.join(labels.select("cls", "comp"), "cls", "left").join(masks, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "n", "floor", "hub", "least", "bound"))
    lists = met.filter(F.col("kind") == LIST).select("key", F.col("a").alias("cls"), "level").join(state.select("cls", "comp", "n", "least"), "cls")
    left = scratch.store(lists.withColumn("bucket", F.shiftright("key", 32)).groupBy("bucket").applyInArrow(_uncovered(settings), _OPEN))
    counted = left.filter("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("level").alias("level")).filter("c >= level")

    # A pair that shares long lists only is in as many of them as the least level asks.
    mixed = left.filter("kind = 1").groupBy(F.col("a").alias("cls")).agg(F.sum("c").alias("lists"))
    asking = state.join(mixed, "cls").filter("lists >= floor")
    hubs = asking.select("cls", "hub").join(whole.select(F.col("cls").alias("hub"), F.col("shingles").alias("y")), "hub").select("cls", "y")
    outside = whole.join(asking, "cls").join(hubs, "cls", "left").select("cls", "comp", "least", "bound", "shingles", "y")
    outside = outside.mapInArrow(_outside(settings, order, min(30, bits + 2)), _OUTSIDE)
    asked = outside.groupBy("bucket").applyInArrow(_asked(settings), "a long, b long, c long, need long")
    asked = asked.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("need").alias("need")).filter("c >= need").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.store(counted.select("a", "b").union(asked).distinct().withColumn("star", F.lit(False)))
    rest = scratch.store(verified(rest, whole, settings, scratch).filter("linked").select("a", "b"))
    final = labels.select("cls", "comp")
    if not rest.isEmpty():
        comp = state.select("cls", "comp")
        across = rest.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("x")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("y")), "b")
        joined = components(across.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
        every = comp.join(joined.select(F.col("cls").alias("comp"), F.col("comp").alias("root")), "comp", "left")
        final = every.select("cls", F.coalesce("root", "comp").alias("comp"))
    member = scratch.store(final.join(groups, "cls"))
    least = scratch.store(member.groupBy("comp").agg(F.min("doc").alias("least")))
    out = groups.join(member.join(least, "comp").select("cls", "least", "comp"), "cls", "left")
    out = scratch.store(out.select("cls", F.coalesce("least", "doc").alias("component_id"), F.coalesce("comp", "cls").alias("comp")))
    scratch.drop_all(out, *kept)
    return rows, out, sets


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component) of every row."""
    rows, labels, _ = classify(docs, settings, id_col, text_col)
    linked = rows.filter("n_shingles > 0").join(labels, "cls").select("doc_id", "n_shingles", "component_id")
    return linked.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component: that with the least id.

    Rows without shingles are a component each and stay.  Rows that share an id
    (or have none) are told apart by their text: of each component one stays.
    """
    rows, labels, sets = classify(docs, settings, id_col, text_col)
    scratch = common.Scratch(docs.sparkSession)
    linked = rows.filter("n_shingles > 0").join(labels, "cls")
    odd = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id")
    with common.table_after_table(docs.sparkSession):
        odd = scratch.store(odd)
        gone = scratch.store(linked.filter("doc_id != component_id").select("doc_id").union(odd.filter("doc_id IS NOT NULL")).distinct())
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # Most rows are surely no copies and pass without a shuffle.
    flagged = _bits(whole.filter("doc_id IS NOT NULL"), gone)
    unsure = flagged.filter("maybe").drop("maybe").join(gone, "doc_id", "left_anti")
    out = flagged.filter("NOT maybe").select("row.*").union(unsure.select("row.*"))
    if odd.isEmpty():
        return out
    special = whole.join(odd, whole["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi").select("doc_id", F.col(f"row.`{text_col}`").cast("string").alias("text"), "row")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slabs(batch.column(1)):
                cls = sets.read(data, offsets)[3]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cls.view(np.int64)), batch.column(2).slice(lo, hi - lo)], ["doc_id", "cls", "row"])

    told = special.mapInArrow(numbered, f"doc_id long, cls long, row {docs.schema.simpleString()}")
    one = told.join(labels, "cls").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["comp"])
    return out.union(told.filter("cls = 0").select("row.*")).union(one.select("row.*"))
