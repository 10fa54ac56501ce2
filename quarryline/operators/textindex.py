"""An inverted index as tables, and batches of full-text queries answered from it in one plan.

``build`` leaves three Parquet tables.  ``blocks``: for each term its postings in
order of ids, cut into blocks of ``BLOCK`` with the range of ids and the greatest
BM25 weight in the block; sorted by term, so that a reader that knows the terms
skips all other row groups and pages.  ``terms``: document frequency and greatest
weight of each term.  ``stats``: number of documents and of tokens.

``search_any`` ranks the documents that hold any term of a query by BM25, with
block-max pruning: the k-th greatest block weight of a term is a lower bound of
the k-th score, and blocks that cannot reach it together with the other terms'
greatest weights are never read.  ``search_web`` answers web-style queries
(alternatives of terms and phrases, wanted or excluded) by BM25 or by
``ts_rank``; phrases are checked on stored positions, shard by shard of the
documents.  Neither reads a text.

Analysers: ``simple`` (runs of letters and digits in lower case), ``folded``
(without diacritics, in any script) and ``english`` (stop words out, stems).
Defined cases: null and blank texts have no terms; a query without terms, or an
alternative with none that is wanted, finds nothing; rows without an id are left
out, and ids that are not distinct are an error; ties rank by id.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stemming import STOP_WORDS, stem
from ..session import shared_path
from .fulltext import B, K1, parse

BLOCK = 128
#: Words of the documents in a shard, some; programs of a batch that are read at once; terms that are sent to all tasks.
SHARD, PROGRAMS, SENT = 1 << 22, 4096, 2_000_000
#: So many distinct terms of a batch are given to the scan as a filter; larger batches are joined only.
PUSHED = 400
_POSTING = "id long, term string, tf long, doc_len long, positions array<int>"


def folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def analysed(words: list[str], analyser: str) -> list[str | None]:
    """What stands for each word, None where it is left out."""
    if analyser == "simple":
        return words
    if analyser == "folded":
        return [folded(w) for w in words]
    if analyser == "english":
        return [None if w in STOP_WORDS else stem(w) for w in words]
    raise ValueError(f"analyser {analyser!r}: simple, folded or english")


def _terms_of(texts: pa.Array, analyser: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Text number, term number and place of each kept word, the terms, and the kept words of each text."""
    cut = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    word, text = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
    full = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    text = text[full]
    coded = word.filter(pa.array(full)).dictionary_encode()
    codes, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    words = np.bincount(text, minlength=len(texts))
    place = np.arange(len(text)) - np.repeat(np.cumsum(words) - words, words)
    if analyser != "simple":  # each distinct word once
        said = pa.array(analysed(known, analyser), pa.string()).dictionary_encode()
        to = said.indices.fill_null(-1).to_numpy()[codes] if len(codes) else codes
        stays = to >= 0
        text, codes, place, coded = text[stays], to[stays], place[stays], said
    return text, codes, place, coded.dictionary, np.bincount(text, minlength=len(texts))


def postings(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyser: str = "simple") -> DataFrame:
    """id, term, tf, doc_len (words that are not left out), positions (from 0, in all words): counted inside each row, so nothing is shuffled to make them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                text, term, place, names, lengths = _terms_of(batch.column(1), analyser)
                order = np.lexsort((place, term, text))
                text, term, place = text[order], term[order], place[order]
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (term[1:] != term[:-1])]) if len(text) else np.zeros(0, np.int64)
                offsets = np.r_[first, len(text)].astype(np.int32)
                at = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), names.take(pa.array(term[first])), pa.array(np.diff(offsets).astype(np.int64)), pa.array(lengths[text[first]]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))], ["id", "term", "tf", "doc_len", "positions"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, _POSTING)


def vocabulary(rows: DataFrame, text_col: str = "text", analyser: str = "simple") -> DataFrame:
    """term, df, cf over all rows: a batch of texts sums its words before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                text, term, _, names, _ = _terms_of(whole.column(0).slice(lo, 2000), analyser)
                cf = np.bincount(term, minlength=len(names))
                df = np.bincount(np.unique(text.astype(np.int64) * max(len(names), 1) + term) % max(len(names), 1), minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(df), pa.array(cf)], ["term", "df", "cf"])

    part = rows.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "term string, df long, cf long")
    return part.filter("cf > 0").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@dataclass(frozen=True)
class Index:
    """A written index: its folder and how its words were made."""

    folder: str
    analyser: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


_BLOCK_TYPE = "term string, lo long, hi long, n int, weight double, ids array<long>, tfs array<long>, lens array<long>, positions array<array<int>>"


def _cut(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``size`` from postings (term, id, tf, doc_len, positions, weight) that come in order of term and id; at most a batch and a block are held."""
    left: pa.RecordBatch | None = None

    def blocks(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch | None]:
        term = rows.column(0).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        ends = np.r_[first[1:], len(term)]
        starts = np.concatenate([np.arange(a, b, size) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])
        offsets = np.r_[starts, len(term)].astype(np.int32)
        full = len(starts) if last else len(starts) - 1  # the last one may go on
        if full:
            at, cut = pa.array(starts[:full]), pa.array(offsets[: full + 1])
            lists = [pa.ListArray.from_arrays(cut, rows.column(i).slice(0, offsets[full])) for i in (1, 2, 3, 4)]
            top = np.maximum.reduceat(rows.column(5).to_numpy()[: offsets[full]], starts[:full])
            hi = rows.column(1).take(pa.array(offsets[1 : full + 1] - 1))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), hi, pa.array(np.diff(offsets[: full + 1])), pa.array(top), *lists], ["term", "lo", "hi", "n", "weight", "ids", "tfs", "lens", "positions"])
        yield None if last else rows.slice(int(offsets[full]))

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([left, batch] if left is not None else [batch]).combine_chunks().to_batches()[0]
            *made, left = blocks(rows, False)
            yield from made
    if left is not None:
        *made, _ = blocks(left, True)
        yield from made


def build(rows: DataFrame, folder: str, analyser: str = "simple", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Index:
    """Writes the index of all rows with an id; the postings are made once and sorted once by (term, id), so a common term is spread over tasks."""
    spark = rows.sparkSession
    kept = rows.filter(F.col(f"`{id_col}`").isNotNull())
    postings(kept, id_col, text_col, analyser).write.parquet(f"{folder}/postings")
    found = spark.read.schema(_POSTING).parquet(f"{folder}/postings")
    n_docs, n_ids = kept.agg(F.count("*"), F.count_distinct(F.col(f"`{id_col}`"))).first()
    if n_docs != n_ids:
        raise ValueError("an index needs distinct ids")
    tokens = found.agg(F.sum("tf")).first()[0] or 0
    mean = tokens / n_docs if n_docs else 0.0
    stats = spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(mean).cast("double").alias("avg_len"))
    stats.write.parquet(f"{folder}/stats")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(max(mean, 1e-9))))
    # What follows from the rest of a row is made after the sort, and the rows it was made from go when they are in blocks.
    ordered = found.select("term", "id", "doc_len", "positions").orderBy("term", "id").withColumn("tf", F.size("positions").cast("long"))
    ordered = ordered.withColumn("weight", weight).select("term", "id", "tf", "doc_len", "positions", "weight")
    blocks = ordered.mapInArrow(partial(_cut, block), _BLOCK_TYPE)
    blocks.write.option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 256).parquet(f"{folder}/blocks")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/postings")
    gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)
    terms = spark.read.schema(_BLOCK_TYPE).parquet(f"{folder}/blocks").groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.max("weight").alias("top"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    return Index(folder, analyser)


def _asked(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of the asked terms: by a pushed filter while they are few, and by the join that follows in any case."""
    some = [r[0] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(some) > PUSHED or not some:
        return table
    wanted = F.lit(False)
    for t in sorted(some):
        wanted = wanted | (F.col("term") == t)
    return table.filter(wanted)


def _idf(spark: SparkSession, index: Index) -> tuple:
    """(1 row of statistics read) idf of a term with document frequency ``df``."""
    stats = index.table(spark, "stats").first()
    n = F.lit(float(stats["n_docs"]))
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), max(stats["avg_len"], 1e-9)


def _weight(mean: float):
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(mean)))


def _exploded(blocks: DataFrame, *keep: str, positions: bool = False) -> DataFrame:
    """One row for each posting of the blocks."""
    lists = [F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lens").alias("doc_len"), *([F.col("positions")] if positions else [])]
    rows = blocks.select(*keep, F.explode(F.arrays_zip(*lists)).alias("p"))
    return rows.select(*keep, "p.*")


def best(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score (4 places) of the k best by unrounded score (to 9 places) and id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def kept_blocks(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """query_id, term, idf, lo of the blocks that may hold one of the k best; ``asked`` is (query_id, term), distinct.  Reads no postings."""
    spark = asked.sparkSession
    idf, _ = _idf(spark, index)
    known = asked.join(_asked(index.table(spark, "terms"), asked), "term").withColumn("idf", idf)
    heads = known.join(_asked(index.table(spark, "blocks"), asked).select("term", "lo", "weight"), "term")
    heads = heads.withColumn("upper", F.col("idf") * F.col("weight"))
    # Each block has a document of its greatest weight, so k blocks of a term are k documents of at least the k-th weight.
    nth = heads.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("upper")))).filter(F.col("r") <= k)
    least = nth.filter(F.col("r") == k).groupBy("query_id").agg(F.max("upper").alias("least"))
    others = known.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("top")).alias("all"))
    limits = others.join(least, "query_id", "left")
    able = heads.join(limits, "query_id").filter(F.col("least").isNull() | (F.col("upper") + F.col("all") - F.col("idf") * F.col("top") >= F.col("least") - 1e-6))
    return able.select("query_id", "term", "idf", "lo")


def search_any(index: Index, queries: DataFrame, k: int, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, id, score: for each query the k documents of the greatest BM25 over its distinct terms."""
    spark = queries.sparkSession
    asked = postings(queries, id_col, text_col, index.analyser).select(F.col("id").alias("query_id"), "term").distinct()
    able = kept_blocks(index, asked, k)
    _, mean = _idf(spark, index)
    blocks = _asked(index.table(spark, "blocks"), asked).select("term", "lo", "ids", "tfs", "lens")
    hits = _exploded(able.join(blocks, ["term", "lo"]), "query_id", "idf")
    scored = hits.groupBy("query_id", "id").agg(F.sum(F.col("idf") * _weight(mean)).alias("score"))
    return best(scored, k)


def _programs(analyser: str):
    """query_id, what it asks (as text, alike for queries that ask alike) and its terms.

    A program has the number of distinct terms, whether it is of one alternative of
    several terms, and the alternatives: clauses of whether they are wanted and of terms
    with their places.  Queries without an alternative that wants something are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = []
                for g in parse(text or ""):
                    phrases = [(True, p) for p in g.wanted] + [(False, p) for p in g.excluded]
                    clauses = [(wanted, [(i, t) for i, t in enumerate(analysed(p.split(), analyser)) if t]) for wanted, p in phrases]
                    parts.append([c for c in clauses if c[1]])
                parts = [p for p in parts if p]
                names = sorted({t for p in parts for _, said in p for _, t in said})
                able = [p for p in parts if any(wanted for wanted, _ in p)]
                if key is not None and able:
                    out.append((key, json.dumps([len(names), len(parts) == 1 and len(names) > 1, able], ensure_ascii=False), names))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], ["query_id", "program", "terms"])

    return run


def _packed_programs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (asks, program) as compressed JSON."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PROGRAMS):
            part = batch.slice(lo, PROGRAMS)
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(json.dumps(rows).encode())], pa.binary())], ["data"])


def _dealt(shards: int, mean: float | None):
    """(shard, data) from blocks of asked terms: the postings of each shard of documents (term, id, positions, and with a mean length their BM25), compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).flatten().to_numpy()
            if not len(ids):
                continue
            block, places = pc.list_parent_indices(batch.column(1)).to_numpy(), batch.column(2).flatten()
            coded = batch.column(0).dictionary_encode()  # a term has several blocks
            term = coded.indices.to_numpy()[block]
            columns = {"id": pa.array(ids), "positions": places}
            if mean is not None:
                tf, length = (batch.column(i).flatten().to_numpy() for i in (3, 4))
                columns["gain"] = pa.array(batch.column(5).to_numpy()[block] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))
            shard = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            there, first = np.unique(shard[order], return_index=True)
            for s, lo, hi in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                pick = order[lo:hi]
                used, code = np.unique(term[pick], return_inverse=True)
                names = pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), coded.dictionary.take(pa.array(used)))
                piece = pa.RecordBatch.from_arrays([names, *(c.take(pa.array(pick)) for c in columns.values())], ["term", *columns])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "data"])

    return run


# Fixed values of the ranking function.
WORD_WEIGHT, SERIES, FARTHEST = 0.1, 1.64493406685, 100


#: log(1 - weight) of two places by the gap between them; farther ones weigh less than a double can show.
_GAPS = np.r_[0.0, np.log1p(-WORD_WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(np.arange(1, FARTHEST + 1) / 1.5 - 2))))]
#: Most pairs of places that are held at once.
_PAIRS = 1 << 20
#: More places than a phrase has.
_PAD = 1 << 20


class _Shard:
    """The postings of a shard's documents by term, each place as one number that grows with document and place."""

    def __init__(self, pieces: list[bytes]):
        table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in pieces]).unify_dictionaries().combine_chunks()
        term = table.column("term").chunk(0)
        self.codes = {t: i for i, t in enumerate(term.dictionary.to_pylist())}
        self.ids, doc = np.unique(table.column("id").to_numpy(), return_inverse=True)
        code = term.indices.to_numpy()
        order = np.lexsort((doc, code))
        self.doc = doc[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.codes) + 1))
        places = table.column("positions").chunk(0).take(pa.array(order))
        counts = places.value_lengths().to_numpy()
        self.at = np.r_[0, np.cumsum(counts)]
        flat = places.flatten().to_numpy().astype(np.int64)
        self.width = int(flat.max()) + _PAD + 1
        self.place_doc = np.repeat(self.doc, counts)
        self.places = self.place_doc * self.width + flat
        if "gain" in table.column_names:
            self.gain, self.bm25 = table.column("gain").to_numpy()[order], True
        else:
            partial_sums = np.r_[0.0, np.cumsum(1 / np.arange(1, int(counts.max()) + 1) ** 2)]
            self.gain, self.bm25 = WORD_WEIGHT * partial_sums[counts] / SERIES, False
        self.known: dict[tuple, np.ndarray] = {}

    def of(self, term: str) -> slice:
        code = self.codes.get(term)
        return slice(0, 0) if code is None else slice(int(self.first[code]), int(self.first[code + 1]))

    def at_places(self, term: str) -> slice:
        rows = self.of(term)
        return slice(int(self.at[rows.start]), int(self.at[rows.stop]))

    def holding(self, said: list) -> np.ndarray:
        """Documents with a phrase, in order; each phrase is looked for once."""
        if len(said) == 1:
            return self.doc[self.of(said[0][1])]
        key = tuple(map(tuple, said))
        if key not in self.known:
            lists = sorted(((self.places[self.at_places(t)], i) for i, t in said), key=lambda x: len(x[0]))
            starts = lists[0][0] - lists[0][1]
            for places, i in lists[1:]:
                if not len(places):
                    starts = starts[:0]
                elif len(starts):
                    near = np.searchsorted(places, starts + i)
                    starts = starts[places[np.minimum(near, len(places) - 1)] == starts + i]
            self.known[key] = np.unique((starts + _PAD) // self.width)
        return self.known[key]

    def matched(self, parts: list) -> np.ndarray:
        """Which documents an alternative accepts."""
        out = np.zeros(len(self.ids), bool)
        for clauses in parts:
            found = np.ones(len(self.ids), bool)
            for wanted, said in sorted(clauses, key=lambda c: not c[0]):
                held = np.zeros(len(self.ids), bool)
                held[self.holding(said)] = True
                found &= held if wanted else ~held
                if not found.any():
                    break
            out |= found
        return out

    def near(self, one: str, two: str, among: np.ndarray) -> np.ndarray:
        """For each document the sum over the pairs of places of two terms at most FARTHEST apart."""
        rows = sorted((self.at_places(t) for t in (one, two)), key=lambda x: x.stop - x.start)
        (left, doc), (right, _) = ((self.places[r][m], self.place_doc[r][m]) for r in rows for m in [among[self.place_doc[r]]])
        out = np.zeros(len(self.ids))
        lo, hi = np.searchsorted(right, left - FARTHEST), np.searchsorted(right, left + FARTHEST, "right")
        some = np.flatnonzero(hi > lo)
        left, doc, lo, n = left[some], doc[some], lo[some], (hi - lo)[some]
        ends = np.cumsum(n)
        begin = 0
        while begin < len(n):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
            m = n[begin:end]
            total = int(m.sum())
            other = right[np.repeat(lo[begin:end] - np.cumsum(m) + m, m) + np.arange(total)]
            gap = np.abs(np.repeat(left[begin:end], m) - other)
            out += np.bincount(np.repeat(doc[begin:end], m), _GAPS[gap], minlength=len(out))
            begin = end
        return out

    def best(self, program: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, scores and scores to 9 places of the k best documents of a program, ties by id."""
        operands, conjunction, parts = program
        among = self.matched(parts)
        found = np.flatnonzero(among)
        if not len(found):
            return self.ids[:0], np.zeros(0), np.zeros(0)
        names = sorted({t for p in parts for wanted, said in p if wanted for _, t in said})
        score = np.zeros(len(self.ids))
        if conjunction and not self.bm25:
            for j, two in enumerate(names):
                for one in names[:j]:
                    score += self.near(one, two, among)
            score = np.where(score == 0, 1e-20, -np.expm1(score))[found]
        else:
            for t in names:
                rows = self.of(t)
                score[self.doc[rows]] += self.gain[rows]
            score = score[found] if self.bm25 else score[found] / operands
        order = np.round(score, 9)
        if len(found) > k:
            least = -np.partition(-order, k - 1)[k - 1]
            above = np.flatnonzero(order > least)
            top = np.r_[above, np.flatnonzero(order == least)[: k - len(above)]]
            found, score, order = found[top], score[top], order[top]
        return self.ids[found], score, order


def _searched(k: int):
    """asks, id, score, raw of the k best in each shard; the postings of a shard come before the programs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, held = None, [], None
        for batch in batches:
            for shard, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != now:
                    now, pieces, held = shard, [], None
                if kind == 0:
                    pieces.append(data.as_py())
                    continue
                if not pieces and held is None:
                    continue  # no posting in this shard
                if held is None:
                    held, pieces = _Shard(pieces), []
                rows = json.loads(zlib.decompress(data.as_py()))
                for lo in range(0, len(rows), 512):
                    found = [(asks, *held.best(json.loads(program), k)) for asks, program in rows[lo : lo + 512]]
                    asks = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(asks), *(pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2, 3))], ["asks", "id", "raw", "order"])

    return run


def search_web(index: Index, queries: DataFrame, k: int, rank: str = "ts_rank", id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, id, score of the k best documents that match each web-style query, by ``ts_rank`` or ``bm25`` of its terms.

    The postings of asked terms are dealt once over shards of documents; every shard
    answers all queries, and only its k best of each go on.  Queries that ask alike
    are answered once.  What is asked is written down and read again.
    """
    if rank not in ("ts_rank", "bm25"):
        raise ValueError(f"rank {rank!r}: ts_rank or bm25")
    spark = queries.sparkSession
    texts = queries.select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path, schema = shared_path(spark, "asked"), "query_id long, program string, terms array<string>"
    texts.mapInArrow(_programs(index.analyser), schema).write.parquet(path)
    asked = spark.read.schema(schema).parquet(path)
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    stats = index.table(spark, "stats").first()
    shards = max(1, round(stats["n_docs"] * stats["avg_len"] / SHARD))
    mean = max(stats["avg_len"], 1e-9) if rank == "bm25" else None
    if mean is not None:
        terms = terms.join(_asked(index.table(spark, "terms"), terms), "term").select("term", _idf(spark, index)[0].alias("idf"))
    few = terms.limit(SENT + 1).count() <= SENT
    blocks = _asked(index.table(spark, "blocks"), terms).select("term", "ids", "positions", "tfs", "lens")
    blocks = blocks.join(F.broadcast(terms) if few else terms, "term")
    blocks = blocks.select("term", "ids", "positions", *([] if mean is None else ["tfs", "lens", "idf"]))
    postings_ = blocks.mapInArrow(_dealt(shards, mean), "shard int, data binary").select("shard", F.lit(0).alias("kind"), "data")
    alike = asked.groupBy("program").agg(F.min("query_id").alias("asks"))
    packed = alike.select("asks", "program").coalesce(8).mapInArrow(_packed_programs, "data binary")
    everywhere = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "data")
    rows = postings_.unionByName(everywhere).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = rows.mapInArrow(_searched(k), 'asks long, id long, raw double, `order` double')
    place = Window.partitionBy("asks").orderBy(F.desc("order"), "id")
    top = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    who = asked.join(alike, "program").select("query_id", "asks")
    return top.join(who, "asks").select("query_id", "rank", "id", F.round("raw", 4).alias("score"))
