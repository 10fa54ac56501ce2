"""Language detection: profiles of character n-grams, naive Bayes, the script where it tells more, and arbitration with an outside result.

A profile is whole: every n-gram of two to five characters that a language's
rows hold, with its count.  A text's n-grams are counted inside its row.  Of the
profiles the commonest n-grams (``IN_ROW`` rows at most, which bounds what is
sent with the function) are looked up there too; if there are more, a row's
other n-grams meet the rest of the profiles bucket by bucket, so that no n-gram is
cut off and those that nearly every text holds are never dealt out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..session import shared_path

# Sizes of n-grams, the pseudo-count, and from which confidence a result counts.
SIZES, ALPHA = (2, 3, 4, 5), 0.1
SURE, SURE_GRAMS = 0.7, 0.55
#: A shorter text gets a language from its script alone.
LEAST = 10
#: Most rows (n-gram, language) of the profiles that are sent with the function: some 30 MB.
IN_ROW = 300_000
#: Rows of the other profiles that a task holds, some.
BUCKET = 1_000_000


BITS = 12


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, Counter]:
    """The n-grams of a text with a space at either end (none of an empty text): those of characters below 2^12 as numbers, five times 12 bits, with their counts, and the others by themselves."""
    wide: Counter = Counter()
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), wide
    text = f" {text} "
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    large = np.concatenate([[0], np.cumsum(points >= 1 << BITS)])
    parts = []
    for n in SIZES:
        count = len(points) - n + 1
        if count < 1:
            continue
        code = np.zeros(count, np.uint64)
        for j in range(n):
            code = (code << np.uint64(BITS)) | points[j : j + count].astype(np.uint64)
        if large[-1]:
            odd = large[n:] > large[:-n]
            wide.update(text[i : i + n] for i in np.flatnonzero(odd).tolist())
            code = code[~odd]
        parts.append(code)
    codes, counts = np.unique(np.concatenate(parts), return_counts=True)
    return codes, counts, wide


def _spelled(codes: np.ndarray) -> list[str]:
    """The n-grams of numbers; no n-gram has the character 0, so a shorter one has zeros in front."""
    most = max(SIZES)
    points = np.stack([(codes >> np.uint64(BITS * (most - 1 - j))) & np.uint64((1 << BITS) - 1) for j in range(most)], 1).astype(np.uint32)
    return [x.lstrip("\0") for x in np.ascontiguousarray(points).view(f"<U{most}").ravel().tolist()]


def _coded(gram: str) -> int | None:
    """The number of an n-gram, None where it has a character from 2^12 on."""
    code = 0
    for c in gram:
        if ord(c) >= 1 << BITS:
            return None
        code = code << BITS | ord(c)
    return code


def cleaned(text):
    return F.lower(rules.cleaned_for_detection(F.coalesce(text, F.lit(""))))


def profiles(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 2_000_000) -> DataFrame:
    """lang, gram, n: all n-grams of each language.  A task holds some ``most`` counts before it passes them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        wide: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums = np.zeros(len(codes), np.int64)
                np.add.at(sums, back, np.concatenate([n for _, n in parts]))
                for i in range(0, len(codes), 100_000):
                    grams = _spelled(codes[i : i + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(sums[i : i + 100_000])], ["lang", "gram", "n"])
                rest = wide[lang]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rest), pa.string()), pa.array([*rest], pa.string()), pa.array([*rest.values()], pa.int64())], ["lang", "gram", "n"])
            held.clear()
            wide.clear()

        count = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n, odd = _grams(text)
                held.setdefault(lang, []).append((codes, n))
                wide.setdefault(lang, Counter()).update(odd)
                count += len(codes) + 4 * len(odd)
                if count > most:
                    yield from flush()
                    count = 0
        yield from flush()

    known = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), cleaned(F.col(text_col)).alias("t"))
    return known.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Table:
    """Gains ln(1 + n / alpha) by n-gram: what a language's count adds to the score of an n-gram that it has not."""

    def __init__(self, gram: list[str], lang: np.ndarray, n: np.ndarray):
        gain = np.log1p(n / ALPHA)
        codes = [_coded(g) for g in gram]
        own = np.array([i for i, c in enumerate(codes) if c is not None], np.int64)
        key = np.array([codes[i] for i in own], np.uint64)
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        self.codes, first = np.unique(key, return_index=True)
        self.begin = np.append(first, len(key))
        self.lang, self.gain = lang[own], gain[own]
        self.wide: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(codes):
            if c is None:
                self.wide.setdefault(gram[i], []).append((int(lang[i]), float(gain[i])))

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of numbers in the table, and whether they are there."""
        at = np.searchsorted(self.codes, codes)
        return at, (self.codes[np.minimum(at, len(self.codes) - 1)] == codes) & (at < len(self.codes)) if len(self.codes) else np.zeros(len(codes), bool)

    def scores(self, codes: np.ndarray, counts: np.ndarray, wide: Counter, langs: int) -> np.ndarray:
        at, there = self.known(codes)
        at, n = at[there], counts[there]
        size = self.begin[at + 1] - self.begin[at]
        stop = np.cumsum(size)
        flat = np.repeat(self.begin[at] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)
        out = np.bincount(self.lang[flat], self.gain[flat] * np.repeat(n, size), minlength=langs).astype(float)  # of nothing, numpy counts in integers
        for g, times in wide.items():
            for i, gain in self.wide.get(g, ()):
                out[i] += times * gain
        return out

    def lacking(self, codes: np.ndarray, counts: np.ndarray, wide: Counter) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        """The n-grams of a text that the table has not: numbers, their counts, and the others by themselves."""
        away = ~self.known(codes)[1]
        return codes[away], counts[away], [{"gram": g, "n": n} for g, n in wide.items() if g not in self.wide]


def _numbers(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each n-gram, and which of them have one."""
    most = max(SIZES)
    points = np.array(grams, f"<U{most}").view(np.uint32).reshape(-1, most).astype(np.uint64)
    codes = np.zeros(len(points), np.uint64)
    for j in range(most):
        codes = np.where(points[:, j] > 0, (codes << np.uint64(BITS)) | points[:, j], codes)
    return codes, (points < 1 << BITS).all(1)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _pieces(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The rows of each bucket, compressed."""
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        part = pa.RecordBatch.from_arrays([pa.array(c[order[lo:hi]]) for c in columns.values()], [*columns])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        yield int(b), sink.getvalue().to_pybytes()


def _gained(rows: DataFrame, rest: DataFrame, langs: list[str], size: int) -> DataFrame:
    """rid, place (of the language), more: what the n-grams of rows (rid, codes, counts) gain from the rest of the profiles.

    Both are dealt over buckets of numbers, each row's n-grams as compressed runs; a bucket's
    profiles meet the runs of a slice of rows in one task, and only sums go on.
    """
    spark = rows.sparkSession
    buckets, slices = 1 + size // BUCKET, spark.sparkContext.defaultParallelism

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rid, lists, counts = (batch.slice(lo, 1000).column(i) for i in range(3))
                codes = lists.flatten().to_numpy().view(np.uint64)
                if not len(codes):
                    continue
                order = np.argsort(codes, kind="stable")
                codes, row = codes[order], rid.to_numpy()[pc.list_parent_indices(lists).to_numpy()][order]
                part = int(rid[0].as_py() >> 33) + int(rid[0].as_py() & 0x1FFFFFFFF) // 1000
                found = [*_pieces(_bucket(codes, buckets), {"code": codes, "rid": row, "n": counts.flatten().to_numpy()[order]})]
                yield pa.RecordBatch.from_arrays([pa.array([b * slices + part % slices for b, _ in found], pa.int32()), pa.array([1] * len(found), pa.int32()), pa.array([d for _, d in found], pa.binary())], ["deal", "kind", "data"])

    def profiles_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, own = _numbers(batch.column(0).to_pylist())
            place = np.array([langs.index(x) for x in batch.column(1).to_pylist()], np.int64)
            found = [*_pieces(_bucket(codes[own], buckets), {"code": codes[own], "place": place[own], "gain": np.log1p(batch.column(2).to_numpy()[own] / ALPHA)})]
            for b, data in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(b * slices, (b + 1) * slices), pa.int32()), pa.array([0] * slices, pa.int32()), pa.array([data] * slices, pa.binary())], ["deal", "kind", "data"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            for deal, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if deal != now:
                    now, held, table = deal, [], None
                part = pa.ipc.open_stream(data.as_py()).read_all()
                code, at, n = (part.column(i).to_numpy() for i in range(3))
                if kind == 0:
                    held.append((code, at, n))
                    continue
                if not held:
                    continue  # no profile in this bucket
                if table is None:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    order = np.argsort(whole[0], kind="stable")
                    table = [x[order] for x in whole]
                lo, hi = np.searchsorted(table[0], code), np.searchsorted(table[0], code, "right")
                size = hi - lo
                stop = np.cumsum(size)
                flat = np.repeat(lo - stop + size, size) + np.arange(stop[-1])
                rid, back = np.unique(at, return_inverse=True)
                more = np.bincount(np.repeat(back, size) * len(langs) + table[1][flat], table[2][flat] * np.repeat(n, size), minlength=len(rid) * len(langs)).astype(float)  # of nothing, numpy counts in integers
                some = np.flatnonzero(more)
                yield pa.RecordBatch.from_arrays([pa.array(rid[some // len(langs)]), pa.array(some % len(langs), pa.int32()), pa.array(more[some])], ["rid", "place", "more"])

    dealt = "deal int, kind int, data binary"
    both = rest.select("gram", "lang", "n").mapInArrow(profiles_, dealt).unionByName(rows.select("rid", "codes", "counts").mapInArrow(runs, dealt))
    return both.repartition(buckets * slices, "deal").sortWithinPartitions("deal", "kind").mapInArrow(met, "rid long, place int, more double")


def _scored(texts: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, found, sure and the other columns of (doc_id, t, ...) but t: the language of the greatest mean log probability and half its lead over the next plus a half, from 0 to 1; null and 0 for a text without n-grams or where there is no profile."""
    spark = texts.sparkSession
    path = shared_path(spark, "profiles")
    profile.select("lang", "gram", F.col("n").cast("long").alias("n")).write.parquet(path)
    kept = spark.read.parquet(path)
    totals = {r.lang: r.n for r in kept.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    langs = sorted(totals)
    size = kept.agg(F.count("*").alias("rows"), F.count_distinct("gram").alias("grams")).first()
    base = np.log(ALPHA) - np.log(np.array([totals[x] for x in langs], float) + ALPHA * max(1, size.grams))
    head, rest = kept, None
    if size.rows > IN_ROW:
        common = kept.groupBy("gram").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "gram").limit(max(1, IN_ROW // len(langs))).select("gram")
        head, rest = kept.join(common, "gram", "left_semi"), kept.join(common, "gram", "left_anti")
    sent = head.toArrow()
    table = _Table(sent.column("gram").to_pylist(), np.array([langs.index(x) for x in sent.column("lang").to_pylist()], np.int64), sent.column("n").to_numpy())
    others = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                found = [_grams(x) for x in batch.column("t").to_pylist()]
                out = [pa.array([int(n.sum()) + odd.total() for _, n, odd in found], pa.int64()), pa.array([table.scores(*x, len(langs)).tolist() for x in found], pa.list_(pa.float64()))]
                if others:
                    away = [table.lacking(*x) for x in found]
                    ends = pa.array(np.r_[0, np.cumsum([len(c) for c, _, _ in away])].astype(np.int32))
                    out += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([a[i] for a in away]).view(np.int64))) for i in (0, 1)] if away else [pa.array([], pa.list_(pa.int64()))] * 2
                    out.append(pa.array([a[2] for a in away], pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "grams", "gains", "codes", "counts", "others"][: batch.num_columns + len(out)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    rows = texts.mapInArrow(run, f"{schema}, grams long, gains array<double>" + (", codes array<long>, counts array<long>, others array<struct<gram: string, n: long>>" if others else "")).drop("t")
    if others:
        # The n-grams of a text are made once: written down with a number for the row, and read again.
        path = shared_path(spark, "grams")
        rows.withColumn("rid", F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        wide = rest.filter(F.col("gram").rlike("[^\\u0000-\\u0FFF]")).select("gram", "lang", F.log1p(F.col("n") / ALPHA).alias("gain"))
        lone = rows.select("rid", F.explode("others").alias("o")).join(wide, F.col("o.gram") == F.col("gram"))
        places = F.create_map(*(x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))))
        sums = _gained(rows, rest, langs, size.rows).unionByName(lone.select("rid", places[F.col("lang")].alias("place"), (F.col("o.n") * F.col("gain")).alias("more")))
        sums = sums.groupBy("rid", "place").agg(F.sum("more").alias("more"))
        more = sums.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("place", "more"))).alias("more"))  # a row a language
        rows = rows.drop("codes", "counts", "others").join(more, "rid", "left")
        added = F.transform(F.array(*(F.lit(i) for i in range(len(langs)))), lambda i: F.coalesce(F.col("more")[i], F.lit(0.0)))
        rows = rows.withColumn("gains", F.zip_with("gains", added, lambda x, y: x + y))
    columns = [c for c in texts.columns if c != "t"]
    if not langs:
        return rows.select(*columns, F.lit(None).cast("string").alias("found"), F.lit(0.0).alias("sure"))
    # Of equal scores the first language in order.
    scores = F.transform(F.array(*map(F.lit, range(len(langs)))), lambda i: F.struct((-(F.col("gains")[i] / F.col("grams")) - F.element_at(F.array(*map(F.lit, base.tolist())), i + 1)).alias("cost"), F.element_at(F.array(*map(F.lit, langs)), i + 1).alias("lang")))
    best = rows.withColumn("best", F.when(F.col("grams") > 0, F.slice(F.array_sort(scores), 1, 2)))
    lead = F.when(F.size("best") > 1, F.get("best", F.lit(1))["cost"] - F.col("best")[0]["cost"]).otherwise(0.0)
    sure = F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), lead / 2 + 0.5))
    return best.select(*columns, F.col("best")[0]["lang"].alias("found"), sure.alias("sure"))


def detect(rows: DataFrame, profile: DataFrame, id_col: str = "doc_id", text_col: str = "text", fallback: str = "en", outside: str | None = None, outside_sure: str | None = None, languages: tuple[str, ...] = (), carry: bool = False) -> DataFrame:
    """doc_id, lang, confidence of every row, and with ``carry`` the row itself as a struct ``row``.

    ``outside`` and ``outside_sure`` name columns with the result of another
    detector: where both agree, its confidence holds; where they don't, the
    profiles win from ``SURE_GRAMS`` on.  Null: there is no such result.  A
    language that is not among ``languages`` (empty: any) is the fallback with
    confidence 0.  The script's language wins over an unsure result and where a
    fifth of the text is in that script, and alone tells for texts of less than
    ``LEAST`` characters; the fallback with confidence 0 where nothing tells.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[぀-ヿ一-鿿가-힣]")), F.length(text)), F.lit(0.0))
    said = F.col(outside).cast("string") if outside else F.lit(None).cast("string")
    said_sure = F.coalesce(F.col(outside_sure).cast("double"), F.lit(0.0)) if outside_sure else F.lit(0.0)
    whole = [F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")] if carry else []
    base = rows.select(F.col(id_col).alias("doc_id"), *whole, cleaned(text).alias("t"), rules.script_language(text).alias("script"), share.alias("share"), F.length(F.trim(text)).alias("size"), said.alias("said"), said_sure.alias("said_sure"))
    out = _scored(base, profile)
    own = F.col("said").isNull() | (F.col("found").isNotNull() & (F.col("found") != F.col("said")) & (F.col("sure") >= SURE_GRAMS))
    lang, sure = F.when(own, F.col("found")).otherwise(F.col("said")), F.when(own, F.col("sure")).otherwise(F.col("said_sure"))
    out = out.withColumns({"lang": lang, "sure": sure})
    short = F.col("size") < LEAST
    none = F.col("lang").isNull() | (~F.col("lang").isin(*languages) if languages else F.lit(False))
    by_script = F.col("script").isNotNull() & (short | F.col("lang").isNull() | (~none & ((F.col("share") >= 0.2) | (F.col("sure") < SURE))))
    final = F.when(by_script, F.col("script")).when(short | none, fallback).otherwise(F.col("lang"))
    return out.select("doc_id", final.alias("lang"), F.when(by_script, 0.95).when(short | none, 0.0).otherwise(F.col("sure")).alias("confidence"), *(["row"] if carry else []))


# Words that mark a query as English.
ENGLISH_MARKERS = (
    "what", "who", "when", "where", "which", "how", "why",
    "is", "are", "do", "does", "did", "can", "could", "would",
    "should", "summarize", "summary", "explain", "describe",
    "provide", "details", "mention", "context",
)


def query_language(detected: DataFrame, queries: DataFrame, fallback: str = "en", least: float = 0.85) -> DataFrame:
    """Detected languages of short queries (doc_id, text): an unsure result for a query of ASCII letters with an English marker word becomes the fallback."""
    rows = detected.join(queries.select("doc_id", "text"), "doc_id")
    letters, ascii_letters = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit("[A-Za-z]"))
    ratio = F.coalesce(F.try_divide(ascii_letters, letters), F.lit(1.0))
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    marker = F.exists(F.array(*map(F.lit, ENGLISH_MARKERS)), lambda m: F.contains(padded, F.concat(F.lit(" "), m, F.lit(" "))))
    override = (ratio > 0.9) & (F.col("lang") != fallback) & marker & (F.col("confidence") < least)
    return rows.select("doc_id", F.when(override, fallback).otherwise(F.col("lang")).alias("lang"), "confidence")
