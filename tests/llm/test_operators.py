"""The training-data operators against brute force on small tables."""

import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quarryline.llm import hamming, language, mixing, neardup, packing, quality, queries, repetition, rollups, tokenfiles, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(4000))
ROWS = [
    (1, None, None, None, None, "a"),
    (2, "", "en", "s1", 0, None),
    (3, " \n\t ", "en", "s1", 4, "a"),
    (4, "one two", "en", "s1", 7, "a"),
    (5, "one  two", "de", None, 8, "a"),
    (6, LONG, "en", "s2", len(LONG), "a"),
    (7, LONG, "en", "s2", len(LONG), "a"),
    (8, LONG + " tail", "fr", "s2", 0, "a"),
    (9, "same line here\nsame line here\nsame line here", "en", "s1", 1, "a"),
    (9, "same line here\nsame line here\nsame line here", "en", "s1", 1, "a"),
    (10, "Größe élan don't *** 12,5 <|endoftext|> x<|endoftext|><|startoftext|>Y <|ENDOFTEXT|> <|endof", "de", "s3", 1, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_ids(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in ROWS]


def test_packing(docs, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, 0).collect()
    want = Counter((k, tuple(v)) for k, v in brute_ids("byte_bpe_50k.json", 0))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 1024
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    # Each document's pieces, in order of their starts, are its ids; rows of one id and equal ids are alike.
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    for key in {k for k, _ in want}:
        ids = next(v for k, v in want if k == key)
        copies = want[key, ids]
        assert all(n == len(ids) and list(ids[a : a + m]) == v for a, m, n, v in pieces[key])
        held = Counter(i for a, m, _, _ in pieces[key] for i in range(a, a + m))
        assert held == Counter({i: copies for i in range(len(ids))})
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("limits", [(32, 3, 4), (64, 100, 5), (16, 2, 100), (50, 4, 9)])
def test_packing_limits(spark, limits):
    """Tokens, segments and loss-bearing tokens stay within their limits at once, and every id lies in one piece."""
    rng = np.random.default_rng(sum(limits))
    rows = [(i, rng.integers(1, 99, n := int(rng.integers(0, 40))).tolist(), [bool(x) for x in rng.random(n) < 0.4]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>, loss array<boolean>").coalesce(1)
    got = packing.pack_ids(df, packing.Limits(*limits), loss_col="loss").collect()
    for s in {r.sequence_id for r in got}:
        own = [r for r in got if r.sequence_id == s]
        bearing = sum(sum(rows[r.doc_id][2][r.start : r.start + r.length]) for r in own)
        assert len(own) <= limits[1] and sum(r.length for r in own) <= limits[0] and bearing <= limits[2]
    for key, ids, _ in rows:
        own = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id == key)
        assert [x for _, v in own for x in v] == ids and all(ids[a : a + len(v)] == v for a, v in own)
    if limits == (32, 3, 4):  # the fill is near what the scarcest limit allows
        least = max(sum(len(r[1]) for r in rows) / 32, sum(sum(r[2]) for r in rows) / 4)
        assert len({r.sequence_id for r in got}) < 1.6 * least


def test_token_files(spark, docs, empty, tmp_path):
    path = queries.tokenizer("word_bpe_49k.json")
    shards = tokenfiles.write(docs, f"file://{tmp_path}/t", path, 2, 49_408, shard_bytes=20_000)
    got = tokenfiles.read(shards, f"file://{tmp_path}/t").orderBy("start").collect()
    want = sorted(brute_ids("word_bpe_49k.json", 2), key=lambda x: x[0])
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [len(v) for _, v in want])[:-1].tolist()
    shard = shards.orderBy("shard").first()
    reader = tokenfiles.ShardReader(f"file://{tmp_path}/t", shard.shard)
    assert [(k, v.tolist()) for k, v in (reader.document(i) for i in range(reader.n_docs))] == want[: reader.n_docs]
    assert tokenfiles.read(tokenfiles.write(empty, f"file://{tmp_path}/e", path, 2, 49_408), f"file://{tmp_path}/e").count() == 0


def test_token_files_of_nulls_and_equal_ids(spark, tmp_path):
    """Rows without an id come first, in several ranges; rows of one id stand together; starts have no gap."""
    rows = [(None if i % 3 == 0 else i // 4, f"text number {i} " * (1 + i % 5)) for i in range(200)] + [(None, None), (-5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = tokenfiles.write(df, f"file://{tmp_path}/n", queries.tokenizer("word_bpe_49k.json"), 2, 49_408, shard_bytes=1500)
    got = tokenfiles.read(shards, f"file://{tmp_path}/n").orderBy("start").collect()
    keys = [r.doc_id for r in got]
    nulls = sum(k is None for k in keys)
    assert keys[:nulls] == [None] * nulls == [k for k, _ in rows if k is None] and keys[nulls:] == sorted(k for k, _ in rows if k is not None)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((r.doc_id, bytes(r.ids)) for r in tokens.tokenize(df, queries.tokenizer("word_bpe_49k.json"), 2).collect())
    assert shards.filter(f"shard < {1 << tokenfiles.SUB_BITS}").count() and shards.count() > 5


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(0, 10_000, 7)), [0, 1 << 40], [3] * 200 + [1 << 33]])
def test_elias_fano(values):
    ef = tokenfiles.EliasFano.decode(tokenfiles.EliasFano.encode(np.array(values, np.uint64)))
    assert ef.values().tolist() == values and [ef[i] for i in range(len(values))] == values
    n = len(values)
    for a, b in ((0, n), (n // 3, n // 2), (n // 2, n), (min(63, n), min(129, n))):
        assert ef.run(a, b).tolist() == values[a:b]


def test_repetition(docs, empty):
    for r in repetition.repetition(docs).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert repetition.repetition(empty).count() == 0


def filled(sizes, weights, share, most):
    """Targets by their definition: shares by weight; whatever stands above its bound is cut to it, and the excess goes to the others, until none is above."""
    bound, total = {s: most * n for s, n in sizes.items()}, share * sum(sizes.values())
    full, out = set(), {}
    while True:
        rest = total - sum(bound[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        out = {s: bound[s] if s in full else rest * weights[s] / weight for s in sizes}
        above = {s for s in sizes if s not in full and out[s] > bound[s] + 1e-9}
        if not above:
            return out
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets(spark, seed):
    rng = np.random.default_rng(seed)
    names = [*sorted(f"s{i}" for i in range(int(rng.integers(2, 12)))), None]
    counts = {s: int(rng.integers(0, 2000) if rng.random() < 0.7 else 0) for s in names}
    rows = [(i, s, n) for i, (s, n) in enumerate(counts.items())]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    want = filled(counts, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in names)


def test_mixing(docs, empty):
    sizes = mixing.sized(docs)
    goals = mixing.targets(sizes)
    g = {r.source: r for r in goals.collect()}
    plan = mixing.draws(sizes, goals).collect()
    taken, each = Counter(), Counter()
    for r in plan:
        taken[r.source] += r.words
        each[r.doc_id, r.row_key, r.nth] += r.words
    assert all(abs(taken[s] - r.target) <= 1 for s, r in g.items())
    size = {(r.doc_id, r.row_key, r.nth): r["size"] for r in sizes.collect()}
    assert len(size) == len(ROWS) and all(n <= 2 * size[k] for k, n in each.items())
    mixed = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.mix_words) for r in mixed) == Counter((r.doc_id, r.words) for r in plan)
    text = {r[0]: r[1] for r in ROWS}
    for r in mixed:
        assert WORD.findall(r.text) == WORD.findall(text[r.doc_id])[: r.mix_words] and r.extra == "a"
    for shard in {r.mix_shard for r in mixed}:
        assert sorted(r.mix_position for r in mixed if r.mix_shard == shard) == list(range(1, 1 + sum(r.mix_shard == shard for r in mixed)))
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed)) and mixing.mix(empty).count() == 0


def test_mixing_keeps_columns_of_any_name(docs):
    odd = docs.selectExpr("*", "doc_id AS size", "1 AS row_key", "2 AS nth", "'x' AS entries", "7 AS mix_shard", "0 AS n")
    got = mixing.mix(odd)
    assert Counter(got.columns) == Counter([*odd.columns, "mix_position", "mix_copy", "mix_words"])
    assert all(r["size"] == r.doc_id and (r.row_key, r.nth, r.entries, r.n) == (1, 2, "x", 0) for r in got.collect())


def test_permutation(spark):
    """Every place is taken once, whatever the count; pairs stand anywhere; keys differ."""
    for n in (1, 2, 3, 64, 257):
        for key in (1, 2):
            got = [r[0] for r in spark.range(n).selectExpr(mixing.permuted("id", f"{n}L", f"{key}L, 9L")).collect()]
            assert sorted(got) == list(range(n))
    first = spark.range(2000).selectExpr(mixing.permuted("3L", "8L", "id, 1L") + " AS p", mixing.permuted("4L", "8L", "id, 1L") + " AS q").collect()
    for values, cells in (([r.p for r in first], 8), ([(r.p, r.q) for r in first], 56)):
        seen = Counter(values)
        expected = 2000 / cells
        assert len(seen) == cells and sum((v - expected) ** 2 / expected for v in seen.values()) < cells + 6 * (2 * cells) ** 0.5


def test_tree_gives_out_exact_quotas(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 37), (2, 1)], "rank long, blocks long")
    leaves = mixing.tree(quotas, 8, 5).collect()
    totals, shards = Counter(), Counter()
    for r in leaves:
        totals[r["rank"]] += r.blocks
        shards[r.shard] += r.blocks
    assert totals == {0: 100, 1: 37, 2: 1} and len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 3


def test_rollups(spark, docs, empty, tmp_path):
    store = rollups.Rollups(spark, f"file://{tmp_path}/r")
    rows = rollups.counted(docs).selectExpr("*", "'insert' AS op", "CAST(NULL AS BIGINT) AS old_tokens")
    assert store.commit("1", rows) and not store.commit("1", rows)
    assert store.totals().filter("tokenizer = 'words-1'").selectExpr("sum(tokens)", "sum(docs)").first()[:] == (sum(len(WORD.findall(r[1] or "")) for r in ROWS), len(ROWS))
    assert store.compact() == 1 and store.compact() == 0 and store.committed("1") and not store.commit("1", rows)
    gone = rows.selectExpr("'delete' AS op", "source", "lang", "tokenizer", "CAST(NULL AS BIGINT) AS tokens", "tokens AS old_tokens")
    assert store.commit("2", gone) and store.totals().count() == 0 and store.compact() == 1 and store.totals().count() == 0
    none = rollups.counted(empty).selectExpr("*", "'insert' AS op", "CAST(NULL AS BIGINT) AS old_tokens")
    assert store.commit("3", none) and not store.commit("3", none)


def test_rollups_of_two_writers(spark, docs, tmp_path, monkeypatch):
    """Both find the batch open; one gets its name."""
    rows = rollups.counted(docs).selectExpr("*", "'insert' AS op", "CAST(NULL AS BIGINT) AS old_tokens")
    one, two = (rollups.Rollups(spark, f"file://{tmp_path}/r") for _ in range(2))
    monkeypatch.setattr(rollups.Rollups, "committed", lambda self, batch: False)
    assert one.commit("1", rows) and not two.commit("1", rows)
    assert one.totals().filter("tokenizer = 'words-1'").selectExpr("sum(docs)").first()[0] == len(ROWS)


def test_rollups_of_tokenizers(spark, docs):
    files = {n: queries.tokenizer(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")}
    got = Counter((r.doc_id, r.tokenizer, r.tokens) for r in rollups.tokenized(docs, files).collect())
    assert got == Counter((k, n, len(v) - 1) for n in files for k, v in brute_ids(f"{n}.json", 0))


def test_op6(spark):
    """The query's totals against counts of each text by the tokenizers themselves."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = Counter()
    for name in ("byte_bpe_50k", "word_bpe_49k"):
        t = Tokenizer.from_file(queries.tokenizer(f"{name}.json"))
        for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
            q, digits = quality.get(r.doc_id), len(re.findall("[0-9]", r.text or ""))
            if q != 0:
                want[r.source, r.lang, name, "docs"] += 1
                want[r.source, r.lang, name, "tokens"] += len(t.encode(r.text or "", add_special_tokens=False).ids) - (digits if q == 1 and name == "word_bpe_49k" else 0)
    got = {(r.source, r.lang, r.tokenizer, k): r[k] for r in queries.op6_rollups(spark, sf).collect() for k in ("docs", "tokens")}
    assert got == dict(want)


def test_hamming(spark):
    rng = np.random.default_rng(1)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 63), 1 << 63, 400))] + [(1000 + i, 5) for i in range(50)] + [(2000, None)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in hamming.top_k(df, df.filter("id % 50 = 0"), 7, index_block=100, query_block=4).collect()}
    for q, c in codes:
        if q % 50 == 0 and c is not None:
            best = sorted((bin((c ^ x) & (1 << 64) - 1).count("1"), i) for i, x in codes if x is not None)[:7]
            assert [got[q, r + 1] for r in range(7)] == [(i, d) for d, i in best]
    assert hamming.top_k(df.filter("false"), df, 3).count() == 0 == hamming.top_k(df, df.filter("false"), 3).count()


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4)
    assert got[6][1] == got[7][1] == got[8][1] == 6 and got[10] == (2, 10)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_around_the_threshold(spark):
    """Groups of copies of mixed similarity and length: most pairs share much and do not link."""
    rng = np.random.default_rng(8)
    texts = []
    for group in range(2):
        base = [f"g{group}w{i}" for i in range(150)]
        for copy in range(60):
            words = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 14)).tolist():
                words[at] = f"n{rng.integers(0, 400)}"
            texts.append(" ".join(words[: 150 - int(rng.integers(0, 40))] + (["extra"] * (copy % 3))))
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (len(a), root(i)) for i, a in enumerate(sets)}
    assert 2 < len({c for _, c in got.values()}) < len(texts)


def test_pairs_of_a_large_group_in_blocks():
    """3000 classes that meet in two lists: millions of candidates in bounded memory, and each pair once with its whole count."""
    n = 3000
    comp = np.arange(n) // 2
    sizes = np.full(n, 100)
    asks = np.arange(n) < 700  # masked classes that look the two shingles up
    low, flag = np.repeat(np.array([5, 9], np.uint32), n), np.tile(asks, 2).astype(np.uint8)
    packed = neardup._packed(np.zeros(2 * n, np.int64), [low, flag], np.tile(np.arange(n), 2), [np.arange(n), sizes, comp, np.where(asks, 0, -1), np.zeros(n, np.int64)], neardup._OUTSIDE_NAMES)
    lists = pa.table({"key": np.repeat([1, 2], n), "cls": np.tile(np.arange(n), 2), "n": np.tile(100 * 2 ** (comp % 20), 2), "level": np.ones(2 * n, np.int64), "comp": np.tile(comp, 2), "least": pa.nulls(2 * n, pa.int64())})
    for run, table, pairs in ((neardup._asked(neardup.Settings()), pa.Table.from_batches([packed]), 700 * (n - 2)), (neardup._uncovered(neardup.Settings()), lists, 20 * 75 * 74 // 2 * 4)):
        tracemalloc.start()
        out = run(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        if "kind" in out.column_names:
            out = out.filter(pc.equal(out["kind"], 0))
        a, b, c = (out[k].to_numpy() for k in "abc")
        assert len(a) == pairs == len(np.unique(a * n + b)) and (c == 2).all() and (comp[a] != comp[b]).all()
        assert peak < 50 * pairs + 170e6, peak


def test_pairs_of_short_lists_in_blocks():
    """100,000 lists of 8 classes: 2.8 million candidates in bounded memory, and each pair once with its whole count."""
    groups, lists = 500, 200
    n = 8 * groups
    low = np.repeat(np.arange(groups * lists, dtype=np.uint32), 8)
    idx = (np.repeat(np.arange(groups), 8 * lists) * 8 + np.tile(np.arange(8), groups * lists)).astype(np.int64)
    packed = neardup._packed(np.zeros(len(low), np.int64), [low], idx, [np.arange(n), np.full(n, 1000, np.uint32), np.zeros(n, np.uint8), np.zeros(n, np.uint8)], neardup._POSTING_NAMES)
    table = pa.Table.from_batches([packed])
    tracemalloc.start()
    out = neardup._lists(neardup.Settings())(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    out = out.filter(pc.equal(out["kind"], neardup.PAIR))
    a, b, c = (out[k].to_numpy() for k in "abc")
    assert len(a) == groups * 28 == len(np.unique(a * n + b)) and (c == lists).all() and (a // 8 == b // 8).all() and (a < b).all()
    assert peak < 110e6, peak


def test_classes_that_share_a_number(spark):
    """With class numbers of 6 bits nearly all sets clash, and the result is the same."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 30)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + [None, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, neardup.near_duplicates(df).collect()))
    assert sorted(map(tuple, neardup.near_duplicates(df, neardup.Settings(class_bits=6)).collect())) == want
    assert len({c for *_, c in want}) == 62


def test_long_lists(spark):
    """Lists beyond ``short``: groups that link, groups that fail their hubs, and passages in many texts."""
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(25):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 12)).tolist():
                words[at] = f"n{rng.integers(0, 300)}"
            texts.append(" ".join(words) + (" " + passage if group else ""))
    texts += [" ".join(f"u{k}x{i}" for i in range(100)) + " " + passage for k in range(20)]
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for settings in (neardup.Settings(), neardup.Settings(short=3, hubs=1), neardup.Settings(bucket=500, frequent=10, crowd=4)):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, settings).collect()}
        assert got == dict(enumerate(label))


def test_deduplicated(spark):
    """One row of each group stays, whatever its ids."""
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " tail"), (3, other), (3, text), (None, other), (None, "alone in this group of words"), (None, "alone in this group of words"), (5, None), (5, ""), (6, "page one")]
    df = spark.createDataFrame([(a, b, "p") for a, b in rows], "doc_id long, text string, page string")
    got = Counter((r.doc_id, r.text) for r in neardup.deduplicated(df).collect())
    assert got == Counter([(1, text), (3, other), (None, "alone in this group of words"), (5, None), (5, ""), (6, "page one")])
    plain = df.filter("doc_id > 1 AND doc_id < 5")
    assert Counter(r.doc_id for r in neardup.deduplicated(plain.filter("text NOT LIKE 'v%'")).collect()) == {2: 1}


def test_models(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (9, 0, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for rows in (labels, labels.filter("false")):
            model = module.train(docs, rows)
            found = module.score(docs, model).collect()
            assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
            assert module.score(empty, model).count() == 0
    model = language.train(docs)
    found = {r.doc_id: r for r in language.score(docs, model).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == "und" and found[6].lang_pred in ("en", "de", "fr")
    assert language.score(docs, language.train(empty)).filter("lang_pred <> 'und'").count() == 0


def test_held_out_quality(spark):
    r = queries.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in r]) > 0.9
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in r)
