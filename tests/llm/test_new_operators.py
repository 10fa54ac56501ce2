"""Conversation repair, importance resampling and line deduplication against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import conversation, importance, linedup, queries

EDITS = {"K": 0, "R": 3, "D": 4, "I": 3}


def brute_parse(symbols):
    """Cheapest (cost, audit) over every list of edits with at most two inserts in a row, tried in full."""
    rows = [(symbols[i], symbols[i + 1]) for i in range(0, len(symbols), 2)]
    best = None
    for ops in itertools.product("KRD", repeat=len(rows)):
        if any(f == "d" and o != "D" for (_, f), o in zip(rows, ops, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + o for g, o in zip(gaps, ops, strict=False)) + "I" * gaps[-1]
            kept = "".join("w" * g + (r if o == "K" else "w" if o == "R" else "") for g, (r, _), o in zip(gaps, rows, ops, strict=False)) + "w" * gaps[-1]
            # w is a role of choice, user or assistant: fits if the places alternate.
            body = kept[1:] if kept[:1] == "s" else kept
            if len(body) % 2 or (kept[:1] == "s" and not body) or any(c not in ("w", "ua"[i % 2]) for i, c in enumerate(body)):
                continue
            cost = sum(EDITS[o] for o in audit) + 3 * sum(f == "t" and o != "D" for (_, f), o in zip(rows, ops, strict=True))
            best = min(best or (cost, audit), (cost, audit))
    return best


def test_parse():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 3, 3, 4, 4, 4):
        for _ in range(12):
            symbols = "".join(rng.choice(list("suuaa-")) + rng.choice(list("....td")) for _ in range(n))
            assert conversation.parse(conversation.TURNS, symbols)[:2] == brute_parse(symbols), symbols


def test_segments_chain_to_the_whole(monkeypatch):
    """However a conversation is cut, the chain of segments has the cost and the audit of the whole."""
    rng = np.random.default_rng(5)
    g = conversation.TURNS
    for _ in range(60):
        n = int(rng.integers(1, 60))
        symbols = "".join(rng.choice(list("suuuaaa-")) + rng.choice(list(".....td")) for _ in range(n))
        cuts = sorted({0, n, *rng.integers(0, n, 5).tolist()})
        segments, cells = [], []
        for a, b in itertools.pairwise(cuts):
            part = symbols[2 * a : 2 * b]
            found = [conversation.chart(g, seed, part).get(name) for seed in g.names for name in g.names]
            order = {x: i for i, x in enumerate(sorted({c[1:] for c in found if c}))}
            segments.append({"seg": a, "first": part[0], "last": part[-2], "illegal": 0, "costs": [c and c[0] for c in found], "ranks": [c and order[c[1:]] for c in found]})
            cells.append(found)
        cost, _, picks, tail = conversation.cheapest_chain(g, segments)
        audit = "".join(c[p][1] for c, p in zip(cells, picks, strict=True)) + "I" * len(tail)
        assert (cost, audit) == conversation.parse(g, symbols)[:2]


def brute_repair(rows):
    """rows of one conversation: (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, symbols, faults = set(), "", Counter()
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        symbols += (role[:1] if role[:1] in tuple("sua") else "-") + {"": ".", "truncated": "t"}.get(fault, "d")
    cost, audit, said = conversation.parse(conversation.TURNS, symbols)
    left, lines = iter(rows), []
    for edit, to in zip(audit, said, strict=True):
        _, role, text = (None, "", "") if edit == "I" else next(left)
        if edit != "D":
            lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[to]) + ":" + text)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or not a[1] or not b[1] for a, b in itertools.pairwise(rows))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation, "SEGMENT", 4)
    rng = np.random.default_rng(3)
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes?"), (1, None, "user", " \t"), (1, None, "", "x"), (2, 5, "user", "Größe!"), (2, 5, "user", "Größe!"), (2, 5, "user", "Größe!"), (2, 9, "tool", "odd.\n"), (3, 1, "system", "S." * 50_000)]
    texts = ["a.", "b?", "c", "", "d! ", "e. "]
    rows += [(10 + i // 40, int(rng.integers(0, 60)), str(rng.choice(["system", "user", "user", "assistant", "assistant", "x"])), str(rng.choice(texts)) + str(i % 7) * (i % 3 == 0) + "." * (i % 2)) for i in range(400)]
    rows += [(99, 7, "user", "same.")] * 50  # a crowd of equal rows
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, edit int").repartition(3)
    done = conversation.repaired(df)
    digests = {r.conv_id: r.sha256 for r in done.digests().collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in done.conversations.collect()}
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    assert got == {conv: brute_repair(r) for conv, r in by.items()}
    edits = done.rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nth", "edit"))), lambda x: x["edit"]), "").alias("audit")).collect()
    assert {r.conv_id: r.audit for r in edits} == {conv: x[6] for conv, x in got.items()}
    none = conversation.repaired(df.limit(0))
    assert none.conversations.count() == none.digests().count() == none.rows.count() == 0


def test_op11_on_odd_rows(spark, tmp_path):
    rows = [(i // 3, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else "user", None if i % 4 == 0 else f"t{i}.") for i in range(120)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversations(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        by[conv] += [] if harm == 0 else [(turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)] * (2 if harm == 3 else 1)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: brute_repair(r) for c, r in by.items()}


SCHEMA = "doc_id long, text string, row long, words string, f int"
TEXTS = [None, "", " ... ", "One two, ONE Größe-größe 12\x00x", "one " * 30, "one " * 30, "zwei\ndrei\tvier fünf \U0001f600x " * 9, "lang " + "word other " * 30_000, "Äpfel É"]


def test_importance(spark):
    texts = TEXTS + [f"w{i % 13} v{i % 5} w{i % 7} " * 9 for i in range(90)]
    ids = [None, 1, 2, 3, 4, 4, 5, 6, None, *range(7, 97)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    goal = ["w1 w2 w3 v1", None, "one größe w1"]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    for n in (1, 2):
        draw = importance.Draw(max_n=n, buckets=100, percent=30)

        def features(text, n=n):
            ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            return ws, [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

        def bucket(f):
            return zlib.crc32(f.encode()) % 100

        s = Counter(bucket(f) for t in texts for f in features(t)[1])
        t_ = Counter(bucket(f) for t in goal for f in features(t)[1])
        gain = [math.floor(1000 * math.log((t_[b] + 1.0) * (s.total() + 100.0) / ((s[b] + 1.0) * (t_.total() + 100.0)))) for b in range(100)]
        want = []
        for i, t in zip(ids, texts, strict=True):
            ws, fs = features(t)
            weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
            h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            want.append((i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))))
        able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[3], w[2]))
        drawn = Counter((*w, i + 1) for i, w in enumerate(able[: 30 * len(able) // 100]))
        drawn += Counter((*w, None) for w in able[30 * len(able) // 100 :]) + Counter((*w, None) for w in want if w[1] < 20)
        assert Counter(tuple(r) for r in importance.resampled(df, target, draw).collect()) == drawn
    assert importance.resampled(df.limit(0), target).count() == 0
    assert importance.resampled(df, target.limit(0)).filter("rank IS NOT NULL").count() == 95 // 10


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_line_dedup(spark, broadcast_rows):
    texts = [None, "", "\n", "Header\nown line 1", " header\t\nx\n\n\nHEADER\n", "header", "Header\n" * 500 + "tail", "É\né", "é\r", "a\x0bb\n\x0b a\x0bb"] + [f"HeaDer\nbody {i}\n\nÉ \nlast" for i in range(6)]
    df = spark.createDataFrame([(None if i % 9 == 0 else i % 12, t, i, "x", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    for least, chars in ((5, 1), (2, 2), (1, 1), (50, 1), (3, 0)):
        often = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
        gone = {k for k, n in often.items() if n >= least and len(k) >= chars}
        want = Counter()
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            kept = [x for x in lines if key(x) not in gone]
            want[(None if i % 9 == 0 else i % 12, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
        got = linedup.deduplicated(df, least, chars, broadcast_rows=broadcast_rows)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert linedup.deduplicated(df.limit(0), broadcast_rows=broadcast_rows).count() == 0
