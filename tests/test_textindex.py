"""The inverted index and its searches against brute force."""

import itertools
import math
import re
from collections import Counter

import pytest

from quarryline.functions.stemming import STOP_WORDS, stem
from quarryline.operators import textindex as ti

#: Words and stems of the algorithm's published description.
STEMS = """consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori
conspicuously conspicu conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knightly knight knives knive knockers knocker
hopping hop hoping hope ties tie cries cri by by say say gas gas gaps gap kiwis kiwi luxuriated luxuri dying die happily happili enjoy enjoy generously generous sky sky
proceed proceed inning inning operator oper rational ration communism communism"""
WORDS = ["alpha", "beta", "gamma", "running", "runs", "the", "and", "größe", "runner", "hoped", "hoping"]


def test_stems():
    pairs = STEMS.split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


@pytest.fixture(scope="module")
def texts():
    out = {i: " ".join(WORDS[(i * j + j * j // 3) % len(WORDS)] for j in range(i % 37)) for i in range(400)}
    return out | {400: None, 401: "", 402: "...", 403: "ALPHA-Beta, the RUNNINǴ größe", 404: "alpha " * 1000}


@pytest.fixture(scope="module")
def made(spark, texts, tmp_path_factory):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(None, "alpha", "x", 1)], "doc_id long, text string, term string, tf int").repartition(3)
    return {a: ti.build(df, str(tmp_path_factory.mktemp("index") / a), a, block=8) for a in ("simple", "english", "folded")}


def words_of(text, analyser="simple"):
    said = ti.analysed(re.findall(r"[^\W_]+", (text or "").lower()), analyser)
    return [(i, w) for i, w in enumerate(said) if w]


def brute_any(texts, query, k):
    docs = {i: [w for _, w in words_of(t)] for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = Counter()
    for t in {w for _, w in words_of(query)}:
        has = {i: d.count(t) for i, d in docs.items() if t in d}
        idf = math.log(1 + (len(docs) - len(has) + 0.5) / (len(has) + 0.5))
        for i, tf in has.items():
            scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    top = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return [(i, round(s, 4)) for i, s in top]


def test_any(spark, texts, made):
    asked = {1: "alpha", 2: "größe runner nothing", 3: " ", 4: None, 5: "the and runs hoped ALPHA alpha", 6: "none such"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for k in (1, 3, 10):
        got = {}
        for r in sorted(ti.search_any(made["simple"], queries, k).collect()):
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert got == {q: b for q, t in asked.items() if (b := brute_any(texts, t, k))}
    # Blocks that cannot hold one of the best are not read.
    terms = spark.createDataFrame([(1, "alpha")], "query_id long, term string")
    kept, all_ = (ti.kept_blocks(made["simple"], terms, k).count() for k in (1, 10_000))
    assert 0 < kept < all_ / 2


def test_only_the_asked_terms_are_read(spark, made):
    queries = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    plan = ti.search_any(made["simple"], queries, 3)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) >= 3 and all("EqualTo(term,alpha)" in x and "text:" not in x for x in scans)


def brute_web(texts, groups, k, analyser):
    """groups: alternatives of (wanted phrases, excluded phrases)."""
    operands = {w for g in groups for p in (*g[0], *g[1]) for _, w in words_of(p, analyser)}
    wanted = {w for g in groups for p in g[0] for _, w in words_of(p, analyser)}
    conj = len(groups) == 1 and len(operands) > 1
    scores = {}
    for key, text in texts.items():
        at = {}
        for i, w in words_of(text, analyser):
            at.setdefault(w, []).append(i)

        def has(phrase, at=at):
            said = words_of(phrase, analyser)
            return any(all(s + i in at.get(w, ()) for i, w in said) for s in range(-3, max(itertools.chain([0], *at.values())) + 1))

        if not any(all(map(has, g[0])) and not any(map(has, g[1])) for g in groups):
            continue
        held = {w: at[w] for w in wanted if w in at}
        if conj:
            left = 1.0
            for a, b in itertools.combinations(held.values(), 2):
                for x, y in itertools.product(a, b):
                    if 0 < abs(x - y) <= 100:
                        left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
            scores[key] = 1 - left if left < 1 else 1e-20
        else:
            scores[key] = sum(0.1 * sum(1 / j**2 for j in range(1, len(a) + 1)) / 1.64493406685 for a in held.values()) / len(operands)
    return [(i, round(s, 4)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


@pytest.mark.parametrize("analyser", ["simple", "english"])
def test_web(spark, texts, made, analyser):
    asked = {
        1: ("alpha beta", [(["alpha", "beta"], [])]),
        2: ('"alpha running" -gamma', [(["alpha running"], ["gamma"])]),
        3: ('größe or "beta gamma runs"', [(["größe"], []), (["beta gamma runs"], [])]),
        4: ("run hoped", [(["run", "hoped"], [])]),
        5: ("-alpha", []),
        6: ('"the runs" alpha', [(["the runs", "alpha"], [])]),
        7: ("nothing or runs -beta", [(["nothing"], []), (["runs"], ["beta"])]),
    }
    queries = spark.createDataFrame([(q, t) for q, (t, _) in asked.items()] + [(8, None), (9, " ")], "query_id long, text string")
    got = {}
    for r in sorted(ti.search_web(made[analyser], queries, 15).collect()):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = {q: b for q, (_, groups) in asked.items() if (b := brute_web(texts, groups, 15, analyser))}
    assert got == want
    assert (4 in got) == (analyser == "english")  # "run" is a stem only
    by_bm25 = {(r.query_id, r.id) for r in ti.search_web(made[analyser], queries, 1000, "bm25").collect()}
    assert by_bm25 == {(r.query_id, r.id) for r in ti.search_web(made[analyser], queries, 1000).collect()}


def test_edges(spark, made, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        ti.build(rows, f"{tmp_path}/one")
    none = ti.build(rows.limit(0), f"{tmp_path}/none")
    queries = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert ti.search_any(none, queries, 3).count() == ti.search_web(none, queries, 3).count() == 0
    assert {r.id for r in ti.search_any(made["folded"], spark.createDataFrame([(1, "Größe GROSSE große")], "query_id long, text string"), 500).collect()} == {r.id for r in ti.search_any(made["folded"], spark.createDataFrame([(1, "große")], "query_id long, text string"), 500).collect()}
    assert ti.folded("Ελλάδα") == "Ελλαδα" and ti.folded("Việt") == "Viet"
    assert "the" in STOP_WORDS
