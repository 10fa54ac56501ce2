"""Chains, segments and laws against enumeration."""

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import crf, language, quality, repetition, toxicity
from quarryline.llm import textscan as ts


def enumerated(emit, trans):
    """Marginals, log partition and summed pair marginals of one chain, over all label paths."""
    n, k = emit.shape
    paths = list(itertools.product(range(k), repeat=n))
    weight = np.array([sum(emit[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p)) for p in paths])
    log_z = np.logaddexp.reduce(weight)
    chance = np.exp(weight - log_z)
    marginal, pairs = np.zeros((n, k)), np.zeros((k, k))
    for p, c in zip(paths, chance, strict=True):
        for i, y in enumerate(p):
            marginal[i, y] += c
        for a, b in itertools.pairwise(p):
            pairs[a, b] += c
    return marginal, log_z, pairs


@pytest.mark.parametrize(("longest", "run"), [(2048, 256), (3, 2), (2, 1)])
def test_forward_backward(monkeypatch, longest, run):
    """Whole chains and chains in runs give what all label paths give."""
    monkeypatch.setattr(crf, "LONGEST", longest)
    monkeypatch.setattr(crf, "RUN", run)
    rng = np.random.default_rng(3)
    length = np.array([4, 1, 7, 5, 2])
    first = np.cumsum(length) - length
    emit, trans = rng.normal(0, 2, (length.sum(), 3)), rng.normal(0, 1.5, (3, 3))
    marginal, log_z, pairs = crf.forward_backward(emit, trans, first, length, pairs=True)
    want = [enumerated(emit[a : a + n], trans) for a, n in zip(first, length, strict=True)]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want]))
    assert np.allclose(log_z, [w[1] for w in want]) and np.allclose(pairs, sum(w[2] for w in want))


def test_fit_follows_the_gradient():
    """The fitted field gives labels like those that it saw a higher likelihood than others."""
    rng = np.random.default_rng(1)
    length = np.full(60, 5)
    first = np.cumsum(length) - length
    y = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.stack([np.ones(300), y + rng.normal(0, 1, 300)], 1)
    w, trans = crf.fit(x, np.eye(2)[y], first, length, 2)
    marginal, _, _ = crf.forward_backward(x @ w, trans, first, length)
    assert (marginal.argmax(1) == y).mean() > 0.85 and trans[0, 0] + trans[1, 1] > trans[0, 1] + trans[1, 0]


def slow_segments(s):
    """Maximal scoring segments by their definition: the best segment, then those left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return slow_segments(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, v) for x, y, v in slow_segments(s[b:])]


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        s = rng.choice([-3.0, -1.5, -0.25, 1.0, 2.125, 4.0], rng.integers(0, 14)) + rng.normal(0, 1e-3, 1)
        got = toxicity.segments(s, np.flatnonzero(s > 0))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(list(s))]
        assert np.allclose([v for *_, v in got], [v for *_, v in slow_segments(list(s))])


@pytest.mark.parametrize("pattern", ["falling", "rising", "mixed"])
def test_segments_are_linear(pattern):
    def seconds(n):
        s = {"falling": np.tile([1.0, -1.5], n), "rising": np.tile([1.5, -1.0], n), "mixed": np.random.default_rng(0).normal(-0.1, 1, 2 * n)}[pattern]
        hot = np.flatnonzero(s > 0)
        began = time.process_time()
        toxicity.segments(s, hot)
        return time.process_time() - began

    seconds(1000)
    assert seconds(64_000) < 40 * max(seconds(4000), 1e-3)  # 16 times the passages; quadratic would be 256


def test_extreme_values():
    """Of random texts, the share whose best segment has a p-value below p is about p."""
    rng = np.random.default_rng(7)
    values, chance, penalty = np.array([1.0, 2.5, 4.0]), np.array([0.02, 0.01, 0.004]), 0.3
    decay = toxicity.decay_of(values, chance, penalty)
    assert abs((chance * np.exp(decay * values)).sum() + (1 - chance.sum()) * np.exp(-decay * penalty) - 1) < 1e-6

    def best(n):
        s = rng.choice(np.append(values, -penalty), n, p=np.append(chance, 1 - chance.sum()))
        return max((x[2] for x in toxicity.segments(s, np.flatnonzero(s > 0))), default=0.0)

    tokens = rng.integers(50, 800, 3000)
    tops = np.array([best(n) for n in tokens])
    scale = toxicity.scale_of(tops[:1500], tokens[:1500], decay)
    p = -np.expm1(-scale * tokens[1500:] * np.exp(-decay * tops[1500:]))
    for level in (0.02, 0.05, 0.2):
        assert abs((p <= level).mean() - level) < 0.5 * level + 0.01


def test_log_odds():
    """Words of toxic texts alone get a score, common ones don't."""
    texts = [f"the plain word number{i % 9} and so on" + (" you filthsome" if i % 4 == 0 else "") for i in range(400)]
    y = np.array([int(i % 4 == 0) for i in range(400)])
    model = toxicity.learn(texts, y, toxicity.Settings())
    data, offsets = next((d, o) for _, _, d, o in ts.slabs(pa.array(["the plain filthsome word"])))
    starts, ends, _ = ts.letter_runs(data, offsets)
    s = toxicity.word_scores(toxicity.token_keys(data, starts, ends), model.keys, model.scores, model.settings.penalty)
    assert s[2] > 2 and (s[[0, 1, 3]] < 0).all()


def slow_repetition(text, lengths, tops):
    words = text.split()
    chars = [len(w) for w in words]
    total = max(1, sum(chars))
    shares = []
    for n in lengths:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(n)}
        shares.append(sum(chars[i] for i in inside) / total)
    best = []
    for n in tops:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        best.append(max((grams.count(g) * sum(map(len, g)) for g in grams if grams.count(g) > 1), default=0) / total)
    lines = [x for x in text.split("\n") if x.split()]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    return shares, best, sum(len(w) for x in again for w in x.split()) / total, sum(text.count(c) for c in "#*$%&|<>")


def test_repetition():
    rng = np.random.default_rng(2)
    texts = ["", "a", "a b " * 20, "x y z\n" * 5]
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, rng.integers(3, 60), rng.integers(1, 80))]
        texts.append("".join(w + rng.choice([" ", "\n", " # "]) for w in words))
    lengths, tops = (5, 6, 8, 10), (2, 3, 4)
    data, offsets = next((d, o) for _, _, d, o in ts.slabs(pa.array(texts)))
    m = repetition.measure(data, offsets, lengths, tops)
    for i, text in enumerate(texts):
        shares, best, lines, symbols = slow_repetition(text, lengths, tops)
        assert np.allclose(m["gram_shares"][i], shares) and np.allclose(m["top_shares"][i], best)
        assert np.isclose(m["line_share"][i], lines) and m["n_symbols"][i] == symbols


def test_repetition_verdict(spark):
    """Texts that pass the base rule and repeat too much by one measure each."""
    plain = " ".join(f"w{i}" for i in range(200))
    top = " ".join(f"w{i} again_and_again" if i % 2 else f"v{i}" for i in range(100)) + " " + " ".join("very_long_word_here and_another_one" for _ in range(4)) + " end"
    line = plain + "\n" + "\n".join(["one line of several words that comes again and again"] * 1) + "\n" + "x1 x2\nx1 x2\n" * 20
    rows = spark.createDataFrame([(1, plain), (2, top), (3, line)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.repetition(rows).collect()}
    assert got[1] == (False, True) and not got[2][1] and not got[3][1]


def test_language_of_long_and_mixed_texts():
    """A long text is one chain: its marginals are those without a cut, and a switch is followed."""
    rng = np.random.default_rng(4)
    sides = {"aa": ["kala", "mato", "sipu", "rena"], "bb": ["zhworth", "blick", "strumpf", "kraftig"], "cc": ["ixion", "oueau", "eauxi", "queoui"]}
    texts = [" ".join(rng.choice(words, 30)) for words in sides.values() for _ in range(40)]
    model = language.learn(texts, [x for x in sides for _ in range(40)], language.Settings())
    mixed = " ".join([*rng.choice(sides["aa"], 5000), *rng.choice(sides["bb"], 2000)])
    data, offsets = next((d, o) for _, _, d, o in ts.slabs(pa.array([mixed, texts[0]])))
    got = language.mass(data, offsets, model)
    share = got / got.sum(1, keepdims=True)
    assert share[0].argmax() == 0 and 0.15 < share[0, 1] < 0.6 and share[1, 0] > 0.9
    crf_longest, crf.LONGEST = crf.LONGEST, 10**9
    try:
        assert np.allclose(language.mass(data, offsets, model), got)
    finally:
        crf.LONGEST = crf_longest


def test_many_languages(spark):
    """Rare languages are learned too."""
    rows = [(i, " ".join(f"q{i % 230}x{j}k" for j in range(12)), f"l{i % 230}", None) for i in range(460)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs, language.Settings(steps=15))
    assert len(model.langs) == 230


def test_quality_of_lines():
    texts = ["A fine sentence stands here.\nAnother good one follows it, too." for _ in range(30)] + ["A fine sentence stands here.\n### $$$ |||| 000 ###\n%%% &&& ***" for _ in range(30)]
    y = np.array([1] * 30 + [0] * 30)
    model = quality.learn(texts, y, quality.Settings())
    data, offsets = next((d, o) for _, _, d, o in ts.slabs(pa.array([texts[0], texts[-1], ""])))
    score, lines, bad = quality.judge(data, offsets, model)
    assert score[0] > 0.9 and score[1] < 0.1 and score[2] == 0 and lines.tolist() == [2, 3, 0] and bad[0] == 0 and bad[1] >= 2
