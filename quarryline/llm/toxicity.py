"""Toxicity: maximum-scoring segment search over token log-odds.

Learning (on a bounded sample of labelled rows): documents containing a token
are counted by class, and the log-odds ratio with an informative Dirichlet prior
(the whole sample's counts, scaled) gives each token a score and its deviation;
tokens are letter runs and their first 4, 5 and 6 bytes, so inflected and
unseen forms of a stem are met.  Tokens with a significant positive score keep
it, all others cost ``penalty``.

Scoring: in one pass over a text's scores the maximal scoring segments are
found (each no larger one contains without loss), from cumulative sums at the
positive tokens only; each segment is linked to the last one before it with a
smaller sum before it, so the search passes each segment once and time is
linear.  A segment's score S in a text of n tokens has the extreme-value p-value
1 - exp(-K n exp(-lambda S)), lambda being the positive root of
E exp(lambda s) = 1 and K the maximum-likelihood value for the best segments of
the sample's clean texts.  Segments below
``alpha`` are the passages; the best segment and the sum over all passages are
brought to a probability by a logistic fit on the sample.

Defined cases: null and empty texts have no passage and get the score of a text
without any; a sample with one class only gives that class' share to all;
equal rows are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf
from . import textscan as ts

SCHEMA = "doc_id long, score double, best double, passages array<struct<start: long, end: long, score: double, p_value: double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows to learn from.
    sample_rows: int = 4000
    #: Weight of the prior, in tokens for each document of the sample.
    prior: float = 0.05
    #: A token counts from this standardised log-odds ratio on, and from this many nats beyond chance.
    min_z: float = 2.0
    margin: float = 0.0
    min_ratio: float = 4.0
    penalty: float = 0.05
    alpha: float = 0.05


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    decay: float
    scale: float
    weights: np.ndarray
    settings: Settings


def token_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the tokens of every letter run: itself and its beginnings (0 where it is not longer)."""
    hasher = ts.Hasher(ts.LOWER[data])
    out = [hasher.spans(starts, ends)]
    for n in PREFIXES:
        h = hasher.spans(starts, np.minimum(starts + n, ends)) ^ np.uint64(n)
        h[ends - starts <= n] = 0
        out.append(h)
    return np.stack(out)


def word_scores(keys: np.ndarray, model_keys: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """Score of every run: the largest of its known tokens, or the penalty."""
    out = np.full(keys.shape[1], -penalty)
    if len(model_keys):
        for row in keys:
            at = np.minimum(np.searchsorted(model_keys, row), len(model_keys) - 1)
            out = np.where(model_keys[at] == row, np.maximum(out, scores[at]), out)
    return out


def segments(s: np.ndarray, hot: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal scoring segments (first item, after the last, score) of a score array whose positive items are ``hot``."""
    total = np.concatenate([[0.0], np.cumsum(s)])
    found: list[tuple] = []  # begin, end, sum before, sum after, the last one before it with a smaller sum before
    for i in hot.tolist():
        begin, low, high = i, total[i], total[i + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]  # those passed over are never looked at again from further right
            if j < 0 or found[j][3] >= high:
                found.append((begin, i + 1, low, high, j))
                break
            begin, _, low, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, float(high - low)) for a, b, low, high, _ in found]


def decay_of(scores: np.ndarray, chance: np.ndarray, penalty: float) -> float:
    """The positive root of E exp(x s) = 1, where s is a score of ``scores`` with its chance and else -penalty."""
    lo, hi = 1e-6, 10.0
    rest = 1 - chance.sum()
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rest * np.exp(-mid * penalty) + (chance * np.exp(mid * scores)).sum() < 1 else (lo, mid)
    return max(lo, 0.05)


def scale_of(best: np.ndarray, tokens: np.ndarray, decay: float) -> float:
    """K of the extreme-value law P(best > S) = 1 - exp(-K n exp(-decay S)), by maximum likelihood over texts of n tokens; texts without any segment (best 0) count as censored there."""
    some = tokens > 0
    return float((best > 0).sum() + 0.5) / float((tokens[some] * np.exp(-decay * best[some])).sum() + 1.0)


def learn(texts, labels: np.ndarray, settings: Settings) -> Model:
    keys_in: list[list[np.ndarray]] = [[], []]
    held = []
    row = 0
    for lo, hi, data, offsets in ts.slabs(pa.array(texts, pa.string())):
        starts, ends, doc = ts.letter_runs(data, offsets)
        keys = token_keys(data, starts, ends)
        for k in keys:  # a document counts a token once
            own = np.flatnonzero(k)
            _, one = np.unique(ts.in_text(k[own], doc[own]), return_index=True)
            for y in (0, 1):
                keys_in[y].append(k[own[one]][labels[row + doc[own[one]]] == y])
        held.append((row, keys, doc, len(offsets) - 1))
        row += hi - lo
    each = [np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_counts=True) for x in keys_in]
    known = np.unique(np.concatenate([each[0][0], each[1][0]]))
    counts = np.zeros((2, len(known)))
    for y in (0, 1):
        counts[y, np.searchsorted(known, each[y][0])] = each[y][1]
    n = counts.sum(1)
    prior = settings.prior * len(labels) * counts.sum(0) / max(n.sum(), 1) + 1e-3
    rest = prior.sum()
    odds = [np.log((counts[y] + prior) / np.maximum(n[y] + rest - counts[y] - prior, 1e-9)) for y in (0, 1)]
    delta = odds[1] - odds[0]
    z = delta / np.sqrt(1 / (counts[0] + prior + 0.5) + 1 / (counts[1] + prior + 0.5))
    # Chance alone: the Chernoff bound on a token's toxic documents, against as many tokens as were tried.
    seen = np.maximum(counts.sum(0), 1)
    share, base = counts[1] / seen, min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base)))
    often = counts[1] / max(base, 1e-9) > settings.min_ratio * counts[0] / (1 - base)  # common words that lean a little are no evidence
    good = often & (z >= settings.min_z) & (seen * distance >= np.log(max((seen >= 3).sum(), 1)) + settings.margin)
    model = Model(known[good], np.minimum(delta[good], 8.0), 1.0, 1.0, np.zeros(3), settings)

    # The law of the best segment by chance, from the clean texts of the sample.
    clean = [(word_scores(keys, model.keys, model.scores, settings.penalty), doc, n, labels[row : row + n] == 0) for row, keys, doc, n in held]
    positive = np.concatenate([s[y[d] & (s > 0)] for s, d, _, y in clean] + [model.scores[:50]])  # smoothed by pseudo-counts
    tokens = sum(int(y[d].sum()) for _, d, _, y in clean) + len(positive) + 1
    model.decay = decay_of(positive, np.full(len(positive), 1 / tokens), settings.penalty)
    best, length = [], []
    for s, d, n, y in clean:
        top = np.zeros(n)
        for i, mine in _by_text(s, d, n):
            top[i] = max(x[2] for x in segments(s[mine[0] : mine[1]], mine[2]))
        best.append(top[y])
        length.append(ts.per_text(d, n)[y])
    model.scale = scale_of(np.concatenate(best) if best else np.zeros(0), np.concatenate(length) if length else np.zeros(0), model.decay)
    x = np.concatenate([np.zeros((0, 2))] + [_features(word_scores(k, model.keys, model.scores, settings.penalty), d, n, model)[0] for _, k, d, n in held])
    share = float(labels.mean()) if len(labels) else 0.5
    if 0 < share < 1:
        model.weights = crf.logistic(x, labels.astype(float), 1e-4)
    else:
        model.weights = np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))])
    return model


def _by_text(s: np.ndarray, doc: np.ndarray, n: int) -> Iterator[tuple[int, tuple[int, int, np.ndarray]]]:
    """Of each text with a positive score: its index, first run, run after the last, and the positive runs counted from its first."""
    hot = np.flatnonzero(s > 0)
    first = np.searchsorted(doc, np.arange(n + 1))
    for d in np.unique(doc[hot]).tolist():
        a, b = int(first[d]), int(first[d + 1])
        yield d, (a, b, hot[np.searchsorted(hot, a) : np.searchsorted(hot, b)] - a)


def _features(s: np.ndarray, doc: np.ndarray, n: int, model: Model) -> tuple[np.ndarray, list[list[tuple]]]:
    """Of each text: strength of the best segment and of all passages (both as -log p, compressed), and the passages (first run, after the last, score, p)."""
    x = np.zeros((n, 2))
    passages: list[list[tuple]] = [[] for _ in range(n)]
    for d, (a, b, mine) in _by_text(s, doc, n):
        for i, j, score in segments(s[a:b], mine):
            surprise = model.decay * score - np.log(model.scale * (b - a))
            p = -np.expm1(-np.exp(-surprise))
            x[d, 0] = max(x[d, 0], np.log1p(max(0.0, surprise)))
            if p <= model.settings.alpha:
                x[d, 1] += surprise
                passages[d].append((a + i, a + j, score, p))
    x[:, 1] = np.log1p(x[:, 1])
    return x, passages


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, score, best (strength of the best segment) and the passages (code-point offsets) of every row; with ``carry`` also the input row, as the struct ``row``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slabs(batch.column(1)):
                starts, ends, doc = ts.letter_runs(data, offsets)
                s = word_scores(token_keys(data, starts, ends), model.keys, model.scores, model.settings.penalty)
                x, passages = _features(s, doc, hi - lo, model)
                points = ts.code_points(data)
                spans = [[{"start": points[starts[a]] - points[offsets[d]], "end": points[ends[b - 1]] - points[offsets[d]], "score": v, "p_value": p} for a, b, v, p in row] for d, row in enumerate(passages)]
                p = crf.sigmoid(x @ model.weights[:2] + model.weights[2])
                yield common.with_rows(batch, lo, hi, [batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array(x[:, 0]), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "score", "best", "passages"])

    return common.carried(docs, id_col, text_col, carry, run, SCHEMA)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic") -> Model:
    """From at most ``settings.sample_rows`` labelled rows, in one task."""
    return common.fitted(common.labelled_sample(docs, labels, label, settings.sample_rows), lambda texts, y: learn(texts, common.int_labels(y), settings))
