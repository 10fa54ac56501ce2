"""Quality classifier: a linear-chain conditional random field over lines.

Every line gets features of its own and of the lines before and after it, and a
label good or bad with learned transitions.  Only documents are labelled, so
lines first inherit the document's label; then the lines of bad documents are
labelled anew by their marginals (the worst line of a bad document staying bad)
and the field is fitted again.  A document's quality is the length-weighted
mean of the forward-backward marginals, with the worst line's, brought to a
probability by a logistic fit.  Learning takes a bounded sample of labelled
rows; scoring reads every whole text once, without a shuffle.

Defined cases: null, empty and blank texts have no line and score 0; a sample
with one class only gives that class' share to all others; equal rows are
scored each; extra columns are not read.
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
from .repetition import _SYMBOL, covered

SCHEMA = "doc_id long, score double, n_lines long, n_bad_lines long"
OWN = 16


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows to learn from, and steps of each fit.
    sample_rows: int = 2000
    steps: int = 60


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    final: np.ndarray


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines with a word, their text index and their length in code points."""
    starts, ends, doc = ts.words(data, offsets)
    hasher, points = ts.Hasher(data), ts.code_points(data)
    h = hasher.spans(starts, ends)
    a, b, line_doc = ts.lines(data, offsets)
    w0, w1 = np.searchsorted(starts, a), np.searchsorted(starts, b)
    some = w1 > w0
    a, b, line_doc, w0, w1 = (x[some] for x in (a, b, line_doc, w0, w1))
    n_words, chars = w1 - w0, points[b] - points[a]
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)

    def bytes_in(flags: np.ndarray) -> np.ndarray:
        return ts.span_sums(ts.running(flags), a, b)

    def words_in(flags: np.ndarray) -> np.ndarray:
        return ts.span_sums(ts.running(flags), w0, w1)

    first, keys = ts.windows(h, doc, 5)
    repeat = covered(first[ts.repeated(ts.in_text(keys, doc[first]))], 5, len(h)) if len(h) else np.zeros(0, bool)
    twin = np.zeros(len(h), bool)
    if len(h):
        twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    line_key = ts.in_text(hasher.spans(a, b), line_doc)
    letters = bytes_in(upper) + bytes_in(lower)
    last = data[np.maximum(ends[np.maximum(w1 - 1, 0)] - 1, 0)] if len(a) else np.zeros(0, np.uint8)
    word_chars = words_in(points[ends] - points[starts]) if len(h) else np.zeros(len(a))
    cols = [
        np.ones(len(a)),
        np.log1p(n_words),
        ts.ratio(bytes_in(upper), letters),
        ts.ratio(bytes_in((data >= 48) & (data <= 57)), chars),
        np.minimum(ts.ratio(bytes_in(_SYMBOL[data]), n_words), 5),
        np.minimum(ts.ratio(bytes_in(data == 33), n_words), 3),
        np.minimum(ts.ratio(bytes_in(data == 124), n_words), 3),
        np.isin(last, np.frombuffer(b".!?:;,\"')", np.uint8)).astype(float),
        ts.ratio(word_chars, n_words) / 5,
        ts.ratio(words_in(repeat), n_words),
        ts.ratio(words_in(twin), n_words),
        ts.repeated(line_key).astype(float),
        ts.ratio(bytes_in(np.isin(data, np.frombuffer(b".,;:", np.uint8))), n_words),
        ts.ratio(letters, np.maximum(b - a, 1)),
        ts.ratio(bytes_in(np.isin(data, np.frombuffer(b"/=_{}[]()\\@~^+", np.uint8))), n_words),
        (n_words < 4).astype(float),
    ]
    own = np.stack(cols, 1) if len(a) else np.zeros((0, OWN))
    near = np.zeros((len(own), 2 * OWN))
    if len(own) > 1:
        same = line_doc[1:] == line_doc[:-1]
        near[1:, :OWN] = own[:-1] * same[:, None]
        near[:-1, OWN:] = own[1:] * same[:, None]
    return np.hstack([own, near]), line_doc, chars.astype(float)


def _aggregate(good: np.ndarray, doc: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """Of each text: the length-weighted mean of the lines' probability of being good, its log-odds, and the worst line's."""
    weight = np.maximum(ts.per_text(doc, n, chars), 1)
    mean = ts.per_text(doc, n, good * chars) / weight
    worst = np.ones(n)
    np.minimum.at(worst, doc, good)
    clip = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([mean, np.log(clip / (1 - clip)), worst], 1)


def learn(texts, labels: np.ndarray, settings: Settings) -> Model:
    parts, row = [], 0
    for lo, hi, data, offsets in ts.slabs(pa.array(texts, pa.string())):
        f, doc, chars = line_features(data, offsets)
        parts.append((f, doc + row, chars))
        row += hi - lo
    width = 3 * OWN
    x, doc, chars = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros((0, width)), np.zeros(0, np.int64), np.zeros(0))
    share = float(labels.mean()) if len(labels) else 0.5
    centre, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    centre[0], spread[0] = 0.0, 1.0
    model = Model(centre, spread, np.zeros((width, 2)), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    if not 0 < share < 1 or not len(x):
        return model
    x = np.clip((x - centre) / spread, -6, 6)
    first, length = crf.chains(doc)
    good = labels[doc].astype(float)
    for _ in range(2):
        model.weights, model.trans = crf.fit(x, np.stack([1 - good, good], 1), first, length, 2, settings.steps)
        marginal, _, _ = crf.forward_backward(x @ model.weights, model.trans, first, length)
        bad = marginal[:, 0]
        worst = np.maximum.reduceat(bad, first)
        bad = np.minimum(1, bad / np.repeat(np.maximum(worst, 1e-3), length))
        good = np.where(labels[doc] == 1, 1.0, 1 - bad)
    marginal, _, _ = crf.forward_backward(x @ model.weights, model.trans, first, length)
    seen = np.unique(doc)
    model.final = crf.logistic(_aggregate(marginal[:, 1], doc, chars, len(labels))[seen], labels[seen].astype(float), 1e-4)
    return model


def judge(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, lines and bad lines of each text."""
    n = len(offsets) - 1
    f, doc, chars = line_features(data, offsets)
    first, length = crf.chains(doc)
    x = np.clip((f - model.centre) / model.spread, -6, 6)
    marginal, _, _ = crf.forward_backward(x @ model.weights, model.trans, first, length)
    lines = ts.per_text(doc, n)
    score = crf.sigmoid(_aggregate(marginal[:, 1], doc, chars, n) @ model.final[:3] + model.final[3])
    return np.where(lines > 0, score, 0.0), lines.astype(np.int64), ts.per_text(doc, n, marginal[:, 0] > 0.5).astype(np.int64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_lines, n_bad_lines of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slabs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, judge(data, offsets, model))], ["doc_id", "score", "n_lines", "n_bad_lines"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Model:
    """From at most ``settings.sample_rows`` labelled rows, in one task."""
    return common.fitted(common.labelled_sample(docs, labels, label, settings.sample_rows), lambda texts, y: learn(texts, common.int_labels(y), settings))
