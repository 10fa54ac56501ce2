"""Language ID: a linear-chain conditional random field over words.

Words (letter runs) have binary features: the word itself (lexicon), its first
and last one to three bytes (affixes) and its byte bigrams and trigrams, hashed
into a fixed table.  The labels are the languages of the sample; transitions
between neighbouring words are learned, so a switch of language inside a text
is followed but one odd word is not.  Forward-backward marginals, weighted by
word length, give a text's languages; the largest is its prediction.

Learning takes a bounded sample of every language: rows in a hash order, and of
their texts chains of words in a hash order.  Scoring reads every whole text
once, without a shuffle; a text is one chain from its first word to its last.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any labelled row every text is ``und``; equal rows are scored each;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, crf
from . import textscan as ts

SCHEMA = "doc_id long, lang_pred string, score double, shares map<string,double>"
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: Most rows of a language to learn from, and of all (each language has one at least); most chains of words, and words of a chain there.
    rows: int = 600
    all_rows: int = 60_000
    chains: int = 5000
    chain: int = 64
    bits: int = 16
    steps: int = 40


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray
    settings: Settings


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and how many each word has."""
    hasher, n = ts.Hasher(data), ends - starts
    groups = [(np.arange(len(starts)), hasher.spans(starts, ends) ^ np.uint64(0xA5))]
    for size in (1, 2, 3):
        own = np.flatnonzero(n >= size)
        groups.append((own, ts.mix(hasher.spans(starts[own], starts[own] + size) + np.uint64(0x10 + size))))
        groups.append((own, ts.mix(hasher.spans(ends[own] - size, ends[own]) + np.uint64(0x20 + size))))
        if size > 1:
            count = n[own] - size + 1
            stop = np.cumsum(count)
            at = np.repeat(starts[own] - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)
            groups.append((np.repeat(own, count), ts.mix(hasher.spans(at, at + size) + np.uint64(0x30 + size))))
    word = np.concatenate([w for w, _ in groups])
    feature = np.concatenate([f for _, f in groups]) & np.uint64((1 << bits) - 1)
    order = np.argsort(word, kind="stable")
    return feature[order].astype(np.int64), np.bincount(word, minlength=len(starts))


def emissions(features: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each word's features, times three: long words weigh somewhat more by being surer, not by being long."""
    if not len(counts):
        return np.zeros((0, weights.shape[1]))
    begin = np.cumsum(counts) - counts
    return 3 * np.add.reduceat(weights[features], begin, axis=0) / counts[:, None]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct word, and each word's number among them."""
    _, first, back = np.unique(ts.Hasher(data).spans(starts, ends), return_index=True, return_inverse=True)
    return first, back


def chain_numbers(doc: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words of a text."""
    first, length = crf.chains(doc)
    return np.cumsum(np.concatenate([np.zeros(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | ((np.arange(len(doc)) - np.repeat(first, length))[1:] % size == 0)]))


def learn(texts, langs, settings: Settings) -> Model:
    names = sorted(set(langs))
    k = len(names)
    model = Model(names, np.zeros((1 << settings.bits, max(k, 1))), np.zeros((max(k, 1),) * 2), settings)
    if k < 2:
        return model
    label = np.array([names.index(x) for x in langs])
    feats, counts, types, labels, lengths, at, row = [], [], [], [], [], 0, 0
    everything = ts.slabs(pa.array(texts, pa.string()))
    per_slab = []
    for lo, hi, data, offsets in everything:
        data = ts.LOWER[data]
        starts, ends, doc = ts.letter_runs(data, offsets)
        number = chain_numbers(doc, settings.chain)
        per_slab.append((data, starts, ends, doc + row, number))
        row += hi - lo
    total = sum(int(x[4][-1]) + 1 for x in per_slab if len(x[4]))
    limit = np.uint64(min(1.0, settings.chains / max(total, 1)) * (2**64 - 2**12))
    for s, (data, starts, ends, doc, number) in enumerate(per_slab):
        keep = ts.mix(number.astype(np.uint64) + np.uint64(s << 32)) <= limit
        starts, ends, doc, number = starts[keep], ends[keep], doc[keep], number[keep]
        first, back = distinct_words(data, starts, ends)
        f, c = word_features(data, starts[first], ends[first], settings.bits)
        feats.append(f)
        counts.append(c)
        types.append(back + at)
        labels.append(label[doc])
        lengths.append(crf.chains(number)[1])
        at += len(first)
    f, c, t, y, length = (np.concatenate(x) for x in (feats, counts, types, labels, lengths))
    first = np.cumsum(length) - length
    truth = np.eye(k)[y]
    # A language's weight does not depend on how much of it the sample has.
    weight = (len(y) / k / np.maximum(np.bincount(y, minlength=k), 1))[y]
    inner = np.ones(len(y), bool)
    inner[first] = False
    after = np.flatnonzero(inner)
    observed = truth[after - 1].T @ truth[after]
    w, trans = model.weights, model.trans
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    flat_type = np.repeat(np.arange(len(c)), c)
    for step in range(1, settings.steps + 1):
        e = emissions(f, c, w)
        marginal, _, expected = crf.forward_backward(e[t], trans, first, length, pairs=True)
        residual = (truth - marginal) * weight[:, None]
        by_type = np.stack([np.bincount(t, residual[:, j], minlength=len(c)) for j in range(k)], 1) * (3 / np.maximum(c, 1))[:, None]
        gw = np.stack([np.bincount(f, by_type[flat_type, j], minlength=len(w)) for j in range(k)], 1) / len(y) - 1e-6 * w
        gt = (observed - expected) / len(y) - 1e-2 * trans
        for x, g, m, v, rate in ((w, gw, mw, vw, 0.3), (trans, gt, mt, vt, 0.05)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return model


def mass(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Length-weighted marginals of each text, texts x languages."""
    n, k = len(offsets) - 1, len(model.langs)
    data = ts.LOWER[data]
    starts, ends, doc = ts.letter_runs(data, offsets)
    first, back = distinct_words(data, starts, ends)
    e = emissions(*word_features(data, starts[first], ends[first], model.settings.bits), model.weights)
    begin, length = crf.chains(doc)
    marginal, _, _ = crf.forward_backward(e[back], model.trans, begin, length)
    points = ts.code_points(data)
    size = points[ends] - points[starts]
    return np.stack([ts.per_text(doc, n, marginal[:, j] * size) for j in range(k)], 1)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; texts without an ASCII letter are looked at by character."""
    ascii_letter = ts.LETTER[data] & (data < 128)
    out = ts.span_sums(ts.running(ascii_letter), offsets[:-1], offsets[1:]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the predicted language) and the shares of all languages of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        k = len(model.langs)
        for batch in batches:
            for lo, hi, data, offsets in ts.slabs(batch.column(1)):
                n = hi - lo
                m = mass(data, offsets, model) if k else np.zeros((n, 0))
                fine = _has_letter(data, offsets) & bool(k)
                share = m / np.maximum(m.sum(1, keepdims=True), 1e-12)
                best = np.where(fine, share.argmax(1) if k else 0, k)
                p = np.where(fine, share.max(1), 0.0) if k else np.zeros(n)
                maps = [list(zip(model.langs, s, strict=True)) if ok else [] for s, ok in zip(share.tolist(), fine.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(names[best], pa.string()), pa.array(p), pa.array(maps, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _in_order(texts: list, langs: list, settings: Settings) -> Model:
    """The same model whatever the order of the sample."""
    pairs = sorted(zip(langs, texts, strict=True))
    return learn([t for _, t in pairs], [x for x, _ in pairs], settings)


def train(docs: DataFrame, settings: Settings = Settings(), seed: int = 11) -> Model:
    """From text and lang of ``docs`` (rows that may be learned from)."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))
    counts = common.cut(known.groupBy("lang").count())
    languages = counts.count()
    rows = max(1, min(settings.rows, settings.all_rows // max(1, languages)))
    # The least hashes of a language lie below a bound set by its count, so few rows of it meet in one task.
    some = 8 * rows + 64
    most = F.when(F.col("count") <= some, F.lit(2**63 - 1)).otherwise((some / F.col("count") * 2.0**64 - 2.0**63).cast("long"))
    bounds = counts.select("lang", most.alias("most"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    # There are a few thousand languages; a longer list is joined as any table is.
    sample = known.join(F.broadcast(bounds) if languages <= 10_000 else bounds, "lang").filter("h <= most").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows)
    return common.fitted(sample.select("text", "lang"), lambda texts, langs: _in_order(texts, langs, settings))
