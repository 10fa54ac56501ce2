"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths measure how many characters of a text
lie inside duplicated n-grams (5 to 10 words) and duplicated lines, and which
share of it the commonest short n-gram (2 to 4 words) makes up.  One pass, no
shuffle: each text is scanned whole, in slabs of a bounded number of bytes.

Defined cases: null and empty texts have zero words and fail the base rule;
texts shorter than an n-gram have no coverage; rows with equal ids are judged
each on its own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textscan as ts


@dataclass(frozen=True)
class Limits:
    """Most that a kept text has: shares of its word characters inside duplicated n-grams (first ones included), by n-gram length, and inside lines equal to an earlier line."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.19), (7, 0.18), (8, 0.17), (9, 0.16), (10, 0.15))
    #: And the characters of all occurrences of its commonest n-gram, by length, if that occurs twice or more.
    tops: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    line_chars: float = 0.20
    min_words: int = 10
    repeat_percent: int = 20


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_share double, gram_shares array<double>, top_shares array<double>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for items inside any of the windows of n items that begin at ``first``."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + n, -1)
    return np.cumsum(step[:-1]) > 0


def top_share(h: np.ndarray, doc: np.ndarray, chars: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of each text: characters of all occurrences of the n-gram that has most of them, among those that occur again."""
    out = np.zeros(n)
    first, keys = ts.windows(h, doc, size)
    if len(first):
        order = np.argsort(ts.in_text(keys, doc[first]), kind="stable")
        key = ts.in_text(keys, doc[first])[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        again = count > 1
        at = first[order[start[again]]]
        sums = ts.running(chars)
        np.maximum.at(out, doc[at], count[again] * (sums[at + size] - sums[at]))
    return out


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], tops: tuple[int, ...] = ()) -> dict[str, np.ndarray]:
    """Repetition figures of each text of a slab.  Longer windows repeat only where shorter ones do, so each length looks only at starts that the one before left."""
    n = len(offsets) - 1
    starts, ends, doc = ts.words(data, offsets)
    hasher, points = ts.Hasher(data), ts.code_points(data)
    chars = points[ends] - points[starts]
    h = hasher.spans(starts, ends)
    out = {"n_words": ts.per_text(doc, n), "word_chars": ts.per_text(doc, n, chars).astype(np.int64)}
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    a, b, line_doc = ts.lines(data, offsets)
    before = np.searchsorted(starts, a)
    has_word = np.searchsorted(starts, b) > before
    a, b, line_doc, before = a[has_word], b[has_word], line_doc[has_word], before[has_word]
    again = ts.later(ts.in_text(hasher.spans(a, b), line_doc))
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = total[np.searchsorted(starts, b)] - total[before]
    out["n_dup_lines"] = ts.per_text(line_doc, n, again).astype(np.int64)
    all_chars = np.maximum(out["word_chars"], 1)
    out["line_share"] = ts.per_text(line_doc, n, again * line_chars) / all_chars

    shares, candidates = [], None
    for length in sorted({5, *lengths}):
        first, keys = ts.windows(h, doc, length)
        keys = ts.in_text(keys, doc[first])
        if candidates is not None:
            keep = candidates[first]
            first, keys = first[keep], keys[keep]
        first = first[ts.repeated(keys)]
        candidates = np.zeros(len(h), bool)
        candidates[first] = True
        inside = covered(first, length, len(h))
        if length == 5:
            out["n_repeat_words"] = ts.per_text(doc, n, inside).astype(np.int64)
        if length in lengths:
            shares.append(ts.per_text(doc, n, inside * chars) / all_chars)
    out["gram_shares"] = np.stack(shares, 1) if shares else np.zeros((n, 0))
    out["top_shares"] = np.stack([top_share(h, doc, chars, k, n) / all_chars for k in tops], 1) if tops else np.zeros((n, 0))
    return out


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))


def _scan(lengths: tuple[int, ...], tops: tuple[int, ...]):
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slabs(batch.column(1)):
                m = measure(data, offsets, lengths, tops)
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(m[k].astype(np.int64)) for k in counts), pa.array(m["line_share"]), _lists(m["gram_shares"]), _lists(m["top_shares"])]
                yield common.with_rows(batch, lo, hi, cols, ["doc_id", *counts, "line_share", "gram_shares", "top_shares"])

    return scan


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: the figures above, ``base_failed`` and ``kept``; with ``carry`` also the input row, as the struct ``row``, so that a filter needs no join."""
    lengths, tops = (tuple(sorted(n for n, _ in x)) for x in (limits.ngrams, limits.tops))
    found = common.carried(docs, id_col, text_col, carry, _scan(lengths, tops), SCHEMA)
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    fine = F.col("line_share") <= limits.line_chars
    for column, given in (("gram_shares", limits.ngrams), ("top_shares", limits.tops)):
        for i, (_, most) in enumerate(sorted(given)):
            fine = fine & (F.col(column)[i] <= most)
    return found.withColumns({"base_failed": base, "kept": ~base & fine})
