"""Speech metrics: normalised texts, word and character errors, corpus rates and bootstrap intervals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

# English number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine".split())}
TEENS = {w: i + 10 for i, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i + 20 for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
SMALL = UNITS | TEENS | TENS
APOSTROPHES = "'\u2019\u02bc"


def _spaced(text: str, numbers: bool) -> str:
    text = unicodedata.normalize("NFKC", text or "").casefold()
    if numbers:
        text = re.sub(r"(?<=\d)[,\u066c](?=\d{3}(?!\d))", "", text)
    kinds = ((c, unicodedata.category(c)) for c in text if c not in APOSTROPHES)
    return "".join(" " if k[0] in "PS" or c.isspace() else str(unicodedata.decimal(c)) if numbers and k == "Nd" else c for c, k in kinds)


#: A letter for each kind of number word, so that the grammar below reads them.
_KIND = dict.fromkeys(UNITS, "u") | dict.fromkeys(TEENS, "e") | dict.fromkeys(TENS, "t") | {"hundred": "h", "thousand": "K", "million": "M", "billion": "B"}
_SMALL = "(?>tu?|e|u)"
#: What stands right before a further ``hundred`` or scale belongs to that.
_BELOW = f"(?>(?:{_SMALL})?h(?:{_SMALL}(?!h))?|{_SMALL}(?!h))"
#: Scales fall from left to right.
_NUMBER = re.compile(f"(?:({_BELOW})?B)?(?:({_BELOW})?M)?(?:({_BELOW})?K)?({_BELOW}(?![KMB]))?")


def _below(words: list[str]) -> int:
    """Value of words below a thousand."""
    at = words.index("hundred") if "hundred" in words else -1
    return (sum(SMALL[w] for w in words[:at]) or 1) * 100 * (at >= 0) + sum(SMALL[w] for w in words[at + 1 :])


def _numbers(run: list[str]) -> list[str]:
    """The numbers that a run of number words says, each the longest that the grammar allows; single digits alone are read as they stand."""
    if len(run) > 1 and all(w in UNITS for w in run):
        return ["".join(str(UNITS[w]) for w in run)]
    kinds, found, at = "".join(_KIND[w] for w in run), [], 0
    while at < len(run):
        said = _NUMBER.match(kinds, at)
        value = 0
        for group, scale in ((1, "billion"), (2, "million"), (3, "thousand"), (4, "")):
            words = run[said.start(group) : said.end(group)] if said[group] is not None else []
            if not scale:
                value += _below(words)
            elif _KIND[scale] in said[0]:
                value += (_below(words) if words else 1) * SCALES[scale]
        found.append(str(value))
        at = said.end()
    return found


def normalised(text: str | None, numbers: bool = False) -> str:
    """Compatibility form, folded case, no apostrophes, punctuation and symbols as spaces; with ``numbers``, English number words as digits."""
    words = _spaced(text or "", numbers).split()
    if not numbers:
        return " ".join(words)
    out: list[str] = []
    run: list[str] = []
    for word, after in zip(words, [*words[1:], ""], strict=True):
        if word in SMALL or word in SCALES or word == "hundred":
            run.append(word)
        elif not (word == "and" and run and (run[-1] == "hundred" or run[-1] in SCALES) and after in SMALL):
            out += [*(_numbers(run) if run else []), word]
            run = []
    return " ".join(out + (_numbers(run) if run else []))


def distance(one: list, two: list) -> int:
    """Edit distance of two sequences, a row of numpy operations for each item of the first."""
    code = {x: i for i, x in enumerate(dict.fromkeys([*one, *two]))}
    b = np.array([code[x] for x in two], np.int64)
    step = np.arange(len(b) + 1)
    row = step.copy()
    for i, x in enumerate(one, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != code[x]))
        # Insertions run from left to right: a running minimum of the values less their place.
        row = np.minimum.accumulate(np.concatenate([[i], best]) - step) + step
    return int(row[-1])


def normalise(text: Column, numbers: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: normalised(t, numbers))

    return run(text)


def errors(rows: DataFrame, reference: str, hypothesis: str, numbers: bool = False) -> DataFrame:
    """The rows with word_errors, ref_words, char_errors, ref_chars; all null where the reference is empty once normalised."""

    @F.pandas_udf("struct<word_errors: int, ref_words: int>")
    def words(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(distance(a.split(), b.split()), len(a.split())) for a, b in zip(r, h, strict=True)], columns=["word_errors", "ref_words"])

    ref, hyp = normalise(F.col(reference), numbers), normalise(F.col(hypothesis), numbers)
    out = rows.withColumns({"_r": ref, "_h": hyp}).withColumn("_w", words("_r", "_h"))
    some = F.col("_r") != ""
    found = {"word_errors": F.col("_w.word_errors"), "ref_words": F.col("_w.ref_words"), "char_errors": F.levenshtein("_r", "_h"), "ref_chars": F.length("_r")}
    return out.withColumns({k: F.when(some, v) for k, v in found.items()}).drop("_r", "_h", "_w")


def rates(rows: DataFrame, by: str = "language") -> DataFrame:
    """Word and character error rates and the real-time factor of each language and of ALL: sums over sums."""
    sums = rows.rollup(by).agg(*(F.sum(c).alias(c) for c in ("word_errors", "ref_words", "char_errors", "ref_chars", "latency_s", "audio_s")), F.count("*").alias("clips"), F.grouping(by).alias("g"))
    rate = [F.try_divide(a, b).alias(n) for n, a, b in (("wer", "word_errors", "ref_words"), ("cer", "char_errors", "ref_chars"), ("rtf", "latency_s", "audio_s"))]
    return sums.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "clips", *rate)


def _share(total: np.ndarray, sizes: list[int], mine: int, seed: int) -> np.ndarray:
    """How many of each resample's ``total`` draws fall on part ``mine``: down a tree over the parts, each node a binomial split that every task makes alike."""
    lo, hi, left = 0, len(sizes), total
    while hi - lo > 1:
        mid = (lo + hi) // 2
        all_, head = sum(sizes[lo:hi]), sum(sizes[lo:mid])
        taken = np.random.default_rng([seed, lo, hi]).binomial(left, head / all_) if all_ else np.zeros_like(left)
        lo, hi, left = (lo, mid, taken) if mine < mid else (mid, hi, left - taken)
    return left


def bootstrap(rows: DataFrame, errors_col: str, units_col: str, other: tuple[str, str] | None = None, resamples: int = 2000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(low, high) of the rate sum(errors) / sum(units) over resamples of as many rows as there are, drawn with replacement; with ``other`` (errors, units of a second system on the same rows), of the difference of the two rates.

    Nothing is collected but sums for each resample: the draws are split over the
    parts of the stored rows by conditional binomials, then over the batches of a
    part, and are drawn row by row inside a batch.  Rows with a null are left out.
    """
    names = [errors_col, units_col, *(other or ())]
    kept = rows.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names))).dropna()
    path = shared_path(rows.sparkSession, "bootstrap")
    kept.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    schema = ", ".join(f"v{i} double" for i in range(len(names))) + ", part int"
    held = rows.sparkSession.read.schema(schema).parquet(path)
    found = {r[0]: r[1] for r in held.groupBy("part").count().collect()}  # one row for each part
    numbers, sizes = sorted(found), [found[p] for p in sorted(found)]

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = numbers.index(key[0])
        left = _share(np.full(resamples, sum(sizes)), sizes, mine, seed)
        rng, rest, sums = np.random.default_rng([seed, mine, 1 << 20]), sizes[mine], np.zeros((resamples, len(names)))
        for frame in frames:
            values = frame[[f"v{i}" for i in range(len(names))]].to_numpy()
            draws = rng.binomial(left, min(1.0, len(values) / rest))
            at = np.concatenate([[0], np.cumsum(draws)])
            for lo in range(0, resamples, 50):  # so many resamples at a time, to bound what is held
                hi = min(resamples, lo + 50)
                picked = values[rng.integers(0, len(values), at[hi] - at[lo])]
                run_of = np.repeat(np.arange(hi - lo), draws[lo:hi])
                for i in range(len(names)):
                    sums[lo:hi, i] += np.bincount(run_of, picked[:, i], hi - lo)
            left, rest = left - draws, rest - len(values)
        yield pd.DataFrame({"b": np.arange(resamples)} | {f"s{i}": sums[:, i] for i in range(len(names))})

    out = "b int, " + ", ".join(f"s{i} double" for i in range(len(names)))
    drawn = held.groupBy("part").applyInPandas(run, out).groupBy("b").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))))
    rate = F.try_divide("s0", "s1") - F.try_divide("s2", "s3") if other else F.try_divide("s0", "s1")
    # One value for each resample: a list of their fixed number.
    values = drawn.select(rate.alias("rate")).filter("rate IS NOT NULL").agg(F.array_sort(F.collect_list("rate")).alias("v"))

    def pick(q: float) -> Column:
        return F.try_element_at("v", (F.floor(F.size("v") * q) + 1).cast("int"))

    return values.select(pick(low).alias("low"), pick(high).alias("high"))
