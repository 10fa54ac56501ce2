"""Importance resampling towards a target text: hashed n-gram weights and a weighted draw without replacement.

Features are the runs of 1 to ``max_n`` words, hashed to ``buckets`` buckets.  A
bucket's gain is the log of its smoothed share in the target over that in the
corpus; a document's weight is the mean gain of its features.  Gumbel noise from
a hash of the id is added, and the documents of the highest sums are drawn: a draw
without replacement in proportion to the weights.  All of it is built-in column
functions: explode, crc32, a grouped count, a join with the table of gains (one
row a bucket, so its size is the parameter), a sum for each document, one sort.

Ranks need no window over all rows: the rows are sorted across partitions and
stored with partition and place, and a rank is the place plus the rows of earlier
partitions.

Defined cases: a null text has no words, no features and weight 0; texts without
words likewise; rows of equal or null ids are documents of their own, and a null
id is the empty string in the hash; of equal scores the smaller id ranks first
(null ids last), then the smaller weight, then fewer features; an empty table
gives no rows, and with an empty target the gains follow from the corpus alone;
other columns, of any name, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What lies between words, which are made of ASCII's letters and digits and of everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Draw:
    """max_n: longest n-gram; min_words: shorter documents are never drawn; percent: share of the others that is drawn."""

    max_n: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024


def words_of(text: str) -> Column:
    """Lower-cased words in order.  Cut at what lies between them: ``regexp_extract_all`` copies the text for each match."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def ngrams_of(words: Column, max_n: int) -> Column:
    """All runs of 1 to ``max_n`` consecutive words, joined by one space; ``words`` is a column, not an expression, as each run looks into it."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(n))))

    return F.concat(words, *(runs(n) for n in range(2, max_n + 1))) if max_n > 1 else words


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def counted(texts: DataFrame, text_col: str, draw: Draw) -> DataFrame:
    """bucket, n: how many features of the table fall into each bucket."""
    features = texts.select(words_of(text_col).alias("words")).select(F.explode(ngrams_of(F.col("words"), draw.max_n)).alias("f"))
    return features.select(bucket_of(F.col("f"), draw.buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, draw: Draw) -> DataFrame:
    """bucket, gain for every bucket: ``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` in doubles."""
    every = corpus.sparkSession.range(draw.buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # one row for each bucket
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_s, all_t = F.sum("s").over(whole).cast("double"), F.sum("t").over(whole).cast("double")
    odds = (t + 1) * (all_s + draw.buckets) / ((s + 1) * (all_t + draw.buckets))
    return both.select("bucket", F.floor(F.log(odds) * 1000).cast("long").alias("gain"))


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number division towards minus infinity, for b > 0."""
    return ((a - F.pmod(a, b)) / b).cast("long")  # the quotient is whole and below 2^53, so exact


def scored(docs: DataFrame, table: DataFrame, draw: Draw, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(f"`{text_col}`").alias("words"))
    features = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.explode_outer(ngrams_of(F.col("words"), draw.max_n)).alias("f"))
    features = features.select("doc_id", "row", "n_words", bucket_of(F.col("f"), draw.buckets).alias("bucket"))
    summed = features.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.count("gain").alias("n_features"), F.sum("gain").alias("total"))
    n, total = F.col("n_features"), F.col("total")
    weight = F.when(n > 0, floor_div(total, n)).otherwise(F.lit(0).cast("long"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    return summed.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def placed(rows: DataFrame, order: list[Column], counted_if: Column) -> DataFrame:
    """The rows with ``place`` (1, 2, 3 and so on in that order) and ``found``, the number of rows for which ``counted_if`` holds: one sort across partitions and a count of each partition."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.orderBy(*order).select("*", F.spark_partition_id().alias("part"), at.alias("at"))
    rows = common.stored(rows)  # sorted once: a second sort could cut elsewhere
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(counted_if).alias("found"))
    # The windows see one row for each partition of the sort, whose number the session sets.
    whole = Window.partitionBy(F.lit(0))
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    sizes = sizes.select("part", before.alias("before"), F.sum("found").over(whole).alias("found"))
    return rows.join(F.broadcast(sizes), "part").withColumn("place", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where the row is not drawn) of every row."""
    table = common.stored(gains(counted(docs, f"`{text_col}`", draw), counted(target, f"`{target_col}`", draw), draw))
    able = F.col("n_words") >= draw.min_words
    order = [F.desc(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    rows = placed(scored(docs, table, draw, id_col, text_col), order, able)
    drawn = F.floor(F.col("found") * draw.percent / 100).cast("long")
    rank = F.when(able & (F.col("place") <= drawn), F.col("place"))
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
