"""Line deduplication over the corpus: lines that many documents share are dropped everywhere.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case.  Keys are hashed to 128 bits; the documents of a key are counted
from one key per document, summed before the shuffle, so a line that a third of
the corpus holds costs a few bytes a task.  The frequent keys come back to the
lines by a join: broadcast while there are at most ``broadcast_rows`` of them
(17 bytes each before hashing), else by a shuffle in which the few heaviest
keys, whose number is bounded by arithmetic, are joined by broadcast.  What stays
of a document is put together again by position.

Defined cases: every row is a document, so equal rows and rows of equal or null
ids count one each; a null or empty text is one empty line; lines whose key has
fewer than ``min_chars`` code points are kept, however often they occur; if all
lines go, the rest is the empty string; other columns, of any name, are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\f\r"
#: A key that holds at least this part of all (document, key) pairs is heavy; there are at most ``1 / HEAVY`` of them.
HEAVY = 1 / 2000


def key_of(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def frequent_keys(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """h1, h2 (the key's hash) and docs of every key that at least ``min_docs`` rows hold."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines_of(text_col), key_of))).alias("key"))
    keys = keys.filter(F.length("key") >= min_chars).select(*hashed(F.col("key")))
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)


def marked(lines: DataFrame, frequent: DataFrame, broadcast_rows: int) -> DataFrame:
    """The lines (h1, h2 and more) with ``gone``, true where the key is frequent; ``frequent`` is a stored table."""
    frequent = frequent.withColumn("gone", F.lit(True))
    size = frequent.agg(F.count("*").alias("n"), F.sum("docs").alias("pairs")).first()
    if size["n"] <= broadcast_rows:
        return lines.join(F.broadcast(frequent.select("h1", "h2", "gone")), ["h1", "h2"], "left")
    least = size["pairs"] * HEAVY
    heavy = frequent.filter(F.col("docs") >= least).select("h1", "h2", F.col("gone").alias("heavy"))
    known = lines.join(F.broadcast(heavy), ["h1", "h2"], "left")
    rest = known.filter("heavy IS NULL").drop("heavy")
    rest = rest.join(frequent.filter(F.col("docs") < least).select("h1", "h2", "gone").hint("merge"), ["h1", "h2"], "left")
    return rest.unionByName(known.filter("heavy").withColumnRenamed("heavy", "gone"))


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what stays, joined by line feeds), one row for each input row."""
    frequent = common.stored(frequent_keys(docs, min_docs, min_chars, text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), lines_of(f"`{text_col}`").alias("lines"))
    lines = rows.select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
    lines = marked(lines.select("*", *hashed(key_of(F.col("line")))), frequent, broadcast_rows)
    stays = F.when(F.col("gone").isNull(), F.struct("pos", "line"))
    kept = lines.groupBy("row", "doc_id").agg(F.count("*").alias("n_lines"), F.count("gone").alias("n_dropped"), F.collect_list(stays).alias("kept"))
    text = F.array_join(F.transform(F.array_sort("kept"), lambda x: x["line"]), "\n")
    return kept.select("doc_id", "n_lines", "n_dropped", text.alias("text"))
