"""Ingest: sanitise, flag, guard, chunk, embed and store documents, each with its own outcome.

The pipeline is one plan over a table of documents (doc_id, filename, text,
metadata); a document that fails gives a row with its error and no chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from . import chunks as ck
from . import graph as gr
from . import language as la
from .committed import Store

#: A guardrail gives (text, reason): the text that goes on, or why it does not.
Guard = Callable[[Column], tuple[Column, Column]]


def length_guard(most: int = tx.MAX_LENGTH) -> Guard:
    return lambda text: (text, F.when(F.length(text) > most, F.lit(f"longer than {most} characters")))


def pattern_guard(pattern: str, reason: str) -> Guard:
    return lambda text: (text, F.when(text.rlike(pattern), F.lit(reason)))


def redacting_guard(pattern: str, mark: str) -> Guard:
    return lambda text: (F.regexp_replace(text, pattern, mark), F.lit(None).cast("string"))


def python_guard(check: Callable[[str], str]) -> Guard:
    """A function from text to text; an exception rejects the text with its message.  Runs in Arrow batches."""
    @F.pandas_udf("struct<text: string, reason: string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None if t is None else check(t), None))
            except Exception as e:  # noqa: BLE001  the exception is the verdict
                rows.append((t, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "reason"])

    return lambda text: (run(text)["text"], run(text)["reason"])


def guarded(docs: DataFrame, guards: list[Guard]) -> DataFrame:
    """docs with the text after all guards and the first ``reason`` that stopped it."""
    rows = docs.withColumn("reason", F.lit(None).cast("string"))
    for guard in guards:
        text, reason = guard(F.col("text"))
        rows = rows.withColumns({"text": F.when(F.col("reason").isNull(), text).otherwise(F.col("text")), "reason": F.coalesce("reason", reason)})
    return rows


def prepared(docs: DataFrame, guards: list[Guard] | None = None) -> DataFrame:
    """Sanitised and guarded documents with ``risk`` (phrases found, for the log alone) and ``error``."""
    clean = docs.withColumn("text", tx.sanitize(F.col("text"))).withColumn("risk", tx.injection_risk(F.col("text")))
    rows = guarded(clean, [length_guard()] if guards is None else guards)
    blank = F.coalesce(F.size(tx.words(F.col("text"))), F.lit(0)) == 0
    return rows.withColumn("error", F.coalesce("reason", F.when(blank, "no text"))).drop("reason")


def stored_chunks(rows: DataFrame, embed: Callable[[Column], Column] = tx.hash_vector, language: bool = False) -> DataFrame:
    """chunk_id, doc_id, chunk_index, text, token_count, vector (and language, where its script tells) of the documents without an error; chunks that could not be embedded are left out."""
    parts = ck.chunk(rows.filter("error IS NULL"))
    key = tx.composite_key(F.lit("chunk"), F.col("doc_id"), F.col("chunk_index"))
    out = parts.select(key.alias("chunk_id"), "*", embed(F.col("text")).alias("vector")).filter("vector IS NOT NULL")
    return out.withColumn("language", rules.script_language(F.col("text"))) if language else out


def ingest(docs: DataFrame, guards: list[Guard] | None = None, embed: Callable[[Column], Column] = tx.hash_vector, language: bool = False) -> tuple[DataFrame, DataFrame]:
    """(outcomes, chunks): for each document doc_id, filename, success, chunks, error; a document of which no chunk could be embedded fails as a whole."""
    rows = prepared(docs, guards)
    parts = stored_chunks(rows, embed, language)
    return _outcomes(rows, parts), parts


def _outcomes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    made = parts.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    found = rows.join(made, "doc_id", "left")
    error = F.coalesce("error", F.when(F.col("chunks").isNull(), "no chunk could be embedded"))
    return found.select("doc_id", "filename", error.isNull().alias("success"), F.coalesce("chunks", F.lit(0)).alias("chunks"), error.alias("error"))


def commit(store: Store, docs: DataFrame, guards: list[Guard] | None = None, embed: Callable[[Column], Column] = tx.hash_vector, profile: DataFrame | None = None) -> int:
    """Ingest into a store in one commit, and its version: tables ``documents`` (outcomes), ``chunks`` with the language of each (by ``profile``, see ``language.profiles``, else where its script tells), and the graph's ``contains`` and ``pairs``.

    Either all four change or none does, so no version has chunks without their
    graph.  A document that is ingested again replaces what it gave before; one
    that fails now keeps no chunks and no graph rows, only its outcome.  Chunks
    are cut and embedded once, into a staged table that the four are made from.
    """
    rows = prepared(docs, guards)
    parts = stored_chunks(rows, embed, language=profile is None)
    if profile is not None:
        found = la.detect(parts, profile, "chunk_id", carry=True)
        parts = found.select("row.*", F.col("lang").alias("language"))
    with store.staged(parts) as kept:
        names = gr.chunk_entities(kept)
        changes = {"documents": _outcomes(rows, kept), "chunks": kept, "contains": gr.contains(names), "pairs": gr.pairs(names)}
        return store.commit(changes, docs.select(store.key))


def write(docs: DataFrame, folder: str, batch: str, **options) -> DataFrame:
    """Ingest into the tables ``documents`` and ``chunks`` under a folder, in the partition of the batch; writing a batch again replaces it.  Returns the outcomes."""
    outcomes, parts = ingest(docs, **options)
    for name, rows in (("chunks", parts), ("documents", outcomes)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    return docs.sparkSession.read.parquet(f"{folder}/documents/batch={batch}")


def deleted(docs: DataFrame, parts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, existed): both tables without the ids in ``gone`` (doc_id), and whether each id was there."""
    there = docs.select("doc_id").distinct().withColumn("there", F.lit(True))
    existed = gone.select("doc_id").distinct().join(there, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("existed"))
    return ck.delete_documents(docs, gone), ck.delete_documents(parts, gone), existed


def embedded_once(texts: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows (text, ...) with their vector: each distinct text is embedded once and joined back."""
    once = texts.select("text").distinct().withColumn("vector", embed(F.col("text")))
    return texts.join(once, "text", "left")


def vector_dimensions(stored: DataFrame, wanted: int, column: str = "vector") -> DataFrame:
    """One row: ok, adjusted (nothing is stored), mismatch or invalid, with the size found."""
    sizes = stored.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high"), F.count(column).alias("n"))
    state = F.when(F.lit(not 1 <= wanted <= 16_000), "invalid").when(F.col("n") == 0, "adjusted").when((F.col("low") == wanted) & (F.col("high") == wanted), "ok").otherwise("mismatch")
    return sizes.select(state.alias("state"), F.col("high").alias("found"))
