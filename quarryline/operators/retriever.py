"""From questions to prompts in one plan: rewrite, embed, retrieve, rerank, pack, cite.

A ``Backend`` holds chunks and finds them by vector and, if it can, by text; hybrid
search over a backend that cannot is dense search.  ``Retriever`` takes tables of
queries (query_id, text).  Models are callables over columns; ``fail_open`` turns a
Python function into one that gives the query itself where the function fails.

Defined cases: a query that cannot be embedded is searched by text alone; without any
hit its context is ``EMPTY``; a rewritten text that is null or blank is replaced by the
query; ties rank by chunk id.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import shared_path
from . import evaluation as ev
from . import fusion as fu
from . import textindex as ti
from . import vectors as ve
from .committed import Store

# The sentence for an empty context, and how many candidates a reranker sees for each result.
EMPTY = "No relevant context was found."
POOL = 4
CHUNK = "id long, doc_id long, name string, chunk_index int, text string, metadata map<string,string>, vector array<double>"


class Backend(ABC):
    """Chunks (the columns of ``CHUNK``) and searches over them; results are query_id, rank, id, score."""

    supports_sparse = False

    @abstractmethod
    def chunks(self) -> DataFrame:
        """All chunks."""

    @abstractmethod
    def insert(self, chunks: DataFrame) -> None:
        """Stores chunks; those of a document that is there already replace it."""

    @abstractmethod
    def delete(self, ids: DataFrame) -> None:
        """Removes documents (doc_id)."""

    def documents(self, limit: int, offset: int = 0) -> DataFrame:
        """doc_id, name, chunks: a page of documents, the newest id first."""
        rows = self.chunks().groupBy("doc_id").agg(F.min("name").alias("name"), F.count("*").alias("chunks"))
        return rows.orderBy(F.desc("doc_id")).offset(offset).limit(limit)

    def dense(self, queries: DataFrame, k: int, where: dict[str, str] | None = None) -> DataFrame:
        """Nearest chunks of each query (query_id, vector) among those with the metadata."""
        rows = self.chunks()
        for key, value in (where or {}).items():
            rows = rows.filter(F.col("metadata")[key] == value)
        return ve.search(rows, queries, k, 0.05, "id", "vector")

    def sparse(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError("this backend has no search by text")

    def hybrid(self, queries: DataFrame, k: int) -> DataFrame:
        """Dense and sparse lists of three times k fused by rank; dense search where there is no sparse one."""
        if not self.supports_sparse:
            return self.dense(queries, k)
        return fu.rrf([self.dense(queries, 3 * k), self.sparse(queries, 3 * k)], k)


class FrameBackend(Backend):
    """Chunks in a DataFrame, found by vector only."""

    def __init__(self, chunks: DataFrame):
        self.rows = chunks

    def chunks(self) -> DataFrame:
        return self.rows

    def insert(self, chunks: DataFrame) -> None:
        self.rows = self.rows.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select(*chunks.columns).unionByName(chunks)

    def delete(self, ids: DataFrame) -> None:
        self.rows = self.rows.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


class StoreBackend(Backend):
    """Chunks in a committed table, found by vector and through an inverted index of the version that is read."""

    supports_sparse = True

    def __init__(self, store: Store, analyser: str = "simple"):
        self.store, self.analyser = store, analyser
        self.indexes: dict[int, ti.Index] = {}

    def chunks(self) -> DataFrame:
        return self.store.read("chunks") if self.store.version() else self.store.spark.createDataFrame([], CHUNK)

    def insert(self, chunks: DataFrame) -> None:
        self.store.commit({"chunks": chunks}, chunks.select("doc_id"))

    def delete(self, ids: DataFrame) -> None:
        self.store.commit({}, ids)

    def sparse(self, queries: DataFrame, k: int) -> DataFrame:
        version = self.store.version()
        if version not in self.indexes:
            self.indexes = {version: ti.build(self.chunks(), shared_path(self.store.spark, "text-index"), self.analyser, "id", "text")}
        return ti.search_any(self.indexes[version], queries, k)


def fail_open(call: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function of a Python function, with the query itself where that raises or gives nothing."""

    def one(text: str | None) -> str | None:
        try:
            made = call(text) if text is not None else None
        except Exception:  # noqa: BLE001  a model that fails must not end the search
            made = None
        return made if made and made.strip() else text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


@dataclass
class Retriever:
    """``embed`` makes vectors of texts, ``rewrite`` the text to search by, ``variants`` further phrasings (an array), ``rerank`` the score of query and text."""

    backend: Backend
    embed: Callable[[Column], Column] = tx.hash_vector
    rewrite: Callable[[Column], Column] | None = None
    variants: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    budget: int = fu.BUDGET

    def searched(self, queries: DataFrame) -> DataFrame:
        """query_id, text (as asked), sought (as searched)."""
        sought = F.col("text")
        if self.rewrite is not None:
            made = self.rewrite(F.col("text"))
            sought = F.when(F.length(F.trim(made)) > 0, made).otherwise(F.col("text"))
        return queries.select("query_id", "text", sought.alias("sought"))

    def retrieve(self, queries: DataFrame, k: int = 5, hybrid: bool = True) -> DataFrame:
        """query_id, rank, id, score of the k best chunks of each query."""
        asked = self.searched(queries)
        pool = POOL * k if self.rerank is not None else k
        texts = F.array("sought") if self.variants is None else self.variants(F.col("sought"))
        each = asked.select("query_id", F.posexplode(texts).alias("variant", "text"))
        if self.variants is not None:  # a list for each phrasing, fused by rank
            each = each.withColumn("query_id", F.col("query_id") * 100 + F.col("variant"))
        each = each.select("query_id", "text", self.embed(F.col("text")).alias("vector"))
        found = self.backend.hybrid(each, pool) if hybrid else self.backend.dense(each, pool)
        if self.variants is not None:
            found = fu.rrf([found.withColumn("query_id", F.floor(F.col("query_id") / 100).cast("long"))], pool)
        if self.rerank is None:
            return found
        texts = self.backend.chunks().select("id", "text").join(F.broadcast(found.select("query_id", "id")), "id")  # pool rows for each query
        return ev.rerank(texts.join(queries.select("query_id", F.col("text").alias("query")), "query_id"), self.rerank, k)

    def prompts(self, queries: DataFrame, k: int = 5, hybrid: bool = True, instructions: str = "") -> DataFrame:
        """query_id, chunks_sent, context, citations (source_number, doc_id, chunk_id, chunk_index, name, preview) and prompt, one row for each query."""
        found = self.retrieve(queries, k, hybrid).select("query_id", "rank", "id")
        rows = found.join(self.backend.chunks().select("id", "doc_id", "name", "chunk_index", "text"), "id")
        kept = fu.within_budget(rows, "query_id", "rank", self.budget)
        line = F.concat(F.lit("[Source "), F.col("place"), F.lit(": "), F.coalesce("name", F.lit("unknown document")), F.lit(", chunk "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?")), F.lit("]\n"), F.coalesce("text", F.lit("")))
        cited = F.struct(F.col("place").alias("source_number"), "doc_id", F.col("id").alias("chunk_id"), "chunk_index", "name", fu.preview(F.col("text")).alias("preview"))
        packed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), cited.alias("cited")))).alias("x"))
        out = queries.select("query_id", "text").join(packed, "query_id", "left")
        context = F.coalesce(F.array_join("x.line", "\n\n"), F.lit(EMPTY))
        head = F.lit(f"{instructions}\n\n" if instructions else "")
        none = F.array().cast("array<struct<source_number: int, doc_id: long, chunk_id: long, chunk_index: int, name: string, preview: string>>")
        out = out.select("query_id", "text", F.coalesce(F.size("x"), F.lit(0)).alias("n"), context.alias("context"), F.coalesce(F.col("x.cited"), none).alias("citations"))
        prompt = F.concat(head, F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), F.coalesce("text", F.lit("")), F.lit("\nAnswer:"))
        return out.select("query_id", F.greatest("n", F.lit(0)).alias("chunks_sent"), "context", "citations", prompt.alias("prompt"))

    def ask(self, queries: DataFrame, generate: Callable[[Column], Column], k: int = 5, hybrid: bool = True, instructions: str = "") -> DataFrame:
        """The prompts with an answer; ``generate`` is the model."""
        return self.prompts(queries, k, hybrid, instructions).withColumn("answer", generate(F.col("prompt")))
