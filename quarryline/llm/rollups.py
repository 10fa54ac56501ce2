"""Token counts: delta-maintained rollups with idempotent batch commits.

A change is a signed statement about one document under one tokenizer version:
an insert adds its tokens, a delete takes the old ones away, a revised count
does both.  A batch of changes is summed by source, language and tokenizer
version before anything is shuffled further (a hot source is a few partial sums)
and written to the folder ``batch=<id>`` of the store in one commit of Spark's
file writer.  Totals are the sums of the committed batches, so they are additive
and need no read of what is there already.

A batch is written under a name of its own and committed by renaming, which one
of several writers of the same id can do: applying it again does nothing, and a
write that broke off is never read.  ``compact`` sums the batches so far into one
table that knows their ids, so neither totals nor commits read more and more.

Counts come from tokenizer files (a version each, whole texts in Arrow batches)
or from column expressions; the deltas and totals are SQL.

Defined cases: null source, language or tokenizer are groups of their own; a
null count is 0; groups whose documents and tokens are all back to 0 leave the
totals; an empty batch commits its id alone; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

#: Changes: what they add to the number of documents, and the sign of each count column that they bear.
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def word_tokens(text: Column) -> Column:
    """Tokenizer version ``words-1``: runs of characters outside \\x20 \\x09-\\x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def piece_tokens(text: Column) -> Column:
    """Tokenizer version ``pieces-1``: runs of ASCII letters, single digits, and single other characters that are no white space."""
    return F.regexp_count(text, F.lit(r"[A-Za-z]+|[^A-Za-z\x20\x09-\x0D]"))


VERSIONS = {"words-1": word_tokens, "pieces-1": piece_tokens}


def counted(docs: DataFrame, versions: dict = VERSIONS, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens (and what ``keep`` adds): one row for each document and tokenizer version."""
    kept = keep or {}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = F.array(*(F.struct(F.lit(k).alias("tokenizer"), f(text).cast("long").alias("tokens")) for k, f in versions.items()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), *(v.cast("long").alias(k) for k, v in kept.items()), F.explode(counts).alias("c"))
    return rows.select("doc_id", "source", "lang", "c.tokenizer", "c.tokens", *kept)


def tokenized(docs: DataFrame, files: dict[str, str], source_col: str = "source", lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """The same by tokenizer files (version to path), without special tokens: each text is read once for all versions.  ``keep`` are further values of the row to carry, as longs."""
    kept = keep or {}
    names = ["doc_id", "source", "lang", "tokenizer", "tokens", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns))]
            for version, path in files.items():
                sizes = np.concatenate([x[3] for x in tokens.id_arrays(batch, path, None)] or [np.zeros(0, np.int64)])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*rest[:3], pa.array([version] * n, pa.string()), pa.array(sizes.astype(np.int64)), *rest[3:]], names)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")]
    more = "".join(f", {k} long" for k in kept)
    return docs.select(*cols, *(v.cast("long").alias(k) for k, v in kept.items())).mapInArrow(run, f"doc_id long, source string, lang string, tokenizer string, tokens long{more}")


def deltas(changes: DataFrame) -> DataFrame:
    """Sums of the changes (op, source, lang, tokenizer, tokens, old_tokens): signed documents and tokens."""
    sign = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).when(F.col("op") == REVISE, 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))).cast("int"))
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("tokens", "old_tokens"))
    tokens = F.when(F.col("op") != DELETE, new).otherwise(0) - F.when(F.col("op") != INSERT, old).otherwise(0)
    return changes.select(*KEYS, sign.cast("long").alias("d"), tokens.alias("t")).groupBy(*KEYS).agg(F.sum("d").alias("docs"), F.sum("t").alias("tokens"))


class Rollups:
    """A store of committed batches under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _exists(self, path: str) -> bool:
        store, place = self._files(path)
        return store.exists(place)

    def _at(self, batch: str) -> str:
        if not batch or any(c in batch for c in "/\\=") or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.folder}/batch={batch}"

    def _base(self) -> tuple[int, str] | None:
        """The latest compaction: number and folder."""
        store, place = self._files(self.folder)
        if not store.exists(place):
            return None
        found = [int(n.removeprefix("base=")) for n in (x.getPath().getName() for x in store.listStatus(place)) if n.startswith("base=")]
        return (max(found), f"{self.folder}/base={max(found)}") if found else None

    def _compacted(self) -> DataFrame | None:
        base = self._base()
        return self.spark.read.schema("id string").parquet(f"{base[1]}/ids") if base else None

    def committed(self, batch: str) -> bool:
        ids = self._compacted()
        return self._exists(self._at(batch)) or ids is not None and not ids.filter(F.col("id") == batch).isEmpty()

    def _open(self) -> list[str]:
        """Committed batches that no compaction holds; those that one holds are gone from the folder, or named by it."""
        store, place = self._files(self.folder)
        if not store.exists(place):
            return []
        names = sorted(n.removeprefix("batch=") for n in (x.getPath().getName() for x in store.listStatus(place)) if n.startswith("batch="))
        ids = self._compacted()
        held = {r[0] for r in ids.filter(F.col("id").isin(names)).collect()} if ids is not None and names else set()
        return [n for n in names if n not in held]

    def _rename(self, made: str, name: str) -> bool:
        """False if the name is taken; one of several writers gets it."""
        jvm = self.spark._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (made, name))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(source, target, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "is not empty" not in str(e):
                raise
            common.remove(self.spark, made)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes; False if it was committed before."""
        at = self._at(batch)
        if self.committed(batch):
            return False
        made = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(made)  # a row for each group
        return self._rename(made, at)

    def _sums(self, paths: list[str]) -> DataFrame:
        sums = self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs != 0 OR tokens != 0")

    def compact(self) -> int:
        """Sum all committed batches into the next base and delete them; the number of batches summed.  One caller at a time."""
        base, open_ = self._base(), self._open()
        if not open_:
            return 0
        made = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        self._sums([*([f"{base[1]}/sums"] if base else []), *map(self._at, open_)]).write.parquet(f"{made}/sums")
        ids = self.spark.createDataFrame([(x,) for x in open_], "id string")
        (ids if base is None else ids.union(self._compacted())).write.parquet(f"{made}/ids")
        if not self._rename(made, f"{self.folder}/base={base[0] + 1 if base else 0}"):
            raise ValueError("another compaction ran meanwhile")
        for batch in open_:
            common.remove(self.spark, self._at(batch))
        return len(open_)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        base = self._base()
        paths = [*([f"{base[1]}/sums"] if base else []), *map(self._at, self._open())]
        return self._sums(paths) if paths else self.spark.createDataFrame([], SCHEMA)
