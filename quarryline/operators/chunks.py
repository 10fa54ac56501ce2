"""Documents, chunks and their maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def chunk(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, text, token_count: windows of ``size`` words, each ``overlap`` words into the one before; the last ends with the text; blank texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    w = docs.select("doc_id", tx.words(F.coalesce("text", F.lit(""))).alias("w"))
    last = F.when(F.size("w") <= size, F.lit(0)).otherwise(F.ceil((F.size("w") - size) / step)).cast("int")
    # Chunks are cut in the row and then dealt out, so a chunk carries its own words only.
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * step + 1, F.lit(size)))
    rows = w.filter(F.size("w") > 0).select("doc_id", F.posexplode(F.transform(parts, lambda p: F.struct(F.array_join(p, " ").alias("text"), F.size(p).alias("token_count")))).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", "c.text", "c.token_count")


def list_documents(docs: DataFrame, chunks: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Documents with their number of chunks, newest (largest id) first."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = docs.select("doc_id", "source").join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return rows.orderBy(F.desc("doc_id")).offset(offset).limit(limit)


def delete_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (documents or chunks) without those of the deleted ids."""
    return rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with the new versions in place of those with equal ids."""
    return delete_documents(old, new).unionByName(new)


def upsert_last(rows: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Merge by key: the row with the largest ``order`` wins (of equal ones, that with the largest hash), rows with a null, empty or zero key are skipped, stored rows without a new one stay."""
    good = rows.filter(F.col(key).isNotNull() & ~F.col(key).cast("string").isin("", "0"))
    last = good.groupBy(key).agg(F.max_by(F.struct(*good.columns), F.struct(order, F.xxhash64(*good.columns))).alias("r")).select("r.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def upsert_first_seen(rows: DataFrame, stored: DataFrame, keys: list[str], touched: str) -> DataFrame:
    """One row for each key: the newest values by ``touched``, whether new or stored."""
    every = stored.unionByName(rows)
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*every.columns), F.struct(touched, F.xxhash64(*every.columns))).alias("r"))
    return last.select("r.*")


def folder_plan(manifest: DataFrame, ingested: DataFrame, complete: bool = True) -> DataFrame:
    """path, action (add, update, keep, remove) of a folder against what was ingested, by content hash.  Nothing is removed if the listing is empty or not complete: a failed listing is no deletion."""
    m, i = manifest.select("path", F.col("hash").alias("new")), ingested.select("path", F.col("hash").alias("old"))
    listed = m.agg((F.count("*") > 0).alias("listed"))  # one row
    gone = F.when(F.lit(complete) & F.col("listed"), "remove").otherwise("keep")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), gone).when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return m.join(i, "path", "full").join(F.broadcast(listed)).select("path", action.alias("action"))


def grant_plan(listing: DataFrame, read: DataFrame, ingested: DataFrame) -> DataFrame:
    """grant, path, action (add, update, keep, remove): files listed (grant, path, hash) against those ingested (the same columns), by grant.  ``read`` (grant, complete) are the listings that could be read: where a grant's was not, was not complete or is empty, nothing of it is removed."""
    m, i = listing.select("grant", "path", F.col("hash").alias("new")), ingested.select("grant", "path", F.col("hash").alias("old"))
    sound = listing.select("grant").distinct().join(read.filter("complete").select("grant").distinct(), "grant", "left_semi").withColumn("sound", F.lit(True))
    both = m.join(i, ["grant", "path"], "full").join(sound, "grant", "left")
    gone = F.when(F.col("sound"), "remove").otherwise("keep")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), gone).when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return both.select("grant", "path", action.alias("action"))


def filename(docs: DataFrame, doc_id) -> DataFrame:
    return docs.filter(F.col("doc_id") == doc_id).select("filename")


def containing(rows: DataFrame, wanted: dict, column: str = "metadata") -> DataFrame:
    """Rows whose metadata (a map, or a JSON string for nested values) holds every key with its value; nested objects hold each of theirs; an unknown key matches nothing."""
    kind = rows.schema[column].dataType.typeName()

    def holds(path: str, value) -> list:
        if isinstance(value, dict):
            return [c for k, v in value.items() for c in holds(f"{path}.{k}", v)]
        found = F.col(column)[path[2:]] if kind == "map" else F.get_json_object(column, path)
        return [F.coalesce(found.cast("string") == F.lit(str(value).lower() if isinstance(value, bool) else str(value)), F.lit(False))]

    for c in holds("$", wanted):
        rows = rows.filter(c)
    return rows


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the values given; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def renamed(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped columns first under their new names, the others behind them as they are."""
    first = [F.col(old).alias(new) for old, new in mapping.items() if old in rows.columns]
    return rows.select(*first, *(c for c in rows.columns if c not in mapping))
