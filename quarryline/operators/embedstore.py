"""Vectors of texts, kept by digest and model, so that no text is embedded twice.

New digests are found by an anti-join (which Spark narrows with a Bloom filter where
that pays), embedded, committed, and joined back.  Defined cases: a null text has no
vector; equal texts are one; a text that cannot be embedded (a null vector) is kept
as such and not tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .committed import Store


def digest(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text).cast("binary"), 256)


def embedded(store: Store, rows: DataFrame, model: str, embed: Callable[[Column], Column], text_col: str = "text") -> tuple[DataFrame, int]:
    """The rows with ``digest`` and ``vector``, and how many texts had to be embedded.  ``store`` is keyed by ``digest``."""
    keyed = rows.withColumn("digest", digest(F.col(text_col).cast("string"), model))
    wanted = keyed.filter("digest IS NOT NULL").groupBy("digest").agg(F.any_value(text_col).alias("text"))
    known = None
    if store.version() and "vectors" in store.manifest(store.version())["tables"]:
        known = store.read("vectors").select("digest")
    new = wanted if known is None else wanted.join(known, "digest", "left_anti")
    before = store.version()
    if known is None or not new.isEmpty():
        made = new.select("digest", F.lit(model).alias("model"), embed(F.col("text")).alias("vector"))
        version = store.commit({"vectors": made}, new.select("digest"))
        fresh = store.read("vectors", version).join(known, "digest", "left_anti") if known is not None else store.read("vectors", version)
        count = fresh.count()
    else:
        version, count = before, 0
    return keyed.join(store.read("vectors", version).select("digest", "vector"), "digest", "left"), count
