"""Rank fusion and what is made of the fused lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
BUDGET = 12_000


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """query_id, rank, id, score: sum over the lists (query_id, rank from 1, id) of 1 / (constant + rank), ties by id."""
    parts = [x.select("query_id", "id", (1 / (constant + F.col("rank"))).alias("part")) for x in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("raw"))
    order = Window.partitionBy("query_id").orderBy(F.round("raw", 12).desc(), "id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("raw", 6).alias("score"))


def within_budget(rows: DataFrame, group: str, order: str, budget: int = BUDGET) -> DataFrame:
    """The first rows of each group while the running length of ``text`` is in the budget; always the first one."""
    w = Window.partitionBy(group).orderBy(order)
    run = rows.withColumns({"used": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    return run.filter((F.col("used") <= budget) | (F.col("place") == 1))


def context(rows: DataFrame, group: str, order: str, budget: int = BUDGET) -> DataFrame:
    """One prompt context for each group: numbered sources with their texts."""
    kept = within_budget(rows, group, order, budget)
    line = F.concat(F.lit("[Source "), F.col("place"), F.lit(": "), F.col("name"), F.lit(", chunk "), F.col("chunk_index"), F.lit("]\n"), F.col("text"))
    packed = kept.select(group, F.struct("place", line.alias("line")).alias("s")).groupBy(group).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return packed.select(group, F.array_join(F.transform("s", lambda x: x["line"]), "\n\n").alias("context"))


def preview(text):
    """First 150 characters, marked if cut."""
    return F.when(F.length(text) > 150, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)
