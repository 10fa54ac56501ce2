"""Evaluation of retrieval and answers: hit rates, coverage, groundedness, score scale, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .fulltext import terms


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """Cases (query, answer, sources, cited, expected_document, expected_keywords) with retrieval_hit, keyword_coverage, keywords_found and groundedness; each null where its case does not ask for it."""
    wanted = F.coalesce(F.size("expected_keywords"), F.lit(0)) > 0
    found = F.when(wanted, tx.keyword_hits(F.col("answer"), F.col("expected_keywords"))).otherwise(F.array().cast("array<string>"))
    rows = cases.withColumn("keywords_found", found)
    hit = F.when(F.col("expected_document").isNotNull(), F.coalesce(F.array_contains("sources", F.col("expected_document")), F.lit(False)))
    grounded = F.when(F.size("keywords_found") > 0, F.size(tx.keyword_hits(F.col("cited"), F.col("keywords_found"))) / F.size("keywords_found"))
    return rows.withColumns({"retrieval_hit": hit, "keyword_coverage": F.when(wanted, F.size("keywords_found") / F.size("expected_keywords")), "groundedness": grounded})


def evaluation_rates(evaluated: DataFrame) -> DataFrame:
    """One row of means; a mean without any case is null."""
    return evaluated.agg(F.avg(F.col("retrieval_hit").cast("double")).alias("retrieval_hit_rate"), F.avg("keyword_coverage").alias("keyword_coverage_rate"), F.avg("groundedness").alias("groundedness_rate"))


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """The k best of each query's hits (query_id, query, id, text) by a scorer of query and text, rounded to 4, ties by id."""
    rows = hits.withColumn("score", F.round(score(F.col("query"), F.col("text")), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def word_overlap(query: Column, text: Column) -> Column:
    """Stand-in scorer: the share of the query's distinct words that the text has."""
    q = F.array_distinct(terms(query))
    t = terms(text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))


def scale_check(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: mean and largest deviation of scores from the exact ones for the same (query_id, id), and the share of queries with the same first hit."""
    both = found.join(exact.select("query_id", "id", F.col("score").alias("true_score"), F.col("rank").alias("true_rank")), ["query_id", "id"])
    gap = F.abs(F.col("score") - F.col("true_score"))
    first = F.col("rank") == 1
    return both.agg(F.avg(gap).alias("mean_deviation"), F.max(gap).alias("max_deviation"), F.avg(F.when(first, F.when(F.col("true_rank") == 1, 1.0).otherwise(0.0))).alias("top1_agreement"))
