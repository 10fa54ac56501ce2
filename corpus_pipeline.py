"""Corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``; further columns of the input end in the first stage.
The stages set the session's Arrow batches to 4 MB, for the memory of executors.

Defined cases: null, empty and very short texts fail the quality rules; of equal
rows, whether their ids are equal, differ or are null, deduplication keeps one;
null source is a source of its own in the mix; ties are broken by hashes of the
rows, so reruns agree; no rows give no sequences; without usable labels all
documents get the score of the label's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import common, mixing, neardup, packing, queries, repetition, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: From this score on a document is toxic.
TOXIC = 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the repetition rules reject; the rows pass through the scan, nothing is joined or shuffled."""
    common.short_batches(spark)
    return repetition.repetition(docs, carry=True).filter("kept").select("row.*").select(*COLUMNS)


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxic passages give a score of at least ``TOXIC``, likewise."""
    common.short_batches(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=True).filter(F.col("score") < TOXIC).select("row.*").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near duplicates, the document with the least id."""
    common.short_batches(spark)
    return neardup.deduplicated(docs).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, cut where its source's target ends."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece, with its ids."""
    common.short_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), end=0, keep=False)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_passages),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]

#: The trained model, the hash orders and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = common.fresh_path(spark, f"pipeline-{number + 1}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
