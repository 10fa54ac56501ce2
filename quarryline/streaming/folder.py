"""Folder ingest as a stream: new files by bounded batches, each file with its own outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest as ing
from ..sources import files as fi


def files(spark: SparkSession, path: str, per_batch: int = 50) -> DataFrame:
    """Files of a folder as they appear, at most ``per_batch`` at a time."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(path)


def documents(batch: DataFrame) -> DataFrame:
    """doc_id, filename, text, read_error of a batch of files; a file's id is the hash of its path and content."""
    read = fi.read_texts(batch)
    digest = batch.select("path", F.xxhash64("path", "content").alias("doc_id"))
    return read.join(digest, "path").select("doc_id", F.col("path").alias("filename"), "text", F.col("error").alias("read_error"))


def cycle(spark: SparkSession, path: str, out: str, checkpoint: str, per_batch: int = 50, once: bool = True) -> StreamingQuery:
    """Ingest what is new into ``out`` (tables documents and chunks, a partition for each batch).  A batch that runs again replaces its partition.  The source hands each version of a file out once; ``retried`` lists what to hand out again."""

    def write(batch: DataFrame, number: int) -> None:
        docs = documents(batch)
        outcomes, chunks = ing.ingest(docs.drop("read_error"))
        outcomes = outcomes.join(docs.select("doc_id", "read_error"), "doc_id").select("doc_id", "filename", F.col("success") & F.col("read_error").isNull(), "chunks", F.coalesce("read_error", "error").alias("error")).toDF("doc_id", "filename", "success", "chunks", "error")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        outcomes.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")

    writer = files(spark, path, per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def retried(outcomes: DataFrame, most_failures: int = 3) -> DataFrame:
    """Files (filename) whose last outcome is a failure, and that failed fewer than ``most_failures`` times."""
    per = outcomes.groupBy("filename").agg(F.count_if(~F.col("success")).alias("failures"), F.max_by("success", "batch").alias("last"))
    return per.filter(~F.col("last") & (F.col("failures") < most_failures)).select("filename", "failures")
