"""Session helpers of the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every operator here counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of whole texts or sets, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a fresh temporary folder in local mode (tests, one machine), and an error on a cluster."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and set_dir.isDefined():
        folder = set_dir.get()
    if not folder:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not set_dir.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder and read again: cuts the lineage as ``cut`` does, and small parts of many stages are read together."""
    return Scratch(df.sparkSession).store(df)


class Scratch:
    """Tables of intermediate results in the shared folder, deleted as soon as they are superseded."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.names: dict[int, str] = {}
        self.held: list[DataFrame] = []  # keeps the numbers in ``paths`` valid

    def store(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "stored")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)
        return out

    def store_by(self, df: DataFrame, key: str) -> DataFrame:
        """A table bucketed by the key, so that joins on it need not deal it out again; ``df`` comes dealt by the key into ``buckets(spark)`` parts."""
        path, name = fresh_path(self.spark, "stored"), f"stored_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets(self.spark), key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)], self.names[id(out)] = path, name
        self.held.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if name := self.names.pop(id(df), None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(id(df)))

    def drop_all(self, *but: DataFrame) -> None:
        for df in [x for x in self.held if id(x) in self.paths and all(x is not y for y in but)]:
            self.drop(df)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def table_after_table(spark: SparkSession, batch_rows: int = 1000) -> Iterator[None]:
    """For operators that write many tables: inside, Spark deletes the shuffle files of a query when it ends, and Arrow batches (of whole sets or texts) are short."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows), _MOST_BYTES: f"{BATCH_BYTES}b"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def short_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most ``BATCH_BYTES`` (Spark's default is 64 MB); so do those of results that are computed later.  Both sides of a Python worker's pipe keep memory for the longest batch that they met."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_MOST_BYTES))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_MOST_BYTES, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int = 5) -> DataFrame:
    """At most ``rows`` labelled documents (text, label long), the first in a hash order of their ids; null labels and ids are left out.  The bound holds for the ids sent to the join and for the rows that come back."""
    picked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("long").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.xxhash64("text"), F.col("label")]
    return found.orderBy(*order).limit(rows).select("text", "label")


def fitted(sample: DataFrame, learn: Callable[[list, list], object]):
    """``learn(first column, second column)`` run in one task over a sample of bounded size; the driver gets the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
        model = learn([x for a, _ in held for x in a], [x for _, b in held for x in b])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # repartition, not coalesce: the scan before it keeps its tasks.
    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else learn([], [])


def int_labels(values: list) -> np.ndarray:
    return np.array(values, np.int64)


def carried(docs: DataFrame, id_col: str, text_col: str, carry: bool, run: Callable, schema: str) -> DataFrame:
    """``run`` over (id, text), and over the whole input row as a struct if it is to come back."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if not carry:
        return docs.select(*cols).mapInArrow(run, schema)
    rows = docs.select(*cols, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(run, f"{schema}, row {docs.schema.simpleString()}")


def with_rows(batch: pa.RecordBatch, lo: int, hi: int, cols: list, names: list[str]) -> pa.RecordBatch:
    """Results of the rows lo to hi of a batch, with the rows themselves where the batch has them."""
    if batch.num_columns > 2:
        cols, names = [*cols, batch.column(2).slice(lo, hi - lo)], [*names, "row"]
    return pa.RecordBatch.from_arrays(cols, names)
