"""The corpus pipeline, stage by stage, on a small table with every odd row."""

import re
import shutil
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import queries, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, words(i), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, words(100 + i) + " filthsome grubbler filthsome", "de", "s1", 1) for i in range(40)]
    rows += [(200, words(3) + " tail", "en", "s0", 1), (3, words(3), "en", "s0", 1), (None, words(4), None, None, None), (201, None, "en", "s1", 0), (202, "", "en", "s1", 0), (203, "too short", "en", None, 1), (204, "again and again and " * 30, "en", "s2", 1), (205, "long " + words(7, 20_000), "en", "s2", 1)]
    docs = spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    docs.withColumns({"page": F.lit("x"), "row": F.lit(1)}).repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, int(i >= 100)) for i in [*range(0, 60, 2), *range(100, 140, 2)]] + [(None, 1, 0), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        after = docs.collect()
        assert docs.columns == list(cp.COLUMNS), name
        texts = Counter((r.doc_id, r.text) for r in after)
        if number == 0:  # null, empty, short and repeating texts go, all others stay
            gone = {201, 202, 203, 204}
            assert texts == Counter((r.doc_id, r.text) for r in before if r.doc_id not in gone)
        elif number == 1:  # toxic texts go, no other does
            assert texts == Counter((r.doc_id, r.text) for r in before if "filthsome" not in r.text)
        elif number == 2:  # one of each group of copies stays: that with the least id, and one of equal rows
            assert texts == Counter((i, words(i)) for i in range(60)) + Counter([(205, "long " + words(7, 20_000))])
        elif number == 3:
            size = {r.doc_id: len(r.text.split()) for r in before}
            taken = Counter()
            for r in after:
                taken[r.doc_id] += len(r.text.split())
                assert r.n_chars == len(r.text)
            assert all(n <= 2 * size[i] for i, n in taken.items())
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 3
    rows = cp.STAGES[-1][1](spark, docs, folder).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = Counter(i for r in docs.collect() for i in [*t.encode(r.text, add_special_tokens=False).ids, 0])
    assert Counter(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()) == want


def test_run_twice(spark, folder):
    one, two = (sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset, bytes(r.ids)) for r in cp.run(spark, folder).collect()) for _ in range(2))
    assert Counter(x[5] for x in one) == Counter(x[5] for x in two) and len(one) > 60


def test_no_rows(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [re.sub(r"\W+", "", n) for n, _ in cp.STAGES] == ["qualityrules", "toxicity", "ngramJaccardjoin", "mixingsourcestotargetweights", "packing"]


def test_workers_keep_no_tokenizer(spark, folder, tmp_path, monkeypatch):
    """The packing stage leaves no encoder in the Python workers, which other stages use after it."""
    path = shutil.copy(queries.tokenizer("byte_bpe_50k.json"), tmp_path / "own.json")
    monkeypatch.setattr(cp.queries, "tokenizer", lambda name: str(path))
    assert cp.packed(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() > 60

    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(path) in tokens._encoders] * b.num_rows)], ["kept"])

    assert {r.kept for r in spark.range(0, 400, 1, 8).mapInArrow(kept, "kept boolean").collect()} == {False}


def test_short_batches(spark, folder):
    """What a stage returns is computed later, and then too no Python worker gets a batch of tens of MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    try:
        for _, stage in [x for x in cp.STAGES if x[1] is not cp.mixed_sources]:
            spark.conf.set(key, before)
            stage(spark, docs.select(*cp.COLUMNS), folder)
            got = spark.range(0, 1000, 1, 1).selectExpr("repeat(md5(CAST(id AS STRING)), 1000) AS text").mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 1000 and max(r.size for r in got) < 5e6
        spark.conf.set(key, "1m")
        cp.quality_rules(spark, docs, folder)
        assert spark.conf.get(key) == "1m"  # shorter ones stay
    finally:
        spark.conf.set(key, before)
