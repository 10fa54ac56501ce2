"""Web-style batches on planted documents against DuckDB, and what they shuffle."""

import duckdb
import pytest

from quarryline.operators import textindex as ti
from quarryline.plans import registry, search


def equal(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, folder).select("query_id", "rank", "id", "score").collect())
    want = sorted(con.execute(registry.ORACLE[name]).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    return got


def test_the_word_or_is_a_term(spark, tmp_path):
    """``or`` as a single term of either kind of query is a term, not what parts alternatives."""
    texts = {0: "x no red fox or", 50: "x no or blue dog", 100: "x no fox red or", 1: "red fox", 2: "red fox or", 3: "or", 4: "blue dog", 5: "dog blue fox red or nox", 6: "fox red or"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = equal(spark, str(tmp_path), "web_batch")
    assert {q: {r[2] for r in found if r[0] == q} for q in (0, 50, 100)} == {0: {0, 2}, 50: {0, 2, 3, 4, 5, 6, 50, 100}, 100: {6, 100}}
    assert {r[0] for r in search.web_queries(spark, str(tmp_path)).collect()} == {0, 50, 100}


def shuffled(spark):
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    jvm, context = sc._jvm, sc._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("analyser", ["simple", "english"])
def test_matches_are_not_shuffled(spark, tmp_path, analyser):
    """Each of the queries is met by every document; only the best of each go from task to task."""
    docs = spark.createDataFrame([(i, f"red fox blue w{i}") for i in range(600)], "doc_id long, text string")
    index = ti.build(docs, str(tmp_path / "index"), analyser)
    queries = spark.createDataFrame([(i, f"red or w{i}") for i in range(300)], "query_id long, text string")
    before = shuffled(spark)
    found = ti.search_web(index, queries, 2).collect()
    assert {(r.query_id, r.id) for r in found if r.rank == 1} == {(i, i) for i in range(300)} and len(found) == 600
    assert shuffled(spark) - before < 300 * 600 / 20


def test_shards_give_the_same(spark, tmp_path, monkeypatch):
    """Many small shards, pieces and pairs that don't fit at once change nothing."""
    words = "red fox blue dog the runs".split()
    docs = spark.createDataFrame([(i * 7 - 50, " ".join(words[(i * j + j * j // 3) % 6] for j in range(i % 23))) for i in range(200)], "doc_id long, text string").repartition(3)
    index = ti.build(docs, str(tmp_path / "index"), block=4)
    queries = spark.createDataFrame([(1, "red fox"), (2, '"red fox" -dog'), (3, 'blue or "the runs"'), (4, "red fox"), (5, "the blue dog"), (None, "red")], "query_id long, text string")
    for rank in ("ts_rank", "bm25"):
        one = sorted(map(tuple, ti.search_web(index, queries, 5, rank).collect()))
        with monkeypatch.context() as m:
            m.setattr(ti, "SHARD", 50)
            m.setattr(ti, "PROGRAMS", 2)
            assert sorted(map(tuple, ti.search_web(index, queries, 5, rank).collect())) == one
        assert {r[0] for r in one} == {1, 2, 3, 4, 5} and [r[1:] for r in one if r[0] == 1] == [r[1:] for r in one if r[0] == 4]
