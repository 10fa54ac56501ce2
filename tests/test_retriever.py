"""Both backends and the retriever, against what they are defined to give."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as tx
from quarryline.operators import evaluation as ev
from quarryline.operators import retriever as rt
from quarryline.operators.committed import Store

TEXTS = {1: "alpha beta", 2: "beta gamma", 3: "delta", 4: "alpha alpha alpha", 5: "epsilon " * 30}


def chunks(spark, texts):
    rows = [(i, i, f"d{i}", 0, t, {"odd": str(i % 2)}) for i, t in texts.items()]
    return spark.createDataFrame(rows, rt.CHUNK.replace(", vector array<double>", "")).withColumn("vector", tx.hash_vector(F.col("text")))


@pytest.fixture(params=["frame", "store"])
def backend(request, spark, tmp_path):
    made = rt.FrameBackend(chunks(spark, {})) if request.param == "frame" else rt.StoreBackend(Store(spark, f"file://{tmp_path}/s", buckets=2))
    made.insert(chunks(spark, TEXTS))
    return made


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def test_backends(spark, backend):
    """What holds for any backend."""
    vectors = asked(spark, *TEXTS.values()).withColumn("vector", tx.hash_vector(F.col("text")))
    best = {r.query_id: r.id for r in backend.dense(vectors, 2).filter("rank = 1").collect()}
    assert best == dict(zip(range(1, 6), TEXTS, strict=True))
    assert {r.id for r in backend.dense(vectors, 5, {"odd": "0"}).collect()} == {2, 4}
    assert [(r.doc_id, r.name, r.chunks) for r in backend.documents(2, 1).collect()] == [(4, "d4", 1), (3, "d3", 1)]
    backend.insert(chunks(spark, {3: "zeta", 9: "eta"}))
    backend.delete(spark.createDataFrame([(1,), (77,)], "doc_id long"))
    assert {r.id: r.text for r in backend.chunks().collect()} == {i: t for i, t in TEXTS.items() if i not in (1, 3)} | {3: "zeta", 9: "eta"}
    found = {r.id for r in backend.hybrid(vectors.filter("query_id = 4"), 3).collect()}
    assert 4 in found and len(found) == 3
    if backend.supports_sparse:
        assert [r.id for r in backend.sparse(asked(spark, "zeta"), 3).collect()] == [3]
    else:
        assert sorted(backend.hybrid(vectors, 3).collect()) == sorted(backend.dense(vectors, 3).collect())
        with pytest.raises(NotImplementedError):
            backend.sparse(vectors, 3)


def test_rewrite_fails_open(spark, backend):
    def model(text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return {"a": "alpha beta", "blank": "  "}.get(text, None)

    r = rt.Retriever(backend, rewrite=rt.fail_open(model))
    assert [x.sought for x in r.searched(asked(spark, "a", "bad", "blank", "other", None)).orderBy("query_id").collect()] == ["alpha beta", "bad", "blank", "other", None]
    assert r.retrieve(asked(spark, "a"), 1, hybrid=False).first().id == 1
    with_null = rt.Retriever(backend, rewrite=lambda c: F.lit(None).cast("string"))
    assert with_null.retrieve(asked(spark, "delta"), 1, hybrid=False).first().id == 3


def test_prompts(spark, backend):
    r = rt.Retriever(backend, rerank=ev.word_overlap, budget=30)
    rows = {x.query_id: x for x in r.prompts(asked(spark, "alpha beta", "epsilon", None), 2, instructions="Be brief.").collect()}
    assert rows[1].context == "[Source 1: d1, chunk 0]\nalpha beta\n\n[Source 2: " + ("d2, chunk 0]\nbeta gamma" if rows[1].citations[1].doc_id == 2 else "d4, chunk 0]\nalpha alpha alpha")
    assert rows[1].prompt == f"Be brief.\n\nContext:\n{rows[1].context}\n\nQuestion: alpha beta\nAnswer:" and rows[1].chunks_sent == 2
    assert rows[2].chunks_sent == 1 and rows[2].citations[0].preview == ("epsilon " * 30)[:150] + "..."  # one chunk, though longer than the budget
    assert (rows[3].context, rows[3].citations, rows[3].chunks_sent) == (rt.EMPTY, [], 0)
    answers = r.ask(asked(spark, "delta"), F.upper).collect()
    assert answers[0].answer == answers[0].prompt.upper()


def test_variants(spark, backend):
    r = rt.Retriever(backend, variants=lambda c: F.array(c, F.lit("delta"), F.lit("alpha beta")))
    got = [x.id for x in r.retrieve(asked(spark, "beta gamma"), 5, hybrid=False).orderBy("rank").collect()]
    assert sorted(got) == [1, 2, 3, 4, 5]
    lists = [[x.id for x in rt.Retriever(backend).retrieve(asked(spark, t), 5, hybrid=False).orderBy("rank").collect()] for t in ("beta gamma", "delta", "alpha beta")]
    score = {i: sum(1 / (61 + ids.index(i)) for ids in lists) for i in TEXTS}
    assert got == sorted(score, key=lambda i: (-round(score[i], 12), i))
