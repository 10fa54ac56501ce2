"""Committed tables and batched graph queries against brute force."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph as gr
from quarryline.operators import graphsearch as gs
from quarryline.operators.committed import Conflict, Store

ROWS = [(i, f"Acme Corp met Globex Industries in Berlin {'and ' + chr(65 + i % 5) * 3 if i % 2 else ''}. Then {'Angela Merkel' if i % 3 else 'IBM-360'} left.") for i in range(20)] + [(20, None), (21, "")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def held(store, name, version=None):
    return sorted(map(str, store.read(name, version).collect()))


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    assert store.version() == 0
    assert gs.write(store, table(spark, ROWS)) == 1
    first = {n: held(store, n) for n in ("chunks", "contains", "pairs")}
    assert all(first.values()) and "language" in store.read("chunks").columns
    # A second write of any documents changes nothing.
    gs.write(store, table(spark, ROWS[3:9]))
    assert {n: held(store, n) for n in first} == first and store.version() == 2
    # Other contents replace the old; a reader of a version keeps it.
    reader = store.read("contains")
    gs.write(store, table(spark, [(3, "Initech Labs sued Hooli Group."), (99, "Hooli Group won.")]))
    assert sorted(map(str, reader.collect())) == held(store, "contains", 1) == first["contains"]
    names = {(r.doc_id, r.entity) for r in store.read("contains").collect()}
    assert {e for d, e in names if d == 3} == {"initech labs", "hooli group"} and (99, "hooli group") in names
    gs.erase(store, table(spark, [(99, ""), (3, ""), (12345, "")]))
    assert {r.doc_id for r in store.read("pairs").collect()} == set(range(20)) - {3}
    store.expire(1)
    assert {r.doc_id for r in store.read("pairs").collect()} == set(range(20)) - {3} and store.read("chunks").count() == 19
    with pytest.raises(KeyError):
        store.read("nothing")


def test_committed_ingest(spark, tmp_path, monkeypatch):
    from quarryline.operators import ingest, language

    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    known = spark.createDataFrame([("en", "Acme Corp met the other side of the thing and left. " * 3), ("de", "Die andere Sache und das Ding in Berlin für Siemens. " * 3)], "lang string, text string")
    calls = spark.sparkContext.accumulator(0)

    def embed(text):
        @F.udf("array<double>")
        def one(x):
            calls.add(1)
            return None if "unembeddable" in x else [1.0, float(len(x))]

        return one(text)

    rows = [(1, "a", "Acme Corp met the other side of Globex Industries."), (2, "b", "Die andere Sache für Siemens und das Ding."), (3, "c", " "), (4, "d", "unembeddable thing"), (5, "e", "x" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, filename string, text string")
    profile = language.profiles(known)
    assert ingest.commit(store, docs, embed=embed, profile=profile) == 1
    assert {r.doc_id: (r.success, r.chunks, r.error) for r in store.read("documents").collect()} == {1: (True, 1, None), 2: (True, 1, None), 3: (False, 0, "no text"), 4: (False, 0, "no chunk could be embedded"), 5: (False, 0, "longer than 50000 characters")}
    assert {r.doc_id: r.language for r in store.read("chunks").collect()} == {1: "en", 2: "de"} and not store._names("staged")
    assert {r.entity for r in store.read("contains").collect() if r.doc_id == 1} == {"acme corp", "globex industries"}
    names = ("documents", "chunks", "contains", "pairs")
    first = {n: held(store, n) for n in names}
    ingest.commit(store, docs.filter("doc_id <= 2"), embed=embed, profile=profile)
    assert {n: held(store, n) for n in names} == first
    # A write that breaks changes none of the four and leaves nothing staged.
    worse = spark.createDataFrame([(1, "a", "  "), (2, "b", "Hooli Group met IBM-360.")], docs.schema)
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest.commit(store, worse, embed=embed, profile=profile)
    assert {n: held(store, n) for n in names} == first and not store._names("staged")
    # A document that fails now loses its chunks and its part of the graph at once.
    ingest.commit(store, worse, embed=embed)
    assert {r.doc_id for r in store.read("chunks").collect()} == {r.doc_id for r in store.read("contains").collect()} == {2}
    assert {r.entity for r in store.read("contains").collect()} == {"hooli group", "ibm-360"} and store.read("documents").count() == 5
    assert calls.value <= 2 * 8  # each chunk of a commit once or, where a filter asks for the vector too, twice


def test_broken_write(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    store.commit({"a": table(spark, ROWS[:5]), "b": table(spark, ROWS[:2])}, table(spark, ROWS[:5]))
    before = held(store, "a"), held(store, "b")
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit({"a": table(spark, [(1, "new")])}, table(spark, [(1, "")]))
    assert (held(store, "a"), held(store, "b")) == before and store.version() == 1
    store.commit({"a": table(spark, [(1, "new")])}, table(spark, [(1, "")]))
    assert {r.doc_id for r in store.read("b").collect()} == {0} and "new" in str(held(store, "a"))


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, f"file://{tmp_path}/s", buckets=4) for _ in range(2))
    one.commit({"a": table(spark, [(1, "x"), (2, "x")])}, table(spark, [(1, ""), (2, "")]))
    publish, late = Store._publish, []

    def overtaken(self, version, manifest):
        if self is one and not late:
            late.append(version)
            two.commit({"a": table(spark, [(2, "two"), (3, "two")])}, table(spark, [(2, ""), (3, "")]))
        return publish(self, version, manifest)

    monkeypatch.setattr(Store, "_publish", overtaken)
    assert one.commit({"a": table(spark, [(1, "one")])}, table(spark, [(1, "")])) == 3 and late == [2]
    assert sorted(map(tuple, two.read("a").collect())) == [(1, "one"), (2, "two"), (3, "two")]
    # The version is there when it is looked for, and when it is not yet.
    assert not publish(one, 3, {"tables": {}, "schemas": {}})
    monkeypatch.setattr(Store, "_publish", lambda *a: False)
    with pytest.raises(Conflict):
        one.commit({}, table(spark, [(1, "")]))


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e"), ("b", "d"), ("e", "f")]


@pytest.mark.parametrize("hub", [2, 10_000])
def test_related(spark, hub):
    contained = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "f"), (2, "g")], "doc_id long, entity string")
    net = gr.network(contained, spark.createDataFrame(EDGES, "a string, b string"))
    both = [(r.x, r.y, r.type, r.edge) for r in net.collect()]
    asked = [(1, "a"), (2, "e"), (2, "g"), (3, "none")]
    want, walks = {}, [(q, e, None, ()) for q, e in asked]
    for d in range(1, 5):
        walks = [(q, y, first or kind, (*path, edge)) for q, at, first, path in walks for x, y, kind, edge in both if x == at and edge not in path]
        want[d] = want.get(d - 1, set()) | {(q, x, first, d) for q, x, first, _ in walks if not x.startswith("doc:")}
    for depth in (1, 2, 4):
        got = gs.related(net, spark.createDataFrame(asked, "query_id long, entity string"), depth, hub).collect()
        assert {tuple(r) for r in got} == want[depth] and len(got) == len(want[depth])
    with pytest.raises(ValueError):
        gs.related(net, spark.createDataFrame(asked, "query_id long, entity string"), 11)


def test_retrieved(spark):
    contained = spark.createDataFrame([(d, e, e.title(), w) for d, e, w in [(1, "acme corp", 2), (2, "acme corp", 5), (2, "berlin", 1), (3, "hooli group", 1), (4, "berlin", 9)]], "doc_id long, entity string, name string, weight long")
    net = gr.network(contained, spark.createDataFrame([("acme corp", "berlin"), ("berlin", "hooli group")], "a string, b string"))
    queries = spark.createDataFrame([(7, "Has Acme Corp left Berlin"), (8, "nobody"), (9, None)], "query_id long, text string")
    hits = spark.createDataFrame([(7, 1, 4, "p"), (8, 1, 1, None)], "query_id long, rank int, id long, preview string")
    found, cited = gs.retrieved(contained, net, queries, hits, 2, 2)
    # Entities of query 7: "Has Acme Corp" is one name, so only berlin is known.
    assert sorted((r.query_id, r.doc_id, r.matched, r.score, r.place, r.already_found, r.mode) for r in found.collect()) == [(7, 2, 1, 1, 2, False, "hybrid_vector_graph"), (7, 4, 1, 9, 1, True, "hybrid_vector_graph")]
    rows = sorted((r.query_id, r.kind, r.number, r.doc_id, r.entity, r.depth) for r in cited.collect())
    assert rows == [(7, "chunk", 1, 4, None, None), (7, "graph_path", 1, None, "acme corp", 1), (7, "graph_path", 2, None, "hooli group", 1), (8, "chunk", 1, 1, None, None)]
    alone, paths = gs.retrieved(contained, net, queries, None, 1, 5)
    assert {r.mode for r in alone.collect()} == {"graph_only"} and paths.filter("kind = 'chunk'").count() == 0
    assert gs.entities_of(queries.filter("query_id > 7")).count() == 0
    assert gs.documents(contained, gs.entities_of(queries)).filter(F.col("query_id") > 7).count() == 0
