"""What the graph queries write and read on their way, and the network by its nodes."""

from pyspark.sql import functions as F

from quarryline.operators import graph as gr
from quarryline.operators import graphsearch as gs
from quarryline.operators.committed import Store
from quarryline.plans import graphs

DATA = "/root/testdata/sf0.001"


def test_the_graph_holds_no_texts(spark):
    """A store of the graph alone is what the graph queries read: it has entities and pairs of all documents."""
    store = graphs.document_graph(spark, DATA)
    assert {*store.manifest(store.version())["tables"]} == {"contains", "pairs"} and store.version() == 2


def test_network_by_nodes(spark):
    contained = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "doc:1")], "doc_id long, entity string")
    pairs = spark.createDataFrame([(1, "a", "b", 2), (2, "a", "b", -2), (1, "b", "c", 1), (2, "b", "c", 1), (3, "c", "doc:1", 1)], "doc_id long, a string, b string, weight long")
    net, rows = gr.network(contained, gr.edges(pairs)), gs.around(contained, pairs)
    for nodes in (["a"], ["b", "doc:1"], ["c", "doc:2", "none"], [], ["doc:1", "doc:2", "doc:3", "a", "b", "c"]):
        some = spark.createDataFrame([(n,) for n in nodes], "x string")
        want = sorted(map(tuple, net.filter(F.col("x").isin(nodes) if nodes else F.lit(False)).collect()))
        assert sorted(map(tuple, rows(some).collect())) == want


def test_enough(spark):
    """With enough ends a query goes no further, and its first ones are the same."""
    contained = spark.createDataFrame([(d, e) for d in range(6) for e in ("a", "b", f"e{d}")] + [(9, "z"), (9, "y")], "doc_id long, entity string")
    pairs = spark.createDataFrame([(d, "a", e, 1) for d in range(6) for e in ("b", f"e{d}")] + [(9, "y", "z", 1)], "doc_id long, a string, b string, weight long")
    asked = spark.createDataFrame([(1, "a"), (2, "z"), (3, "none"), (4, "e1")], "query_id long, entity string")
    every = gs.related(gr.network(contained, gr.edges(pairs)), asked, 3)
    for n in (1, 3, 7, 100):
        some = gs.related(gs.around(contained, pairs), asked, 3, enough=n)
        assert sorted(map(tuple, gs.nearest(some, n).collect())) == sorted(map(tuple, gs.nearest(every, n).collect()))
    far = {r.query_id for r in gs.related(gs.around(contained, pairs), asked, 3, enough=3).filter("depth = 2").collect()}
    assert far == {2, 4}


def test_names_are_found_once(spark, tmp_path, monkeypatch):
    """Both tables of a commit are made of names that are written down, not of texts."""
    seen, commit = [], Store.commit

    def looked(self, changes, ids, expect=None):
        seen.extend(changes[n]._jdf.queryExecution().executedPlan().toString() for n in ("contains", "pairs"))
        return commit(self, changes, ids, expect)

    monkeypatch.setattr(Store, "commit", looked)
    store = Store(spark, str(tmp_path / "graph"))
    gs.write(store, spark.createDataFrame([(1, "Acme Corp met Hooli Group in Berlin.")], "doc_id long, text string"))
    assert len(seen) == 2 and not any("regexp_extract_all" in plan for plan in seen)
    assert store.read("contains").count() == 3 == store.read("pairs").count() and store.read("chunks").count() == 1


def test_documents_need_no_walk(spark, monkeypatch):
    """Documents of a passage's entities are found without a step through the network."""

    def walked(*a, **b):
        raise AssertionError("a walk")

    monkeypatch.setattr(gs, "related", walked)
    rows = graphs.graph_retrieve(spark, DATA).collect()
    assert rows and {r.mode for r in rows} == {"hybrid_vector_graph"}
