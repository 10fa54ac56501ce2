"""Parsed answers, listings, routing and record keeping: planted cases."""

import json
import re
from difflib import SequenceMatcher

import pytest

from quarryline.operators import chunks, graph, ingest, ledger, memory
from quarryline.sources import connectors, files


def test_open_query_entities(spark):
    asked = {1: 'Tell me about "the  big report" and NASA or NASA-7b by Ada Lovelace, using graph-db and the nasa', 2: None, 3: "  ", 4: 'a "b" on it', 5: "Chaînon für überall émigré", 6: " ".join(f"word{i:02d}" for i in range(20))}
    df = spark.createDataFrame(list(asked.items()), "id int, t string")
    got = {r.id: list(r.names) for r in df.select("id", graph.open_query_entities(df.t).alias("names")).collect()}
    assert got[1] == ["the big report", "NASA", "Tell", "Ada Lovelace", "report", "NASA-7b", "Lovelace", "graph-db"]
    assert got[2] == got[3] == got[4] == got[5] == [] and got[6] == [f"word{i:02d}" for i in range(10)]


def test_answers(spark):
    entity = [{"name": " Ada ", "type": "PERSON"}, {"name": "ADA", "type": "ORG"}, {"name": "", "type": "ORG"}, {"type": "ORG"}, {"name": "X", "type": "Odd"}, {"name": "Y"}, {"name": 7, "type": "ORG"}]
    relation = [
        {"subject": "ada", "relation_type": " knows ", "object": "Bob"}, {"subject": "Ada", "relation_type": "KNOWS", "object": "ADA"},
        {"subject": "Ada", "relation_type": "", "object": "Bob"}, {"subject": "Ada", "relation_type": "R", "object": "Nobody"},
        {"relation_type": "R", "object": "Bob"}, {"subject": "Bob", "relation_type": "likes", "object": "Ada"},
    ]
    good = json.dumps({"entities": entity, "relations": relation})
    rows = [(1, ["Ada", "Bob"], good), (2, ["Ada"], good[:30]), (3, ["Ada"], "[]"), (4, None, None), (5, ["Ada"], '{"entities": []}')]
    df = spark.createDataFrame(rows, "doc_id long, entities array<string>, answer string")
    assert [tuple(r) for r in graph.parsed_entities(df, ("PERSON", "ORG")).orderBy("place").collect()] == [(1, 0, "Ada", "PERSON"), (1, 1, "X", "UNKNOWN"), (1, 2, "Y", "UNKNOWN"), (1, 3, "7", "ORG")]
    assert [r.type for r in graph.parsed_entities(df, most=5).orderBy("place").collect()] == ["PERSON", "Odd"]
    assert sorted(tuple(r) for r in graph.parsed_relations(df).collect()) == [(1, "Bob", "LIKES", "Ada"), (1, "ada", "KNOWS", "Bob")]
    assert {r.doc_id for r in graph.malformed(df, "entities").collect()} == {2, 3, 4}
    assert {r.doc_id for r in graph.malformed(df, "relations").collect()} == {2, 3, 4, 5}


def test_clusters_of_many_names(spark):
    """No name of a long list is left by itself."""
    names = [(1, i % 150, f"Company number {i:04d} {'x' * (i % 7)}") for i in range(200)] + [(1, 500, "company. number 0007"), (1, 501, "COMPANY NUMBER 0199 xxx")]
    got = {r.name: r.canonical for r in graph.deduplicated(spark.createDataFrame(names, "doc_id long, place int, name string")).collect()}
    clusters = []
    for _, _, n in sorted(names):
        key = re.sub(r"\s+", " ", re.sub(r"[.\-_,]", "", n.lower())).strip()
        home = next((c for c in clusters if SequenceMatcher(None, key, c[0]).ratio() >= 0.92), None)
        home[1].append(n) if home else clusters.append((key, [n]))
    assert got == {n: max(c, key=len) for _, c in clusters for n in c}
    with pytest.raises(ValueError):
        graph.deduplicated(spark.createDataFrame(names, "doc_id long, place int, name string"), 0)


def test_manifests(spark):
    sha = "a" * 64
    entries = [("in/a", 5, sha), ("in/a", 6, "b" * 64), ("/abs", 5, sha), ("a/../b", 5, sha), ("a//b", 5, sha), ("a\\b", 5, sha), ("", 5, sha), ("x" * 301, 5, sha), ("n", -1, sha), ("big", 25 * 1024 * 1024 + 1, sha), ("c", 5, "A" * 64), ("d", True, sha), ("e", 1.5, sha), (None, 5, sha), ("f", None, sha), ("g/h", 0, sha)]
    body = {"grant": "one", "files": [{"path": p, "size": s, "sha256": h} for p, s, h in entries]}
    rows = [("one", json.dumps(body)), ("two", json.dumps(body)), ("cut", json.dumps({"grant": "cut", "files": body["files"][:1], "truncated": True})), ("wait", json.dumps({"grant": "wait", "files": body["files"][:1], "pending": 3})), ("none", json.dumps({"grant": "none", "files": []})), ("bad", "{"), ("null", None), ("odd", '{"grant": "odd"}')]
    read = files.manifests(spark.createDataFrame(rows, "grant string, body string"))
    assert {r.grant: (len(r.files), r.invalid, r.complete) for r in read.collect()} == {"one": (3, 13, True), "cut": (1, 0, False), "wait": (1, 0, False), "none": (0, 0, True)}
    held = files.listed(read)
    assert {(r.grant, r.path): (r.size, r.hash[0]) for r in held.collect()} == {("one", "in/a"): (6, "b"), ("one", "g/h"): (0, "a"), ("cut", "in/a"): (5, "a"), ("wait", "in/a"): (5, "a")}
    ingested = spark.createDataFrame([(g, p, "b" * 64) for g in ("one", "cut", "none", "bad") for p in ("in/a", "gone")], "grant string, path string, hash string")
    got = {(r.grant, r.path): r.action for r in chunks.grant_plan(held, read, ingested).collect()}
    assert got == {("one", "in/a"): "keep", ("one", "gone"): "remove", ("one", "g/h"): "add", ("cut", "in/a"): "update", ("cut", "gone"): "keep", ("wait", "in/a"): "add", ("none", "in/a"): "keep", ("none", "gone"): "keep", ("bad", "in/a"): "keep", ("bad", "gone"): "keep"}


def test_routing(spark):
    said = [("web", "What PRICE is it?"), ("web", "hello"), ("mail", "hello"), ("mail", "a campaign and a price"), ("mail", "THIS ISN'T HELPING me"), (None, None)]
    channels = spark.createDataFrame([("mail", "ceo")], "channel string, role string")
    got = [(r.role, r.escalate) for r in ledger.routed(spark.createDataFrame(said, "channel string, text string").coalesce(1), channels).orderBy("channel", "text").collect()]
    assert got == [("support", False), ("ceo", True), ("sales", False), ("ceo", False), ("sales", False), ("support", False)]


def test_knowledge(spark):
    texts = spark.sql("SELECT id AS chunk_id, timestamp_seconds(id div 2) AS created_at, CASE WHEN id % 5 = 0 THEN '' ELSE repeat(id || ' ', 100) END AS text FROM range(40)")
    sources = spark.createDataFrame([("b", True), ("a", True), ("a", True), ("c", False)], "name string, active boolean")
    rows = [(f"h{i}", f"text {i} " + "y" * 200, "short" if i == 3 else None, ["lead"] if i % 2 else ["other"], 0.5 + i / 40) for i in range(20)]
    memories = spark.createDataFrame(rows, "content_hash string, text string, summary string, tags array<string>, importance double").selectExpr("*", "timestamp_seconds(0) AS created_at")
    r = memory.summary(texts, sources, memories, ["lead", "voice"]).first()
    newest = sorted(range(40), key=lambda i: (-(i // 2), i))[:15]
    assert r.recent == "\n---\n".join((f"{i} " * 100)[:200] for i in [i for i in newest if i % 5][:8])
    assert r.sources == "a, b" and r.learned == "\n".join((f"text {i} " + "y" * 200)[:150] for i in (19, 17, 15, 13, 11))
    none = memory.summary(texts.filter("false"), sources.filter("false"), memories.filter("false"), ["lead"]).first()
    assert tuple(none) == ("", "", "")
    full = ledger.capabilities(texts, sources, memories, "lead").first()
    assert full.line == "[Capabilities: 40 knowledge documents, 3 active integrations, 10 learned interaction patterns]"
    one = ledger.capabilities(texts.limit(1), sources.filter("false"), memories.filter("false")).first()
    assert one.line == "[Capabilities: 1 knowledge document]" and ledger.capabilities(texts.filter("false"), sources.filter("false"), memories.filter("false")).first().line == ""


def test_keeping(spark):
    docs = spark.createDataFrame([(1, "a.txt", "open"), (2, "b.txt", "done"), (3, None, "open")], "doc_id long, filename string, status string")
    assert [r.filename for r in chunks.filename(docs, 2).collect()] == ["b.txt"] and chunks.filename(docs, 9).count() == 0
    assert chunks.matching(docs, status=None).count() == 3 and chunks.matching(docs, status="open", filename=None).count() == 2 and chunks.matching(docs, status="open", filename="a.txt").count() == 1
    log = graph.audit("u", "n", "list", docs, "2024-01-02").first()
    assert (log.user_id, log.namespace, log.action, log.n, str(log["at"])) == ("u", "n", "list", 3, "2024-01-02 00:00:00")
    due = spark.sql("SELECT * FROM VALUES (1, true, NULL, 5), (2, true, timestamp'2024-01-01 00:00:00', NULL), (3, true, timestamp'2024-01-01 00:01:00', 0), (4, false, NULL, 5), (5, true, timestamp'2024-01-01 05:55:00', 5) AS s(id, active, last_sync, interval_min)")
    assert {r.id for r in ledger.sync_due(due, "2024-01-01 06:00:00").collect()} == {1, 2, 5}
    keys = spark.createDataFrame([("t", "a"), ("t", "a"), ("other", "b")], "table string, column string")
    shown = connectors.described(spark, {"t": spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), "api_keys": docs}, keys).orderBy("column").collect()
    assert [(r.column, r.nullable, r.is_key) for r in shown] == [("a", False, True), ("b", True, False)]


def test_required_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS desk_test")
    try:
        for _ in range(2):
            connectors.required_tables(spark, 8, "desk_test")
        assert {r.tableName for r in spark.sql("SHOW TABLES IN desk_test").collect()} == {"documents", "chunks", "embeddings"}
        spark.sql("INSERT INTO desk_test.chunks VALUES ('c', 'd', 0, 't', NULL)")
        connectors.required_tables(spark, 8, "desk_test")
        assert spark.table("desk_test.chunks").count() == 1
    finally:
        spark.sql("DROP DATABASE desk_test CASCADE")


def test_plug_ins(spark):
    """Kinds without a library here go to what the caller gives; without one they are an error of that file alone."""
    rows = spark.createDataFrame([("a.pdf", b"%PDF one"), ("b.PNG", b"two"), ("c.txt", b"three"), ("d.mp3", b"four")], "path string, content binary")
    made = files.read_texts(rows, plug_ins={"pdf": lambda raw: raw.decode()[5:] + "\n\nend", "png": lambda raw: raw.decode().upper()})
    got = {r.path: r.text for r in made.collect()}
    assert got["a.pdf"] == "one\n\nend" and got["b.PNG"] == "TWO" and got["c.txt"] == "three" and not got["d.mp3"]


def test_vector_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, vector array<double>")
    cases = [(rows, 2, ("mismatch", 2)), (rows.filter("id = 1"), 2, ("ok", 2)), (rows.filter("id = 1"), 3, ("mismatch", 2)), (rows.filter("id > 3"), 3, ("adjusted", None)), (rows, 0, ("invalid", 2)), (rows, 16_001, ("invalid", 2))]
    for df, wanted, state in cases:
        assert tuple(ingest.vector_dimensions(df, wanted).first()) == state
