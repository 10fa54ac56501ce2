"""Queries over corpora and stores: ingest, graph, memory, evaluation, speech, sources, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calculator, rules, speech, tools
from ..operators import chunks as ck
from ..operators import evaluation as ev
from ..operators import graph as gr
from ..operators import ingest as ing
from ..operators import language as la
from ..operators import ledger as le
from ..operators import memory as me
from ..operators import vectors as ve
from ..session import table
from ..sources import connectors as cn
from ..sources import files as fi
from ..sources import markup
from ..streaming import state as st
from .catalog import _CHUNK
from .registry import both, query

# Graph over the chunks of documents

#: Entities of each chunk in order, as SQL.  Letters beyond ASCII count as word characters, as they do for Unicode-aware word boundaries.
_ENTITIES = (
    _CHUNK
    + r""", p AS (SELECT doc_id, chunk_index, regexp_replace(regexp_replace(regexp_replace(text, '\p{Z}', ' ', 'g'), '[^\x00-\x7F\p{L}\p{M}\p{N}]', '.', 'g'), '[^\x00-\x7F]', '_', 'g') AS t FROM chunks),
found AS (SELECT doc_id, chunk_index, list_concat(regexp_extract_all(t, '\b[A-Z]{2,}(?:-[A-Z0-9]+)?\b'), list_filter(regexp_extract_all(t, '\b(?:[A-Z][a-z]{2,})(?:\s+[A-Z][a-z]{2,}){0,2}\b'), lambda x: NOT list_contains(["""
    + ", ".join(f"'{w}'" for w in gr.SENTENCE_WORDS)
    + r"""], x))) AS n FROM p),
each AS (SELECT doc_id, chunk_index, unnest(n) AS name, generate_subscripts(n, 1) AS i FROM found),
firsts AS (SELECT doc_id, chunk_index, lower(name) AS entity, min(i) AS i, arg_min(name, i) AS name FROM each WHERE length(name) >= 3 GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY i) AS place FROM firsts) WHERE place <= 12),
c1 AS (SELECT doc_id, name, entity, count(*) AS weight, min(chunk_index * 100 + place) AS first FROM m GROUP BY ALL),
c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) AS r FROM c1),
contained AS (SELECT doc_id, entity, arg_min(name, r) AS name, arg_max(weight, r) AS weight FROM c2 WHERE r <= 80 GROUP BY ALL),
p1 AS (SELECT a.doc_id, a.entity AS a, b.entity AS b, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND a.entity < b.entity GROUP BY ALL),
pairs AS (SELECT doc_id, a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, a, b) AS r FROM p1) WHERE r <= 150),
edges AS (SELECT a, b, sum(weight)::BIGINT AS weight, count(*) AS docs FROM pairs GROUP BY ALL) """
)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.chunk_entities(ck.chunk(table(spark, sf_dir, "documents")))


@query(_ENTITIES + "SELECT doc_id, chunk_index, string_agg(name, '|' ORDER BY place) AS entities FROM m GROUP BY ALL")
def entity_extract(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "chunk_index", F.array_join("names", "|").alias("entities"))


@query(_ENTITIES + "SELECT entity, count(*) AS docs, sum(weight)::BIGINT AS weight FROM contained GROUP BY entity")
def entity_counts(spark, sf_dir):
    return gr.contains(_found(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("docs"), F.sum("weight").alias("weight"))


@query(_ENTITIES + "SELECT * FROM pairs")
def pair_cooccurrence(spark, sf_dir):
    return gr.pairs(_found(spark, sf_dir))


@query(_ENTITIES + "SELECT * FROM edges")
def edge_weights(spark, sf_dir):
    return gr.edges(gr.pairs(_found(spark, sf_dir)))


@query(_ENTITIES + "SELECT count(*) AS edges, sum(weight)::BIGINT AS weight FROM edges")
def graph_upsert(spark, sf_dir):
    """Writing half of the documents a second time changes nothing."""
    old = gr.pairs(_found(spark, sf_dir))
    again = gr.pairs(gr.chunk_entities(ck.chunk(table(spark, sf_dir, "documents").filter("doc_id % 2 = 0"))))
    return gr.edges(gr.replaced(old, again)).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query(_ENTITIES + ", kept AS (SELECT * FROM contained WHERE doc_id % 3 <> 0) SELECT entity, count(*) AS docs, bool_or(doc_id < 0) AS orphan FROM kept GROUP BY entity UNION ALL SELECT DISTINCT entity, 0, true FROM contained WHERE entity NOT IN (SELECT entity FROM kept)")
def document_graph_delete(spark, sf_dir):
    c = gr.contains(_found(spark, sf_dir))
    gone = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id")
    left = gr.without(c, gone).groupBy("entity").agg(F.count("*").alias("docs")).withColumn("orphan", F.lit(False))
    return left.unionByName(gr.orphans(c, gone).withColumns({"docs": F.lit(0).cast("long"), "orphan": F.lit(True)}))


#: The commonest names, to ask for.
_TOP = "(SELECT entity FROM contained GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 3)"


def _asked(c: DataFrame) -> list[str]:
    return [r[0] for r in c.groupBy("entity").count().orderBy(F.desc("count"), "entity").limit(3).collect()]


@query(_ENTITIES + f"SELECT doc_id, count(DISTINCT entity) AS matched, sum(weight)::BIGINT AS score, string_agg(DISTINCT entity, ',' ORDER BY entity) AS names FROM contained WHERE entity IN {_TOP} GROUP BY doc_id ORDER BY matched DESC, score DESC, doc_id LIMIT 25")
def docs_by_entities(spark, sf_dir):
    c = gr.contains(_found(spark, sf_dir))
    return gr.documents_by_entities(c, _asked(c))


_NET = r""", e1 AS (SELECT 'doc:' || doc_id AS x, entity AS y, 'CONTAINS' AS type FROM contained UNION ALL SELECT a, b, 'RELATED_TO' FROM edges),
net AS (SELECT x, y, type, x || '~' || type || '~' || y AS edge FROM e1 UNION ALL SELECT y, x, type, x || '~' || type || '~' || y FROM e1),
one AS (SELECT DISTINCT net.y AS x, type AS first_type, edge FROM net WHERE net.x = {start}),
two AS (SELECT DISTINCT net.y AS x, first_type FROM one JOIN net ON one.x = net.x AND one.edge <> net.edge),
reached AS (SELECT DISTINCT x AS entity, first_type, 1 AS depth FROM one UNION ALL SELECT x, first_type, 2 FROM two) """
_START = "(SELECT entity FROM contained GROUP BY entity ORDER BY count(*), entity DESC LIMIT 1)"


def _rare(c: DataFrame) -> list[str]:
    return [r[0] for r in c.groupBy("entity").count().orderBy("count", F.desc("entity")).limit(1).collect()]


@query(_ENTITIES + _NET.format(start=_START) + "SELECT entity, first_type, depth FROM reached WHERE NOT starts_with(entity, 'doc:')")
def related_entities(spark, sf_dir):
    f = _found(spark, sf_dir)
    c = gr.contains(f)
    return gr.related(gr.network(c, gr.edges(gr.pairs(f))), _rare(c), 2)


@query(_ENTITIES + ", t AS (SELECT a, b FROM edges ORDER BY weight DESC, a, b LIMIT 1) SELECT p.doc_id, 'RELATED_TO' AS kind, p.a AS subject, p.b AS object, p.weight::DOUBLE AS weight FROM pairs p JOIN t ON p.a = t.a AND p.b = t.b UNION ALL SELECT p.doc_id, 'SEEN_WITH', p.b, p.a, 0.5::DOUBLE FROM pairs p JOIN t ON p.a = t.a AND p.b = t.b WHERE p.doc_id % 2 = 0")
def entity_lineage(spark, sf_dir):
    p = gr.pairs(_found(spark, sf_dir))
    a, b = gr.edges(p).orderBy(F.desc("weight"), "a", "b").select("a", "b").first()
    rel = p.filter("doc_id % 2 = 0").select("doc_id", F.col("b").alias("subject"), F.lit("seen_with").alias("type"), F.col("a").alias("object"), F.lit(0.5).alias("weight"))
    return gr.lineage(p, rel, b, a.upper())


@query(_ENTITIES + "SELECT entity, name, weight FROM contained WHERE doc_id = 7 ORDER BY weight DESC, entity LIMIT 50")
def document_entities(spark, sf_dir):
    return gr.document_entities(gr.contains(_found(spark, sf_dir)), 7)


#: Relations of orders: customers place orders of a priority.
_REL = "WITH c AS (SELECT o_orderkey AS doc_id, 'Customer ' || o_custkey AS subject, 'placed' AS type, o_orderpriority AS object, 1.0::DOUBLE AS weight FROM orders), r AS (SELECT lower(subject) AS subject, upper(type) AS type, lower(object) AS object, sum(weight) AS weight FROM c GROUP BY ALL) "


def _relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Customer "), "o_custkey").alias("subject"), F.lit("placed").alias("type"), F.col("o_orderpriority").alias("object"), F.lit(1.0).alias("weight"))


@query(_REL + "SELECT * FROM r WHERE object = '1-urgent' AND type = 'PLACED' ORDER BY weight DESC, subject, type, object LIMIT 50")
def find_relations(spark, sf_dir):
    return gr.find_relations(gr.relations(_relations(spark, sf_dir)), "1-URGENT", "incoming", "placed")


@query("SELECT DISTINCT lower('Customer ' || o_custkey) AS entity FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) = 'F')")
def entities_by_type(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer "), "o_custkey").alias("entity"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("seq"))
    return gr.entities_by_type(gr.typed(rows), "f")


@query("WITH t AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) SELECT o_orderkey AS doc_id, 'Customer ' || o.o_custkey AS subject, 'placed' AS type, o_orderpriority AS object, 1.0::DOUBLE AS weight FROM orders o JOIN t USING (o_custkey) WHERE status = 'F' AND o_orderpriority LIKE '1%'")
def ontology_filter(spark, sf_dir):
    types = gr.typed(table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer "), "o_custkey").alias("entity"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("seq")))
    levels = table(spark, sf_dir, "orders").select(F.lower("o_orderpriority").alias("entity"), F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("type")).distinct()
    known = spark.createDataFrame([("placed", "F", "P1"), ("returned", "O", "P5")], "type string, subject_type string, object_type string")
    return gr.by_ontology(_relations(spark, sf_dir), types.union(levels), known)


@query()
def entity_dedup(spark, sf_dir):
    m = gr.mentions(_found(spark, sf_dir))
    names = m.groupBy("doc_id", "name").agg(F.min(F.col("chunk_index") * 100 + F.col("place")).alias("place"))
    return gr.deduplicated(names)


# Ingest

_BASE = "WITH d AS (SELECT doc_id, doc_id || '.txt' AS filename, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g') AS text FROM documents), n AS (SELECT doc_id, filename, len(list_filter(regexp_split_to_array(text, '[\\s]+'), lambda x: x <> '')) AS w, length(text) AS l, contains(text, 'idiot') AS bad FROM d) "
_WHY = "CASE WHEN l > 50000 THEN 'longer than 50000 characters' WHEN bad THEN 'not wanted' WHEN w = 0 THEN 'no text' END"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.coalesce("text", F.lit("")).alias("text"))


@query(_BASE + f"SELECT doc_id, filename, {_WHY} IS NULL AS success, CASE WHEN {_WHY} IS NOT NULL THEN 0 WHEN w <= 512 THEN 1 ELSE 1 + ceil((w - 512) / 462.0)::BIGINT END AS chunks, {_WHY} AS error FROM n")
def ingest_outcomes(spark, sf_dir):
    return ing.ingest(_documents(spark, sf_dir), [ing.length_guard(), ing.pattern_guard("idiot", "not wanted")])[0]


@query("SELECT doc_id, text, reason FROM (SELECT doc_id, CASE WHEN contains(text, 'idiot') THEN text ELSE regexp_replace(text, '[0-9]{4,}', '#', 'g') END AS text, CASE WHEN contains(text, 'idiot') THEN 'not wanted' END AS reason FROM documents)")
def guardrails(spark, sf_dir):
    return ing.guarded(table(spark, sf_dir, "documents").select("doc_id", "text"), [ing.pattern_guard("idiot", "not wanted"), ing.redacting_guard("[0-9]{4,}", "#")])


@query(_CHUNK + "SELECT g.doc_id, g.doc_id IN (SELECT doc_id FROM documents) AS existed, (SELECT count(*) FROM chunks WHERE doc_id % 4 <> 0) AS chunks_left FROM (SELECT doc_id FROM documents WHERE doc_id % 4 = 0 UNION SELECT -1) g")
def delete_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gone = docs.filter("doc_id % 4 = 0").select("doc_id").union(spark.createDataFrame([(-1,)], "doc_id long"))
    _, left, existed = ing.deleted(docs, ck.chunk(docs), gone)
    return existed.join(F.broadcast(left.agg(F.count("*").alias("chunks_left"))))


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id % 2 = 1")
def metadata_containment(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.to_json(F.struct(F.col("lang").alias("lang"), F.struct((F.col("doc_id") % 2 == 1).alias("odd"), F.col("source").alias("source")).alias("of")))
    return ck.containing(d.select("doc_id", meta.alias("metadata")), {"lang": "de", "of": {"odd": True}}).select("doc_id")


# Memory over conversations: tenant by conversation, subject the conversation, agent the role

_ENTRIES = "WITH entries AS (SELECT conv_id || '-' || turn AS id, 't' || conv_id % 3 AS tenant, 'c' || conv_id AS subject, role AS agent, text, CASE WHEN role = 'system' THEN 'fact' ELSE 'note' END AS kind, CASE role WHEN 'user' THEN 'owner' WHEN 'assistant' THEN 'model' ELSE 'untrusted' END AS trust, TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER) AS created_at, CASE WHEN turn % 5 = 3 THEN TIMESTAMP '2024-01-02' END AS expires_at FROM conversations), seen AS (SELECT * FROM entries WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-01') "
_NOW = "2024-06-01 00:00:00"


def _entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_micros(F.lit(1704067200000000) + (F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000000)
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("t"), F.col("conv_id") % 3).alias("tenant"), F.concat(F.lit("c"), "conv_id").alias("subject"), F.col("role").alias("agent"), F.lit(None).cast("string").alias("session"),
        "text", F.when(F.col("role") == "system", "fact").otherwise("note").alias("kind"), F.lit("chat").alias("source"), F.when(F.col("role") == "user", "owner").when(F.col("role") == "assistant", "model").otherwise("untrusted").alias("trust"),
        F.lit(0.5).alias("importance"), at.alias("created_at"), F.when(F.col("turn") % 5 == 3, F.lit("2024-01-02").cast("timestamp")).alias("expires_at"), F.lit(None).cast("string").alias("superseded_by"), F.array().cast("array<string>").alias("derived_from"), F.array("role").alias("tags"),
    )


@query(_ENTRIES + "SELECT count(*) AS n FROM seen WHERE tenant = 't1' AND agent = 'user'")
def memory_scope(spark, sf_dir):
    return me.count(_entries(spark, sf_dir), {"tenant": "t1", "agent": "user"}, _NOW)


@query(_ENTRIES + r""", t AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM entries), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
h AS (SELECT id, len(t) AS l, unnest(t) AS term FROM t), f AS (SELECT id, term, l, count(*) AS tf FROM h WHERE term IN ('the', 'and', 'with') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
b AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM f JOIN d USING (term), s GROUP BY id)
SELECT rank, id, round(score, 4) AS score FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, created_at DESC, id)::INTEGER AS rank FROM b JOIN seen USING (id) WHERE tenant = 't0' AND kind = 'note' AND trust IN ('model', 'owner')) WHERE rank <= 20""")
def memory_search(spark, sf_dir):
    return me.search(_entries(spark, sf_dir), "The and WITH", {"tenant": "t0"}, _NOW, ("note",), "model", 20)


_NEXT = "(SELECT conv_id || '-' || turn AS old_id, conv_id || '-' || turn || '+' AS id FROM conversations WHERE turn = 0)"


@query(_ENTRIES + f"SELECT e.id, e.tenant, e.subject, n.id AS superseded_by, e.text FROM entries e LEFT JOIN {_NEXT} n ON e.id = n.old_id UNION ALL SELECT n.id, e.tenant, e.subject, NULL, 'revised' FROM entries e JOIN {_NEXT} n ON e.id = n.old_id")
def memory_supersede(spark, sf_dir):
    e = _entries(spark, sf_dir)
    new = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.concat_ws("-", "conv_id", "turn").alias("old_id"), F.concat(F.concat_ws("-", "conv_id", "turn"), F.lit("+")).alias("id"), F.lit("revised").alias("text"), F.lit(_NOW).cast("timestamp").alias("created_at"))
    late = new.withColumns({"id": F.concat("id", F.lit("+")), "created_at": F.lit("2024-07-01").cast("timestamp")})
    return me.supersede(e, new.union(late)).select("id", "tenant", "subject", "superseded_by", "text")


@query(_ENTRIES + "SELECT id FROM seen")
def memory_sweep(spark, sf_dir):
    return me.sweep(_entries(spark, sf_dir), _NOW).select("id")


@query(_ENTRIES + "SELECT id FROM entries WHERE NOT (tenant = 't2' AND agent = 'assistant' AND ends_with(id, '-1'))")
def memory_forget(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return me.forget(e, e.filter("id LIKE '%-1'").select("id"), {"tenant": "t2", "agent": "assistant"}).select("id")


@query(_ENTRIES + "SELECT id FROM entries WHERE tenant <> 't1'")
def memory_erase(spark, sf_dir):
    return me.erase(_entries(spark, sf_dir), {"tenant": "t1"}).select("id")


@query(_ENTRIES + "SELECT id, created_at, md5(text) AS text_md5 FROM seen WHERE tenant = 't2' AND agent = 'user'")
def memory_export(spark, sf_dir):
    return me.export(_entries(spark, sf_dir), {"tenant": "t2", "agent": "user"}, _NOW).select("id", "created_at", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_ENTRIES + "SELECT id FROM seen UNION ALL SELECT id || '*' FROM seen WHERE ends_with(id, '-2') AND agent = 'user' AND length(trim(text)) > 0")
def memory_add(spark, sf_dir):
    """New notes derived from a visible entry come in; those derived from another tenant's, of an unknown kind or without text don't."""
    old = me.sweep(_entries(spark, sf_dir), _NOW)
    new = old.filter("id LIKE '%-2' AND agent = 'user'").withColumns({"derived_from": F.array("id"), "id": F.concat("id", F.lit("*")), "expires_at": F.lit(None).cast("timestamp")})
    other = new.withColumns({"id": F.concat("id", F.lit("x")), "tenant": F.lit("elsewhere")})
    odd = new.withColumns({"id": F.concat("id", F.lit("y")), "kind": F.lit("rumour")})
    return me.add(old, new.union(other).union(odd), ("note", "fact"), _NOW).select("id")


both("memory_scope_key", "conversations", "SELECT conv_id, turn, concat('tenant=t', conv_id % 3, '/subject=c', conv_id, '/agent=', role) AS key FROM {conversations}")


@query("SELECT conv_id, turn, 'tenant=t' || conv_id % 3 || '/subject=c' || conv_id || '/agent=' || role AS key, 'c' || conv_id AS subject FROM conversations")
def memory_scope_parse(spark, sf_dir):
    rows = _entries(spark, sf_dir).select(F.split_part("id", F.lit("-"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("id", F.lit("-"), F.lit(2)).cast("long").alias("turn"), me.scope_key().alias("key"))
    return rows.withColumn("subject", me.parse_scope(F.col("key"))["subject"])


_LEARNED = "WITH l AS (SELECT substr(md5(substr(text, 1, 200)), 1, 8) AS content_hash, source, doc_id, text, n_chars % 10 / 10.0::DOUBLE AS i, doc_id % 4 = 0 AS p FROM documents WHERE length(trim(text)) >= 10), m AS (SELECT content_hash, source, arg_min(CASE WHEN p THEN greatest(i, 0.95::DOUBLE) ELSE i END, doc_id) AS importance, arg_min(p OR i >= 0.95, doc_id) AS permanent, min(doc_id) AS seq FROM l GROUP BY content_hash, source) "


def _memories(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return me.learned(d.select(F.col("doc_id").alias("seq"), "text", F.array("lang").alias("tags"), (F.col("n_chars") % 10 / 10.0).alias("importance"), "source", (F.col("doc_id") % 4 == 0).alias("permanent")))


@query(_LEARNED + "SELECT content_hash, source, importance, permanent FROM m")
def learned_memory(spark, sf_dir):
    return _memories(spark, sf_dir).select("content_hash", "source", "importance", "permanent")


@query(_LEARNED + ", c AS (SELECT content_hash, -0.3::DOUBLE * count(*) AS delta FROM m WHERE source LIKE '%1%' OR source LIKE '%2%' GROUP BY content_hash) SELECT content_hash, source, least(1.0::DOUBLE, greatest(0.1::DOUBLE, importance + coalesce(delta, 0.0::DOUBLE))) AS importance FROM m LEFT JOIN c USING (content_hash)")
def reinforce(spark, sf_dir):
    m = _memories(spark, sf_dir)
    down = m.filter("source LIKE '%1%' OR source LIKE '%2%'").select("content_hash", F.lit(-0.3).alias("delta"))
    return me.reinforced(m, down.groupBy("content_hash").agg((F.lit(-0.3) * F.count("*")).alias("delta"))).select("content_hash", "source", "importance")


# Evaluation

@query("SELECT avg(CASE WHEN hit THEN 1.0::DOUBLE WHEN NOT hit THEN 0.0::DOUBLE END) AS retrieval_hit_rate, avg(cov) AS keyword_coverage_rate, avg(g) AS groundedness_rate FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 = 0 END AS hit, CASE WHEN doc_id % 5 <> 0 THEN len(k) / 3.0::DOUBLE END AS cov, CASE WHEN doc_id % 5 <> 0 AND len(k) > 0 THEN len(list_filter(k, lambda x: contains(lower(substr(text, 1, 100)), x))) / len(k)::DOUBLE END AS g FROM (SELECT *, list_filter(['the', 'und', 'les'], lambda x: contains(lower(text), x)) AS k FROM documents))")
def eval_retrieval(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cases = d.select(F.col("text").alias("answer"), F.array(F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).alias("sources"), F.substring("text", 1, 100).alias("cited"), F.when(F.col("doc_id") % 2 == 0, "a").alias("expected_document"), F.when(F.col("doc_id") % 5 != 0, F.array(*map(F.lit, ("the", "und", "les")))).alias("expected_keywords"))
    return ev.evaluation_rates(ev.evaluate_cases(cases))


@query("SELECT doc_id, CASE WHEN i = 0 THEN false ELSE NOT list_bool_or([contains(substr(t, greatest(1, i - 80), i - greatest(1, i - 80)), m) FOR m IN [" + ", ".join("'" + m.replace("'", "''") + "'" for m in rules.NEGATION_MARKERS) + "]]) END AS bad FROM (SELECT doc_id, t, instr(t, ' and ') AS i FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'we cannot say ' ELSE '' END || lower(text) AS t FROM documents))")
def forbidden_phrase(spark, sf_dir):
    answer = F.concat(F.when(F.col("doc_id") % 3 == 0, "We cannot say ").otherwise(""), "text")
    return table(spark, sf_dir, "documents").select("doc_id", rules.forbidden(answer, " AND ").alias("bad"))


_EXACT = "WITH r AS (SELECT q.vec_id AS query_id, v.vec_id AS id, (1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2 AS raw FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) "


@query(_EXACT + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM r) SELECT round(avg(abs(round(raw, 4) - raw)), 6) AS mean_deviation, round(max(abs(round(raw, 4) - raw)), 6) AS max_deviation, count(DISTINCT query_id) FILTER (rank = 1) / count(DISTINCT query_id)::DOUBLE AS top1_agreement FROM k WHERE rank <= 10")
def score_scale_check(spark, sf_dir):
    """The search's scores against dot products of the unit vectors in SQL."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ve.search(e, q, 10)
    pairs = found.join(q, "query_id").join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    dot = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    exact = pairs.withColumn("score", (1 + dot / (norm("vector") * norm("embedding"))) / 2)
    # Ranked anew by the exact score.
    exact = exact.withColumn("rank", F.row_number().over(ve.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).select("query_id", "id", "score", "rank")
    out = ev.scale_check(found, exact)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("SELECT item_id, array_to_string(([q] || list_filter([' first - try', 'second', q, upper(q)], lambda x: lower(trim(x, ' -*' || chr(9))) <> lower(q)))[1:3], '|') AS variants FROM (SELECT item_id, 'q' || item_id AS q FROM benchmark)".replace("' first - try'", "'first - try'"))
def multi_query_parse(spark, sf_dir):
    q = F.concat(F.lit("q"), "item_id")
    answer = F.concat(F.lit(" - first - try \n\n* second\n"), q, F.lit("\n"), F.upper(q))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(rules.variants(q, answer), "|").alias("variants"))


# Speech: the names of parts as references, the same with changes as what was heard

def _clips(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    heard = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit(" Extra!"))).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_type"))
    return p.select("p_partkey", F.concat(F.lit("s"), F.col("p_size") % 3).alias("language"), F.col("p_name").alias("reference"), heard.alias("hypothesis"), F.lit(1.5).alias("latency_s"), F.lit(3.0).alias("audio_s"))


_HEARD = "WITH c AS (SELECT p_partkey, 's' || p_size % 3 AS language, lower(p_name) AS r, CASE p_partkey % 3 WHEN 0 THEN lower(p_name) || ' extra' WHEN 1 THEN lower(p_name) ELSE lower(p_type) END AS h FROM part), k AS (SELECT *, regexp_replace(regexp_replace(r, '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g') AS rr, regexp_replace(regexp_replace(h, '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g') AS hh FROM c) "


@query()
def word_error_rate(spark, sf_dir):
    return speech.errors(_clips(spark, sf_dir), "reference", "hypothesis").select("p_partkey", "word_errors", "ref_words", "char_errors", "ref_chars")


@query(_HEARD + "SELECT coalesce(language, 'ALL') AS language, count(*) AS clips, round(sum(levenshtein(rr, hh))::DOUBLE / sum(length(rr)), 6) AS cer, 0.5::DOUBLE AS rtf FROM k GROUP BY ROLLUP (language)")
def wer_rollup(spark, sf_dir):
    rows = speech.errors(_clips(spark, sf_dir), "reference", "hypothesis")
    return speech.rates(rows).select("language", "clips", F.round("cer", 6).alias("cer"), "rtf")


@query()
def bootstrap_ci(spark, sf_dir):
    rows = speech.errors(_clips(spark, sf_dir), "reference", "hypothesis").select("p_partkey", "char_errors", "ref_chars")
    return speech.bootstrap(rows, "char_errors", "ref_chars")


# Sources

@query()
def html_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_visible_text(F.col("html")).alias("text"))


@query(r"""SELECT c_custkey, 'id' || chr(9) || 'name' || chr(10) || c_custkey || chr(9) || c_name || ', "x"' AS text FROM customer""")
def csv_to_rows(spark, sf_dir):
    raw = F.concat(F.lit('id,name\r\n'), F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(', ""x"""\n'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", fi.parse_csv(raw).alias("rows"))
    return rows.select("c_custkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n").alias("text"))


@query("SELECT event_id, 'json' AS kind, props AS text FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'txt', event_type FROM events WHERE event_id % 10 = 1 UNION ALL SELECT event_id, 'bin', NULL FROM events WHERE event_id % 10 = 2 UNION ALL SELECT event_id, 'tsv', event_type || chr(9) || user_id FROM events WHERE event_id % 10 = 3")
def file_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id % 10 < 4")
    kind = F.element_at(F.array(*map(F.lit, ("json", "txt", "bin", "tsv"))), (F.col("event_id") % 10 + 1).cast("int"))
    content = F.when(kind == "json", F.col("props")).when(kind == "tsv", F.concat_ws("\t", "event_type", "user_id")).otherwise(F.col("event_type"))
    read = fi.read_texts(e.select(F.concat_ws(".", "event_id", kind).alias("path"), content.cast("binary").alias("content")))
    text = F.when(F.col("path").endswith(".json"), F.to_json(F.from_json("text", "struct<k: long>"))).otherwise(F.col("text"))
    return read.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("event_id"), F.split_part("path", F.lit("."), F.lit(2)).alias("kind"), F.replace(text, F.lit('"k":'), F.lit('"k": ')).alias("text"))


@query("SELECT event_id, k FROM (SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events) UNION ALL SELECT event_id, (props::JSON->>'k')::BIGINT + 1 FROM events WHERE event_id % 3 = 0")
def rest_unwrap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    second = F.concat(F.lit('{"k": '), (F.get_json_object("props", "$.k").cast("long") + 1).cast("string"), F.lit("}"))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"n": 2, "items": ['), "props", F.lit(","), second, F.lit("]}"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return e.select("event_id", F.explode(cn.unwrapped(body)).alias("row")).select("event_id", F.get_json_object("row", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def sql_template(spark, sf_dir):
    return cn.sql_rows(spark, "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = '{{user_id}}'", "BUILDING", {"customer": table(spark, sf_dir, "customer")})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def document_store(spark, sf_dir):
    q = cn.document_query('{"database": "shop", "collection": "orders", "filter": {"o_orderstatus": "{{user_id}}"}, "projection": {"o_orderkey": 1, "o_totalprice": 1, "o_clerk": 1}}', "F")
    return cn.document_rows(table(spark, sf_dir, "orders"), q)


_SHOWN = ("region", "nation", "customer", "part", "supplier")


@query("SELECT table_name AS \"table\", column_name AS \"column\", contains(column_name, 'pin') OR contains(column_name, 'hash') OR contains(column_name, 'salt') AS sensitive FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _SHOWN) + ")")
def schema_blacklist(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in _SHOWN} | {"auth_user": table(spark, sf_dir, "nation"), "my_tokens": table(spark, sf_dir, "nation")}
    return cn.described(spark, tables).select("table", "column", "sensitive")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ko' WHEN doc_id % 4 = 1 THEN 'ja' WHEN doc_id % 4 = 2 THEN 'zh' END AS script FROM documents")
def language_script(spark, sf_dir):
    added = F.element_at(F.array(*map(F.lit, ("한국어", "かな文", "中文字", "plain"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.script_language(F.concat(F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 5), added)).alias("script"))


_CLEANED = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)page\s*\d+', ' ', 'g'), '\b[A-Z]{2,}\d+\b', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\d+', ' ', 'g'), '_+', ' ', 'g'), '\s+', ' ', 'g')))"


_DETECTED = f"""
WITH c AS (SELECT doc_id, lang, source, {_CLEANED} AS t, length(trim(text)) AS size FROM documents),
g AS (
  SELECT doc_id, substr(t, i, size) AS gram, count(*) AS n
  FROM (SELECT doc_id, s.size, t, unnest(range(1, least(257, length(t) + 2 - s.size))) AS i
        FROM (SELECT doc_id, substr(' ' || t || ' ', first_at, 260) AS t
              FROM (SELECT doc_id, t, unnest(range(1, length(t) + 3, 256)) AS first_at FROM c WHERE t <> '')), (VALUES (2), (3), (4), (5)) s(size))
  GROUP BY ALL),
p AS (SELECT lang, gram, sum(n) AS n FROM g JOIN c USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
l AS (SELECT lang, sum(n) + {la.ALPHA} * (SELECT count(DISTINCT gram) FROM p) AS total FROM p GROUP BY lang),
d AS (SELECT doc_id, sum(n) AS grams FROM g GROUP BY doc_id),
m AS (SELECT g.doc_id, p.lang, sum(g.n * ln(1 + p.n / {la.ALPHA}::DOUBLE)) AS gain FROM g JOIN p USING (gram) GROUP BY ALL),
s AS (
  SELECT d.doc_id, l.lang, coalesce(gain, 0) / grams + ln({la.ALPHA}::DOUBLE) - ln(total) AS score
  FROM d CROSS JOIN l LEFT JOIN m USING (doc_id, lang)),
r AS (SELECT *, row_number() OVER w AS place, score - lead(score) OVER w AS ahead FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, lang)),
b AS (SELECT doc_id, lang AS found, least(1.0::DOUBLE, coalesce(ahead, 0) / 2 + 0.5::DOUBLE) AS sure FROM r WHERE place = 1)"""


@query(_DETECTED + """
SELECT c.doc_id, CASE WHEN size < 10 OR found IS NULL THEN 'en' ELSE found END AS lang,
  round(CASE WHEN size < 10 OR found IS NULL THEN 0 ELSE sure END, 4) AS confidence
FROM c LEFT JOIN b USING (doc_id)""")
def language_detect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return la.detect(d, la.profiles(d)).select("doc_id", "lang", F.round("confidence", 4).alias("confidence"))


@query(_DETECTED + f""",
k AS (
  SELECT *, sum(n) OVER (PARTITION BY source) AS total
  FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY source, lang)),
o AS (
  SELECT source, lang AS said, n / total::DOUBLE AS said_sure
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS place FROM k) WHERE place = 1),
e AS (
  SELECT doc_id, size,
    CASE WHEN said IS NULL OR (found <> said AND sure >= {la.SURE_GRAMS}) THEN found ELSE said END AS lang,
    CASE WHEN said IS NULL OR (found <> said AND sure >= {la.SURE_GRAMS}) THEN sure ELSE said_sure END AS sure
  FROM c LEFT JOIN b USING (doc_id) LEFT JOIN o USING (source))
SELECT doc_id, CASE WHEN size < 10 OR lang IS NULL OR lang NOT IN ('de', 'en', 'fr') THEN 'en' ELSE lang END AS lang,
  round(CASE WHEN size < 10 OR lang IS NULL OR lang NOT IN ('de', 'en', 'fr') THEN 0 ELSE sure END, 4) AS confidence
FROM e""")
def language_arbitrated(spark, sf_dir):
    """The commonest language of a document's source is the outside result, its share the confidence."""
    d = table(spark, sf_dir, "documents")
    counts = d.filter("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"))
    told = counts.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("m"), F.sum("n").alias("total"))
    rows = d.join(told.select("source", F.col("m.lang").alias("said"), (-F.col("m.n") / F.col("total")).alias("said_sure")), "source", "left")
    found = la.detect(rows, la.profiles(d), outside="said", outside_sure="said_sure", languages=("de", "en", "fr"))
    return found.select("doc_id", "lang", F.round("confidence", 4).alias("confidence"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'k is missing' WHEN event_id % 4 = 1 THEN 'not JSON' WHEN event_id % 4 = 2 THEN 'k is not integer' END AS problem FROM events")
def json_schema(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "{}").when(F.col("event_id") % 4 == 1, "{k").when(F.col("event_id") % 4 == 2, '{"k": true}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", tools.json_problem(text, {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}).alias("problem"))


@query("SELECT event_id, event_id % 2 = 0 AS success, CASE WHEN event_id % 2 = 0 THEN (user_id + 1)::VARCHAR END AS result FROM events")
def tool_calls(spark, sf_dir):
    kit = tools.Toolkit()

    @kit.add
    def add_one(n: int) -> int:
        """One more."""
        return n + 1

    name = F.when(F.col("event_id") % 2 == 0, "add_one").otherwise("no_such_tool")
    calls = table(spark, sf_dir, "events").select("event_id", name.alias("tool"), F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit("}")).alias("arguments"))
    return kit.call(calls).select("event_id", "success", "result")


# Scalar tools

@query()
def safe_calc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("round("), F.col("value").cast("string"), F.lit(") + sqrt("), F.col("user_id").cast("string"), F.lit(") * 2 ** 3"))
    return e.select("event_id", calculator.calculate(F.when(F.col("event_id") % 10 == 0, "__import__('os')").otherwise(text)).alias("r")).select("event_id", F.round("r.result", 6).alias("result"), F.col("r.error").isNotNull().alias("refused"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sun,mon' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'tue,wed,thu' END AS days FROM orders")
def cron_weekdays(spark, sf_dir):
    field = F.when(F.col("o_orderkey") % 3 == 0, "7,1").when(F.col("o_orderkey") % 3 == 1, "*/2").otherwise("2-4")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.weekday_names(field).alias("days"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '9.9.9.' || user_id % 200 WHEN event_id % 3 = 1 THEN '10.0.0.1' ELSE '8.8.8.8' END AS client FROM events")
def forwarded_client(spark, sf_dir):
    peer = F.when(F.col("event_id") % 3 == 2, "8.8.8.8").otherwise("10.0.0.1")
    hops = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1.1.1.1, 9.9.9."), (F.col("user_id") % 200).cast("string"), F.lit(", 10.0.0.2"))).otherwise(F.lit("1.2.3.4, nonsense"))
    return table(spark, sf_dir, "events").select("event_id", rules.client_of(peer, hops, ("10.0.0.1", "10.0.0.2")).alias("client"))


# Ledgers over events: users are callers, values are dollars or milliseconds

_CALLS = "WITH calls AS (SELECT event_id, event_type AS provider, 'm' || user_id % 3 AS model, user_id % 1000 AS prompt_tokens, event_id % 500 AS completion_tokens FROM events) "


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), (F.col("user_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 500).alias("completion_tokens"))


@query(_CALLS + "SELECT event_id, CASE WHEN provider = 'click' AND model = 'm1' THEN round(prompt_tokens / 1e6 * 3 + completion_tokens / 1e6 * 15, 6) WHEN provider = 'click' THEN round(prompt_tokens / 1e6 * 1 + completion_tokens / 1e6 * 2, 6) WHEN provider = 'view' AND model = 'm2' THEN round(prompt_tokens / 1e6 * 8 + completion_tokens / 1e6 * 8, 6) END AS usd FROM calls")
def pricing_lookup(spark, sf_dir):
    prices = spark.createDataFrame([("click", "m1", 3.0, 15.0), ("click", "*", 1.0, 2.0), ("view", "m2", 5.0, 5.0)], "provider string, model string, input double, output double")
    more = spark.createDataFrame([("view", "m2", 8.0, 8.0)], prices.schema)
    return le.priced(_calls(spark, sf_dir), le.merged_pricing(prices, more)).select("event_id", "usd")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 7 ELSE ceil(length(text) / 4.0)::BIGINT END AS prompt_tokens, ceil(length(text) / 4.0)::BIGINT AS completion_tokens, true AS estimated FROM conversations")
def usage_ledger(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("text").alias("answer"), F.when(F.col("turn") % 2 == 0, 7).alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"))
    return le.usage(c).select("conv_id", "turn", "prompt_tokens", "completion_tokens", "estimated")


def _traces(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("is_error"), (F.col("user_id") % 7 == 0).alias("is_fallback"), F.col("value").alias("latency_ms"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("r"), F.col("user_id") % 5)).alias("role"), F.concat(F.lit("p"), F.col("user_id") % 2).alias("provider"))


_TRACE = "WITH t AS (SELECT event_type = 'error' AS e, user_id % 7 = 0 AS f, value AS v, CASE WHEN user_id % 5 > 0 THEN 'r' || user_id % 5 ELSE '(none)' END AS role, 'p' || user_id % 2 AS provider FROM events) "
_SUMS = "count(*) AS calls, round(100.0::DOUBLE * count(*) FILTER (WHERE e) / count(*), 2) AS error_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE f) / count(*), 2) AS fallback_pct, round(avg(v), 2) AS mean_ms FROM t"


@query(_TRACE + f"SELECT 'all' AS kind, 'ALL' AS name, {_SUMS} UNION ALL SELECT 'role', role, {_SUMS} GROUP BY role UNION ALL SELECT 'provider', provider, {_SUMS} GROUP BY provider")
def observability_sets(spark, sf_dir):
    return le.report(_traces(spark, sf_dir))


@query("SELECT event_type AS type, 'c' || user_id % 2 AS channel, CASE WHEN user_id % 3 = 0 THEN '(no role)' ELSE 'r' || user_id % 3 END AS role, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL HAVING count(*) >= 2")
def rejection_groups(spark, sf_dir):
    log = table(spark, sf_dir, "events").select((F.col("value") > 10).alias("rejected"), F.col("event_type").alias("type"), F.concat(F.lit("c"), F.col("user_id") % 2).alias("channel"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("r"), F.col("user_id") % 3)).alias("role"))
    return le.rejections(log)


@query("SELECT date_trunc('day', ts) AS day, event_type AS type, count(*) AS n, count(*) FILTER (WHERE user_id % 4 = 0) AS failures FROM events GROUP BY ALL")
def action_failures(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("type"), F.when(F.col("user_id") % 4 == 0, "got ERROR 5").otherwise("error-free").alias("result"))
    return le.daily_actions(log).withColumn("day", F.col("day").cast("timestamp_ntz"))


both("status_histogram", "orders", "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderdate) AS next_run FROM {orders} GROUP BY o_orderstatus")


@query("SELECT coalesce(k.role, u.role) AS role, k.role IS NOT NULL AS known, coalesce(u.calls, 0) AS calls, round(coalesce(u.usd, 0.0::DOUBLE), 4) AS usd FROM (SELECT * FROM (VALUES ('click'), ('idle')) v(role)) k FULL JOIN (SELECT event_type AS role, count(*) AS calls, sum(value) AS usd FROM events GROUP BY 1) u ON k.role = u.role")
def usage_by_role(spark, sf_dir):
    known = spark.createDataFrame([("click",), ("idle",)], "role string")
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("role"), F.col("value").alias("usd"))
    return le.by_role(known, calls).withColumn("usd", F.round("usd", 4))


@query("SELECT n_name AS role, coalesce(CASE WHEN n_regionkey < 3 THEN r_name END, 'General') AS department, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 3 > 0) AS open_tasks FROM nation JOIN region ON r_regionkey = n_regionkey")
def organisation_chart(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    homes = n.join(r.filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("role"), F.col("r_name").alias("department"))
    tasks = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("role"), F.when(F.col("s_suppkey") % 3 == 0, "done").otherwise("open").alias("status"))
    return le.chart(n.select(F.col("n_name").alias("role")), homes, tasks)


@query("SELECT event_id AS id, event_type, substr(props, 1, 5) AS props FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_log(spark, sf_dir):
    return le.recent(table(spark, sf_dir, "events").withColumnRenamed("event_id", "id"), 500, "props", 5).select("id", "event_type", "props")


_TRIG = "(SELECT o_orderkey AS id, o_orderdate AS next_run_at, o_orderstatus <> 'P' AS is_active, 86400 * (o_orderkey % 7 + 1) AS every_s FROM orders)"


def _triggers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("next_run_at"), (F.col("o_orderstatus") != "P").alias("is_active"), (86400 * (F.col("o_orderkey") % 7 + 1)).alias("every_s"))


@query(f"SELECT id FROM {_TRIG} WHERE is_active AND next_run_at <= TIMESTAMP '1996-01-01'")
def due_triggers(spark, sf_dir):
    return le.due(_triggers(spark, sf_dir), "1996-01-01 00:00:00").select("id")


@query(f"SELECT id, d AS claimed, CASE WHEN d THEN epoch(next_run_at)::BIGINT + (floor((epoch(TIMESTAMP '1996-01-01') - epoch(next_run_at)) / every_s)::BIGINT + 1) * every_s ELSE epoch(next_run_at)::BIGINT END AS next_s FROM (SELECT *, is_active AND next_run_at <= TIMESTAMP '1996-01-01' AS d FROM {_TRIG})")
def claim_triggers(spark, sf_dir):
    return le.claimed(_triggers(spark, sf_dir), "1996-01-01 00:00:00").select("id", "claimed", F.unix_seconds("next_run_at").alias("next_s"))


@query("SELECT user_id AS schedule, min(gap) AS least_gap FROM (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 60e6 AS gap FROM events) GROUP BY 1 HAVING min(gap) < 5")
def narrow_schedules(spark, sf_dir):
    return le.narrow_gaps(table(spark, sf_dir, "events").select(F.col("user_id").alias("schedule"), F.col("ts").cast("timestamp").alias("at")))


_LOGS = "WITH r AS (SELECT user_id % 100 AS log, row_number() OVER (PARTITION BY user_id % 100 ORDER BY ts, event_id) AS seq FROM events) "


@query(_LOGS + "SELECT log, NOT (log % 4 = 0 AND count(*) >= 3) AS ok, count(*) AS records, CASE WHEN log % 4 = 0 AND count(*) >= 3 THEN 3 END AS first_bad FROM r GROUP BY log")
def audit_chain_verify(spark, sf_dir):
    """In every fourth log the data of the third record is altered."""
    e = table(spark, sf_dir, "events").withColumn("log", F.col("user_id") % 100)
    seq = F.row_number().over(ve.Window.partitionBy("log").orderBy("ts", "event_id")).cast("long")
    records = e.select("log", seq.alias("seq"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("event"), F.lit("tenant=t1").alias("scope"), F.replace("props", F.lit(" "), F.lit("")).alias("data"))
    tampered = le.chained(records).withColumn("data", F.when((F.col("log") % 4 == 0) & (F.col("seq") == 3), F.lit('{"k":-1}')).otherwise(F.col("data")))
    return le.verified(tampered)


# State

both("usage_calendar", "events", "SELECT date_trunc('day', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")


@query("SELECT date_trunc('day', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total, sum(value) > 100 AS over FROM events GROUP BY 1, 2")
def usage_windows(spark, sf_dir):
    w = st.over_caps(st.usage_windows(table(spark, sf_dir, "events")), 100.0)
    return w.withColumn("total", F.round("total", 4))


@query()
def login_throttle(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id") % 50).alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "purchase").alias("failed"))
    return st.throttle(a, most=3, window=86_400.0, lockout=3_600.0)


@query()
def cache_ttl(spark, sf_dir):
    return st.cached(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), 86_400.0)


@query()
def cache_lru(spark, sf_dir):
    return st.least_recently_used(table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key")), 50)


@query("SELECT count(*) - count(DISTINCT text) AS hits, count(DISTINCT text) AS misses, round((count(*) - count(DISTINCT text))::DOUBLE / count(*), 4) AS hit_rate, count(DISTINCT text) AS size FROM conversations")
def cache_counts(spark, sf_dir):
    return st.cache_stats(table(spark, sf_dir, "conversations"), ["text"])

