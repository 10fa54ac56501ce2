"""Schedules, claims, the embedding store, semantic memory and reranking over a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cron
from ..functions import text as tx
from ..operators import embedstore
from ..operators import evaluation as ev
from ..operators import memory as me
from ..operators import retriever as rt
from ..operators import textindex as ti
from ..operators import triggers as tr
from ..operators.committed import Store
from ..session import shared_path, table
from .corpus import _ENTRIES, _NOW, _entries
from .registry import query
from .search import LISTS, SPARSE, document_index, passages

#: A schedule of one minute, one hour and three weekdays for each customer, and a time to look from.
_CRON = "{k} % 60 || ' ' || {k} % 24 || ' * * ' || {k} % 5 || '-' || ({k} % 5 + 2)"
_FROM = 1704067200


@query(
    f"""
WITH c AS (SELECT c_custkey AS id, TIMESTAMP '2024-01-01' + to_minutes((c_custkey * 7919 % 1000000)::INTEGER) AS t, c_custkey % 60 AS m, c_custkey % 24 AS h, c_custkey % 5 AS d FROM customer),
days AS (SELECT id, t, d, unnest(range(0, 9)) AS i, date_trunc('day', t) + to_minutes((h * 60 + m)::INTEGER) AS run FROM c),
runs AS (SELECT id, t, run + to_days(i::INTEGER) AS run, d FROM days)
SELECT id, {_CRON.format(k="id")} AS cron, min(epoch(run))::BIGINT AS next_s FROM runs WHERE run > t AND dayofweek(run) BETWEEN d AND d + 2 GROUP BY id"""
)
def cron_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_CRON.format(k="c_custkey")).alias("cron"), F.timestamp_seconds(F.lit(_FROM) + F.col("c_custkey") * 7919 % 1000000 * 60).alias("t"))
    rows = rows.withColumn("sets", cron.fields(F.col("cron")))
    return rows.select("id", "cron", F.unix_seconds(cron.next_run(F.col("sets"), F.col("t"))).alias("next_s"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'runs more often than every 5 minutes' WHEN event_id % 4 = 1 AND user_id % 60 > 31 THEN 'invalid' WHEN event_id % 4 = 1 AND user_id % 60 IN (0, 30, 31) THEN CASE WHEN user_id % 60 = 0 THEN 'invalid' ELSE 'never runs' END
WHEN event_id % 4 = 2 AND user_id % 10 BETWEEN 1 AND 4 THEN 'runs more often than every 5 minutes' WHEN event_id % 4 = 2 AND user_id % 10 = 0 THEN 'invalid' END AS problem FROM events"""
)
def cron_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules made from events: each minute; a day of February; steps of minutes; and daily ones."""
    day, step = (F.col("user_id") % 60).cast("string"), (F.col("user_id") % 10).cast("string")
    kinds = F.when(F.col("event_id") % 4 == 0, "* * * * *").when(F.col("event_id") % 4 == 1, F.concat(F.lit("0 9 "), day, F.lit(" 2 *"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("0-58/"), step, F.lit(" 3 * * *"))).otherwise("5 4 * * sun")
    rows = table(spark, sf_dir, "events").select("event_id", cron.fields(kinds).alias("sets"))
    return rows.select("event_id", cron.problem(F.col("sets")).alias("problem"))


@query("SELECT o_orderkey AS id, 1::BIGINT AS claims, epoch(o_orderdate)::BIGINT + (o_orderkey % 90 + 5) * 60 AS due_s FROM orders WHERE o_orderkey % 9 <> 0 AND epoch(o_orderdate) + (o_orderkey % 90 + 5) * 60 <= epoch(TIMESTAMP '1996-01-01')")
def claims_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as triggers; two callers claim at one time, and each due trigger has one claim."""
    store = Store(spark, shared_path(spark, "triggers"), key="id", buckets=4)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("cron"), F.lit("UTC").alias("zone"), (F.col("o_orderkey") % 90 + 5).alias("every_min"), (F.col("o_orderkey") % 9 != 0).alias("is_active"), F.timestamp_add("MINUTE", (F.col("o_orderkey") % 90 + 5).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("next_run_at"), F.lit(None).cast("timestamp").alias("last_run_at"))
    store.commit({"triggers": rows}, rows.select("id"))
    one, two = (tr.claim(store, "1996-01-01 00:00:00") for _ in range(2))
    return one.unionByName(two).groupBy("id").agg(F.count("*").alias("claims"), F.unix_seconds(F.min("due_at")).alias("due_s"))


_VALUES = "round(list_sum([('0x' || substr(sha256(text), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE FOR i IN range(0, 8)]), 6)"


@query(f"SELECT conv_id, turn, CASE WHEN length(trim(text)) > 0 THEN {_VALUES} END AS total, (SELECT count(DISTINCT text) FROM conversations) AS first_run, 0::BIGINT AS second_run FROM conversations")
def embed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations embedded through the store: the second run embeds nothing."""
    store = Store(spark, shared_path(spark, "vectors"), key="digest")
    rows = table(spark, sf_dir, "conversations")
    _, first = embedstore.embedded(store, rows, "hash-8", tx.hash_vector)
    out, second = embedstore.embedded(store, rows, "hash-8", tx.hash_vector)
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6)
    return out.select("conv_id", "turn", total.alias("total"), F.lit(first).cast("long").alias("first_run"), F.lit(second).cast("long").alias("second_run"))


_COSINE = "(1 + list_cosine_similarity([('0x' || substr(sha256(text), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE FOR i IN range(0, 8)], [('0x' || substr(sha256('what do we know'), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE FOR i IN range(0, 8)])) / 2"


@query(
    _ENTRIES
    + f""", near AS (SELECT id, row_number() OVER (ORDER BY {_COSINE} DESC, id) AS r FROM seen WHERE agent IN ('assistant', 'system') AND tenant = 't1' AND length(trim(text)) > 0)
SELECT 'found' AS branch, id AS content_hash FROM near WHERE r <= 5
UNION ALL SELECT 'short', id FROM (SELECT id FROM entries WHERE agent IN ('assistant', 'system') ORDER BY created_at DESC, id LIMIT 5)"""
)
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic hits with the tags, and the tagged ones where the query is too short."""
    rows = _entries(spark, sf_dir).withColumnRenamed("id", "content_hash").withColumn("vector", tx.hash_vector(F.col("text")))
    asked = spark.range(1).select(F.col("id").alias("query_id"), tx.hash_vector(F.lit("what do we know")).alias("vector"))
    tags = ["assistant", "system"]
    found = me.semantic(rows, asked, 5, tags, {"tenant": "t1"}, _NOW).select(*rows.columns)
    tagged = me.by_tags(rows, tags)
    long = me.with_fallback(found, tagged, "what do we know").select(F.lit("found").alias("branch"), "content_hash")
    return long.unionByName(me.with_fallback(found, tagged, "what").select(F.lit("short").alias("branch"), "content_hash"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


@query(
    "WITH"
    + SPARSE
    + f""",
pool AS (SELECT query_id, id FROM sparse WHERE rank <= 40),
scored AS (
    SELECT query_id, id, round(coalesce(len(list_intersect({_WORDS.format(t="b.text")}, {_WORDS.format(t="d.text")}))::DOUBLE / len({_WORDS.format(t="b.text")}), 0.0::DOUBLE), 4) AS score
    FROM pool JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored) WHERE rank <= 10"""
)
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages reranked over a pool of four times k documents; no other text is read by the scorer."""
    asked = passages(spark, sf_dir)
    pool = ti.search_any(document_index(spark, sf_dir), asked, 40).select("query_id", "id")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = texts.join(F.broadcast(pool), "id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")  # 40 rows for each query
    return ev.rerank(hits, ev.word_overlap, 10)


@query("SELECT role AS channel, conv_id AS chat, turn AS id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def last_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("channel"), F.col("conv_id").alias("chat"), F.col("turn").alias("id"), F.col("turn").alias("at"), "text")
    return me.last_reply(rows).select("channel", "chat", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _asking(spark: SparkSession, sf_dir: str):
    """A retriever over the documents, each one chunk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _backends:
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "doc_id", F.col("source").alias("name"), F.lit(0).alias("chunk_index"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata"), tx.hash_vector(F.col("text")).alias("vector"))
        backend = rt.StoreBackend(Store(spark, shared_path(spark, "chunks")))
        backend.insert(rows)
        _backends[key] = backend
    return rt.Retriever(_backends[key], rerank=ev.word_overlap)


_backends: dict[tuple, rt.Backend] = {}


@query(
    "WITH"
    + LISTS.replace("rank <= 30", "rank <= 60")
    + f""",
scored AS (
    SELECT query_id, id, round(coalesce(len(list_intersect({_WORDS.format(t="b.text")}, {_WORDS.format(t="d.text")}))::DOUBLE / len({_WORDS.format(t="b.text")}), 0.0::DOUBLE), 4) AS score
    FROM top JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id WHERE rank <= 20),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored) WHERE r <= 5),
used AS (SELECT query_id, id, r, source, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY r) AS chars FROM best JOIN documents ON doc_id = id)
SELECT query_id, count(*)::INTEGER AS chunks_sent, md5(string_agg('[Source ' || r || ': ' || coalesce(source, 'unknown document') || ', chunk 0]' || chr(10) || text, chr(10) || chr(10) ORDER BY r)) AS context_md5,
    string_agg(r || '=' || id || ':' || CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END, '|' ORDER BY r) AS cited
FROM used WHERE chars <= 12000 OR r = 1 GROUP BY query_id"""
)
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as questions: hybrid retrieval, a pool reranked, a packed context and its citations."""
    rows = _asking(spark, sf_dir).prompts(passages(spark, sf_dir))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["source_number"], F.lit("="), c["chunk_id"], F.lit(":"), c["preview"])), "|")
    return rows.select("query_id", "chunks_sent", F.md5(F.col("context").cast("binary")).alias("context_md5"), cited.alias("cited"))


@query(
    r"""
WITH e AS (SELECT event_id AS seq, ['instruction', 'conversation', 'approval', 'rejection', 'integration', 'gossip'][event_id % 6 + 1] AS kind, event_type AS name, props AS said, 'user ' || user_id AS done, user_id % 3 > 0 AS resolved, event_id % 11 / 10.0::DOUBLE AS score FROM events),
m AS (
    SELECT seq, 'OWNER INSTRUCTION (always follow this): ' || said AS text, ['owner_instruction', 'core', 'business'] AS tags, 1.0::DOUBLE AS importance, 'owner' AS source, true AS permanent FROM e WHERE kind = 'instruction' AND length(trim(said)) >= 10
    UNION ALL SELECT seq, '[' || upper(name) || ' INTERACTION — score ' || printf('%.1f', score) || ']' || chr(10) || 'Customer said: ' || said || chr(10) || 'AI replied: ' || done, ['learned_pattern', 'interaction', name, 'comms'], least(score, 0.85), 'conversation', false FROM e WHERE kind = 'conversation' AND resolved AND score >= 0.5
    UNION ALL SELECT seq, 'OWNER APPROVED ACTION [' || name || ']: ' || said || chr(10) || 'Outcome: ' || done, ['learned_pattern', 'approval', 'owner_approved', name], 0.95, 'owner_approval', true FROM e WHERE kind = 'approval'
    UNION ALL SELECT seq, 'OWNER REJECTED ACTION [' || name || ']: ' || said || chr(10) || 'Reason/outcome: ' || done, ['learned_pattern', 'approval', 'owner_rejected', name], 0.95, 'owner_approval', true FROM e WHERE kind = 'rejection'
    UNION ALL SELECT seq, 'INTEGRATION ACTION: ' || name || ' — ' || said || chr(10) || 'Result: ' || done, ['integration', 'operations', 'process', 'capability'], 0.75, 'integration', false FROM e WHERE kind = 'integration')
SELECT seq, md5(text) AS text_md5, array_to_string(tags, ',') AS tags, importance, source, permanent FROM m"""
)
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what an owner said, conversations, approvals, rejections and actions: what is to be learned from each."""
    kinds = F.array(*map(F.lit, ("instruction", "conversation", "approval", "rejection", "integration", "gossip")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"), F.col("event_type").alias("name"), F.col("props").alias("said"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("done"), (F.col("user_id") % 3 > 0).alias("resolved"), (F.col("event_id") % 11 / 10.0).alias("score"))
    return me.lessons(rows).select("seq", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("tags", ",").alias("tags"), "importance", "source", "permanent")


@query(
    """SELECT conv_id, turn, conv_id % 2 = 0 AS tenant_covers, turn % 2 = 0 AS subject_covers, 'tenant=t' || conv_id % 3 || '/subject=c' || conv_id || '/agent=' || role AS narrower, CASE WHEN turn % 2 = 0 THEN 'tenant=t' || conv_id % 3 || '/subject=c' || conv_id END AS narrow_again FROM conversations"""
)
def scope_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scopes cover which, and what a scope narrowed by another part is."""
    tenant = F.concat(F.lit("tenant=t"), F.col("conv_id") % 3)
    wide = F.when(F.col("conv_id") % 2 == 0, tenant).otherwise("tenant=other")
    subject = F.concat(tenant, F.lit("/subject=c"), "conv_id")
    other = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), "conv_id")).otherwise("somebody")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", me.covers(wide, subject).alias("tenant_covers"), me.covers(F.concat(tenant, F.lit("/subject="), other), subject).alias("subject_covers"),
        me.narrowed(subject, "agent", F.col("role")).alias("narrower"), me.narrowed(subject, "subject", other).alias("narrow_again"),
    )


@query("SELECT p_partkey, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN regexp_extract_all(p_name || '''s ' || p_brand, '[A-Za-z]+|[^A-Za-z]+')], '') AS title FROM part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.title(F.concat("p_name", F.lit("'s "), "p_brand")).alias("title"))
