"""Routing, sessions, logs, listings of folders, parsed model answers and other keeping of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import chunks as ch
from ..operators import graph as gr
from ..operators import ledger as le
from ..operators import memory as me
from ..session import table
from ..sources import connectors as cn
from ..sources import files as fi
from .registry import query


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Questions and model answers

_QUESTION = "'Find \"' || role || ' of  conversation ' || conv_id || '\" now: ' || text"


@query(f"""
WITH q AS (  -- other letters as _, a word character that no text has
  SELECT conv_id, turn, regexp_replace(regexp_replace({_QUESTION}, '[^\\x00-\\x7F\\p{{L}}\\p{{M}}\\p{{N}}]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS t
  FROM conversations WHERE text IS NOT NULL),
n AS (
  SELECT conv_id, turn, list_filter(list_transform(
    regexp_extract_all(t, '"([^"\\n]{{3,120}})"', 1) || regexp_extract_all(t, '\\b[A-Z]{{2,}}(?:-[A-Z0-9]+)?\\b')
    || regexp_extract_all(t, '\\b(?:[A-Z][a-z]{{2,}})(?:\\s+[A-Z][a-z]{{2,}}){{0,2}}\\b')
    || list_filter(regexp_extract_all(t, '\\b[A-Za-z][A-Za-z0-9_-]{{3,}}\\b'), lambda x: NOT contains(x, '_') AND lower(x) NOT IN ({_listed(gr.QUERY_STOP_WORDS)})),
    lambda x: substr(trim(regexp_replace(x, '\\s+', ' ', 'g')), 1, 200)), lambda x: x <> '') AS names
  FROM q),
k AS (SELECT *, list_transform(names, lambda x: lower(x)) AS low FROM n)
SELECT conv_id, turn, array_to_string(list_filter(names, lambda x, i: list_position(low, lower(x)) = i)[1:10], '|') AS names FROM k""")
def query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    asked = F.concat(F.lit('Find "'), "role", F.lit(" of  conversation "), F.col("conv_id").cast("string"), F.lit('" now: '), "text")
    return c.select("conv_id", "turn", F.array_join(gr.open_query_entities(asked), "|").alias("names"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each customer: its orders as entities and relations, in order of their keys; each seventh answer is cut off and no JSON."""
    o = table(spark, sf_dir, "orders").withColumn("who", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
    entity = F.struct("o_orderkey", F.concat("o_orderpriority", F.lit(" ")).alias("name"), F.col("o_orderstatus").alias("type"))
    relation = F.struct("o_orderkey", F.upper("who").alias("subject"), F.lower("o_orderstatus").alias("relation_type"), F.col("o_orderpriority").alias("object"))
    rows = o.groupBy(F.col("o_custkey").alias("doc_id"), "who").agg(F.array_sort(F.collect_list(entity)).alias("entities"), F.array_sort(F.collect_list(relation)).alias("relations"))
    body = F.to_json(F.struct("entities", "relations"))
    answer = F.when(F.col("doc_id") % 7 == 0, F.substring(body, 1, 40)).otherwise(body)
    known = F.array("who", F.lit("1-urgent"), F.lit("3-Medium"))
    return rows.select("doc_id", answer.alias("answer"), known.alias("entities"))


@query("""
WITH e AS (
  SELECT o_custkey AS doc_id, o_orderpriority AS name, o_orderstatus AS type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
  FROM orders WHERE o_custkey % 7 <> 0)
SELECT doc_id, name, CASE WHEN arg_min(type, n) IN ('F', 'O') THEN arg_min(type, n) ELSE 'UNKNOWN' END AS type
FROM e WHERE n <= 20 GROUP BY doc_id, name
UNION ALL SELECT DISTINCT o_custkey, 'malformed', '' FROM orders WHERE o_custkey % 7 = 0""")
def answered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    bad = gr.malformed(a, "entities").select("doc_id", F.lit("malformed").alias("name"), F.lit("").alias("type"))
    return gr.parsed_entities(a, ("F", "O")).drop("place").union(bad)


@query("""
SELECT o_custkey AS doc_id, 'CUSTOMER ' || o_custkey AS subject, o_orderstatus AS type, o_orderpriority AS object, count(*) AS n
FROM orders WHERE o_custkey % 7 <> 0 AND lower(o_orderpriority) IN ('1-urgent', '3-medium') GROUP BY ALL""")
def answered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gr.parsed_relations(_answers(spark, sf_dir))
    return found.groupBy("doc_id", "subject", "type", "object").agg(F.count("*").alias("n"))


# Routing

_SAID = ("", " Any DISCOUNT?", " Our Newsletter", " I want a real person", " a demo campaign")
_MESSAGE = f"text || [{_listed(_SAID)}][(conv_id + turn) % {len(_SAID)} + 1]"


def _any(words: tuple[str, ...]) -> str:
    return f"len(list_filter([{_listed(words)}], lambda w: contains(lower(m), w))) > 0"


@query(f"""
SELECT conv_id, turn,
  CASE {" ".join(f"WHEN {_any(words)} THEN '{role}'" for role, words in rules.INTENT_KEYWORDS.items())}
    WHEN channel = 'assistant' THEN 'finance' ELSE '{rules.DEFAULT_ROLE}' END AS role,
  coalesce({_any(rules.ESCALATION_PHRASES)}, false) AS escalate
FROM (SELECT conv_id, turn, role AS channel, {_MESSAGE} AS m FROM conversations)""")
def routed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAID)), ((F.col("conv_id") + F.col("turn")) % len(_SAID) + 1).cast("int"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("channel"), F.concat("text", said).alias("text"))
    channels = messages.select("channel").distinct().filter("channel = 'assistant'").withColumn("role", F.lit("finance"))
    return le.routed(messages, channels).select("conv_id", "turn", "role", "escalate")


# Listings of folders

_FILES = """
f AS (
  SELECT doc_id // 50 AS g, doc_id,
    CASE WHEN doc_id % 11 = 0 THEN '../' ELSE '' END || 'in/' || doc_id || '.txt' AS path,
    CASE WHEN doc_id % 13 = 0 THEN 26214401 ELSE n_chars END AS size, sha256(coalesce(text, '')) AS hash,
    doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS fine, (doc_id // 50) % 4 <> 1 AS complete, (doc_id // 50) % 4 <> 2 AS named
  FROM documents WHERE doc_id % 17 <> 0)"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each fifty ids; of four one is cut and one bears another name, and some of their entries are not in order."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 17 <> 0")
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "../").otherwise(""), F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    size = F.when(F.col("doc_id") % 13 == 0, F.lit(26214401)).otherwise(F.col("n_chars"))
    entry = F.struct(path.alias("path"), size.alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    rows = d.groupBy(F.floor(F.col("doc_id") / 50).cast("long").alias("g")).agg(F.collect_list(entry).alias("files"))
    grant = F.concat(F.lit("g"), F.col("g").cast("string"))
    body = F.struct(F.when(F.col("g") % 4 == 2, "other").otherwise(grant).alias("grant"), (F.col("g") % 4 == 1).alias("truncated"), "files")
    return rows.select(grant.alias("grant"), F.to_json(body).alias("body"))


@query(f"""
WITH {_FILES}
SELECT 'g' || g AS "grant", count(*) FILTER (WHERE fine) AS files, count(*) FILTER (WHERE NOT fine) AS invalid, bool_and(complete) AS complete
FROM f WHERE named GROUP BY g""")
def folder_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.manifests(_listings(spark, sf_dir)).select("grant", F.size("files").alias("files"), "invalid", "complete")


@query(f"""
WITH {_FILES},
m AS (SELECT 'g' || g AS "grant", path, hash AS new FROM f WHERE fine AND named),
s AS (SELECT DISTINCT 'g' || g AS "grant" FROM f WHERE fine AND named AND complete),
i AS (
  SELECT 'g' || doc_id // 50 AS "grant", 'in/' || doc_id || '.txt' AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE coalesce(text, '') END) AS old
  FROM documents WHERE doc_id % 3 <> 0)
SELECT "grant", path,
  CASE WHEN old IS NULL THEN 'add' WHEN new IS NULL AND s.grant IS NOT NULL THEN 'remove' WHEN new <> old THEN 'update' ELSE 'keep' END AS action
FROM m FULL JOIN i USING ("grant", path) LEFT JOIN s USING ("grant")""")
def manifest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = fi.manifests(_listings(spark, sf_dir))
    d = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0")
    text = F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.coalesce("text", F.lit("")))
    grant = F.concat(F.lit("g"), F.floor(F.col("doc_id") / 50).cast("string"))
    ingested = d.select(grant.alias("grant"), F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(text, 256).alias("hash"))
    return ch.grant_plan(fi.listed(read), read, ingested)


# Sessions, keyed rows, logs

@query("""
SELECT conv_id AS session_id, epoch_us(min(made)) AS created_us, epoch_us(max(made)) AS updated_us
FROM (SELECT conv_id, make_timestamp((conv_id * 1000 + turn) * 1000000) AS made FROM conversations WHERE turn IS NOT NULL) GROUP BY conv_id""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even turns first, then the odd ones into what they left."""
    c = table(spark, sf_dir, "conversations").filter("turn IS NOT NULL")
    turns = c.select(F.col("conv_id").alias("session_id"), "turn", F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    kept = me.sessions(turns.filter("turn % 2 = 1"), me.sessions(turns.filter("turn % 2 = 0")))
    return kept.select("session_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("touched"))
    return ch.upsert_first_seen(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), ["user_id", "event_type"], "touched").drop("touched")


@query("SELECT conv_id, turn, md5(substr(text, 1, 500)) AS question_md5, length(substr(text, 1, 500)) AS n FROM conversations")
def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("answer"))
    cut = le.trace(c)
    return cut.select("conv_id", "turn", F.md5("question").alias("question_md5"), F.length("answer").cast("long").alias("n"))


@query("SELECT 'u1' AS user_id, source AS namespace, 'list' AS action, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def graph_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for all documents of a source: one log row each, gathered as calls in one plan."""
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    return gr.audited(d, "source", F.lit("u1"), "list", "2024-01-01").drop("at")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'u' || o_custkey END AS user_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'kept' ELSE sha256('order' || chr(0) || o_orderkey || chr(0) || coalesce(o_orderstatus, '')) END AS composite_key
FROM orders""")
def keyed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"user_id": F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))), "composite_key": F.when(F.col("o_orderkey") % 4 == 0, "kept"), "kind": F.lit("order")})
    return gr.keyed(o, "kind", "o_orderkey", "o_orderstatus").select("o_orderkey", "user_id", "composite_key")


@query("""
SELECT c_custkey AS id FROM customer
WHERE c_acctbal > 0 AND (c_custkey % 10 = 0 OR c_custkey * 5 >= CASE WHEN c_custkey % 7 = 0 THEN 360 ELSE c_custkey % 7 * 100 END)""")
def sources_to_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("c_custkey") % 10 != 0, F.timestamp_seconds(F.lit(1_704_067_200) - F.col("c_custkey") * 300))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("active"), last.alias("last_sync"), (F.col("c_custkey") % 7 * 100).alias("interval_min"))
    return le.sync_due(c, F.timestamp_seconds(F.lit(1_704_067_200))).select("id")


_SHOWN = ("region", "nation", "customer", "supplier", "part", "orders")


@query(f"""
SELECT table_name AS "table", column_name AS "column", ordinal_position = 1 AS is_key, true AS nullable
FROM information_schema.columns WHERE table_name IN ({_listed(_SHOWN)})""")
def schema_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in _SHOWN}
    keys = spark.createDataFrame([(t, df.columns[0]) for t, df in tables.items()], "table string, column string")
    return cn.described(spark, tables, keys).select("table", "column", "is_key", "nullable")


# What the store knows

def _remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    made = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars"))
    return d.select(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text")).alias("content_hash"), "text", F.array("lang").alias("tags"), (F.col("n_chars") % 100 / 100.0).alias("importance"), made.alias("created_at"))


@query("""
WITH d AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM documents),
c AS (SELECT *, row_number() OVER (ORDER BY r) AS k FROM d WHERE r <= 15 AND text <> ''),
s AS (SELECT string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM documents WHERE source LIKE '%e%'),
m AS (
  SELECT text, n_chars % 100 / 100.0::DOUBLE AS importance,
    row_number() OVER (ORDER BY n_chars % 100 / 100.0::DOUBLE DESC, n_chars DESC, md5(doc_id || ':' || text)) AS r
  FROM documents WHERE text IS NOT NULL AND lang IN ('de', 'fr'))
SELECT md5(coalesce((SELECT string_agg(substr(text, 1, 200), chr(10) || '---' || chr(10) ORDER BY k) FROM c WHERE k <= 8), '')) AS recent_md5,
  coalesce((SELECT sources FROM s), '') AS sources,
  md5(coalesce((SELECT string_agg(substr(text, 1, 150), chr(10) ORDER BY r) FROM m WHERE r <= 10 AND importance >= 0.75), '')) AS learned_md5""")
def knowledge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "text", F.timestamp_seconds("n_chars").alias("created_at"))
    sources = d.select(F.col("source").alias("name"), F.contains("source", F.lit("e")).alias("active"))
    out = me.summary(chunks, sources, _remembered(spark, sf_dir), ["de", "fr"])
    return out.select(F.md5("recent").alias("recent_md5"), "sources", F.md5("learned").alias("learned_md5"))


@query("""
WITH n AS (
  SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS integrations,
    (SELECT count(*) FROM documents WHERE text IS NOT NULL AND lang = 'de') AS patterns)
SELECT *, '[Capabilities: ' || concat_ws(', ',
  CASE WHEN documents > 0 THEN documents || ' knowledge document' || CASE WHEN documents <> 1 THEN 's' ELSE '' END END,
  CASE WHEN integrations > 0 THEN integrations || ' active integration' || CASE WHEN integrations <> 1 THEN 's' ELSE '' END END,
  CASE WHEN patterns > 0 THEN patterns || ' learned interaction pattern' || CASE WHEN patterns <> 1 THEN 's' ELSE '' END END) || ']' AS line
FROM n""")
def capability_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("active"))
    return le.capabilities(table(spark, sf_dir, "documents"), sources, _remembered(spark, sf_dir), "de")
