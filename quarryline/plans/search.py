"""Batches of queries over the inverted index of ``documents``: every 50th row of a table asks, all rows are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion as fu
from ..operators import textindex as ti
from ..operators import vectors as ve
from ..session import shared_path, table
from .registry import query

_indexes: dict[tuple, ti.Index] = {}


def document_index(spark: SparkSession, sf_dir: str, analyser: str = "simple") -> ti.Index:
    """The index of the documents' texts, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, analyser)
    if key not in _indexes:
        _indexes[key] = ti.build(table(spark, sf_dir, "documents"), shared_path(spark, "text-index"), analyser)
    return _indexes[key]


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
#: Words of all documents with their places.
_WORDS = f"""
td AS (SELECT doc_id AS id, {_TERMS} AS t FROM documents),
tw AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS place, len(t) AS l FROM td)"""
#: Documents with any term of the passages by BM25.
SPARSE = f"""{_WORDS},
tq AS (SELECT DISTINCT query_id, unnest(t) AS term FROM (SELECT item_id AS query_id, {_TERMS} AS t FROM benchmark WHERE item_id % 50 = 0)),
total AS (SELECT count(*) AS n, avg(len(t)) AS a FROM td),
counted AS (SELECT id, term, l, count(*) AS tf FROM tw WHERE term IN (SELECT term FROM tq) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weighed AS (
    SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
    FROM tq JOIN counted USING (term) JOIN held USING (term), total GROUP BY ALL),
sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM weighed)"""


@query("WITH" + SPARSE + " SELECT query_id, rank::INTEGER AS rank, id, round(score, 4) AS score FROM sparse WHERE rank <= 10")
def sparse_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.search_any(document_index(spark, sf_dir), passages(spark, sf_dir), 10)


_VECTOR = "[('0x' || substr(sha256({t}), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE FOR i IN range(0, 8)]"
#: The same with the nearest stand-in vectors, and both fused by rank.
LISTS = f"""{SPARSE},
pv AS (SELECT item_id AS query_id, {_VECTOR.format(t="text")} AS v FROM benchmark WHERE item_id % 50 = 0),
cosines AS (SELECT query_id, doc_id AS id, (1 + list_cosine_similarity({_VECTOR.format(t="text")}, v)) / 2 AS cos FROM documents, pv WHERE length(trim(coalesce(text, ''))) > 0),
dense AS (SELECT query_id, id, round(cos, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 12) DESC, id) AS rank FROM cosines),
fused AS (
    SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score
    FROM (SELECT query_id, id, rank FROM dense WHERE rank <= 30 UNION ALL SELECT query_id, id, rank FROM sparse WHERE rank <= 30) GROUP BY ALL),
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM fused)"""


@query("WITH" + LISTS + " SELECT query_id, rank, id, score FROM top WHERE rank <= 10")
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense (stand-in vectors) and sparse lists of three times k for each passage, fused by rank."""
    return hybrid_hits(spark, sf_dir, passages(spark, sf_dir), 10)


def hybrid_hits(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.hash_vector(F.col("text")).alias("v"))
    dense = ve.search(docs, asked.select("query_id", tx.hash_vector(F.col("text")).alias("vector")), 3 * k, None, "doc_id", "v")
    return fu.rrf([dense, ti.search_any(document_index(spark, sf_dir), asked, 3 * k)], k)


#: A query of two kinds from words 2 to 5 of every 50th document: a phrase and a term without another, or a term or a phrase.  A term in quotes is a term whatever it says: a bare ``or`` parts alternatives.
_KINDS = "CASE WHEN {id} % 100 = 0 THEN '\"' || {w2} || ' ' || {w3} || '\" \"' || {w4} || '\" -' || {w1} || 'x' ELSE '\"' || {w2} || '\" or \"' || {w3} || ' ' || {w4} || '\"' END"


def web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fulltext import terms

    rows = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select("doc_id", terms(F.col("text")).alias("t"))
    rows = rows.select("doc_id", *(F.get("t", F.lit(i)).alias(f"w{i}") for i in range(1, 5))).filter("w4 IS NOT NULL")
    return rows.select(F.col("doc_id").alias("query_id"), F.expr(_KINDS.format(id="doc_id", w1="w1", w2="w2", w3="w3", w4="w4")).alias("text"))


_WEB = f"""
WITH {_WORDS},
q AS (SELECT id AS query_id, id % 100 = 0 AS conj, t[2] AS no, t[3] AS a, t[4] AS b, t[5] AS c FROM td WHERE id % 50 = 0 AND len(t) >= 5),
o AS (
    SELECT query_id, conj, unnest([a, b, c]) AS term, unnest([0, 1, 2]) AS i FROM q),
h AS (SELECT query_id, o.conj, o.i, o.term, tw.id, list(place ORDER BY place) AS places FROM o JOIN tw USING (term) GROUP BY ALL),
g AS (SELECT query_id, conj, id, any_value(places) FILTER (i = 0) AS a, any_value(places) FILTER (i = 1) AS b, any_value(places) FILTER (i = 2) AS c FROM h GROUP BY ALL),
no AS (SELECT query_id, tw.id FROM q JOIN tw ON tw.term = q.no || 'x' GROUP BY ALL),
m AS (
    SELECT g.* FROM g LEFT JOIN no USING (query_id, id)
    WHERE CASE WHEN conj THEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND len(list_intersect([x + 1 FOR x IN a], b)) > 0 AND no.id IS NULL
        ELSE a IS NOT NULL OR (b IS NOT NULL AND c IS NOT NULL AND len(list_intersect([x + 1 FOR x IN b], c)) > 0) END),
e AS (SELECT DISTINCT query_id, conj, id, term, places FROM m JOIN h USING (query_id, conj, id)),
pairs AS (
    SELECT query_id, id, sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x - y) / 1.5::DOUBLE - 2))))) AS total
    FROM (SELECT e.query_id, e.id, unnest(e.places) AS x, f.places AS others FROM e JOIN e f ON e.query_id = f.query_id AND e.id = f.id AND e.term < f.term WHERE e.conj) z, unnest(others) u(y)
    WHERE abs(x - y) BETWEEN 1 AND 100 GROUP BY ALL),
ors AS (SELECT query_id, id, sum(0.1::DOUBLE * list_sum([1.0::DOUBLE / (j * j) FOR j IN range(1, len(places) + 1)]) / 1.64493406685::DOUBLE) AS total FROM e WHERE NOT conj GROUP BY ALL),
size AS (SELECT query_id, count(DISTINCT term) AS n FROM o GROUP BY query_id),
scores AS (
    SELECT m.query_id, m.id, CASE WHEN m.conj THEN coalesce(1 - exp(pairs.total), 1e-20::DOUBLE) ELSE ors.total / n END AS score
    FROM m LEFT JOIN pairs USING (query_id, id) LEFT JOIN ors USING (query_id, id) JOIN size ON size.query_id = m.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, id, round(score, 4) AS score FROM r WHERE rank <= 10
"""


@query(_WEB)
def web_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-style queries with phrases, alternatives and exclusions, ranked by ``ts_rank``."""
    return ti.search_web(document_index(spark, sf_dir), web_queries(spark, sf_dir), 10)


@query()
def web_batch_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries with English stems and without stop words."""
    return ti.search_web(document_index(spark, sf_dir, "english"), web_queries(spark, sf_dir), 10)
