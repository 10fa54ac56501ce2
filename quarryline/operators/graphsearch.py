"""The entity graph as committed tables, and many graph queries in one plan.

``write`` commits a set of documents: their chunks with the language of each,
their entities and their pairs of entities, all in one version.  Look-ups take a
table of queries (query_id, text), find the entities of each text, and walk all
queries together: the frontier is keyed by query and node, a step reads the network
at the frontier's nodes, and the neighbours of a hub are dealt over ``SALTS`` tasks.

Walks use no edge twice.  Walks of a query that stand at one node, began with the
same kind of edge and have used the same edges can only go on alike, so one of
them is kept; before the last step only edges at the node itself still matter.

Defined cases: texts without entities, and null texts, find nothing; an entity
that the graph does not hold finds nothing; ties rank by document or by entity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..session import shared_path
from . import chunks as ck
from . import graph as gr
from .committed import Store

#: A node with more edges than this is a hub.
HUB, SALTS = 10_000, 16
RESULTS, RELATED = 25, 10
#: So many nodes of a step are sent to all tasks; more are joined.
SENT = 200_000


def write(store: Store, docs: DataFrame, texts: bool = True) -> int:
    """Commits documents (doc_id, text): tables ``contains`` and ``pairs``, and ``chunks`` (with language) unless ``texts`` is false, for a store of the graph alone.  Writing a document again replaces what it gave before.  Names are found once, for both tables."""
    parts = ck.chunk(docs)
    with store.staged(gr.chunk_entities(parts)) as found:
        changes = {"contains": gr.contains(found), "pairs": gr.pairs(found)}
        if texts:
            changes["chunks"] = parts.withColumn("language", rules.script_language(F.col("text")))
        return store.commit(changes, docs.select(store.key))


def erase(store: Store, ids: DataFrame) -> int:
    """Commits the removal of documents (doc_id) from all tables."""
    return store.commit({}, ids)


def entities_of(queries: DataFrame) -> DataFrame:
    """query_id, entity: the entities of each query's text, in lower case."""
    names = queries.select("query_id", F.explode(gr.query_entities(F.col("text"))).alias("name"))
    return names.select("query_id", F.lower("name").alias("entity")).distinct()


def _first(rows: DataFrame, limit: int, *order) -> DataFrame:
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return placed.filter(F.col("place") <= limit)


def documents(contained: DataFrame, asked: DataFrame, limit: int = RESULTS) -> DataFrame:
    """query_id, doc_id, matched, score, names, place: for each query the ``limit`` documents with most of its entities (query_id, entity), then the greatest summed weight."""
    hits = contained.join(asked.distinct(), "entity").groupBy("query_id", "doc_id")
    rows = hits.agg(F.count_distinct("entity").alias("matched"), F.sum(F.coalesce("weight", F.lit(1))).alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set("entity")), 1, 10), ",").alias("names"))
    return _first(rows, limit, F.desc("matched"), F.desc("score"), "doc_id")


def salted(net: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """The network with a salt for each edge of a hub (0 elsewhere), and the hubs."""
    hubs = net.groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("x", F.lit(True).alias("hub"))
    rows = net.join(hubs, "x", "left")
    return rows.withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("edge"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub"), hubs


def around(contained: DataFrame, contributions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The network of a graph (``gr.network``) by its nodes: a function that gives the rows at the nodes (x) of a table.  Pairs are summed at these nodes only."""
    doc = F.concat(F.lit("doc:"), F.col("doc_id"))

    def rows(nodes: DataFrame) -> DataFrame:
        first = gr.network(contained.join(nodes, doc == F.col("x"), "left_semi"), gr.edges(contributions.join(nodes, F.col("a") == F.col("x"), "left_semi")), both=False)
        second = gr.network(contained.join(nodes, F.col("entity") == F.col("x"), "left_semi"), gr.edges(contributions.join(nodes, F.col("b") == F.col("x"), "left_semi")), both=False)
        return first.union(second.select(F.col("y").alias("x"), F.col("x").alias("y"), "type", "edge"))

    return rows


def related(net: DataFrame | Callable[[DataFrame], DataFrame], asked: DataFrame, depth: int = 2, hub: int = HUB, enough: int | None = None) -> DataFrame:
    """query_id, entity, first_type, depth: distinct ends of walks of 1 to ``depth`` (at most 10) steps from the query's entities that use no edge twice.  Each step is written down and read again.

    ``net``: the network, or a function that gives its rows at a table of nodes.  With
    ``enough``, a query that has so many ends goes no further: its first ones by depth are there.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth must be 1 to 10")
    spark = asked.sparkSession

    def kept(rows: DataFrame) -> DataFrame:
        path = shared_path(spark, "walks")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    none = F.array().cast("array<string>")
    now = kept(asked.select("query_id", F.col("entity").alias("x"), F.lit(None).cast("string").alias("first_type"), none.alias("used")))
    reached = []
    for d in range(1, depth + 1):
        nodes = kept(now.select("x").distinct())
        sent = F.broadcast(nodes) if nodes.count() <= SENT else nodes
        adjacent, hubs = salted(kept(net(sent) if callable(net) else net.join(sent, "x", "left_semi")), hub)
        salts = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        spread = now.join(hubs, "x", "left").withColumn("salt", F.explode(salts)).drop("hub")
        step = spread.join(adjacent, ["x", "salt"]).filter(~F.array_contains("used", F.col("edge")))
        used = F.array_sort(F.array_append("used", F.col("edge")))
        if d == depth - 1:  # one step is left: only edges at the node can be met again
            at = F.concat(F.lit("\0"), "y", F.lit("\0"))
            used = F.filter(used, lambda e: F.concat(F.lit("\0"), e, F.lit("\0")).contains(at))
        if d == depth:
            used = none
        now = kept(step.select("query_id", F.col("y").alias("x"), F.coalesce("first_type", "type").alias("first_type"), used.alias("used")).distinct())
        reached.append(now.select("query_id", F.col("x").alias("entity"), "first_type", F.lit(d).alias("depth")).distinct().filter(~F.col("entity").startswith("doc:")))
        if enough is not None and d < depth:
            have = reduce(DataFrame.unionByName, reached).groupBy("query_id").agg(F.count("*").alias("n"))
            now = now.join(have.filter(F.col("n") >= enough).select("query_id"), "query_id", "left_anti")
    return reduce(DataFrame.unionByName, reached)


def nearest(ends: DataFrame, limit: int = RELATED) -> DataFrame:
    """The first ``limit`` related entities of each query by depth, entity and type."""
    return _first(ends, limit, "depth", "entity", "first_type")


def found(contained: DataFrame, queries: DataFrame, hits: DataFrame | None, limit: int = RESULTS) -> DataFrame:
    """query_id, doc_id, matched, score, names, place, already_found, mode: the documents of the entities of queries (query_id, text), beside hits (query_id, id) or by the graph alone where hits is None."""
    rows = documents(contained, entities_of(queries), limit)
    if hits is None:
        return rows.withColumns({"already_found": F.lit(False), "mode": F.lit("graph_only")})
    flag = hits.select("query_id", F.col("id").alias("doc_id")).distinct().withColumn("already_found", F.lit(True))
    return rows.join(flag, ["query_id", "doc_id"], "left").withColumns({"already_found": F.coalesce("already_found", F.lit(False)), "mode": F.lit("hybrid_vector_graph")})


def cited(net: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, hits: DataFrame | None, depth: int = 2, limit: int = RESULTS) -> DataFrame:
    """query_id, kind (chunk or graph_path), number, doc_id, preview, entity, first_type, depth: hits (query_id, rank, id, preview) first, then the first ``limit`` related entities."""
    near = nearest(related(net, entities_of(queries), depth, enough=limit), limit)
    paths = near.select("query_id", F.lit("graph_path").alias("kind"), F.col("place").alias("number"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("preview"), "entity", "first_type", "depth")
    if hits is None:
        return paths
    none = F.lit(None)
    own = hits.select("query_id", F.lit("chunk").alias("kind"), F.col("rank").alias("number"), F.col("id").alias("doc_id"), "preview", none.cast("string").alias("entity"), none.cast("string").alias("first_type"), none.cast("int").alias("depth"))
    return own.unionByName(paths)


def retrieved(contained: DataFrame, net: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, hits: DataFrame | None, depth: int = 2, limit: int = RESULTS) -> tuple[DataFrame, DataFrame]:
    """Graph retrieval for a table of queries (query_id, text) beside hits (query_id, rank, id, preview), or by the graph alone where hits is None: documents (``found``) and citations (``cited``)."""
    return found(contained, queries, hits, limit), cited(net, queries, hits, depth, limit)
