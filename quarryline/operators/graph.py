"""Entity graph: extraction by chunk, contributions of each document, edges, paths and look-ups, as equi-joins and aggregates.

The graph is a set of contribution tables keyed by document, so that writing a
document again replaces what it gave before; edges are their sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The patterns of entity names, single words that begin sentences, and limits.
ACRONYM = r"\b[A-Z]{2,}(?:-[A-Z0-9]+)?\b"
PHRASE = r"\b(?:[A-Z][a-z]{2,})(?:\s+[A-Z][a-z]{2,}){0,2}\b"
SENTENCE_WORDS = (
    "What", "Who", "When", "Where", "Why", "How", "Which",
    "The", "This", "That", "These", "Those",
    "Is", "Are", "Was", "Were", "Do", "Does", "Did",
    "Can", "Could", "Would", "Should", "Will", "May", "Might",
)
QUERY_STOP_WORDS = (
    "the", "this", "that", "with", "from", "what", "when", "where",
    "which", "about", "does", "tell", "built", "using", "uses", "used",
    "platform", "into", "for", "and", "are", "was", "were", "has", "have",
)
QUOTED = r'"([^"\n]{3,120})"'
TOKEN = r"\b[A-Za-z][A-Za-z0-9_-]{3,}\b"
PER_CHUNK, PER_QUERY, TOP_ENTITIES, TOP_PAIRS = 12, 10, 80, 150
DIRECT_BOOST, INDIRECT_BOOST = 0.15, 0.25


def candidates(text: Column, cap: int = PER_CHUNK, domain_terms: tuple[str, ...] = ()) -> Column:
    """Entity names of a chunk: acronyms, then capitalised phrases, then domain terms that occur; normalised, the first spelling of each without case, at most ``cap``."""
    phrases = F.filter(F.regexp_extract_all(text, F.lit(f"(?U){PHRASE}"), 0), lambda x: ~x.isin(*SENTENCE_WORDS))
    found = F.concat(F.regexp_extract_all(text, F.lit(f"(?U){ACRONYM}"), 0), phrases)
    if domain_terms:
        terms = F.array(*map(F.lit, domain_terms))
        found = F.concat(found, F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t))))
    return _firsts(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), tx.normalize_entity), lambda x: x != ""), cap)


def _firsts(names: Column, cap: int) -> Column:
    """The first spelling of each name without case, at most ``cap``."""
    none = F.array().cast("array<string>")

    def take(held: Column, name: Column) -> Column:
        more = F.struct(F.array_append(held["keys"], F.lower(name)).alias("keys"), F.array_append(held["names"], name).alias("names"))
        return F.when((F.size(held["names"]) < cap) & ~F.array_contains(held["keys"], F.lower(name)), more).otherwise(held)

    return F.aggregate(names, F.struct(none.alias("keys"), none.alias("names")), take, lambda held: held["names"])


def query_entities(text: Column, domain_terms: tuple[str, ...] = ()) -> Column:
    return candidates(text, PER_QUERY, domain_terms)


def open_query_entities(text: Column, cap: int = PER_QUERY) -> Column:
    """Names to start from in a query of any wording: quoted passages, acronyms, capitalised phrases, then every word of four signs or more that is no stop word; spaces collapsed, the first spelling of each without case, at most ``cap`` of up to 200 characters.  Null and blank queries have none."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(f"(?U){TOKEN}"), 0), lambda x: ~F.lower(x).isin(*QUERY_STOP_WORDS))
    found = F.concat(F.regexp_extract_all(text, F.lit(QUOTED), 1), F.regexp_extract_all(text, F.lit(f"(?U){ACRONYM}"), 0), F.regexp_extract_all(text, F.lit(f"(?U){PHRASE}"), 0), tokens)
    names = F.filter(F.transform(found, lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 200)), lambda x: x != "")
    return F.coalesce(_firsts(names, cap), F.array().cast("array<string>"))


def chunk_entities(chunks: DataFrame, domain_terms: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_index, names: the entities of each chunk that has any."""
    # Through an explode of one list, below which the filter is not pushed: else the names would be found twice.
    names = F.explode(F.array(candidates(F.col("text"), PER_CHUNK, domain_terms)))
    return chunks.select("doc_id", "chunk_index", names.alias("names")).filter(F.size("names") > 0)


def mentions(found: DataFrame) -> DataFrame:
    """doc_id, chunk_index, place, name: a row for each entity of a chunk."""
    return found.select("doc_id", "chunk_index", F.posexplode("names").alias("place", "name"))


def contains(found: DataFrame, top: int = TOP_ENTITIES) -> DataFrame:
    """doc_id, entity (lower case), name, weight: chunks of the document with the name, for its ``top`` names.

    Names are counted as spelt, the commonest first and ties by first place; of
    spellings that differ in case alone the last such count holds.
    """
    counts = mentions(found).groupBy("doc_id", "name").agg(F.count("*").alias("weight"), F.min(F.struct("chunk_index", "place")).alias("first"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "first")
    best = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    return best.groupBy("doc_id", F.lower("name").alias("entity")).agg(F.min_by("name", "r").alias("name"), F.max_by("weight", "r").alias("weight"))


def pairs(found: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """doc_id, a < b (lower case), weight: chunks with both, the ``top`` pairs of a document.  Pairs are made inside a chunk's row, of at most ``PER_CHUNK`` names."""
    low = found.select("doc_id", F.transform("names", F.lower).alias("low"))
    inside = F.flatten(F.transform("low", lambda x: F.transform(F.filter("low", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    each = low.select("doc_id", F.explode(inside).alias("p")).select("doc_id", "p.*")
    counts = each.groupBy("doc_id", "a", "b").agg(F.count("*").alias("weight"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "a", "b")
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contributions with those of the documents in ``new`` in place of what they gave before; writing twice changes nothing."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def without(contributions: DataFrame, gone: DataFrame) -> DataFrame:
    """Contributions of the documents that are not in ``gone``."""
    return contributions.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def orphans(contained: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities that only documents in ``gone`` contain."""
    return contained.select("entity").distinct().join(without(contained, gone).select("entity").distinct(), "entity", "left_anti")


def edges(contributions: DataFrame) -> DataFrame:
    """a, b, weight, docs over all documents, without those that are back to 0."""
    return contributions.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("docs")).filter("weight <> 0")


def _names(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n.lower(),) for n in dict.fromkeys(names)], "entity string")


def documents_by_entities(contained: DataFrame, names: list[str], limit: int = 25) -> DataFrame:
    """Documents with any of the entities: number of distinct ones, summed weight, up to ten names."""
    hits = contained.filter(F.col("entity").isin([n.lower() for n in names]))
    rows = hits.groupBy("doc_id").agg(F.countDistinct("entity").alias("matched"), F.sum(F.coalesce("weight", F.lit(1))).alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set("entity")), 1, 10), ",").alias("names"))
    return rows.orderBy(F.desc("matched"), F.desc("score"), "doc_id").limit(limit)


def network(contained: DataFrame, edge: DataFrame, relation: DataFrame | None = None, both: bool = True) -> DataFrame:
    """All edges both ways, or one way: (x, y, type, edge id).  Documents are nodes named ``doc:<id>``, so paths run through them too."""
    doc = F.concat(F.lit("doc:"), F.col("doc_id"))
    parts = [contained.select(doc.alias("x"), F.col("entity").alias("y"), F.lit("CONTAINS").alias("type")), edge.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit("RELATED_TO").alias("type"))]
    if relation is not None:
        parts.append(relation.select(F.lower("subject").alias("x"), F.lower("object").alias("y"), F.lit("RELATES_AS").alias("type")).distinct())
    one = parts[0]
    for p in parts[1:]:
        one = one.union(p)
    one = one.withColumn("edge", F.concat_ws("\0", "x", "type", "y"))
    return one.union(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "type", "edge")) if both else one


def related(net: DataFrame, names: list[str], depth: int = 2) -> DataFrame:
    """entity, first_type, depth: distinct ends of edge-unique paths of 1 to ``depth`` (at most 10) steps from any of the names; ordered look-ups sort by depth, entity and type."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must be 1 to 10")
    reached = []
    paths = _names(net.sparkSession, names).select(F.col("entity").alias("x"), F.lit(None).cast("string").alias("first_type"), F.array().cast("array<string>").alias("path"))
    for d in range(1, depth + 1):
        step = paths.join(net, "x").filter(~F.array_contains("path", F.col("edge")))
        # Paths that end alike and have the same last edges can only go on alike: for two steps the last edge is all.
        paths = step.select(F.col("y").alias("x"), F.coalesce("first_type", "type").alias("first_type"), F.array_append("path", F.col("edge")).alias("path"))
        if depth <= 2:
            paths = paths.withColumn("path", F.slice("path", -1, 1)).distinct()
        reached.append(paths.select(F.col("x").alias("entity"), "first_type", F.lit(d).alias("depth")).distinct())
    out = reached[0]
    for r in reached[1:]:
        out = out.union(r)
    return out.filter(~F.col("entity").startswith("doc:"))


def relations(contributions: DataFrame) -> DataFrame:
    """subject, type, object (lower case), weight over the documents' relations (doc_id, subject, type, object, weight)."""
    return contributions.groupBy(F.lower("subject").alias("subject"), F.upper("type").alias("type"), F.lower("object").alias("object")).agg(F.sum("weight").alias("weight")).filter("weight <> 0")


def find_relations(rows: DataFrame, name: str, direction: str = "both", kind: str | None = None, limit: int = 50) -> DataFrame:
    """subject, type, object, weight of a name's outgoing, incoming or both relations, optionally of one type, the heaviest first."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction must be outgoing, incoming or both")
    key = name.lower()
    ends = [F.col(c) == key for c, on in (("subject", direction != "incoming"), ("object", direction != "outgoing")) if on]
    found = rows.filter(ends[0] | ends[-1])
    if kind is not None:
        found = found.filter(F.col("type") == kind.upper())
    return found.orderBy(F.desc("weight"), "subject", "type", "object").limit(limit)


def document_entities(contained: DataFrame, doc_id, limit: int = 50) -> DataFrame:
    return contained.filter(F.col("doc_id") == doc_id).orderBy(F.desc("weight"), "entity").select("entity", "name", "weight").limit(limit)


def entities_by_type(typed: DataFrame, kind: str) -> DataFrame:
    """Entities (entity, type) of a type, without case."""
    return typed.filter(F.lower("type") == kind.lower()).select("entity").distinct()


def typed(rows: DataFrame) -> DataFrame:
    """entity, type: the last type (by ``seq``) that is not UNKNOWN, else UNKNOWN."""
    known = F.max_by("type", F.when(F.upper("type") != "UNKNOWN", F.col("seq")))
    return rows.groupBy(F.lower("entity").alias("entity")).agg(F.coalesce(known, F.lit("UNKNOWN")).alias("type"))


def lineage(pair_contributions: DataFrame, relation_contributions: DataFrame, one: str, two: str) -> DataFrame:
    """doc_id, kind, subject, object, weight: what each document gave to the edges between two names, either way round."""
    a, b = one.lower(), two.lower()
    pair = pair_contributions.filter(((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a)))
    rel = relation_contributions.select("doc_id", "type", F.lower("subject").alias("s"), F.lower("object").alias("o"), "weight").filter(((F.col("s") == a) & (F.col("o") == b)) | ((F.col("s") == b) & (F.col("o") == a)))
    return pair.select("doc_id", F.lit("RELATED_TO").alias("kind"), F.col("a").alias("subject"), F.col("b").alias("object"), F.col("weight").cast("double").alias("weight")).union(rel.select("doc_id", F.upper("type"), "s", "o", F.col("weight").cast("double")))


def by_ontology(relation: DataFrame, types: DataFrame, ontology: DataFrame) -> DataFrame:
    """Relations whose type the ontology (type, subject_type, object_type) does not know, or allows between the types of their ends.  The ontology is a small list that Spark broadcasts by its size."""
    kind = types.select(F.col("entity").alias("e"), F.col("type").alias("t"))
    known = ontology.select("type").distinct().withColumn("known", F.lit(True))
    rows = relation.join(kind.select(F.col("e").alias("k"), F.col("t").alias("st")), F.lower("subject") == F.col("k"), "left").drop("k")
    rows = rows.join(kind.select(F.col("e").alias("k"), F.col("t").alias("ot")), F.lower("object") == F.col("k"), "left").drop("k")
    rows = rows.withColumns({"st": F.coalesce("st", F.lit("UNKNOWN")), "ot": F.coalesce("ot", F.lit("UNKNOWN"))}).join(known, "type", "left")
    allowed = ontology.select("type", F.col("subject_type").alias("st"), F.col("object_type").alias("ot")).distinct().withColumn("fine", F.lit(True))
    return rows.join(allowed, ["type", "st", "ot"], "left").filter("known IS NULL OR fine").select(*relation.columns)


def _answered(answer: Column, name: str, fields: str) -> Column:
    """The list ``name`` of a model's JSON answer, null where the answer has none."""
    return F.from_json(answer, f"struct<{name}: array<struct<{fields}>>>")[name]


def malformed(answers: DataFrame, name: str) -> DataFrame:
    """doc_id of the answers (doc_id, answer) that are not JSON or have no list ``name``: these are to be asked again, the others are parsed."""
    return answers.filter(_answered(F.col("answer"), name, "name: string").isNull()).select("doc_id")


def parsed_entities(answers: DataFrame, types: tuple[str, ...] = (), most: int = 20) -> DataFrame:
    """doc_id, place, name, type from a model's JSON answer (doc_id, answer): ``entities``, a list of objects with name and type.  Of the first ``most`` those with a name, the first of each without case; a type that is missing or not among ``types`` (empty: any) is UNKNOWN."""
    items = F.slice(_answered(F.col("answer"), "entities", "name: string, type: string"), 1, most)
    named = F.transform(items, lambda x: F.struct(F.trim(F.coalesce(x["name"], F.lit(""))).alias("name"), x["type"].alias("type")))

    def once(list_: Column) -> Column:
        low = F.transform(list_, lambda x: F.lower(x["name"]))
        return F.filter(list_, lambda x, i: (x["name"] != "") & (F.array_position(low, F.lower(x["name"])) == i + 1))

    # The list is bound once: in the filter itself the answer would be parsed anew for each of its items.
    kept = F.transform(F.array(named), once)[0]
    kind = F.coalesce("e.type", F.lit("UNKNOWN"))
    rows = answers.select("doc_id", F.posexplode(kept).alias("place", "e"))
    return rows.select("doc_id", "place", "e.name", (F.when(kind.isin(*types), kind).otherwise("UNKNOWN") if types else kind).alias("type"))


def parsed_relations(answers: DataFrame) -> DataFrame:
    """doc_id, subject, type, object from a model's JSON answer (doc_id, entities: list of names, answer): ``relations``, a list of objects with subject, relation_type and object.  Types in capitals; relations that lack a part, or whose ends are the same or no known entity, are dropped."""
    items = _answered(F.col("answer"), "relations", "subject: string, relation_type: string, object: string")
    rows = answers.select("doc_id", F.transform("entities", F.lower).alias("known"), F.explode(items).alias("r"))
    rows = rows.select("doc_id", "known", F.trim("r.subject").alias("subject"), F.upper(F.trim("r.relation_type")).alias("type"), F.trim("r.object").alias("object"))
    fine = F.array_contains("known", F.lower("subject")) & F.array_contains("known", F.lower("object")) & (F.lower("subject") != F.lower("object"))
    return rows.filter(fine & (F.col("type") != "") & (F.col("subject") != "") & (F.col("object") != "")).drop("known")


def deduplicated(names: DataFrame, threshold: float = 0.92) -> DataFrame:
    """doc_id, name, canonical of names (doc_id, place, name): each joins the first cluster of its document whose first name is alike, in order of place; the longest name stands for a cluster, the first of equal lengths.  The names of one document are one group; names that are alike but for case and signs are compared once, and lengths too different not at all."""
    import re
    from difflib import SequenceMatcher

    import pandas as pd

    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def plain(name: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"[.\-_,]", "", name.lower())).strip()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[str, list[str]]] = []
        homes: dict[str, int] = {}

        def alike(key: str, first: str) -> bool:
            both = len(key) + len(first)
            if both and 2 * min(len(key), len(first)) / both < threshold:
                return False  # the ratio is no larger than this
            return SequenceMatcher(None, key, first).ratio() >= threshold

        for name in frame.sort_values(["place", "name"])["name"]:
            key = plain(name)
            if key not in homes:
                homes[key] = next((i for i, (first, _) in enumerate(clusters) if alike(key, first)), len(clusters))
                if homes[key] == len(clusters):
                    clusters.append((key, []))
            clusters[homes[key]][1].append(name)
        rows = [(n, max(c, key=len)) for _, c in clusters for n in c]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "name": [r[0] for r in rows], "canonical": [r[1] for r in rows]})

    return names.select("doc_id", "place", "name").groupBy("doc_id").applyInPandas(run, "doc_id long, name string, canonical string")


def remapped(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pair contributions (doc_id, a, b, weight) with canonical names; pairs of a name with itself are dropped."""
    m = mapping.select("doc_id", F.lower("name").alias("k"), F.lower("canonical").alias("c")).distinct()
    one = counts.join(m.withColumnRenamed("k", "a"), ["doc_id", "a"], "left").withColumn("x", F.coalesce("c", "a")).drop("c")
    two = one.join(m.withColumnRenamed("k", "b"), ["doc_id", "b"], "left").withColumn("y", F.coalesce("c", "b"))
    rows = two.filter("x <> y").select("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")
    return rows.groupBy("doc_id", "a", "b").agg(F.sum("weight").alias("weight"))


def keyed(rows: DataFrame, *columns: str, user: str = "user_id") -> DataFrame:
    """Rows of older versions brought up to date: null users are '', and ``composite_key`` is filled where it is missing."""
    filled = rows.withColumn(user, F.coalesce(user, F.lit("")))
    made = tx.composite_key(*(F.col(c) for c in columns))
    return filled.withColumn("composite_key", F.coalesce("composite_key", made) if "composite_key" in rows.columns else made)


def boosted(hits: DataFrame, linked: DataFrame, k: int, boost: float = DIRECT_BOOST) -> DataFrame:
    """Fused hits (query_id, id, doc_id, score) with ``boost`` added where a query entity's document (query_id, doc_id) holds them; not clamped; ranked anew."""
    flag = linked.select("query_id", "doc_id").distinct().withColumn("graph_boosted", F.lit(True))
    rows = hits.join(flag, ["query_id", "doc_id"], "left").withColumn("graph_boosted", F.coalesce("graph_boosted", F.lit(False)))
    return _ranked(rows.withColumn("score", F.round(F.col("score") + F.when(F.col("graph_boosted"), boost).otherwise(0.0), 6)), k)


def boosted_dense(hits: DataFrame, linked: DataFrame, indirect: DataFrame, k: int) -> DataFrame:
    """Dense hits with ``DIRECT_BOOST`` for documents of query entities, else ``INDIRECT_BOOST`` for those of related entities, at most 1."""
    one = linked.select("query_id", "doc_id").distinct().withColumn("direct", F.lit(True))
    two = indirect.select("query_id", "doc_id").distinct().withColumn("near", F.lit(True))
    rows = hits.join(one, ["query_id", "doc_id"], "left").join(two, ["query_id", "doc_id"], "left")
    more = F.when(F.col("direct"), DIRECT_BOOST).when(F.col("near"), INDIRECT_BOOST).otherwise(0.0)
    rows = rows.withColumns({"score": F.round(F.least(F.lit(1.0), F.col("score") + more), 6), "graph_boosted": more > 0}).drop("direct", "near")
    return _ranked(rows, k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve(contained: DataFrame, net: DataFrame, hits: DataFrame, query: str, depth: int = 2, limit: int = 25) -> DataFrame:
    """Documents of the entities of a query and of their related ones, with ``already_found`` where the hits (doc_id) have them: doc_id, matched, score, names, related, already_found."""
    spark = contained.sparkSession
    names = spark.range(1).select(query_entities(F.lit(query)).alias("n")).first()[0]  # one query's entities, ten at most
    direct = documents_by_entities(contained, names or [""], limit).withColumn("related", F.lit(False))
    near = related(net, names or [""], depth).select("entity").distinct().join(_names(spark, names or [""]), "entity", "left_anti")
    more = contained.join(near, "entity").groupBy("doc_id").agg(F.countDistinct("entity").alias("matched"), F.sum("weight").alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set("entity")), 1, 10), ",").alias("names"))
    more = more.join(direct.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("matched"), F.desc("score"), "doc_id").limit(limit).withColumn("related", F.lit(True))
    found = hits.select("doc_id").distinct().withColumn("already_found", F.lit(True))
    return direct.unionByName(more).join(found, "doc_id", "left").withColumn("already_found", F.coalesce("already_found", F.lit(False)))


def audit(user: str, namespace: str, action: str, rows: DataFrame, at) -> DataFrame:
    """One log row for a call: who, where, what, and how many rows it gave."""
    return rows.agg(F.count("*").alias("n")).select(F.lit(user).alias("user_id"), F.lit(namespace).alias("namespace"), F.lit(action).alias("action"), "n", F.lit(at).cast("timestamp").alias("at"))


def audited(rows: DataFrame, namespace: str, user: Column, action: str, at) -> DataFrame:
    """The log rows of one call for each namespace (a column), as ``audit`` gives them."""
    counts = rows.groupBy(F.col(namespace).alias("namespace")).agg(F.count("*").alias("n"))
    return counts.select(user.alias("user_id"), "namespace", F.lit(action).alias("action"), "n", F.lit(at).cast("timestamp").alias("at"))
