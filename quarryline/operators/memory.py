"""Scoped memory entries: add, search, supersede, forget, erase, sweep, export; learned memories and sessions.

An entry is a row (id, tenant, subject, agent, session, text, kind, source,
trust, importance, created_at, expires_at, superseded_by, derived_from, tags).
Each operation takes the table and gives the new one, or what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fulltext as ft
from . import vectors as ve

# Parts of a scope from wide to narrow, kinds and trust levels from low to high.
PARTS = ("tenant", "subject", "agent", "session")
TRUST = ("untrusted", "model", "owner")
MOST, TERMS = 50, 32


def trust_rank(trust: Column) -> Column:
    """1 for untrusted, 2 for model, 3 for owner; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), trust), F.lit(0))


def in_scope(scope: dict[str, str]) -> Column:
    """Rows that the scope covers: the tenant, and each narrower part that is given, are equal."""
    if not scope.get("tenant"):
        raise ValueError("a scope has a tenant")
    ok = F.lit(True)
    for part in PARTS:
        if scope.get(part) is not None:
            ok = ok & (F.col(part) == scope[part])
    return F.coalesce(ok, F.lit(False))


def scope_key(row: str = "") -> Column:
    """tenant=..., then each further part that is set, joined by /."""
    given = [F.when(F.col(f"{row}{p}").isNotNull(), F.concat(F.lit(f"{p}="), F.col(f"{row}{p}"))) for p in PARTS]
    return F.concat_ws("/", *given)


def parse_scope(key: Column) -> Column:
    """The parts of a scope key as a map."""
    return F.str_to_map(key, F.lit("/"), F.lit("="))


def covers(wide: Column, narrow: Column) -> Column:
    """Whether the scope of one key covers that of another: each part that is set in the first is equal in the second.  False for keys that are no scopes."""
    parts = parse_scope(wide)
    equal = F.forall(F.map_entries(parts), lambda e: parse_scope(narrow)[e["key"]].eqNullSafe(e["value"]))
    return F.coalesce(is_scope(wide) & is_scope(narrow) & equal, F.lit(False))


def is_scope(key: Column) -> Column:
    """Keys of a tenant and any further parts, in order and without empty ones."""
    rest = "".join(f"(/{p}=[^/=]+)?" for p in PARTS[1:])
    return F.coalesce(key.rlike(f"^{PARTS[0]}=[^/=]+{rest}$"), F.lit(False))


def narrowed(key: Column, part: str, value: Column) -> Column:
    """The key with one more part; null where the part is set to another value already, or the key is no scope."""
    if part not in PARTS[1:]:
        raise ValueError(f"only {PARTS[1:]} can be narrowed")
    held = parse_scope(key)
    parts = [F.coalesce(held[p], value) if p == part else held[p] for p in PARTS]
    made = F.concat_ws("/", *(F.when(v.isNotNull(), F.concat(F.lit(f"{p}="), v)) for p, v in zip(PARTS, parts, strict=True)))
    return F.when(is_scope(key) & (held[part].isNull() | (held[part] == value)), made)


def exact(scope: dict[str, str]) -> Column:
    """Rows of just this scope."""
    ok = F.lit(True)
    for part in PARTS:
        ok = ok & F.col(part).eqNullSafe(F.lit(scope.get(part)).cast("string"))
    return ok


def visible(now, superseded: bool = False) -> Column:
    """Rows that have not expired and, unless asked for, have no successor."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))
    return alive if superseded else alive & F.col("superseded_by").isNull()


def checked(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The rows with ``error``: null for one that may be added."""
    wrong = F.when(F.length(F.trim("text")) == 0, "empty text").when(F.col("text").isNull(), "empty text").when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind").when(trust_rank(F.col("trust")) == 0, "unknown trust")
    wrong = wrong.when(~F.coalesce(F.col("importance").between(0, 1), F.lit(False)), "importance must be 0 to 1").when(F.col("expires_at") <= F.col("created_at"), "expires before it begins")
    return rows.withColumn("error", wrong)


def add(entries: DataFrame, new: DataFrame, kinds: tuple[str, ...], now) -> DataFrame:
    """Entries with the new rows that are valid and whose sources (``derived_from``) are all visible to their scope."""
    fine = checked(new, kinds).filter("error IS NULL").drop("error")
    asked = fine.select("id", *(F.col(p).alias(f"n_{p}") for p in PARTS), F.explode("derived_from").alias("source_id"))
    there = entries.filter(visible(now)).select(F.col("id").alias("source_id"), *(F.col(p).alias(f"o_{p}") for p in PARTS))
    covers = F.col("n_tenant") == F.col("o_tenant")
    for p in PARTS[1:]:
        covers = covers & (F.col(f"n_{p}").isNull() | F.col(f"n_{p}").eqNullSafe(F.col(f"o_{p}")))
    missing = asked.join(there, "source_id", "left").filter(~F.coalesce(covers, F.lit(False))).select("id").distinct()
    return entries.unionByName(fine.join(missing, "id", "left_anti"))


def search(entries: DataFrame, text: str, scope: dict[str, str], now, kinds: tuple[str, ...] = (), least: str = "untrusted", k: int = 10) -> DataFrame:
    """rank, id, score: visible entries of the scope by BM25 of any of the first 32 words; statistics are of all entries."""
    words = ft.query_words(text)[:TERMS]
    rows = entries.filter(in_scope(scope) & visible(now) & (trust_rank(F.col("trust")) >= TRUST.index(least) + 1))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    scored = ft.bm25(entries, words, "id", "text") if words else entries.select("id", F.lit(0.0).alias("score")).filter("false")
    top = scored.join(rows.select("id", "created_at"), "id").orderBy(F.desc("score"), F.desc("created_at"), "id").limit(min(k, MOST))
    order = Window.orderBy(F.desc("score"), F.desc("created_at"), "id")  # at most 50 rows
    return top.select(F.row_number().over(order).alias("rank"), "id", F.round("score", 4).alias("score"))


def supersede(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries where each change (old_id, id, text, created_at) is a new one in exactly the old one's scope, and the old one points to it; an old entry that has a successor is left alone, and of several changes of one the first holds."""
    first = changes.groupBy("old_id").agg(F.min_by(F.struct("id", "text", "created_at"), F.struct("created_at", "id")).alias("c"))
    open_ = entries.filter("superseded_by IS NULL").join(first, F.col("id") == F.col("old_id"))
    new = {"id": F.col("c.id"), "text": F.col("c.text"), "created_at": F.col("c.created_at"), "superseded_by": F.lit(None).cast("string"), "derived_from": F.array("old_id")}
    made = open_.select(*(new.get(c, F.col(c)).cast(entries.schema[c].dataType).alias(c) for c in entries.columns))
    links = open_.select("old_id", F.col("c.id").alias("new_id"))
    old = entries.join(links, F.col("id") == F.col("old_id"), "left").withColumn("superseded_by", F.coalesce("superseded_by", "new_id"))
    return old.select(*entries.columns).unionByName(made)


def forget(entries: DataFrame, ids: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Without the rows of these ids (id) that the scope covers."""
    gone = ids.select("id").distinct().join(entries.filter(in_scope(scope)).select("id"), "id", "left_semi")
    return entries.join(gone, "id", "left_anti")


def erase(entries: DataFrame, scope: dict[str, str]) -> DataFrame:
    return entries.filter(~in_scope(scope))


def sweep(entries: DataFrame, now) -> DataFrame:
    """Without what has expired."""
    return entries.filter(visible(now, superseded=True))


def export(entries: DataFrame, scope: dict[str, str], now) -> DataFrame:
    """All visible rows of a scope in order of time and id."""
    return entries.filter(in_scope(scope) & visible(now)).orderBy("created_at", "id")


def count(entries: DataFrame, scope: dict[str, str], now) -> DataFrame:
    return entries.filter(in_scope(scope) & visible(now)).agg(F.count("*").alias("n"))


# Learned memories

def learned(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows (seq, text, tags, importance, source, permanent) as memories; texts under 10 characters are skipped, and what is stored under the same hash and source stays as it is (the first row of equal ones holds)."""
    digest = F.substring(F.md5(F.substring("text", 1, 200).cast("binary")), 1, 8)
    good = rows.filter(F.length(F.trim("text")) >= 10).withColumn("content_hash", digest)
    importance = F.when(F.col("permanent"), F.greatest("importance", F.lit(0.95))).otherwise(F.col("importance"))
    shaped = good.select("content_hash", "source", "seq", F.struct("text", F.array_append("tags", F.concat(F.lit("source:"), F.col("source"))).alias("tags"), importance.alias("importance"), (F.col("permanent") | (F.col("importance") >= 0.95)).alias("permanent")).alias("m"))
    first = shaped.groupBy("content_hash", "source").agg(F.min_by("m", "seq").alias("m")).select("content_hash", "source", "m.*")
    return first if stored is None else stored.unionByName(first.join(stored, ["content_hash", "source"], "left_anti"))


def lessons(events: DataFrame) -> DataFrame:
    """Rows for ``learned`` (seq, text, tags, importance, source, permanent) from events (seq, kind, name, said, done, resolved, score).

    Kinds: ``instruction`` of the owner (said, 10 characters or more), ``conversation``
    on a channel (name; customer's and reply's words; unresolved ones and scores under
    0.5 teach nothing), ``approval`` and ``rejection`` of an action (name, detail,
    outcome) and ``integration`` (name, action, result).  Other kinds teach nothing.
    """
    kind, name, score = F.col("kind"), F.coalesce("name", F.lit("")), F.col("score")
    said, done = F.coalesce("said", F.lit("")), F.coalesce("done", F.lit(""))

    def first(text: Column, n: int) -> Column:
        return F.substring(text, 1, n)

    talk = F.concat(F.lit("["), F.upper(name), F.lit(" INTERACTION \u2014 score "), F.format_string("%.1f", score), F.lit("]\nCustomer said: "), first(said, 300), F.lit("\nAI replied: "), first(done, 300))
    yes = F.concat(F.lit("OWNER APPROVED ACTION ["), name, F.lit("]: "), first(said, 300), F.lit("\nOutcome: "), first(done, 200))
    no = F.concat(F.lit("OWNER REJECTED ACTION ["), name, F.lit("]: "), first(said, 300), F.lit("\nReason/outcome: "), first(done, 200))
    act = F.concat(F.lit("INTEGRATION ACTION: "), name, F.lit(" \u2014 "), first(said, 150), F.lit("\nResult: "), first(done, 200))

    def row(text: Column, tags: list, importance: Column, source: str, permanent: bool) -> Column:
        return F.struct(text.alias("text"), F.array(*(t if isinstance(t, Column) else F.lit(t) for t in tags)).alias("tags"), importance.cast("double").alias("importance"), F.lit(source).alias("source"), F.lit(permanent).alias("permanent"))

    made = (
        F.when((kind == "instruction") & (F.length(F.trim(said)) >= 10), row(F.concat(F.lit("OWNER INSTRUCTION (always follow this): "), F.trim(said)), ["owner_instruction", "core", "business"], F.lit(1.0), "owner", True))
        .when((kind == "conversation") & F.col("resolved") & (score >= 0.5), row(talk, ["learned_pattern", "interaction", name, "comms"], F.least(score, F.lit(0.85)), "conversation", False))
        .when(kind == "approval", row(yes, ["learned_pattern", "approval", "owner_approved", name], F.lit(0.95), "owner_approval", True))
        .when(kind == "rejection", row(no, ["learned_pattern", "approval", "owner_rejected", name], F.lit(0.95), "owner_approval", True))
        .when(kind == "integration", row(act, ["integration", "operations", "process", "capability"], F.lit(0.75), "integration", False))
    )
    return events.select("seq", made.alias("m")).filter("m IS NOT NULL").select("seq", "m.*")


def reinforced(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Importance moved by each change (content_hash, delta), within 0.1 and 1."""
    total = changes.groupBy("content_hash").agg(F.sum("delta").alias("delta"))
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("importance") + F.coalesce("delta", F.lit(0.0))))
    return memories.join(total, "content_hash", "left").withColumn("importance", moved).drop("delta")


def semantic(memories: DataFrame, query: DataFrame, k: int = 8, tags: list[str] | None = None, scope: dict[str, str] | None = None, now=None) -> DataFrame:
    """The k memories (content_hash, tags, vector) nearest to each query (query_id, vector) among those with any of the tags, in the scope and not expired: query_id, rank, score and the memory's columns.

    What may not be seen is left out before the k best are taken, so k come back if there are k; ``content_hash`` is unique.
    """
    rows = memories.filter(F.col("vector").isNotNull())
    if tags is not None:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)).cast("array<string>")))
    if scope:
        rows = rows.filter(in_scope(scope))
    if now is not None:
        rows = rows.filter(visible(now))
    numbered = rows.withColumn("number", F.xxhash64("content_hash"))
    found = ve.search(numbered, query, k, None, "number", "vector").withColumnRenamed("id", "number")
    return found.join(numbered, "number").drop("number")


def by_tags(memories: DataFrame, tags: list[str], k: int = 5) -> DataFrame:
    """Memories with any of the tags, the most important and then the newest first."""
    hit = F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return memories.filter(hit).orderBy(F.desc("importance"), F.desc("created_at"), "content_hash").limit(k)


def with_fallback(semantic: DataFrame, tagged: DataFrame, query: str) -> DataFrame:
    """The semantic hits if the query has more than 5 characters and there are any, else the tagged ones; rows of the owner are left out."""
    first = semantic if len(query.strip()) > 5 else semantic.filter("false")
    some = first.agg((F.count("*") > 0).alias("some"))
    rest = tagged.join(some, ~F.col("some")).drop("some")  # one row: whether there are any
    return first.unionByName(rest).filter(~F.array_contains("tags", "source:owner"))


def summary(chunks: DataFrame, sources: DataFrame, memories: DataFrame, tags: list[str]) -> DataFrame:
    """One row: the first 200 characters of chunks (of the 15 newest the first 8 that have a text), the active sources, and of the ten first memories with one of the tags those of importance 0.75 or more (their ``summary``, or 150 characters of their text); empty where there is nothing."""
    newest = chunks.orderBy(F.desc("created_at"), "chunk_id").limit(15).filter("text <> ''").orderBy(F.desc("created_at"), "chunk_id").limit(8)
    shown = F.struct((-F.unix_micros("created_at")).alias("t"), "chunk_id", F.substring("text", 1, 200).alias("p"))
    text = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["p"]), "\n---\n").alias("recent"))
    names = sources.filter("active").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("sources"))
    said = F.substring("text", 1, 150)
    said = F.coalesce(F.nullif("summary", F.lit("")), said) if "summary" in memories.columns else said
    order = F.struct((-F.col("importance")).alias("i"), (-F.unix_micros("created_at")).alias("t"), "content_hash", said.alias("p"))
    best = by_tags(memories, tags, 10).filter("importance >= 0.75")
    best = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["p"]), "\n").alias("learned"))
    return text.join(names).join(best)  # one row each


# Sessions

def sessions(turns: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """session_id, created_at, updated_at: made by a session's first turn and touched by each later one."""
    rows = turns.select("session_id", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    rows = rows if stored is None else rows.unionByName(stored)
    return rows.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def last_reply(messages: DataFrame) -> DataFrame:
    """The last reply of each (channel, chat)."""
    return messages.groupBy("channel", "chat").agg(F.max_by(F.struct("id", "text"), F.struct("at", "id")).alias("m")).select("channel", "chat", "m.*")
