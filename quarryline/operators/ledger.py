"""Ledgers: usage rows and their price, reports over them, the audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx

GENESIS = "0" * 64


def usage(calls: DataFrame) -> DataFrame:
    """Calls (prompt, answer, prompt_tokens, completion_tokens) with both counts: the provider's, or an estimate from the texts marked ``estimated``."""
    filled = {c: F.coalesce(F.col(c).cast("long"), tx.estimate_tokens(F.coalesce(t, F.lit("")))) for c, t in (("prompt_tokens", "prompt"), ("completion_tokens", "answer"))}
    missing = F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull()
    return calls.withColumns({"estimated": missing} | filled)


def priced(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls (provider, model, prompt_tokens, completion_tokens) with ``usd``: by the model's rate a million tokens, else by the provider's ``*``, else null.  The price list is small; Spark broadcasts it by its size."""
    rate = pricing.groupBy("provider", "model").agg(F.max_by(F.struct("input", "output"), "input").alias("rate"))
    own = rate.withColumnRenamed("rate", "own")
    every = rate.filter("model = '*'").select("provider", F.col("rate").alias("every"))
    rows = calls.join(own, ["provider", "model"], "left").join(every, "provider", "left").withColumn("rate", F.coalesce("own", "every"))
    usd = F.coalesce("prompt_tokens", F.lit(0)) / 1e6 * F.col("rate.input") + F.coalesce("completion_tokens", F.lit(0)) / 1e6 * F.col("rate.output")
    return rows.withColumn("usd", F.round(usd, 6)).drop("own", "every", "rate").select(*calls.columns, "usd")


def merged_pricing(pricing: DataFrame, overrides: DataFrame) -> DataFrame:
    """A price list with the overrides in place of its rows of the same provider and model."""
    return pricing.join(overrides.select("provider", "model"), ["provider", "model"], "left_anti").unionByName(overrides)


def caps(calls: DataFrame, day_cap: float, month_cap: float, now) -> DataFrame:
    """One row: what was spent on the calendar day and month (UTC) of ``now``, and whether either cap is reached."""
    at = F.lit(now).cast("timestamp")
    sums = calls.agg(*(F.coalesce(F.sum(F.when(F.date_trunc(unit, "ts") == F.date_trunc(unit, at), F.col("usd"))), F.lit(0.0)).alias(unit) for unit in ("day", "month")))
    return sums.withColumn("reached", (F.col("day") >= day_cap) | (F.col("month") >= month_cap))


def trace(answers: DataFrame, preview: int = 500) -> DataFrame:
    """One log row for each answered question, with texts cut."""
    return answers.withColumns({c: F.substring(c, 1, preview) for c in ("question", "answer")})


def recent(log: DataFrame, limit: int, text: str, cut: int = 200) -> DataFrame:
    """The newest 1 to 200 rows with their text cut."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(200, limit))).withColumn(text, F.substring(text, 1, cut))


def report(traces: DataFrame) -> DataFrame:
    """calls, error_pct, fallback_pct, mean_ms in all ('ALL'), by role and by provider: one grouping-sets pass."""
    sums = traces.groupingSets([[], ["role"], ["provider"]], "role", "provider")
    out = sums.agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.count_if("is_fallback").alias("fallbacks"), F.avg("latency_ms").alias("mean_ms"), F.grouping_id("role", "provider").alias("g"))
    label = F.when(F.col("g") == 3, "ALL").when(F.col("g") == 1, F.coalesce("role", F.lit("(none)"))).otherwise(F.coalesce("provider", F.lit("(none)")))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "role").otherwise("provider")
    pct = [F.round(F.try_divide(100.0 * F.col(a), "calls"), 2).alias(b) for a, b in (("errors", "error_pct"), ("fallbacks", "fallback_pct"))]
    return out.select(kind.alias("kind"), label.alias("name"), "calls", *pct, F.round("mean_ms", 2).alias("mean_ms"))


def daily_actions(log: DataFrame) -> DataFrame:
    """Actions of each day and type, and how many results mention ERROR."""
    return log.groupBy(F.to_date("ts").alias("day"), "type").agg(F.count("*").alias("n"), F.count_if(F.contains("result", F.lit("ERROR"))).alias("failures"))


def rejections(log: DataFrame, least: int = 2) -> DataFrame:
    """Rejected actions by type, channel and role ('(no role)' where there is none), from ``least`` on."""
    return log.filter("rejected").groupBy("type", "channel", F.coalesce("role", F.lit("(no role)")).alias("role")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def histogram(tasks: DataFrame) -> DataFrame:
    """Tasks by status and the next run of each."""
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.min("next_run").alias("next_run"))


def by_role(roles: DataFrame, calls: DataFrame) -> DataFrame:
    """Usage of every known role, none included, and of roles that are used without being known."""
    sums = calls.groupBy("role").agg(F.count("*").alias("calls"), F.sum("usd").alias("usd"))
    known = roles.select("role").distinct().withColumn("known", F.lit(True))
    return known.join(sums, "role", "full").select("role", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("usd", F.lit(0.0)).alias("usd"))


def chart(roles: DataFrame, departments: DataFrame, tasks: DataFrame) -> DataFrame:
    """role, department, open_tasks: roles with their department ('General' without one) and open tasks, ordered."""
    open_ = tasks.filter(~F.col("status").isin("done", "cancelled")).groupBy("role").agg(F.count("*").alias("open_tasks"))
    rows = roles.join(departments, "role", "left").join(open_, "role", "left")
    return rows.select("role", F.coalesce("department", F.lit("General")).alias("department"), F.coalesce("open_tasks", F.lit(0)).alias("open_tasks")).orderBy("department", "role")


def routed(messages: DataFrame, channel_roles: DataFrame) -> DataFrame:
    """Messages (channel, text, ...) with their ``role``: the one that the words call for, else that of the channel (channel, role; one row each), else the default; ``escalate`` where a person is asked for."""
    own = channel_roles.select("channel", F.col("role").alias("channel_role"))
    rows = messages.join(own, "channel", "left")
    role = F.coalesce(rules.intent_role(F.col("text")), F.col("channel_role"), F.lit(rules.DEFAULT_ROLE))
    return rows.withColumns({"role": role, "escalate": rules.wants_human(F.col("text"))}).drop("channel_role")


def capabilities(documents: DataFrame, sources: DataFrame, memories: DataFrame, tag: str = "interaction") -> DataFrame:
    """One row: documents, active integrations, memories with the tag, and a line that names those that are not 0 (empty if all are)."""
    one = documents.agg(F.count("*").alias("documents")).join(sources.agg(F.count_if("active").alias("integrations")))
    one = one.join(memories.agg(F.count_if(F.array_contains("tags", tag)).alias("patterns")))  # one row each

    def part(n: str, what: str) -> Column:
        return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {what}"), F.when(F.col(n) != 1, "s").otherwise("")))

    parts = F.concat_ws(", ", part("documents", "knowledge document"), part("integrations", "active integration"), part("patterns", "learned interaction pattern"))
    return one.withColumn("line", F.when(parts != "", F.concat(F.lit("[Capabilities: "), parts, F.lit("]"))).otherwise(""))


def due(triggers: DataFrame, now) -> DataFrame:
    """Active triggers whose next run has come, the earliest first."""
    return triggers.filter(F.col("is_active") & (F.col("next_run_at") <= F.lit(now).cast("timestamp"))).orderBy("next_run_at", "id")


def claimed(triggers: DataFrame, now) -> DataFrame:
    """Triggers after a claim: a due one runs once and its next run is the first of its interval after ``now``, however many were missed."""
    at = F.lit(now).cast("timestamp")
    is_due = F.col("is_active") & (F.col("next_run_at") <= at)
    period = F.col("every_s")
    missed = F.floor((F.unix_micros(at) - F.unix_micros("next_run_at")) / 1e6 / period) + 1
    later = F.timestamp_micros(F.unix_micros("next_run_at") + (missed * period * 1_000_000).cast("long"))
    return triggers.withColumns({"claimed": is_due, "next_run_at": F.when(is_due, later).otherwise(F.col("next_run_at"))})


def sync_due(sources: DataFrame, now, every_min: int = 360) -> DataFrame:
    """Active sources never synced, or not within their interval; an interval that is null or 0 is ``every_min``."""
    at = now if isinstance(now, Column) else F.lit(now)
    gap = (F.unix_micros(at.cast("timestamp")) - F.unix_micros("last_sync")) / 60e6
    interval = F.coalesce(F.nullif("interval_min", F.lit(0)), F.lit(every_min))
    return sources.filter(F.col("active") & (F.col("last_sync").isNull() | (gap >= interval)))


def narrow_gaps(fires: DataFrame, least_min: int = 5) -> DataFrame:
    """Schedules whose consecutive fire times ever lie closer than ``least_min`` minutes."""
    w = Window.partitionBy("schedule").orderBy("at")
    gap = (F.unix_micros(F.lead("at").over(w)) - F.unix_micros("at")) / 60e6
    return fires.withColumn("gap", gap).groupBy("schedule").agg(F.min("gap").alias("least_gap")).filter(F.col("least_gap") < least_min)


# Audit chain: each record (log, seq, ts, event, scope, data, prev, hash) holds the hash of the one before.

def canonical(seq: Column, ts: Column, event: Column, scope: Column, data: Column, prev: Column) -> Column:
    """Canonical JSON of a record without its hash: keys in order, no spaces; ``data`` is canonical JSON already, and texts are ASCII without quotes or control characters."""

    def text(x: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))

    return F.concat(F.lit('{"data":'), data, F.lit(',"event":'), text(event), F.lit(',"prev":'), text(prev), F.lit(',"scope":'), text(scope), F.lit(',"seq":'), seq.cast("string"), F.lit(',"ts":'), text(ts), F.lit("}"))


def digest(prev: Column | None = None) -> Column:
    return F.sha2(canonical(F.col("seq"), F.col("ts"), F.col("event"), F.col("scope"), F.col("data"), F.col("prev") if prev is None else prev).cast("binary"), 256)


def chained(records: DataFrame) -> DataFrame:
    """Records (log, seq, ts, event, scope, data) with prev and hash.  A hash needs the one before, so each log is chained in order in one group; logs are many and short."""
    import hashlib

    import pandas as pd

    body = records.withColumns({"head": F.concat(F.lit('{"data":'), "data", F.lit(',"event":"'), "event", F.lit('","prev":"')), "tail": canonical(F.col("seq"), F.col("ts"), F.col("event"), F.col("scope"), F.lit(""), F.lit(""))})
    body = body.withColumn("tail", F.regexp_extract("tail", '("?,"scope":.*)$', 1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        prev, rows = GENESIS, []
        for r in frame.sort_values("seq").itertuples():
            mine = hashlib.sha256(f"{r.head}{prev}{r.tail}".encode()).hexdigest()
            rows.append((r.log, r.seq, r.ts, r.event, r.scope, r.data, prev, mine))
            prev = mine
        return pd.DataFrame(rows, columns=["log", "seq", "ts", "event", "scope", "data", "prev", "hash"])

    return body.groupBy("log").applyInPandas(run, "log long, seq long, ts string, event string, scope string, data string, prev string, hash string")


def verified(records: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """log, ok, records, first_bad (place in the log) of each chain: sequence numbers without a gap, links and hashes; anchors (log, expected, last_hash) find cut-off logs."""
    w = Window.partitionBy("log").orderBy("seq")
    rows = records.withColumns({"place": F.row_number().over(w), "before": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))})
    good = (F.col("seq") == F.col("place")) & (F.col("prev") == F.col("before")) & (F.col("hash") == digest())
    out = rows.withColumn("good", F.coalesce(good, F.lit(False))).groupBy("log").agg(F.bool_and("good").alias("ok"), F.count("*").alias("records"), F.min(F.when(~F.col("good"), F.col("place"))).alias("first_bad"), F.max_by("hash", "seq").alias("last"))
    if anchors is not None:
        out = out.join(anchors, "log", "full").withColumns({"records": F.coalesce("records", F.lit(0)), "ok": F.coalesce("ok", F.lit(True)) & F.coalesce(F.col("expected") == F.coalesce("records", F.lit(0)), F.lit(True)) & F.coalesce(F.col("last_hash") == F.coalesce("last", F.lit(GENESIS)), F.lit(True))})
    return out.select("log", "ok", "records", "first_bad")
