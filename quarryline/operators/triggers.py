"""Scheduled triggers in a committed table, each due run claimed by one caller.

A claim reads a version, moves the due triggers' next runs, and publishes the next
version only if that version is still the newest: of callers at the same time one
wins and the others look again.  Missed runs are not made up: the next run is
counted from the time of the claim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cron
from .committed import Conflict, Store

SCHEMA = "id long, cron string, zone string, every_min long, is_active boolean, next_run_at timestamp, last_run_at timestamp"


def add(store: Store, triggers: DataFrame, now) -> int:
    """Commits triggers (id, cron or every_min, zone, is_active), their first run after ``now``.  A trigger whose schedule is wrong raises ValueError."""
    rows = triggers.withColumn("sets", cron.fields(F.col("cron")))
    wrong = rows.filter("cron IS NOT NULL").select("id", cron.problem(F.col("sets")).alias("why")).filter("why IS NOT NULL").orderBy("id").first()
    if wrong:
        raise ValueError(f"trigger {wrong['id']}: {wrong['why']}")
    made = rows.select("id", "cron", F.coalesce("zone", F.lit("UTC")).alias("zone"), F.col("every_min").cast("long").alias("every_min"), "is_active", _next(now).alias("next_run_at"), F.lit(None).cast("timestamp").alias("last_run_at"))
    return store.commit({"triggers": made}, made.select("id"))


def _next(now):
    at = F.lit(now).cast("timestamp")
    by_cron = cron.next_run(F.col("sets"), at, F.coalesce("zone", F.lit("UTC")))
    return F.when(F.col("cron").isNotNull(), by_cron).otherwise(F.timestamp_add("MINUTE", F.col("every_min").cast("int"), at))


def claim(store: Store, now, tries: int = 20) -> DataFrame:
    """id, due_at of the triggers that this caller, and no other, is to run now."""
    at = F.lit(now).cast("timestamp")
    for _ in range(tries):
        version = store.version()
        due = store.read("triggers", version).filter(F.col("is_active") & (F.col("next_run_at") <= at))
        if due.isEmpty():
            return due.select("id", F.col("next_run_at").alias("due_at"))
        moved = due.withColumn("sets", cron.fields(F.col("cron"))).withColumns({"next_run_at": _next(now), "last_run_at": at}).drop("sets")
        try:
            store.commit({"triggers": moved}, due.select("id"), expect=version)
        except Conflict:
            continue
        return due.select("id", F.col("next_run_at").alias("due_at"))
    raise Conflict(f"{tries} tries to claim in {store.folder}")
