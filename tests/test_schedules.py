"""Cron, claims, the embedding store and the bootstrap."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import cron, speech
from quarryline.operators import embedstore, triggers
from quarryline.operators.committed import Store

GOOD = ["0 9 * * *", "*/15 8-10 * * 1-5", "30 6 1,15 * *", "5 0 29 2 *", "0 12 * jan,jul mon", "7 3 31 * 7", "0 0 13 * fri", "10/20 22 * 12 0", "59 23 31 12 *", "0 5 29 2 sun"]
BAD = {"61 * * * *": "invalid", "* * * *": "invalid", "0 9 * * */2": "invalid", "5-1 * * * *": "invalid", "0 0 30 2 *": "never runs", "*/4 * * * *": "runs more often than every 5 minutes", "0,58 1-2 * * *": "runs more often than every 5 minutes", "": "invalid", "a b c d e": "invalid", "*/0 * * * *": "invalid", "0 9 * * 8": "invalid"}


def members(field, low, high, names=(), first=0):
    for i, n in enumerate(names):
        field = field.lower().replace(n, str(i + first))
    out = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        a, b = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def brute_next(expression, after):
    m, h, d, mo, w = expression.split()
    minutes, hours, days, months = members(m, 0, 59), members(h, 0, 23), members(d, 1, 31), members(mo, 1, 12, cron._MONTHS, 1)
    weekdays = {x % 7 for x in members(w, 0, 7, cron._DAYS)}
    at = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    while True:
        if at.month not in months or at.day not in days or at.isoweekday() % 7 not in weekdays:
            at = (at + dt.timedelta(days=1)).replace(hour=0, minute=0)
        elif at.hour in hours and at.minute in minutes:
            return at
        else:
            at += dt.timedelta(minutes=1)


def test_cron(spark):
    rng = random.Random(4)
    cases = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 800), seconds=rng.randrange(60))) for e in GOOD for _ in range(6)]
    cases += [("0 9 * * *", dt.datetime(2024, 5, 5, 9, 0)), ("0 9 * * *", dt.datetime(2024, 5, 5, 8, 59, 59))]
    df = spark.createDataFrame([(i, e, t.isoformat()) for i, (e, t) in enumerate(cases)], "i int, e string, t string").withColumn("sets", cron.fields(F.col("e")))
    got = {r.i: r.n for r in df.select("i", F.date_format(cron.next_run(F.col("sets"), F.col("t").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("n")).collect()}
    assert got == {i: f"{brute_next(e, t):%Y-%m-%d %H:%M}" for i, (e, t) in enumerate(cases)}
    local = spark.range(1).select(cron.fields(F.lit("0 9 * * *")).alias("s")).select(F.date_format(cron.next_run(F.col("s"), F.lit("2024-07-01 12:00:00").cast("timestamp"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("n")).first().n
    assert local == "2024-07-02 03:30"
    every = spark.createDataFrame([(e,) for e in [*GOOD, *BAD, None]], "e string").select("e", cron.fields(F.col("e")).alias("s")).select("e", cron.problem(F.col("s")).alias("p")).collect()
    assert {r.e: r.p for r in every} == dict.fromkeys(GOOD) | BAD | {None: "invalid"}


def test_claims(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, f"file://{tmp_path}/t", key="id", buckets=2) for _ in range(2))
    rows = [(1, "0 9 * * *", None, None, True), (2, None, None, 30, True), (3, None, None, 30, False), (4, "0 9 1 * *", "Asia/Kolkata", None, True)]
    df = spark.createDataFrame(rows, "id long, cron string, zone string, every_min long, is_active boolean")
    triggers.add(one, df, "2024-03-01 08:00:00")
    with pytest.raises(ValueError, match="trigger 9: never runs"):
        triggers.add(one, spark.createDataFrame([(9, "0 0 31 4 *", None, None, True)], df.schema), "2024-03-01 08:00:00")
    assert triggers.claim(one, "2024-03-01 08:29:59").count() == 0
    # Two callers at once: what one claims the other does not.
    publish, inner = Store._publish, []

    def at_once(self, version, manifest):
        if self is one and not inner:
            inner.append(sorted(r.id for r in triggers.claim(two, "2024-03-03 10:00:00").collect()))
        return publish(self, version, manifest)

    monkeypatch.setattr(Store, "_publish", at_once)
    outer = sorted(r.id for r in triggers.claim(one, "2024-03-03 10:00:00").collect())
    assert inner == [[1, 2]] and outer == []
    after = {r.id: f"{r.next_run_at:%m-%d %H:%M}" for r in one.read("triggers").withColumn("next_run_at", F.col("next_run_at").cast("timestamp_ntz")).collect()}
    assert after == {1: "03-04 09:00", 2: "03-03 10:30", 3: "03-01 08:30", 4: "04-01 03:30"}
    assert triggers.claim(one, "2024-03-03 10:00:00").count() == 0  # missed runs are not made up


def test_embedding_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/e", key="digest", buckets=2)
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(x):
        calls.add(len(x))
        return x.map(lambda t: [float(len(t))] if t.strip() else None)

    rows = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, " "), (5, "de")], "id long, text string")

    def run(df, model="m"):
        before = calls.value
        out, n = embedstore.embedded(store, df, model, embed)
        return {r.id: r.vector for r in out.collect()}, n, calls.value - before

    want = {1: [3.0], 2: [3.0], 3: None, 4: None, 5: [2.0]}
    assert run(rows) == (want, 3, 3)
    assert run(rows) == (want, 0, 0)
    assert run(rows.union(spark.createDataFrame([(6, "new!")], rows.schema))) == (want | {6: [4.0]}, 1, 1)
    assert run(rows, "other") == (want, 3, 3)
    assert run(rows.limit(0)) == ({}, 0, 0)


def test_draws_are_exact(spark):
    """Each resample draws as many rows as there are, over all parts and batches; sums spread as multinomial draws do."""
    sizes = [7, 0, 120, 33, 1, 64]
    total = np.full(4000, sum(sizes))
    parts = np.array([speech._share(total, sizes, i, 3) for i in range(len(sizes))])
    assert (parts.sum(axis=0) == total).all() and (parts[1] == 0).all()
    p = np.array(sizes) / sum(sizes)
    assert np.allclose(parts.mean(axis=1), total[0] * p, atol=4 * np.sqrt(total[0] * p * (1 - p) / 4000) + 1e-9)
    assert np.allclose(parts.var(axis=1), total[0] * p * (1 - p), rtol=0.15)
    assert np.corrcoef(parts[2], parts[3])[0, 1] == pytest.approx(-np.sqrt(p[2] * p[3] / ((1 - p[2]) * (1 - p[3]))), abs=0.06)


def test_bootstrap_interval(spark):
    # Rows that are all alike but for the error: equal rows are drawn independently.
    rows = spark.range(600).select((F.col("id") % 4 == 0).cast("int").alias("e"), F.lit(1).alias("u"), (F.col("id") % 4 < 2).cast("int").alias("e2")).repartition(5)
    low, high = speech.bootstrap(rows, "e", "u").first()
    deviation = (0.25 * 0.75 / 600) ** 0.5
    assert low == pytest.approx(0.25 - 1.96 * deviation, abs=0.004) and high == pytest.approx(0.25 + 1.96 * deviation, abs=0.004)
    assert (low, high) == tuple(speech.bootstrap(rows, "e", "u").first())
    # The paired difference is narrower than two unpaired ones: e2 - e is 1 for a quarter of the rows, never -1.
    low, high = speech.bootstrap(rows, "e2", "u", other=("e", "u")).first()
    assert low == pytest.approx(0.25 - 1.96 * deviation, abs=0.004) and high == pytest.approx(0.25 + 1.96 * deviation, abs=0.004)
    assert tuple(speech.bootstrap(rows.filter("false"), "e", "u").first()) == (None, None)
