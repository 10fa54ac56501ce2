"""The cursor source and the throttle with keyed state."""

import json

import pytest
from pyspark.sql import functions as F
from test_library import ATTEMPTS, throttled

from quarryline.operators import memory
from quarryline.sources import connectors
from quarryline.streaming import cursor, state


def test_cursor_source(spark, tmp_path):
    """A stream that stops and starts again, while the last page grows and pages are added, delivers each row once."""
    api, out, marks = tmp_path / "api.json", f"{tmp_path}/out", f"{tmp_path}/marks"
    place = str(api)

    def fetch(at):
        with open(place) as f:
            pages = json.load(f)
        i = int(at or 0)
        return [tuple(r) for r in pages[i]], str(i + 1) if i + 1 < len(pages) else None

    spark.dataSource.register(cursor.cursor_source("pages_of_api", "n long, page long", fetch, pages=2))

    def run(pages):
        api.write_text(json.dumps(pages))
        q = spark.readStream.format("pages_of_api").load().writeStream.format("parquet").option("checkpointLocation", marks).trigger(processingTime="0 seconds").start(out)
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.schema("n long, page long").parquet(out).collect()))

    pages = [[[i * 10 + j, i] for j in range(3)] for i in range(5)]
    flat = lambda: sorted((n, p) for page in pages for n, p in page)
    assert run(pages) == flat()
    assert run(pages) == flat()  # nothing new
    pages[-1].append([99, 4])
    assert run(pages) == flat()
    pages[-1].append([100, 4])
    pages += [[[200, 5]], [], [[300, 7], [301, 7]]]
    assert run(pages) == flat() and len(flat()) == 20


def test_all_pages():
    pages = {None: ([{"a": 1}], "x"), "x": ([{"a": 2}], "y"), "y": ([], None)}
    assert [r["a"] for r in connectors.all_pages(pages.get)] == [1, 2]
    many = lambda o: ([{"n": int(o or 0)}], str(int(o or 0) + 1) if int(o or 0) < 3000 else None)
    assert sum(1 for _ in connectors.all_pages(many)) == 3001
    with pytest.raises(ValueError):
        list(connectors.all_pages(lambda o: ([{}], "same")))


def test_keyed_throttle(spark, tmp_path):
    """The stream equals the sequential version, and idle clients leave no state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(((c, at + 1000, f) for c, at, f in ATTEMPTS), key=lambda x: x[1])  # time 0 is the first watermark
        late = [("last", 10_000.0, False), ("last", 20_000.0, False)]  # far later: only this client matters then
        source = f"{tmp_path}/in"
        df = spark.createDataFrame([*rows, *late], "client string, at double, failed boolean").select("client", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "failed")
        for low, high in ((1000, 1020), (1020, 1040), (1040, 1200), (9_000, 11_000), (19_000, 21_000)):
            df.filter(F.unix_seconds("ts").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
        q = state.throttle_stream(stream, 3, 10.0, 5.0).writeStream.format("memory").queryName("throttled").option("checkpointLocation", f"{tmp_path}/marks").start()
        q.processAllAvailable()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
        got = sorted(map(tuple, spark.table("throttled").collect()))
        assert got == sorted(throttled([*rows, *late], 3, 10.0, 5.0))
        assert left == 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_semantic_memory(spark):
    """What may not be seen is left out before the k best are taken."""
    rows = [(f"m{i}", ["a"] if i % 3 == 0 else ["b", "c"] if i % 3 == 1 else [], f"t{i % 2}", [1.0, i / 10]) for i in range(30)] + [("none", ["a"], "t0", None)]
    df = spark.createDataFrame(rows, "content_hash string, tags array<string>, tenant string, vector array<double>")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("subject", "agent", "session", "superseded_by")}).withColumns({"expires_at": F.lit(None).cast("timestamp")})
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")

    def found(**given):
        return [r.content_hash for r in memory.semantic(df, query, 4, **given).orderBy("rank").collect()]

    assert found() == ["m0", "m1", "m2", "m3"]
    assert found(tags=["a"]) == ["m0", "m3", "m6", "m9"] and found(tags=["c", "x"]) == ["m1", "m4", "m7", "m10"]
    assert found(tags=["a"], scope={"tenant": "t1"}) == ["m3", "m9", "m15", "m21"] and found(tags=[]) == []
