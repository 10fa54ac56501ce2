"""Stateful streams: login throttle, usage by calendar window, sessions, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttle_step(failures: list[float], until: float, at: float, failed: bool, most: int, window: float, lockout: float) -> tuple[list[float], float, float]:
    """Failures kept, time locked until, and the lockout that this attempt starts (0: none).  A success clears the failures; the attempt that makes ``most`` within the window locks the client out and clears them."""
    if not failed:
        return [], until, 0.0
    kept = [*(t for t in failures if at - t <= window), at]
    return ([], at + lockout, lockout) if len(kept) >= most else (kept, until, 0.0)


def throttle(attempts: DataFrame, most: int = 5, window: float = 300.0, lockout: float = 900.0) -> DataFrame:
    """client, at, failed, blocked, lockout for each attempt (client, at as seconds, failed) of a stream, or of a table.

    A client's state is its failures inside the window, at most ``most``, and the
    end of its lockout; in a stream it goes with an attempt after which neither matters.
    """
    schema = "client string, at double, failed boolean, blocked boolean, lockout double"

    def run(frames: Iterator[pd.DataFrame], failures: list[float], until: float) -> tuple[pd.DataFrame, list[float], float]:
        rows = []
        every = pd.concat(list(frames)).sort_values("at", kind="stable")
        for client, at, failed in every[["client", "at", "failed"]].itertuples(index=False):
            blocked = until > at
            failures, until, started = throttle_step(failures, until, at, bool(failed), most, window, lockout)
            rows.append((client, at, bool(failed), blocked, started))
        return pd.DataFrame(rows, columns=["client", "at", "failed", "blocked", "lockout"]), failures, until

    if not attempts.isStreaming:
        return attempts.groupBy("client").applyInPandas(lambda f: run(iter([f]), [], 0.0)[0], schema)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else ([], 0.0)
        out, failures, until = run(frames, list(failures), until)
        if failures or until > out["at"].iloc[-1]:
            state.update((failures, until))
        elif state.exists:
            state.remove()
        yield out

    return attempts.groupBy("client").applyInPandasWithState(step, schema, "failures array<double>, until double", "append", GroupStateTimeout.NoTimeout)


class Throttle(StatefulProcessor):
    """The throttle of one client with keyed state: its failures inside the window, the end of its lockout, and a timer that clears both when neither can matter any more."""

    def __init__(self, most: int, window: float, lockout: float):
        self.most, self.window, self.lockout = most, window, lockout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "at array<double>")
        self.until = handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures = list(self.failures.get()[0]) if self.failures.exists() else []
        until = self.until.get()[0] if self.until.exists() else 0.0
        out = []
        every = pd.concat(list(rows)).sort_values("at", kind="stable")
        for at, failed in every[["at", "failed"]].itertuples(index=False):
            blocked = until > at
            failures, until, started = throttle_step(failures, until, at, bool(failed), self.most, self.window, self.lockout)
            out.append((key[0], at, bool(failed), blocked, started))
        last = float(every["at"].iloc[-1])
        idle = max([until, *(t + self.window for t in failures[-1:])])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if idle > last:
            self.failures.update((failures,))
            self.until.update((until,))
            self.handle.registerTimer(int(idle * 1000) + 1)
        else:
            self._clear()
        yield pd.DataFrame(out, columns=["client", "at", "failed", "blocked", "lockout"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def _clear(self) -> None:
        self.failures.clear()
        self.until.clear()

    def close(self) -> None:
        pass


def throttle_stream(attempts: DataFrame, most: int = 5, window: float = 300.0, lockout: float = 900.0, late: str = "1 minute") -> DataFrame:
    """``throttle`` for a stream of attempts (client, ts, failed) by event time: a client that is idle until its failures and its lockout are past loses its state when the watermark passes them, so the table of clients is as large as the clients that matter.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).  Attempts later than the watermark are judged without what has expired.
    """
    rows = attempts.withWatermark("ts", late).select("client", (F.unix_micros("ts") / 1e6).alias("at"), "failed", "ts")
    schema = "client string, at double, failed boolean, blocked boolean, lockout double"
    return rows.groupBy("client").transformWithStateInPandas(Throttle(most, window, lockout), schema, "append", "eventTime")


def usage_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """start, key, n, total by calendar window (UTC) of a stream or a table of events (ts, value); a stream closes a window ``late`` after its end."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), F.col(by).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")


def over_caps(windows: DataFrame, cap: float) -> DataFrame:
    return windows.withColumn("over", F.col("total") > cap)


def cached(requests: DataFrame, ttl: float) -> DataFrame:
    """Requests (key, at as seconds) with ``hit``: the same key was asked for within ``ttl`` seconds before, since when a stored answer is good from its last miss.

    The first request of a key misses; each miss stores an answer for ``ttl``
    seconds.  A key's requests are walked in order in one group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable")
        until, hits = float("-inf"), []
        for at in frame["at"]:
            hits.append(at < until)
            if not hits[-1]:
                until = at + ttl
        return frame.assign(hit=hits)[["key", "at", "hit"]]

    return requests.select("key", "at").groupBy("key").applyInPandas(run, "key string, at double, hit boolean")


def least_recently_used(requests: DataFrame, capacity: int) -> DataFrame:
    """cache, hits, misses, hit_rate, size of each cache's log (cache, seq, key) under a least-recently-used policy.  A cache is one process, so its log is one group, walked in order."""
    from collections import OrderedDict

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        hits = 0
        for key in frame.sort_values("seq")["key"]:
            hits += key in held
            held[key] = True
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
        return pd.DataFrame({"cache": [frame["cache"].iloc[0]], "hits": [hits], "misses": [len(frame) - hits], "size": [len(held)]})

    out = requests.groupBy("cache").applyInPandas(run, "cache long, hits long, misses long, size long")
    return out.withColumn("hit_rate", F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 4))


def cache_stats(requests: DataFrame, keys: list[str]) -> DataFrame:
    """One row for a cache that never evicts: misses are the distinct keys."""
    distinct = requests.select(*keys).distinct().agg(F.count("*").alias("misses"))
    total = requests.agg(F.count("*").alias("total"))
    out = total.join(distinct).withColumn("hits", F.col("total") - F.col("misses"))  # one row each
    return out.select("hits", "misses", F.round(F.try_divide("hits", "total"), 4).alias("hit_rate"), F.col("misses").alias("size"))


def last_turns(turns: DataFrame, most: int) -> DataFrame:
    """The last ``most`` turns of each conversation, in order."""
    newest = turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return newest.filter(F.col("r") <= most).drop("r")
