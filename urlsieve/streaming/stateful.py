"""Rate limits and result reuse over streams, in event time.

Rows wait in their key's state until the watermark has passed them and are then decided in the order of time, so what comes out
is what the batch twins in ``jobs`` give, whatever the order of arrival within the watermark's delay.  Rows later than that
are dropped by Spark, which counts them in the query's progress.  State lives in RocksDB; a timer at the last decision's
end of effect deletes it, so idle keys leave nothing behind.

A call into the state costs the same for one row as for thousands, so keys share the state of a bucket, by their hash: the calls
of a batch grow with the buckets, not with the keys.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from urlsieve.streaming import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: States that share all keys; restarts from a checkpoint need the number that it began with.
BUCKETS = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, as these need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _values(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


class _Waiting(StatefulProcessor):
    """Holds a bucket's rows back until the watermark has passed them.  Times are kept as microseconds."""

    row, out = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.begin(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            us = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(us.tolist(), *(_values(frame[c]) for c in self.out))))
            first = min(us.min(), us.min() if first is None else first)
        if first is not None:
            self.handle.registerTimer(int(first // 1000) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, left = defaultdict(list), []
        for r in self.waiting.get():
            if r[0] <= passed:
                due[r[-1]].append(tuple(r)[:-1])
            else:
                left.append(tuple(r))
        if due:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if left:
            self.handle.registerTimer(min(r[0] for r in left) // 1000 + 1)
        made, ends = self.decide({name: sorted(rows) for name, rows in due.items()}, passed)
        if ends is not None:
            self.handle.registerTimer(ends // 1000 + 1)
        yield made

    def close(self) -> None:
        pass


class _Limit(_Waiting):
    row, out = "us long, id long, client string", ("id", "client")

    def __init__(self, most: int, window: float):
        self.most, self.window = most, window

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "client string, second double")

    def decide(self, due: dict[object, list[tuple]], passed: int) -> tuple[pd.DataFrame, int | None]:
        logs, made = defaultdict(deque), []
        for client, second in self.recent.get():
            logs[client].append(second)
        for client, rows in due.items():
            marks = jobs.limit_hits([us / 1e6 for us, _ in rows], logs[client], self.most, self.window)
            made += [(client, i, us, allowed, after) for (us, i), (allowed, after) in zip(rows, marks)]
        # a log whose last hit does not reach beyond the watermark is done with
        logs = {client: log for client, log in logs.items() if log and log[-1] + self.window > passed / 1e6}
        if logs:
            self.recent.put([(client, s) for client, log in logs.items() for s in log])
        else:
            self.recent.clear()
        clients, ids, times, allowed, after = zip(*made) if made else [()] * 5
        out = pd.DataFrame({"client": pd.array([None if c is None else int(c) for c in clients], "Int64"), "id": list(ids), "ts": pd.to_datetime(list(times), unit="us"), "allowed": list(allowed), "retry_after": pd.array(after, "int32")})
        return out, int((max(log[-1] for log in logs.values()) + self.window) * 1e6) if logs else None


class _Reuse(_Waiting):
    row, out = "us long, id long, ok boolean, origin string", ("id", "ok", "origin")

    def __init__(self, ttl: float):
        self.ttl = ttl

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "origin string, us long")

    def decide(self, due: dict[object, list[tuple]], passed: int) -> tuple[pd.DataFrame, int | None]:
        kept, made = dict(tuple(r) for r in self.kept.get()), []
        for origin, rows in due.items():
            at = pd.Timestamp(kept.pop(origin), unit="us") if origin in kept else None
            times = [pd.Timestamp(us, unit="us") for us, *_ in rows]
            fresh, scored_at, at = jobs.reuse(times, [ok for *_, ok in rows], at, self.ttl)
            made += [(origin, r[1], ts, f, s) for r, ts, f, s in zip(rows, times, fresh, scored_at)]
            if at is not None:
                kept[origin] = int(at.value // 1000)
        kept = {origin: us for origin, us in kept.items() if us + self.ttl * 1e6 > passed}
        if kept:
            self.kept.put(list(kept.items()))
        else:
            self.kept.clear()
        origins, ids, times, fresh, scored_at = zip(*made) if made else [()] * 5
        out = pd.DataFrame({"origin": pd.Series(origins, dtype=object), "id": list(ids), "ts": pd.to_datetime(list(times)), "fresh": list(fresh), "scored_at": pd.to_datetime(list(scored_at))})
        return out, int(max(kept.values()) + self.ttl * 1e6) if kept else None


def _bucketed(rows: DataFrame, key: str):
    """The key goes as text: a batch of whole numbers with a null among them would come as floats."""
    return rows.withColumn(key, F.col(key).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")


def rate_limit(requests: DataFrame, most: int = 30, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """Decisions on a stream of ``client, id, ts`` (see ``jobs.rate_limit``); start it inside :func:`rocksdb`."""
    rows = requests.select("client", "id", "ts").withWatermark("ts", delay)
    return _bucketed(rows, "client").transformWithStateInPandas(_Limit(most, window), jobs.LIMITED, "Append", "EventTime")


def result_reuse(scans: DataFrame, ttl: float = 300.0, delay: str = "10 minutes") -> DataFrame:
    """Decisions on a stream of ``origin, id, ts, ok`` (see ``jobs.result_reuse``); start it inside :func:`rocksdb`."""
    rows = scans.select("origin", "id", "ts", "ok").withWatermark("ts", delay)
    return _bucketed(rows, "origin").transformWithStateInPandas(_Reuse(ttl), jobs.REUSED, "Append", "EventTime")
