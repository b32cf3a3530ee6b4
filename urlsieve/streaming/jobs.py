"""Request streams: scoring and daily counts, and the batch twins of rate limits and result reuse (see ``stateful``)."""

from __future__ import annotations

import threading
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

LIMITED = "client long, id long, ts timestamp, allowed boolean, retry_after int"
REUSED = "origin string, id long, ts timestamp, fresh boolean, scored_at timestamp"


def limit_hits(seconds: Iterable[float], recent: deque[float], most: int, window: float) -> list[tuple[bool, int]]:
    """Sliding log: a hit is allowed if fewer than ``most`` allowed hits are younger than the window; ``recent`` is carried on."""
    out = []
    for now in seconds:
        if most <= 0:
            out.append((True, 0))
            continue
        while recent and now - recent[0] >= window:
            recent.popleft()
        if len(recent) >= most:
            out.append((False, max(1, int(window - (now - recent[0])) + 1)))
        else:
            recent.append(now)
            out.append((True, 0))
    return out


def seconds_of(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64) / 1e6


def rate_limit(requests: DataFrame, most: int = 30, window: float = 60.0) -> DataFrame:
    """Batch twin: ``client, id, ts`` rows in the order of time. A client's hits are cut into stretches at pauses of a whole window,
    as no hit reaches across one. Spark sorts the stretches; a task streams through its own and holds only the log of the
    last allowed hits, so a client that never pauses takes long, but no memory."""
    rows = _stretches(requests.select("client", "id", "ts"), "client", window)

    def step(frame: pd.DataFrame, recent: deque[float] | None) -> tuple[dict[str, list], deque[float]]:
        recent = deque() if recent is None else recent
        marks = limit_hits(seconds_of(frame["ts"]), recent, most, window)
        return {"allowed": [a for a, _ in marks], "retry_after": [r for _, r in marks]}, recent

    return _streamed(rows, "client", step, LIMITED)


#: Windows that one stretch covers before it is cut at the next pause.
STRETCH = 1000


def _stretches(rows: DataFrame, key: str, window: float) -> DataFrame:
    """``rows`` with ``_g``: bursts, which end at pauses of ``window`` seconds, numbered by the span of time they begin in."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    seconds = F.col("ts").cast("double")
    begins = F.when(F.coalesce(seconds - F.lag(seconds).over(w) >= window, F.lit(True)), seconds)
    began = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_s", begins).withColumn("_g", F.floor(began / (window * STRETCH))).drop("_s")


def _streamed(rows: DataFrame, key: str, step: Callable[[pd.DataFrame, object], tuple[dict[str, list], object]], schema: str) -> DataFrame:
    """``step`` over the rows of each stretch (:func:`_stretches`) in the order of time, in pieces; it gives the columns that it adds and
    hands its state on from piece to piece, and gets None at a stretch's beginning."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            if frame.empty:
                continue
            names = [frame[c] for c in (key, "_g")]
            same = np.logical_and.reduce([(n.eq(n.shift()) | (n.isna() & n.shift().isna())).to_numpy() for n in names])
            same[0] = False
            edge, made = np.flatnonzero(~same), []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(frame)]):
                name = tuple(None if pd.isna(n.iat[a]) else n.iat[a] for n in names)
                if name != now:
                    now, state = name, None
                got, state = step(frame.iloc[a:b], state)
                made.append(got)
            yield frame[[key, "id", "ts"]].assign(**{c: [x for part in made for x in part[c]] for c in made[0]})

    # a number of its own, or the adaptive planner would merge small tasks to one
    return rows.repartition(parts, key, "_g").sortWithinPartitions(key, "_g", "ts", "id").mapInPandas(run, schema)


def reuse(times: Iterable, oks: Iterable[bool], scored_at, ttl: float) -> tuple[list[bool], list, object]:
    """Which scans are scored anew, when the result that each has was made, and the time of the result that is kept."""
    fresh, at = [], []
    for ts, ok in zip(times, oks):
        new = scored_at is None or (ts - scored_at).total_seconds() >= ttl
        fresh.append(new)
        at.append(ts if new else scored_at)
        if new:
            scored_at = ts if ok else None  # failures are not kept
    return fresh, at, scored_at


def result_reuse(scans: DataFrame, ttl: float = 300.0) -> DataFrame:
    """Batch twin: which scans of ``origin, id, ts, ok`` are scored anew and which reuse a result of their origin. An origin's
    scans are cut where it pauses for the whole time to live, and streamed through like those of :func:`rate_limit`."""

    def step(frame: pd.DataFrame, at) -> tuple[dict[str, list], object]:
        fresh, scored_at, kept = reuse(frame["ts"], frame["ok"], at, ttl)
        return {"fresh": fresh, "scored_at": scored_at}, kept

    return _streamed(_stretches(scans.select("origin", "id", "ts", "ok"), "origin", ttl), "origin", step, REUSED)


def window_hits(requests: DataFrame, window: int = 60, stretch: int = STRETCH) -> DataFrame:
    """Hits of the same client in the last ``window`` seconds, the row itself included.

    A client's time is cut into pieces of ``stretch`` windows, so a busy client is many tasks' work; a row in the last window of
    a piece also goes to the next one, where it counts but has no row of its own."""
    at, long = F.unix_micros("ts"), window * 1_000_000
    piece = F.floor(F.col("_us") / (long * stretch))
    rows = requests.select("client", "id", at.alias("_us")).withColumn("_g", piece)
    tail = F.when((F.col("_g") + 1) * (long * stretch) - F.col("_us") <= long, F.struct((F.col("_g") + 1).alias("g"), F.lit(False).alias("own")))
    rows = rows.select("client", "id", "_us", F.explode(F.array_compact(F.array(F.struct(F.col("_g").alias("g"), F.lit(True).alias("own")), tail))).alias("_p"))
    w = Window.partitionBy("client", "_p.g").orderBy("_us").rangeBetween(-(long - 1), 0)
    return rows.withColumn("hits", F.count("*").over(w)).where("_p.own").select("client", "id", "hits")


def daily_stream(scans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Scans of each day and prediction; rows later than the watermark are dropped (and counted in the query's progress)."""
    day = F.window("ts", "1 day")
    return scans.withWatermark("ts", delay).groupBy(day.alias("w"), "prediction").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "prediction", "n")


def closed_days(scans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same for append mode: a day comes out once, when the watermark has passed its end.  Each ``id`` counts once, though a source
    sends it again within the delay; as that step sees single rows, the late rows it drops are counted one by one."""
    once = scans.select("id", "ts", "prediction").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "prediction").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "prediction", "n")


class LateRows(StreamingQueryListener):
    """Adds up the rows that queries drop for coming after the watermark, over restarts; ``wait`` for a query's last news."""

    def __init__(self) -> None:
        self.total, self._ended = 0, defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        query.awaitTermination()
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError("no news of the query's end")


def reconciled(table: DataFrame, closed: DataFrame) -> DataFrame:
    """``day, prediction, n, closed, missing``: the batch's counts beside those of the stream's closed days, and what these lack."""
    batch = table.groupBy(F.to_date("ts").alias("day"), "prediction").agg(F.count("*").alias("n"))
    both = batch.join(closed.select("day", "prediction", F.col("n").alias("closed")), ["day", "prediction"], "full")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("closed", F.lit(0))
    return both.select("day", "prediction", n.alias("n"), c.alias("closed"), (n - c).alias("missing"))


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch with ``score`` and append the rows to record. A batch that is run again replaces its own folder, so
    a restart writes nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).where("record").drop("record").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
