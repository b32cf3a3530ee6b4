import random
import time

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import bootstrap, datasets, explain, history, metrics
from urlsieve.streaming import jobs


@pytest.fixture(scope="module")
def scores(spark):
    r = random.Random(4)
    rows = [(i, int(r.random() < 0.3), round(r.random(), 2)) for i in range(800)]
    return rows, spark.createDataFrame(rows, "id long, y int, p double").persist()


def test_auc_and_thresholds_against_brute_force(scores):
    rows, df = scores
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    for cap in (0.01, 0.05, 0.2):
        boundary = metrics.threshold_max_fpr(df, cap).first()["boundary"]
        assert sum(p > boundary for p in neg) <= cap * len(neg)
        lower = max(p for p in {*pos, *neg} if p < boundary)
        assert sum(p > lower for p in neg) > cap * len(neg)
    best = max(sorted({p for _, _, p in rows}), key=lambda t: (round(2 * sum(p >= t for p in pos) / (len(pos) + sum(p >= t for _, _, p in rows)), 12), t))
    assert metrics.threshold_fbeta(df, 1.0).first()["threshold"] == best


def test_identical_scores_gain_nothing(scores):
    _, df = scores
    row = bootstrap.bootstrap_gain(df.withColumn("p2", F.col("p")).withColumn("id", F.monotonically_increasing_id()), reps=20).first()
    assert (row["mean"], row["ci_lo"], row["ci_hi"]) == (0, 0, 0)


def test_split_is_disjoint_and_repeatable(spark):
    rows = spark.createDataFrame([(i, f"g{i % 50}", i % 2) for i in range(500)], "id long, group string, label int")
    a = datasets.grouped_split(rows)
    datasets.require_disjoint(a)
    assert a.count() == 500
    assert sorted(map(tuple, a.select("id", "split").collect())) == sorted(map(tuple, datasets.grouped_split(rows.repartition(3)).select("id", "split").collect()))
    with pytest.raises(ValueError):
        datasets.require_consistent(rows.withColumn("url", F.col("group")).withColumn("label", F.col("id") % 3))


def test_classify_bounds(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.69,), (0.7,), (None,)], "p double")
    assert [r["prediction"] for r in explain.classify(df, 0.3, 0.7).collect()] == ["Safe", "Suspicious", "Suspicious", "Phishing", None]
    assert [r["prediction"] for r in explain.classify(df, 0.3, None).collect()][3] == "Suspicious"


def test_history_search_is_literal(spark):
    rows = spark.createDataFrame([(1, "https://a.com/100%", "a.com"), (2, "https://b.com/100x", "b.com"), (3, "https://c_d.com/", None)], "id long, url string, host string")
    found = lambda q: [r["id"] for r in history.matching(rows, search=q).collect()]
    assert found("100%") == [1] and found("C_D") == [3] and found("'") == []


def limited(rows, most, window):
    out, log = {}, {}
    for c, i, s in sorted(rows, key=lambda x: (x[2], x[1])):
        past = [t for t in log.get(c, []) if s - t < window]
        ok = len(past) < most
        out[i] = (ok, 0 if ok else max(1, int(window - (s - past[0])) + 1))
        log[c] = past + [s] * ok
    return out


def reused(rows, ttl):
    out, held = {}, {}
    for o, i, s, ok in sorted(rows, key=lambda x: (x[2], x[1])):
        at = held.get(o)
        fresh = at is None or s - at >= ttl
        out[i] = (fresh, s if fresh else at)
        if fresh:
            held[o] = s if ok else None
    return out


def test_clients_that_never_pause(spark):
    """A busy client's hits come to a task in pieces, and the log goes from piece to piece."""
    r = random.Random(5)
    rows = [(1, i, 1_700_000_000 + i // 3) for i in range(6000)] + [(c, 10_000 * c + i, 1_700_000_000 + r.randint(0, 90_000)) for c in (2, 3, 4) for i in range(300)] + [(None, 900_007, 1_700_000_000), (None, 900_008, 1_700_000_001)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "client long, id long, s long").select("client", "id", F.timestamp_seconds("s").alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {x["id"]: (x["allowed"], x["retry_after"]) for x in jobs.rate_limit(df, 4, 60.0).collect()}
        assert got == limited(rows, 4, 60)
        assert all(x["allowed"] for x in jobs.rate_limit(df, 0, 60.0).collect())
        scans = [(f"https://h{c}", i, s, i % 4 != 0) for c, i, s in rows if c]
        frame = spark.createDataFrame(scans, "origin string, id long, s long, ok boolean").select("origin", "id", F.timestamp_seconds("s").alias("ts"), "ok")
        got = {x["id"]: (x["fresh"], int(x["scored_at"].timestamp())) for x in jobs.result_reuse(frame, 300.0).collect()}
        assert got == reused(scans, 300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert jobs.rate_limit(df.limit(0)).count() == 0
