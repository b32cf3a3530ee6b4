import random

from pyspark.sql import functions as F

from urlsieve.streaming import jobs, stateful

FAR = 1_800_000_000


def phases(spark, rows, columns, key, path, start, out):
    """Runs the query once for each list of rows, from its checkpoint on each time; the last list only moves the watermark."""
    dropped = 0
    for i, part in enumerate([*rows, [(None if key == "origin" else -1, -1, FAR, *[True] * (columns.count(",") - 2))]]):
        spark.createDataFrame(part, columns).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)
        schema = spark.read.parquet(path).schema
        with stateful.rocksdb(spark):
            q = start(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
            q.awaitTermination()
        dropped += sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    return spark.read.parquet(out), dropped


def shuffled(r, rows, spread):
    """Rows in three parts by time, those near an edge in the wrong one at times."""
    rows = sorted(rows, key=lambda x: x[2] + r.randint(0, spread))
    n = len(rows) // 3
    return [rows[:n], rows[n : 2 * n], rows[2 * n :]]


def test_rate_limit_over_restarts_equals_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(1, 3), i, 1_700_000_000 + r.randint(0, 600)) for i in range(120)]
    batch = jobs.rate_limit(spark.createDataFrame(rows, "client long, id long, s long").select("client", "id", F.timestamp_seconds("s").alias("ts")), 3, 60.0)
    got, dropped = phases(spark, shuffled(r, rows, 50), "client long, id long, s long", "client", str(tmp_path / "in"), lambda s: stateful.rate_limit(s, 3, 60.0, "1 minute"), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and dropped == 0


def test_result_reuse_over_restarts_equals_batch_and_late_rows_are_counted(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"https://h{r.randint(1, 3)}", i, 1_700_000_000 + r.randint(0, 5000), r.random() < 0.8) for i in range(150)]
    batch = jobs.result_reuse(spark.createDataFrame(rows, "origin string, id long, s long, ok boolean").select("origin", "id", F.timestamp_seconds("s").alias("ts"), "ok"), 300.0)
    parts = shuffled(r, rows, 200)
    parts[2] = [*parts[2], ("https://h1", 900, 1_700_000_001, True), ("https://new", 901, 1_700_000_002, True)]
    got, dropped = phases(spark, parts, "origin string, id long, s long, ok boolean", "origin", str(tmp_path / "in"), lambda s: stateful.result_reuse(s, 300.0, "5 minutes"), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and dropped == 2


def test_window_hits_in_pieces(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, None]), i, 1_700_000_000 + r.randint(0, 400)) for i in range(300)]
    df = spark.createDataFrame([*rows, (3, 900, None)], "client long, id long, s long").select("client", "id", F.timestamp_seconds("s").alias("ts"))
    want = {i: sum(c2 == c and s - 20 < s2 <= s for c2, _, s2 in rows) for c, i, s in rows} | {900: 1}
    for stretch in (1, 3, 1000):
        assert {x["id"]: x["hits"] for x in jobs.window_hits(df, 20, stretch).collect()} == want


def test_keys_share_states_and_are_decided_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    r = random.Random(4)
    rows = [(r.choice([None, (1 << 60) + 1, *range(20)]), i, 1_700_000_000 + r.randint(0, 600)) for i in range(300)]
    batch = jobs.rate_limit(spark.createDataFrame(rows, "client long, id long, s long").select("client", "id", F.timestamp_seconds("s").alias("ts")), 2, 60.0)
    got, dropped = phases(spark, shuffled(r, rows, 50), "client long, id long, s long", "client", str(tmp_path / "in"), lambda s: stateful.rate_limit(s, 2, 60.0, "1 minute"), str(tmp_path / "out"))
    key = lambda x: (x[1], str(x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, batch.collect()), key=key) and dropped == 0


def test_origins_share_states_and_are_decided_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    r = random.Random(5)
    rows = [(f"https://h{r.randint(1, 20)}", i, 1_700_000_000 + r.randint(0, 5000), r.random() < 0.7) for i in range(400)]
    batch = jobs.result_reuse(spark.createDataFrame(rows, "origin string, id long, s long, ok boolean").select("origin", "id", F.timestamp_seconds("s").alias("ts"), "ok"), 300.0)
    got, dropped = phases(spark, shuffled(r, rows, 200), "origin string, id long, s long, ok boolean", "origin", str(tmp_path / "in"), lambda s: stateful.result_reuse(s, 300.0, "5 minutes"), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and dropped == 0
