import datetime as dt
import os

from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.operators import datasets, history, parity, urls
from urlsieve.streaming import jobs


def files(path):
    return {f"{os.path.relpath(d, path)}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_delete_rewrites_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.range(60).select("id", F.expr("case when id < 58 then timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(id div 10 as int)) end").alias("scanned_at"), F.lit("Safe").alias("prediction"))
    history.append(rows, path)
    before = files(path)
    ids = spark.createDataFrame([(3,), (3,), (4,), *[(i,) for i in range(20, 30)], (58,), (None,), (777,)], "id long")
    got = history.rewrite_without(spark, path, ids).first()
    assert (got["deleted"], got["kept"], got["days"]) == (13, 47, 3)
    after = files(path)
    day = lambda f: f.split("/")[0]
    touched = {"day=2024-01-01", "day=2024-01-03", "day=__HIVE_DEFAULT_PARTITION__"}
    assert {f: t for f, t in before.items() if day(f) not in touched} == {f: t for f, t in after.items() if day(f) not in touched}
    assert "day=2024-01-03" not in os.listdir(path)
    left = spark.read.parquet(path)
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(60) if i not in (3, 4, 58) and not 20 <= i < 30]
    same = files(path)
    assert tuple(history.rewrite_without(spark, path, ids.limit(0)).first()) == (0, 47, 0) and files(path) == same


def test_digest_tree(spark):
    rows = [(s, f"https://h{i}.com") for s in ("a", "b") for i in range(400)] + [("a", None), ("b", None)]
    of = lambda r, n=3: {x["split"]: x["sha256"] for x in datasets.digest_tree(spark.createDataFrame(r, "split string, url string").repartition(n)).collect()}
    first = of(rows)
    assert first["a"] == first["b"] and of(rows[::-1], 7) == first
    changed = [("a", "https://h1.com/"), *rows[:1], *rows[2:]]
    more = [*rows, ("a", "https://h5.com")]
    assert len({first["a"], of(changed)["a"], of(more)["a"], of(rows[1:])["a"]}) == 4 and of(changed)["b"] == first["b"]


def test_closed_days_and_late_rows(spark, tmp_path):
    listener, path, out = jobs.LateRows(), str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    parts = [[(1, at(1, 5), "Safe"), (2, at(1, 6), "Safe"), (2, at(1, 6), "Safe"), (3, at(2, 1), "Phishing")], [(4, at(3, 2), "Safe"), (5, at(3, 1), "Safe")], [(6, at(1, 7), "Safe"), (7, at(1, 8), "Safe"), (8, at(3, 3), "Safe")], [(99, at(20), "Safe")]]
    spark.streams.addListener(listener)
    try:
        for part in parts:
            spark.createDataFrame(part, "id long, ts timestamp, prediction string").coalesce(1).write.mode("append").parquet(path)
            source = spark.readStream.schema("id long, ts timestamp, prediction string").parquet(path)
            q = jobs.closed_days(source, "3 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            listener.wait(q)
    finally:
        spark.streams.removeListener(listener)
    closed = spark.read.parquet(out)
    assert sorted((str(r["day"]), r["prediction"], r["n"]) for r in closed.collect()) == [("2024-01-01", "Safe", 2), ("2024-01-02", "Phishing", 1), ("2024-01-03", "Safe", 3)]
    assert listener.total == 2
    table = spark.createDataFrame([x for p in parts[:3] for x in dict.fromkeys(p)], "id long, ts timestamp, prediction string")
    assert jobs.reconciled(table, closed).agg(F.sum("missing")).first()[0] == listener.total


def test_parity_recovers_what_was_read(spark):
    prior = spark.createDataFrame([("com", 0.5)], "tld string, p double")
    pages = spark.createDataFrame([(i, f"https://www.example{i}.com/a/b{i}?q=1%20x") for i in range(8)], "id long, url string")
    stored = urls.with_features(pages.withColumn("cut", F.expr("left(url, length(url) - cast(id as int))")), prior, "cut")
    whole = urls.with_features(pages, prior, "url").select("id", *(F.col(c).alias(f"w_{c}") for c in parity.HOST_LEVEL))
    stored = stored.join(whole, "id").withColumns({c: F.col(f"w_{c}") for c in parity.HOST_LEVEL}).select("id", "url", *feat.NAMES)
    got = {r["feature"]: r for r in parity.audit(stored, prior).collect()}
    assert all(r["prefix_share"] == 1 for r in got.values()) and got["URLLength"]["whole_share"] == 1 / 8
    assert {r["offset"]: r["rows"] for r in parity.offsets(stored).collect()} == {-i: 1 for i in range(8)}
    odd = stored.withColumn("NoOfDegitsInURL", F.col("NoOfDegitsInURL") + 5).withColumn("DegitRatioInURL", F.col("DegitRatioInURL") + 0.001).withColumn("URLLength", F.lit(9999))
    got = {r["feature"]: r for r in parity.audit(odd, prior).collect()}
    assert got["NoOfDegitsInURL"]["prefix_share"] == 0 and got["URLLength"]["prefix_share"] == 0 and got["TLDLength"]["prefix_share"] == 1
    assert parity.tolerance("TLDLegitimateProb") == 1e-6 and parity.tolerance("DegitRatioInURL") == 0.0015
