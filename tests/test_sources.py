import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.operators import datasets, history, metrics
from urlsieve.sources import tables, views


def test_a_suffix_list_file(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text("// ===BEGIN ICANN DOMAINS===\n// a comment\nxx\nco.xx\n*.yy\n!www.yy\n\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\npages.xx  // note\n// ===END PRIVATE DOMAINS===\n")
    rules = {(r["rule"], r["kind"], r["section"]) for r in views.load_psl(spark, str(path)).collect()}
    assert rules == {("xx", "normal", "icann"), ("co.xx", "normal", "icann"), ("yy", "wildcard", "icann"), ("www.yy", "exception", "icann"), ("pages.xx", "normal", "private")}


def test_csv_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([("https://a.org/,\"x\"", 1, "org", 0.5), ("b", 0, None, None)], tables.LABELLED)
    tables.write_csv(rows, path)
    assert sorted(map(str, tables.load_csv(spark, path).collect())) == sorted(map(str, rows.collect()))
    tables.write_csv(rows.withColumn("label", F.lit("many")), str(tmp_path / "bad"))
    with pytest.raises(Exception):
        tables.load_csv(spark, str(tmp_path / "bad")).collect()
    tables.require_columns(["a", "b"], ("a", "b"))
    for other in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            tables.require_columns(other, ("a", "b"))


def test_pages_by_key_equal_pages_by_number(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02d}", "u", "Safe", "Low", "web") for i in range(45)], "id long, scanned_at string, url string, prediction string, risk_level string, source string")
    second = history.page(rows, 2, 10).collect()
    last = history.page(rows, 1, 10).agg(F.min("id")).first()[0]
    assert [r["id"] for r in history.page_after(rows, last, 10).collect()] == [r["id"] for r in second] == list(range(34, 24, -1))


def test_shuffle_is_seeded_and_whole(spark):
    rows = spark.createDataFrame([(i,) for i in range(1000)], "id long")
    at = {r["id"]: r["position"] for r in datasets.shuffle_rank(rows, seed=7).collect()}
    assert sorted(at.values()) == list(range(1, 1001))
    assert at == {r["id"]: r["position"] for r in datasets.shuffle_rank(rows.repartition(5), seed=7).collect()}
    assert at != {r["id"]: r["position"] for r in datasets.shuffle_rank(rows, seed=8).collect()}


def test_running_sums_and_percentiles_with_outliers(spark):
    r = random.Random(1)
    values = [round(r.expovariate(1), 2) for _ in range(900)] + [1e9, -1e9, 5e8]
    rows = spark.createDataFrame([(v, 2 * v if i % 3 else None) for i, v in enumerate(values)], "a double, b double")
    for row in metrics.percentiles(rows, ("a", "b")).collect():
        own = values if row["feature"] == "a" else [2 * v for i, v in enumerate(values) if i % 3]
        assert [row[f"p{p}"] for p in (1, 5, 50, 95, 99)] == pytest.approx(np.percentile(own, [1, 5, 50, 95, 99]).tolist())
    counts = spark.createDataFrame([(g, float(v), c) for g in "xy" for v, c in ((1, 2), (2, 5), (1e12, 1), (3, 4))], "g string, v double, c long")
    for down, want in ((False, {1.0: 2, 2.0: 7, 3.0: 11, 1e12: 12}), (True, {1e12: 1, 3.0: 5, 2.0: 10, 1.0: 12})):
        got = metrics.prefix_sum(counts, "v", ("c",), down, by=("g",)).collect()
        assert len(got) == 8 and all(want[x["v"]] == x["cum_c"] for x in got)
    s = metrics.latency_summary(rows, "b").first()
    own = sorted(2 * v for i, v in enumerate(values) if i % 3)
    assert (s["n"], s["median"], s["p95"]) == (len(own), np.median(own), own[round(0.95 * len(own)) - 1])
