import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.operators import bootstrap, datasets, models


def brute(y, score, w, cap):
    """Recall of one repetition by its definition."""
    allowed, best = int(np.floor(cap * w[y == 0].sum())), 0
    for t in np.unique(score):
        flag = score >= t
        if w[flag & (y == 0)].sum() <= allowed:
            best = max(best, w[flag & (y == 1)].sum())
    return best / w[y == 1].sum()


@pytest.mark.parametrize("kind", ["ties", "distinct", "close", "signs"])
def test_recalls_against_brute_force(spark, kind):
    r = np.random.default_rng(5)
    n, reps = 300, 40
    y = r.integers(0, 2, n)
    a = {"ties": np.round(r.random(n), 1), "distinct": r.random(n), "close": 0.5 + r.integers(0, 50, n) * 2.0**-52, "signs": r.normal(size=n) * 10.0 ** r.integers(-300, 300, n)}[kind]
    b = np.round(a + r.normal(size=n) * 0.1, 3)
    df = spark.createDataFrame([(int(i) * 7, int(k), float(p), float(q)) for i, (k, p, q) in enumerate(zip(y, a, b))], "id long, y int, p double, p2 double")
    w = bootstrap.draws(np.arange(n) * 7, reps)
    for frame in (df.coalesce(1), df.repartition(5)):
        got = bootstrap.recalls(frame, 0.1, reps, "p", "p2", "id")
        assert np.allclose(got, [[brute(y, s, w[:, k], 0.1) for k in range(reps)] for s in (a, b)])


def test_draws_are_poisson_and_independent():
    w = bootstrap.draws(np.arange(4000), 200)
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153], atol=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
    assert 0.8 < w.sum(axis=0).var() / 4000 < 1.25


def test_no_rows_one_class_and_nulls(spark):
    schema = "id long, y int, p double, p2 double"
    assert bootstrap.bootstrap_gain(spark.createDataFrame([], schema)).first()["mean"] is None
    assert bootstrap.bootstrap_gain(spark.createDataFrame([(1, 0, 0.5, 0.1), (2, 0, None, 0.2)], schema), reps=5).first()["mean"] is None
    assert bootstrap.bootstrap_gain(spark.createDataFrame([(i, 1, 0.5, 0.1) for i in range(9)], schema), reps=5).first()["mean"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256])
def test_permutation_is_a_bijection(spark, n):
    keys = [F.array(*(F.lit(k) for k in datasets.permutation_keys(s))) for s in (1, 2)]
    got = spark.range(n).select(*(datasets.permuted(F.col("id"), F.lit(n), k).alias(f"k{i}") for i, k in enumerate(keys))).collect()
    assert all(sorted(r[f"k{i}"] for r in got) == list(range(n)) for i in (0, 1))
    if n > 50:
        one, two = ([r[k] for r in got] for k in ("k0", "k1"))
        assert one != two and abs(np.corrcoef(one, range(n))[0, 1]) < 0.35 and sum(a == i for i, a in enumerate(one)) < 8


def test_shuffled_columns_lose_what_they_tell(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(x > 0), float(x), float(z), 1.0) for i, (x, z) in enumerate(r.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, y int, x double, z double, c double")
    score = lambda rows, keep: rows.select(*keep, (F.col("x") + F.col("c")).alias("p"))
    got = {x["feature"]: (x["mean"], x["std"]) for x in models.permutation_importance(score, df, ["x", "z", "c"], 6).collect()}
    assert 0.4 < got["x"][0] < 0.6 and 0 < got["x"][1] < 0.1 and got["z"] == got["c"] == (0, 0)
