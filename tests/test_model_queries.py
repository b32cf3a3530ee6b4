import numpy as np
from pyspark.ml import classification as C
from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.operators import metrics, models
from urlsieve.operators.boosting import Boosting

NAMES = ["a", "b", "c"]


def parts(spark, n=300):
    r = np.random.default_rng(8)
    x = r.normal(size=(n, 3))
    y = (2 * x[:, 0] - x[:, 1] + 0.3 * r.normal(size=n) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x))], "id long, y int, a double, b double, c double")
    return rows.where("id % 3 > 0"), rows.where("id % 3 = 0")


def test_grids_have_the_survey_parameters(spark):
    grid, research = models.grid(), models.research(len(feat.NAMES))
    assert grid["decision_tree"].getMaxDepth() == 12 and grid["random_forest"].getNumTrees() == 200
    assert (grid["gradient_boosting"].rounds, grid["gradient_boosting"].depth, grid["gradient_boosting"].rate) == (200, 3, 0.1)
    hist, large = grid["hist_gradient_boosting"], grid["hist_gradient_boosting_large"]
    assert (hist.rounds, hist.rate, hist.leaves, hist.min_rows) == (300, 0.1, 31, 20)
    assert (large.rounds, large.rate, large.leaves, large.min_rows) == (600, 0.05, 63, 40)
    assert research["random_forest"].getNumTrees() == 300 and research["perceptron"].getLayers() == [17, 128, 64, 2]
    boost = research["regularised_boosting"]
    assert (boost.rounds, boost.depth, boost.rate, boost.rows, boost.columns, boost.l2) == (300, 6, 0.08, 0.85, 0.85, 1.0)
    assert (research["gradient_boosting"].rounds, research["gradient_boosting"].rate) == (150, 0.08)


def test_models_learn_and_are_compared(spark):
    train, test = parts(spark)
    chosen = {k: v for k, v in models.grid(small=True).items() if k in ("logistic_regression", "gradient_boosting", "hist_gradient_boosting")}
    got = {(r["model"], r["weighting"]): r for r in models.compare(train, test, NAMES, chosen).collect()}
    assert len(got) == 6 and all(r["n"] == 100 and r["accuracy"] > 0.75 for r in got.values())
    one = models.research(3, small=True)["perceptron"]
    assert [r["weighting"] for r in models.compare(train, test, NAMES, {"perceptron": one}).collect()] == ["none"]


def test_leave_outs_follow_the_importances(spark):
    train, test = parts(spark)
    ranked = [r["feature"] for r in models.importances(models.fit(train, NAMES, models.grid(small=True)["random_forest"]), NAMES, train).orderBy(F.desc("importance")).collect()]
    assert ranked[0] == "a" and ranked[2] == "c"
    assert [len(v) for v in models.leave_out(feat.NAMES, feat.NAMES).values()] == [17] + [16] * 10 + [12, 7]
    lists = models.leave_out(NAMES, ranked)
    assert list(lists) == ["all", "without a", "without b", "without c"]
    got = {r["features"]: r["accuracy"] for r in models.ablation(train, test, lists, C.LogisticRegression(labelCol="y", weightCol="w")).collect()}
    assert got["without a"] < got["all"] - 0.1


def test_rescored_models_agree_with_their_records(spark):
    train, test = parts(spark)
    made = {"lr": (models.fit(train, NAMES, C.LogisticRegression(labelCol="y", weightCol="w")), 0.4), "boost": (models.fit(train, NAMES, Boosting(rounds=10)), 0.6)}
    records = []
    for name, (model, at) in made.items():
        flags = models.scored(model, test, ("y",)).select("y", (F.col("p") >= at).cast("double").alias("p"))
        records.append(metrics.binary_metrics(flags).select(F.lit(name).alias("model"), "accuracy", "recall").unpivot("model", ["accuracy", "recall"], "metric", "recorded"))
    recorded = records[0].union(records[1])
    assert all(r["agrees"] for r in models.rescore(made, test, recorded).collect())
    off = recorded.withColumn("recorded", F.when((F.col("model") == "lr") & (F.col("metric") == "recall"), F.col("recorded") + 1e-6).otherwise(F.col("recorded")))
    assert [(r["model"], r["metric"]) for r in models.rescore(made, test, off).where("not agrees").collect()] == [("lr", "recall")]


def test_fits_of_a_comparison_run_at_once(spark, monkeypatch):
    from threading import Barrier

    train, test = parts(spark)
    fit, both = models.fit, Barrier(2)

    def meeting(*args):
        both.wait(timeout=60)  # breaks unless another fit is there
        return fit(*args)

    chosen = {"one": C.LogisticRegression(labelCol="y", weightCol="w", maxIter=5), "two": C.LogisticRegression(labelCol="y", weightCol="w", maxIter=9)}
    want = {k: [r.asDict() for r in models.compare(train, test, NAMES, {k: v}, (False,)).collect()] for k, v in chosen.items()}
    monkeypatch.setattr(models, "fit", meeting)
    got = models.compare(train, test, NAMES, chosen, (False,)).collect()
    assert {r["model"]: [r.asDict()] for r in got} == want
