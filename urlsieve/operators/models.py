"""Model families, training, scoring and experiments on Spark ML (y = 1: phishing)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as FT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.operators import datasets, metrics
from urlsieve.operators.boosting import BoostedTrees, Boosting
from urlsieve.sources.tables import keep_table

SEED = 42


def assembled(columns: Sequence[str], scale: bool = False, impute: bool = False) -> list:
    """Stages that make ``features`` of numeric columns."""
    stages, used = [], list(columns)
    if impute:
        used = [f"{c}_filled" for c in columns]
        stages.append(FT.Imputer(strategy="median", inputCols=list(columns), outputCols=used))
    stages.append(FT.VectorAssembler(inputCols=used, outputCol="raw" if scale else "features", handleInvalid="keep"))
    if scale:
        stages.append(FT.StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return stages


def grid(small: bool = False) -> dict[str, object]:
    """Model families of the improvement grid; ``small`` keeps the families and cuts trees for quick runs.  Early stopping of the
    histogram family is not built: all rounds run."""
    trees, cut = (20, 20) if small else (200, 1)
    common = {"labelCol": "y", "weightCol": "w"}
    return {
        "logistic_regression": C.LogisticRegression(maxIter=100, **common),
        "decision_tree": C.DecisionTreeClassifier(maxDepth=12, minInstancesPerNode=5, seed=SEED, **common),
        "random_forest": C.RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, maxDepth=8 if small else 16, seed=SEED, **common),
        "gradient_boosting": Boosting(rounds=200 // cut, rate=0.1, leaves=8, depth=3, min_rows=1, newton=False),
        "hist_gradient_boosting": Boosting(rounds=300 // cut, rate=0.1),
        "hist_gradient_boosting_large": Boosting(rounds=600 // cut, rate=0.05, leaves=63, min_rows=40),
    }


def research(width: int, small: bool = False) -> dict[str, object]:
    """The six research families; the perceptron has no weights."""
    trees, cut = (10, 20) if small else (300, 1)
    common = {"labelCol": "y", "weightCol": "w"}
    return {
        "logistic_regression": C.LogisticRegression(maxIter=100, **common),
        "linear_svm": C.LinearSVC(maxIter=50, **common),
        "random_forest": C.RandomForestClassifier(numTrees=trees, maxDepth=8, seed=SEED, **common),
        "gradient_boosting": Boosting(rounds=150 // cut, rate=0.08, leaves=8, depth=3, min_rows=1, newton=False),
        "regularised_boosting": Boosting(rounds=300 // cut, rate=0.08, leaves=64, depth=6, min_rows=1, min_hessian=1.0, l2=1.0, rows=0.85, columns=0.85),
        "perceptron": C.MultilayerPerceptronClassifier(layers=[width, 128, 64, 2], maxIter=30 if small else 200, seed=SEED, labelCol="y"),
    }


def weighted(df: DataFrame, balanced: bool) -> DataFrame:
    """``df`` with ``w``: 1, or balanced class weights."""
    if not balanced:
        return df.withColumn("w", F.lit(1.0))
    # a number for each class, found once: as a join it would be found anew in each pass of a fit
    n = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    w = F.lit(None).cast("double")
    for y in n.keys() - {None}:
        w = F.when(F.col("y") == y, sum(n.values()) / (2 * n[y])).otherwise(w)
    return df.withColumn("w", w).where("y is not null")


#: Rows that a task of a fit takes at least; iterations over small tables spend their time on starting tasks.
TASK_ROWS = 20_000


def packed(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than its rows are worth."""
    return df.coalesce(max(1, -(-df.count() // TASK_ROWS)))


def fit(train: DataFrame, columns: Sequence[str], estimator, balanced: bool = True) -> PipelineModel | BoostedTrees:
    if isinstance(estimator, Boosting):
        return estimator.fit(weighted(train, balanced), columns)
    estimator = estimator.copy()
    scale = isinstance(estimator, (C.LogisticRegression, C.LinearSVC, C.MultilayerPerceptronClassifier))
    return Pipeline(stages=[*assembled(columns, scale=scale), estimator]).fit(packed(weighted(train, balanced)))


def scored(model: PipelineModel | BoostedTrees, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``p``: P(phishing), or for models without probabilities the margin through a logistic curve."""
    if isinstance(model, BoostedTrees):
        return model.scored(df, keep)
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(*keep, p.alias("p"))


#: Fits that :func:`compare` runs at once: many of a fit's steps have fewer tasks than there are cores, or run on the driver.
FITS = 4


def compare(train: DataFrame, test: DataFrame, columns: Sequence[str], models: dict[str, object], weightings: Iterable[bool] = (False, True)) -> DataFrame:
    """Metrics of each model and weighting on ``test``: one long score table, one aggregate."""
    test = packed(test)
    weights = lambda estimator: isinstance(estimator, Boosting) or estimator.hasParam("weightCol")
    runs = [(name, estimator, balanced) for name, estimator in models.items() for balanced in weightings if not balanced or weights(estimator)]

    def one(name: str, estimator, balanced: bool) -> DataFrame:
        return scored(fit(train, columns, estimator, balanced), test, ("y",)).select(F.lit(name).alias("model"), F.lit("balanced" if balanced else "none").alias("weighting"), "y", "p")

    with ThreadPool(FITS) as pool:
        inherit = inheritable_thread_target(train.sparkSession)
        parts = pool.map(lambda fitted: fitted(), [inherit(partial(one, *run)) for run in runs], chunksize=1)
    return metrics.binary_metrics(reduce(DataFrame.union, parts), by=("model", "weighting"))


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[str]], estimator) -> DataFrame:
    """Metrics of one model on several lists of columns."""
    parts = [scored(fit(train, cols, estimator), test, ("y",)).select(F.lit(name).alias("features"), F.lit(len(cols)).alias("n_features"), "y", "p") for name, cols in groups.items()]
    return metrics.binary_metrics(reduce(DataFrame.union, parts), by=("features", "n_features"))


def leave_out(columns: Sequence[str], ranked: Sequence[str]) -> dict[str, list[str]]:
    """All columns, each of the ten most important left out, and the five and ten most important left out together."""
    out = {"all": list(columns)}
    out |= {f"without {c}": [x for x in columns if x != c] for c in ranked[:10]}
    return out | {f"without top {k}": [x for x in columns if x not in ranked[:k]] for k in (5, 10) if len(columns) > k}


def importances(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """``feature, importance`` of a tree model."""
    values = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "feature string, importance double")


def class_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``label, feature, mean``."""
    means = df.groupBy("label").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))
    return means.unpivot("label", list(columns), "feature", "mean")


def single_feature_auc(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, auc``: the greater of both directions, 0.5 for a constant; one histogram over all features."""
    long = df.unpivot(["y"], [F.col(c).cast("double").alias(c) for c in columns], "feature", "v")
    h = long.groupBy("feature", "v").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))
    out = metrics.prefix_sum(h, "v", ("pos",), by=("feature",)).groupBy("feature").agg(area.alias("a"), F.count("*").alias("values"))
    return out.select("feature", F.when(F.col("values") > 1, F.greatest("a", 1 - F.col("a"))).otherwise(0.5).alias("auc"))


def permutation_importance(model, df: DataFrame, columns: Sequence[str], repeats: int = 3, seed: int = SEED) -> DataFrame:
    """``feature, mean, std`` of the drop in AUC when a column is shuffled; ``df`` has ``id, y`` and the columns.  ``model``: a fitted
    one, or a function from rows and the names to keep to these and ``p``.

    Rows are numbered once.  A repetition is a bijection of the numbers (:func:`datasets.permuted`), and each row meets the row at
    its place in one join that serves all columns and repetitions; all that is then scored in one pass."""
    score = model if callable(model) else lambda rows, keep: scored(model, rows, keep)
    numbered = keep_table(datasets.shuffle_rank(df.select("id", "y", *columns), "id", seed).withColumn("_at", F.col("position") - 1).drop("position"), "permutation")
    total = F.broadcast(numbered.agg(F.count("*").alias("_n")))
    keys = F.array(*(F.array(*(F.lit(k) for k in datasets.permutation_keys(seed * 1000 + r))) for r in range(repeats)))
    left = numbered.join(total).select("*", F.posexplode(keys).alias("r", "_keys"))
    left = left.withColumn("_other", datasets.permuted(F.col("_at"), F.col("_n"), F.col("_keys"))).drop("_keys", "_n", "_at")
    other = numbered.select(F.col("_at").alias("_other"), F.struct(*columns).alias("_o"))
    met = left.join(other, "_other").withColumn("feature", F.explode(F.array(*map(F.lit, columns))))
    mixed = met.select("feature", "r", "y", *(F.when(F.col("feature") == c, F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    plain = numbered.select(F.lit("").alias("feature"), F.lit(0).alias("r"), "y", *columns)
    h = score(mixed.unionByName(plain), ("feature", "r", "y")).groupBy("feature", "r", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))
    auc = metrics.prefix_sum(keep_table(h, "permutation-scores"), "p", ("pos",), buckets=64, by=("feature", "r")).groupBy("feature", "r").agg(area.alias("auc"))
    auc = keep_table(auc, "permutation-auc")  # a row for each column and repetition
    base = auc.where("feature = ''").select(F.col("auc").alias("base"))
    return auc.where("feature <> ''").join(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("base") - F.col("auc")).alias("mean"), F.stddev_pop(F.col("base") - F.col("auc")).alias("std"))


def coefficients(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """``feature, coefficient`` of a linear model on standardised features."""
    values = [float(x) for x in model.stages[-1].coefficients.toArray()]
    return df.sparkSession.createDataFrame(list(zip(columns, values)), "feature string, coefficient double")


def text_classifier(buckets: int = 1 << 14) -> Pipeline:
    """Character three-grams of ``url``, hashed and weighted, into a logistic regression."""
    return Pipeline(stages=[
        FT.RegexTokenizer(inputCol="url", outputCol="chars", pattern="", toLowercase=True),
        FT.NGram(n=3, inputCol="chars", outputCol="grams"),
        FT.HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets),
        FT.IDF(inputCol="tf", outputCol="features"),
        C.LogisticRegression(labelCol="y", maxIter=20),
    ])


def rescore(models: dict[str, tuple[PipelineModel, float]], df: DataFrame, recorded: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Metrics of each model at its threshold against the recorded ones: ``model, metric, recorded, measured, agrees``."""
    parts = [scored(m, df, ("y",)).select(F.lit(n).alias("model"), "y", (F.col("p") >= t).cast("double").alias("p")) for n, (m, t) in models.items()]
    now = metrics.binary_metrics(reduce(DataFrame.union, parts), by=("model",)).unpivot("model", ["accuracy", "precision", "recall", "f1"], "metric", "measured")
    return recorded.join(now, ["model", "metric"], "left").withColumn("agrees", F.coalesce(F.abs(F.col("recorded") - F.col("measured")) <= tolerance, F.lit(False)))
