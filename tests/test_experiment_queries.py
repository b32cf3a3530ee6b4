import pytest

from urlsieve.functions import features as feat
from urlsieve.operators import models
from urlsieve.plans import experiment_queries as E


@pytest.mark.parametrize(("name", "fits"), [("methodology", 5), ("feature_sufficiency", 2), ("view_subset_rates", 2)])
def test_fits_read_tables_and_make_no_features_again(spark, monkeypatch, name, fits):
    plans, fit = [], models.fit

    def seen(train, columns, estimator, *rest):
        plans.append(models.weighted(train, True)._jdf.queryExecution().optimizedPlan().toString())
        return fit(train, columns, estimator.setMaxIter(3), *rest)

    monkeypatch.setattr(models, "fit", seen)
    got = getattr(E, name)(spark, "/root/testdata/sf0.001").collect()
    assert got and len(plans) == fits
    assert not [p for p in plans if "Join" in p or "Aggregate" in p or "regexp" in p]


def test_balanced_weights_by_class(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (0, 2), (1, 3), (None, 4)], "y int, id long")
    got = {r["id"]: r["w"] for r in models.weighted(rows, True).collect()}
    assert got == {0: 5 / 6, 1: 5 / 6, 3: 5 / 6, 2: 5 / 2}
