import heapq

import numpy as np
import pytest

from urlsieve.operators import models
from urlsieve.operators.boosting import BoostedTrees, Boosting, quantile_edges

NAMES = ["a", "b", "c"]


def table(spark, n=500, seed=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([np.round(r.normal(size=n), 1), r.integers(0, 6, n), r.integers(0, 2, n)]).astype(float)
    y = (x[:, 0] + 0.4 * x[:, 1] * x[:, 2] + r.normal(size=n) > 0.5).astype(int)
    w = np.where(y == 1, 2.0, 0.75)
    rows = [(i, *map(float, row), int(a), float(b)) for i, (row, a, b) in enumerate(zip(x, y, w))]
    return x, y, w, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double")


def brute(x, y, w, p, edges):
    """Margins after all rounds: every split tried on every row, best leaf first, by its own means."""
    base = np.log(w[y == 1].sum() / w[y == 0].sum())
    margin = np.full(len(y), base)
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = w * (q - y), w * q * (1 - q)

        def score(i):
            return g[i].sum() ** 2 / ((h if p.newton else w)[i].sum() + p.l2)

        def split(i, depth):
            best = (0.0,)
            for c, cuts in enumerate(edges if not p.depth or depth < p.depth else []):
                for e in cuts:
                    left, right = i[x[i, c] <= e], i[x[i, c] > e]
                    if min(len(left), len(right)) >= max(1, p.min_rows) and min(h[left].sum(), h[right].sum()) >= p.min_hessian:
                        gain = score(left) + score(right) - score(i)
                        if gain > best[0] + 1e-6:
                            best = gain, left, right
            return best

        everything, leaves, count = np.arange(len(y)), [], 1
        first = split(everything, 0)
        heap, n = [(-first[0], 0, everything, 0, first)], 1
        while heap:
            gain, _, i, depth, found = heapq.heappop(heap)
            if -gain <= 1e-9 or count >= p.leaves:
                leaves.append(i)
                continue
            count += 1
            for part in found[1:]:
                s = split(part, depth + 1)
                heapq.heappush(heap, (-s[0], n, part, depth + 1, s))
                n += 1
        for i in leaves:
            margin[i] -= p.rate * g[i].sum() / (h[i].sum() + p.l2)
    return margin


@pytest.mark.parametrize("p", [Boosting(rounds=4, leaves=7, min_rows=5), Boosting(rounds=3, leaves=64, depth=3, min_rows=1, min_hessian=1.0, l2=1.0), Boosting(rounds=3, leaves=8, depth=3, min_rows=1, newton=False)])
def test_trees_against_brute_force(spark, p):
    x, y, w, df = table(spark)
    edges = quantile_edges(df, NAMES)
    assert edges == [sorted(set(c))[:-1] for c in x.T.tolist()]
    got = {r["id"]: r["p"] for r in p.fit(df, NAMES).scored(df, ["id"]).collect()}
    want = 1 / (1 + np.exp(-brute(x, y, w, p, edges)))
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-5)


def test_table_and_arrays_give_the_same_trees(spark):
    df = table(spark, 300)[3]
    p = dict(rounds=2, leaves=5, min_rows=3, rows=0.7, columns=0.67)
    here, there = Boosting(**p).fit(df, NAMES), Boosting(**p, local_cells=0).fit(df.repartition(7), NAMES)
    assert here.trees == there.trees and here.base == there.base
    assert BoostedTrees.from_json(here.to_json()) == here
    assert abs(sum(here.importances().values()) - 1) < 1e-9


def test_shares_of_rows_and_columns(spark):
    df = table(spark)[3]
    one, other = (Boosting(rounds=5, rows=0.5, columns=0.34, seed=s).fit(df, NAMES) for s in (1, 2))
    assert one.trees != other.trees
    assert all(len({c for c, left in zip(t.column, t.left) if left >= 0}) <= 1 for t in one.trees)


def test_nulls_one_class_and_empty_tables(spark):
    schema = "id long, a double, b double, c double, y int, w double"
    rows = [(i, None if i % 3 else 1.0, float("nan") if i % 2 else float(i), 5.0, int(i % 3 == 0), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    got = Boosting(rounds=20, min_rows=1).fit(df, NAMES).scored(df, ["id", "y"]).collect()
    assert all((r["p"] > 0.5) == bool(r["y"]) for r in got)
    alone = Boosting(rounds=3).fit(df.where("y = 1"), NAMES)
    assert all(r["p"] > 0.99 for r in alone.scored(df, ["id"]).collect())
    assert Boosting(rounds=3).fit(df.limit(0), NAMES).scored(df, ["id"]).count() == 60


def test_balanced_weights_move_scores(spark):
    df = table(spark)[3].drop("w").where("y = 1 or id % 5 = 0")
    plain, even = (models.scored(models.fit(df, NAMES, Boosting(rounds=5), balanced=b), df, ("y",)).agg({"p": "avg"}).first()[0] for b in (False, True))
    assert plain > even + 0.1
