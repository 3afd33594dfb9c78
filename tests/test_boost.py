"""Second-order boosting against a plain version that tries every cut of every leaf."""

import math

import numpy as np
import pandas as pd
import pytest

from loomline.operators import boost
from loomline.operators import evaluate as E
from loomline.operators import learn as L

COLUMNS = ["a", "b", "c", "d"]


def data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, size=(n, 4)).astype(float)
    x[rng.random((n, 4)) < 0.15] = np.nan
    signal = np.nan_to_num(x[:, 0], nan=4.0) - 1.5 * (np.nan_to_num(x[:, 1], nan=0.0) > 2) * np.nan_to_num(x[:, 2], nan=1.0)
    y = (signal + rng.normal(scale=1.5, size=n) > 1).astype(float)
    return pd.DataFrame(x, columns=COLUMNS).assign(id=np.arange(n), y=y, w=rng.choice([1.0, 2.0, 6.5], n))


def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def plain_tree(x, g, h, p):
    """Leaves as (rows, value), grown best leaf first."""

    def grade(rows):
        return soft(g[rows].sum(), p.l1) ** 2 / (h[rows].sum() + p.l2) if rows.any() else 0.0

    def best(rows, depth):
        found = None
        if depth < p.max_depth:
            for f in range(x.shape[1]):
                known = rows & ~np.isnan(x[:, f])
                values = np.unique(x[known, f])
                # The last cut parts the known rows from the missing ones.
                for cut in np.unique(x[~np.isnan(x[:, f]), f]):
                    for missing_left in (True, False):
                        left = rows & np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)
                        right = rows & ~left
                        if min(left.sum(), right.sum()) < max(1, p.min_rows) or min(h[left].sum(), h[right].sum()) < p.min_child_weight or not len(values):
                            continue
                        gain = 0.5 * (grade(left) + grade(right) - grade(rows))
                        if gain > p.min_gain and (found is None or gain > found[0] + 1e-12):
                            found = (gain, left, right)
        return found

    everything = np.ones(len(x), dtype=bool)
    leaves = [(everything, 0, best(everything, 0))]
    while len(leaves) < (p.max_leaves or 1 << p.max_depth):
        ready = [i for i, leaf in enumerate(leaves) if leaf[2]]
        if not ready:
            break
        i = max(ready, key=lambda k: leaves[k][2][0])
        _, depth, (_, left, right) = leaves.pop(i)
        leaves += [(side, depth + 1, best(side, depth + 1)) for side in (left, right)]
    return [(rows, -p.learning_rate * soft(g[rows].sum(), p.l1) / (h[rows].sum() + p.l2)) for rows, _, _ in leaves]


def plain_margins(pdf, p):
    x, y, w = pdf[COLUMNS].values, pdf.y.values, pdf.w.values
    margin = np.zeros(len(pdf))
    for _ in range(p.rounds):
        s = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(pdf))
        for rows, value in plain_tree(x, w * (s - y), w * s * (1 - s), p):
            step[rows] = value
        margin = margin + step
    return margin


PARAMS = [
    {"rounds": 3, "max_depth": 3},
    {"rounds": 3, "max_depth": 6, "max_leaves": 7, "learning_rate": 0.3, "l2": 1.7, "l1": 4.1},
    {"rounds": 2, "max_depth": 4, "min_child_weight": 12.0, "min_rows": 25, "min_gain": 0.2},
    {"rounds": 7, "max_depth": 1, "learning_rate": 0.7},
]


@pytest.mark.parametrize("params", PARAMS, ids=["depth", "leaves", "least", "stumps"])
def test_trees_are_the_best_ones(spark, monkeypatch, params):
    monkeypatch.setattr(boost, "REWRITE_TREES", 2)
    pdf = data()
    df = spark.createDataFrame(pdf).repartition(5)
    model = boost.fit(df, COLUMNS, "y", "w", **params)
    got = boost.margins(model, df).toPandas().sort_values("id")
    assert np.allclose(got.margin.values, plain_margins(pdf, boost.Params(**params)), atol=1e-8)


def test_partitioning_changes_nothing(spark):
    pdf = data(seed=4)
    a, b = (boost.fit(spark.createDataFrame(pdf).repartition(n), COLUMNS, "y", "w", key="id", rounds=3, row_share=0.7, feature_share=0.6) for n in (1, 9))
    assert a.trees == b.trees and a.trees[0] != a.trees[1]
    used = [{n.feature for n in t if n.feature >= 0} for t in a.trees]
    assert all(used) and any(len(u) < 4 for u in used)


def test_held_out_rows_end_the_rounds(spark):
    rng = np.random.default_rng(1)
    pdf = data(200).assign(y=rng.integers(0, 2, 200).astype(float), held=np.arange(200) % 3 == 0)
    df = spark.createDataFrame(pdf)
    model = L.fit("newton", df, COLUMNS, "y", rounds=12, learning_rate=0.9, patience=3, validationIndicatorCol="held")
    assert len(model.trees) < 12 and len(model.trees) == int(np.argmin(model.losses))
    # The loss before the first tree is that of even odds.
    assert model.losses[0] == pytest.approx(math.log(2), rel=1e-9)
    apart = boost.fit(df.filter("NOT held"), COLUMNS, "y", rounds=len(model.trees) or 1, learning_rate=0.9)
    assert apart.trees[: len(model.trees)] == model.trees


def test_fifty_rounds_find_the_signal(spark):
    pdf = data(400, seed=2)
    df = spark.createDataFrame(pdf)
    model = boost.fit(df, COLUMNS, "y", rounds=50, max_depth=1, learning_rate=0.2)
    assert len(model.trees) == 50
    assert np.allclose(boost.margins(model, df).toPandas().sort_values("id").margin, plain_margins(pdf.assign(w=1.0), boost.Params(rounds=50, max_depth=1, learning_rate=0.2)), atol=1e-7)
    assert E.auc(L.score(model, df), "y", "score").first()["auc"] > 0.8
    table = L.importance(model, COLUMNS, 4).collect()
    assert table[0]["column_name"] == "a" and sum(r["importance"] for r in table) == pytest.approx(1)


def test_out_of_fold_and_disk(spark, tmp_path):
    df = spark.createDataFrame(data())
    found = L.out_of_fold("newton", df, "id", COLUMNS, "y", "w", folds=2, stop_early=True, rounds=3, max_depth=2)
    assert found.held_out.count() == 240 and found.predict(df, "id").count() == 240
    model = found.models[0]
    model.save(spark, str(tmp_path / "m"))
    assert boost.Booster.load(spark, str(tmp_path / "m")) == model


def test_edges_of_the_input(spark):
    schema = "id long, y double, a double, b string"
    rows = [(i, float(i % 2), None if i % 3 else 1.0, None) for i in range(20)] + [(99, None, 1.0, None), (98, 1.0, float("nan"), None)]
    df = spark.createDataFrame(rows, schema).selectExpr("id", "y", "a", "CAST(b AS double) AS `b.c`", "'x' AS margin")
    model = boost.fit(df, ["a", "b.c"], "y", rounds=2)
    got = boost.score(model, df)
    assert got.count() == 22 and got.columns == df.columns + ["score"] and {r["margin"] for r in got.collect()} == {"x"}
    assert boost.fit(df.filter("false"), ["a"], "y", rounds=2).trees == []
    one = boost.fit(df.filter("y = 1"), ["a"], "y", rounds=2, learning_rate=1.0)
    assert all(r["score"] > 0.8 for r in boost.score(one, df).collect())
    with pytest.raises(ValueError):
        boost.fit(df, ["a"], "y", bins=300)
