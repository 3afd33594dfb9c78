"""Evaluation against brute force, and models on a planted signal."""

import numpy as np
import pandas as pd
import pytest
from helpers import by_key, rows

from loomline.operators import encode
from loomline.operators import evaluate as E
from loomline.operators import learn as L
from loomline.plans import training as T
from loomline.plans.training import POSITIVE_WEIGHT, score_applicants
from loomline.queries.catalogue import QUERIES
from loomline.sources import tables as S

FEATURES = ["x0", "x1", "noise"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.8, size=600) > 0.8).astype(int)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(id=np.arange(600), y=y)
    return S.cut_lineage(spark.createDataFrame(pdf).repartition(2))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < s).astype(int)
    pdf = pd.DataFrame({"y": y, "s": s, "fold": np.arange(500) % 2, "p": (s > 0.5).astype(int)})
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_auc_counts_pairs(scored):
    pdf, df = scored
    pos, neg = pdf[pdf.y == 1].s.values, pdf[pdf.y == 0].s.values
    want = (np.sign(pos[:, None] - neg[None, :]) + 1).mean() / 2
    assert E.auc(df, "y", "s").first()["auc"] == pytest.approx(want, rel=1e-12)


def test_roc_and_thresholds(scored):
    pdf, df = scored
    points = E.roc(df, "y", "s").toPandas()
    assert len(points) == pdf.s.nunique()
    for t, tpr, fpr in points.itertuples(index=False):
        assert tpr == pytest.approx(((pdf.s >= t) & (pdf.y == 1)).sum() / (pdf.y == 1).sum())
        assert fpr == pytest.approx(((pdf.s >= t) & (pdf.y == 0)).sum() / (pdf.y == 0).sum())
    for rule, grade in (("product", points.tpr * (1 - points.fpr)), ("youden", points.tpr - points.fpr)):
        best = E.best_threshold(df, "y", "s", rule).first()
        assert best["grade"] == pytest.approx(grade.max())
        assert best["threshold"] == points.threshold[grade >= grade.max() - 1e-12].max()
    folds = by_key(E.best_threshold(df, "y", "s", "youden", "fold"), "fold")
    assert E.mean_threshold(df, "y", "s", "fold").first()["threshold"] == pytest.approx(
        (folds[0]["threshold"] + folds[1]["threshold"]) / 2
    )


def test_one_class_has_no_auc(frame):
    assert rows(E.auc(frame([(1, 0.2), (1, 0.4)], "y int, s double"), "y", "s")) == [(None,)]


def test_confusion_adds_up(scored):
    pdf, df = scored
    cells = E.confusion(df, "y", "p").collect()
    assert sum(c["n"] for c in cells) == len(pdf)
    for side, share in (("predicted", "precision_share"), ("actual", "recall_share")):
        for v in (0, 1):
            assert sum(c[share] for c in cells if c[side] == v) == pytest.approx(1)
    assert E.accuracy(df, "y", "p").first()["accuracy"] == pytest.approx((pdf.y == pdf.p).mean())


def test_score_label(frame):
    df = frame([(1, 0.37414), (2, 0.37416), (3, 0.1)], "id int, s double")
    out = by_key(E.score_label(df, "s"), "id")
    assert [out[i]["predicted"] for i in (1, 2, 3)] == [0, 1, 0]
    assert out[2]["message"] == "The customer with this ID is a Potential Defaulter with a probability of 0.3742"
    assert out[3]["message"] == "The customer with this ID is not a Potential Defaulter with a probability of 0.1"


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 333 THEN 1 WHEN id < 998 THEN 0 END AS y")
    out = L.stratified_split(df, "id", "y", 0.2, seed=1)
    n = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    # 66.6 and 133 rounded; rows without a label are in no part.
    assert n == {(1, "cv"): 67, (1, "train"): 266, (0, "cv"): 133, (0, "train"): 532, (None, None): 2}
    again = L.stratified_split(df.repartition(5), "id", "y", 0.2, seed=1)
    assert rows(again, "id") == rows(out, "id")


def test_folds_and_weights(spark):
    df = spark.range(5000)
    sizes = [r["count"] for r in L.assign_folds(df, "id", 5, 2).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 850
    labelled = df.selectExpr("id", "CASE WHEN id < 1000 THEN 1 ELSE 0 END AS y")
    assert rows(L.class_weights(labelled, "y")) == [(0, 4000, 0.625), (1, 1000, 2.5)]
    weighted = L.positive_weight(labelled, "y", 6.01)
    assert weighted.selectExpr("sum(weight)").first()[0] == pytest.approx(4000 + 6010)


def test_anova_matches_definition(planted):
    pdf = planted.toPandas()
    got = by_key(L.anova_f(planted, FEATURES, "y"), "column_name")
    for c in FEATURES:
        groups = [g[c].values for _, g in pdf.groupby("y")]
        between = sum(len(g) * (g.mean() - pdf[c].mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[c]["f"] == pytest.approx(between / (within / (len(pdf) - 2)), rel=1e-9)
    assert L.selected(L.anova_topk(planted, FEATURES, "y", 2)) == ["x0", "x1"]


def test_standardise_uses_population_deviation(frame):
    df = frame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    fit = df.filter("a IS NOT NULL")
    assert rows(L.standardise(fit, df, ["a", "b"])) == [(-2.0, 0.0), (-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize(
    "kind, params",
    [
        ("logistic", {"regParam": 0.01}),
        ("svm", {"regParam": 0.01, "maxIter": 10}),
        ("forest", {"numTrees": 5, "maxDepth": 4, "seed": 1}),
        ("boosted", {"maxIter": 3, "maxDepth": 3, "seed": 1}),
    ],
)
def test_models_find_the_signal(planted, kind, params):
    df = L.balanced_weight(planted, "y")
    model = L.fit(kind, df, FEATURES, "y", "weight", **params)
    assert E.auc(L.score(model, df), "y", "score").first()["auc"] > 0.8
    table = L.importance(model, FEATURES, 2).collect()
    assert table[0]["column_name"] == "x0" and len(table) == 2


def test_calibrated_scores_are_probabilities(planted):
    model = L.calibrate("svm", planted, "id", FEATURES, "y", folds=2, regParam=0.01, maxIter=5)
    out = model.score(planted).toPandas()
    assert out.score.between(0, 1).all() and abs(out.score.mean() - out.y.mean()) < 0.05


def test_out_of_fold(planted):
    result = L.out_of_fold("logistic", planted, "id", FEATURES, "y", folds=3, regParam=0.01)
    assert result.held_out.count() == 600 and result.held_out.select("id").distinct().count() == 600
    assert result.trained_on.count() == 1200
    assert result.overall_auc("y").first()["auc"] > 0.8 and result.fold_auc("y").count() == 3
    mean = result.predict(planted, "id").toPandas().set_index("id").score
    each = [L.score(m, planted).toPandas().set_index("id").score for m in result.models]
    assert np.allclose(mean, sum(each) / 3)


def test_sweep_and_search(planted):
    table = L.sweep("logistic", planted, planted, FEATURES, "y", "regParam", [0.001, 1.0]).collect()
    assert [r["value"] for r in table] == [0.001, 1.0] and all(r["train_auc"] == r["cv_auc"] > 0.8 for r in table)
    best, draws = L.random_search("forest", planted, FEATURES, "y", {"numTrees": (2, 4), "maxDepth": (2, 4)}, draws=2, folds=2)
    assert draws.count() == 2 and L.score(best, planted).count() == 600


def test_models_and_scores_on_disk(planted, spark, tmp_path):
    model = L.fit("logistic", planted, FEATURES, "y")
    S.save_model(model, str(tmp_path / "model"))
    loaded = S.load_model(str(tmp_path / "model"))
    a, b = (rows(L.score(m, planted).select("id", "score"), "id") for m in (model, loaded))
    assert a == b
    S.save_scores(L.score(model, planted).select("id", "score"), str(tmp_path / "scores"))
    assert S.load_scores(spark, str(tmp_path / "scores")).count() == 600
    S.save_threshold(E.best_threshold(L.score(model, planted), "y", "score"), str(tmp_path / "threshold"))
    assert S.load_scores(spark, str(tmp_path / "threshold")).columns == ["threshold"]
    S.write_scores_csv(L.score(model, planted), "id", "score", str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["id", "score"]


def test_compare(scored):
    _, df = scored
    table = E.compare({"a": E.auc(df, "y", "s"), "b": E.auc(df, "y", "p")})
    assert [r["model"] for r in table.orderBy("auc", ascending=False).collect()] == ["a", "b"]


def test_early_stopping_ends_the_rounds(planted):
    params = {"maxIter": 40, "maxDepth": 4, "seed": 1}
    found = L.out_of_fold("boosted", planted, "id", FEATURES, "y", folds=2, stop_early=True, **params)
    assert all(m.stages[1].getNumTrees < 40 for m in found.models)
    assert found.held_out.count() == 600 and found.trained_on.count() == 600
    assert min(r["auc"] for r in found.fold_auc("y").collect()) > 0.7


def test_fitted_threshold_is_the_fold_mean(planted):
    params = {"maxIter": 3, "maxDepth": 2}
    out = score_applicants(planted, "id", "y", FEATURES, folds=2, fitted_threshold=True, **params)
    weighted = L.positive_weight(planted, "y", POSITIVE_WEIGHT)
    found = L.out_of_fold("boosted", weighted, "id", FEATURES, "y", "weight", 2, **params)
    cut = E.mean_threshold(found.trained_on, "y", "score", "fold").first()["threshold"]
    assert all(r["predicted"] == (r["score_rounded"] > cut) for r in out.collect())


def test_sigmoids_fit_each_group_best(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.arange(900) % 3, "m": rng.normal(size=900) * 50 + 400})
    pdf["y"] = (rng.random(900) < 1 / (1 + np.exp(-(pdf.m - 400) / 30 * (pdf.g - 1)))).astype(int)
    pdf.loc[len(pdf)] = [7, 1.0, 1]
    found = L.platt(spark.createDataFrame(pdf).repartition(4), "m", "y", "g")
    for g in (0, 1, 2):
        part = pdf[pdf.g == g]
        p, n = part.y.sum(), (1 - part.y).sum()
        t = np.where(part.y == 1, (p + 1) / (p + 2), 1 / (n + 2))

        def loss(a, b):
            z = -(a * part.m + b)
            return np.sum(np.logaddexp(0, z) - t * z)

        a, b = found[g]
        assert all(loss(a, b) <= loss(a + da, b + db) for da in (-1e-4, 0, 1e-4) for db in (-1e-3, 0, 1e-3))
    assert found[7][0] == 0 and 1 / (1 + np.exp(found[7][1])) == pytest.approx(2 / 3)


def test_search_on_fixed_folds_repeats(planted):
    draws = [
        rows(L.random_search("forest", df, FEATURES, "y", {"maxDepth": (2, 4)}, draws=2, folds=3, id_col="id", numTrees=1, bootstrap=False)[1])
        for df in (planted, planted.repartition(3))
    ]
    assert draws[0] == draws[1]


def test_fifty_thousand_categories(spark):
    df = spark.range(100_000).selectExpr(
        "id", "CAST(id % 50000 AS STRING) AS c", "CASE WHEN id % 10 < 9 THEN 'k' END AS k", "CAST(id % 2 AS INT) AS y", "1.0D AS x"
    )
    model = encode.fit_sparse(df, ["c", "k"])
    flags = encode.sparse_one_hot(model, df)
    one = flags.filter("id = 7").first()["flags"]
    names = encode.sparse_names(model)
    assert one.size == len(names) == 50_001 + 2 and [names[i] for i in one.indices] == [("c", "7"), ("k", "k")]
    assert [names[i] for i in flags.filter("id = 9").first()["flags"].indices] == [("c", "9"), ("k", "nan")]
    fitted = L.fit("logistic", flags, ["flags", "x"], "y", maxIter=8)
    assert E.auc(L.score(fitted, flags), "y", "score").first()["auc"] > 0.99


def test_out_of_fold_scores_each_part_only(planted, monkeypatch):
    seen, real = [], L.score
    monkeypatch.setattr(L, "score", lambda model, df, *a: seen.append(df) or real(model, df, *a))
    found = L.out_of_fold("newton", planted, "id", FEATURES, "y", folds=3, rounds=1, max_depth=1)
    n = planted.count()
    assert found.held_out.count() == n and found.trained_on.count() == 2 * n
    assert seen and all(df.count() < n for df in seen)


def test_scored_applicants_are_selected_from_every_recipe(spark, tmp_path, monkeypatch):
    tables = {
        "customer": (60, "id AS c_custkey", "CAST(id * 167 - 900 AS DOUBLE) AS c_acctbal", "CAST(id % 25 AS INT) AS c_nationkey",
                     "elt(1 + id % 3, 'MACHINERY', 'BUILDING', 'FURNITURE') AS c_mktsegment"),
        "orders": (180, "id AS o_orderkey", "id % 59 AS o_custkey", "date_sub(DATE'2001-08-02', CAST(id * 5 AS INT)) AS o_orderdate",
                   "elt(1 + id % 3, 'F', 'O', 'P') AS o_orderstatus", "elt(1 + id % 2, '1-URGENT', '2-HIGH') AS o_orderpriority",
                   "CAST(id * 2777 AS DOUBLE) AS o_totalprice"),
        "lineitem": (360, "id % 180 AS l_orderkey", "CAST(1 + id DIV 180 AS INT) AS l_linenumber", "0.02D AS l_tax", "id % 5 / 50.0D AS l_discount",
                     "CAST(1 + id % 50 AS DOUBLE) AS l_quantity", "CAST(id * 91 AS DOUBLE) AS l_extendedprice",
                     "elt(1 + id % 3, 'A', 'N', 'R') AS l_returnflag", "date_sub(DATE'2001-11-05', CAST(id AS INT)) AS l_shipdate"),
        "events": (240, "id % 60 AS user_id", "elt(1 + id % 5, 'view', 'signup', 'purchase', 'click', 'error') AS event_type",
                   "TIMESTAMP'2024-01-30' - make_interval(0, 0, 0, CAST(id % 40 AS INT)) AS ts", "CAST(id AS DOUBLE) / 3 AS value"),
    }
    for name, (n, *exprs) in tables.items():
        spark.range(n).selectExpr(*exprs).write.parquet(str(tmp_path / f"{name}.parquet"))
    given = []

    def scored(matrix, id_col, label, columns, folds=5, **params):
        given.append((matrix, columns, folds))
        return matrix.select(id_col)

    monkeypatch.setattr(T, "score_applicants", scored)
    assert QUERIES["score_applicants"](spark, str(tmp_path)).count() == 60
    matrix, columns, folds = given[0]
    found = T.feature_columns(matrix)
    for part in ("AMT_INCOME_TOTAL", "EXT_SOURCE_2", "BUREAU_", "PREV_", "POS_", "INS_", "CR_"):
        assert any(c.startswith(part) for c in found), part
    assert len(found) > 500 and folds == 5
    # The label follows from the income here, so that column must be among the best 500 of all.
    assert len(set(columns)) == 500 and set(columns) <= set(found) and "AMT_INCOME_TOTAL" in columns


def test_numbers_are_assembled_as_alone(frame):
    values = [(1, 1.5, None, 7), (2, float("nan"), 3, 8), (3, float("inf"), 4, 9), (4, float("-inf"), -2, 1), (5, None, None, None)]
    df = frame(values, "id int, a double, b bigint, c int")
    got = {r["id"]: [float(x) for x in r["features"]] for r in L.assemble(df, ["a", "b", "c"]).collect()}
    want = by_key(df.select("id", *[L.nan_to_num(c).alias(c) for c in "abc"]), "id")
    assert got == {i: [r["a"], r["b"], r["c"]] for i, r in want.items()}
    assert got[2] == [0.0, 3.0, 8.0] and got[5] == [0.0, 0.0, 0.0] and np.isfinite(got[3]).all()
