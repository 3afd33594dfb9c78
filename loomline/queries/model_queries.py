"""Splits, selection, scaling, evaluation and classifiers on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import evaluate as E
from loomline.operators import learn as L
from loomline.plans.training import compare_models, prepare
from loomline.queries.registry import query, rounded
from loomline.sources.tables import cut_lineage, table

# A fixed score: coarse enough for ties, and related to the label.
SCORED_COLUMNS = {
    "id": "c_custkey",
    "label": "CASE WHEN c_acctbal < 2500 THEN 1 ELSE 0 END",
    "score": "round((9998 - c_acctbal) / 16384 + c_nationkey / 256, 3)",
    "predicted": "CASE WHEN round((9998 - c_acctbal) / 16384 + c_nationkey / 256, 3) > 0.5 THEN 1 ELSE 0 END",
    "fold": "c_nationkey",
}
SCORED_SQL = "SELECT " + ", ".join(
    f"{e.replace('/ 16384', '/ 16384.0::DOUBLE').replace('/ 256', '/ 256.0::DOUBLE')} AS {c}" for c, e in SCORED_COLUMNS.items()
) + " FROM customer"


def scored(spark, folder):
    exprs = [f"{e.replace('/ 256', '/ 256.0D')} AS {c}" for c, e in SCORED_COLUMNS.items()]
    return table(spark, folder, "customer").selectExpr(*exprs)


HASH_SQL = "md5(concat(CAST(c_custkey AS VARCHAR), '_7'))"


@query(
    "stratified_split",
    f"""
    WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {HASH_SQL}) AS r,
                      count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_custkey, c_mktsegment, CASE WHEN r <= floor(n * 0.2::DOUBLE + 0.5) THEN 'cv' ELSE 'train' END AS split FROM h
    """,
)
def stratified_split(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return L.stratified_split(df, "c_custkey", "c_mktsegment", 0.2, seed=7)


@query(
    "kfold_assign",
    f"SELECT c_custkey, CAST(('0x' || substr({HASH_SQL}, 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM customer",
)
def kfold_assign(spark, folder):
    return L.assign_folds(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 5, seed=7)


@query(
    "class_weights",
    "SELECT toxic, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight "
    "FROM labels GROUP BY toxic",
)
def class_weights(spark, folder):
    return L.class_weights(table(spark, folder, "labels"), "toxic")


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _anova_sql(c: str) -> str:
    return f"""
    SELECT '{c}' AS column_name, round(sum(n * (m - g) * (m - g)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))), 5) AS f
    FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_samp({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g
          FROM lineitem GROUP BY 1)"""


@query(
    "anova_topk",
    "SELECT * FROM (" + " UNION ALL ".join(_anova_sql(c) for c in MEASURES) + ") ORDER BY f DESC, column_name LIMIT 3",
)
def anova_topk(spark, folder):
    return rounded(L.anova_topk(table(spark, folder, "lineitem"), MEASURES, "l_returnflag", k=3), 5)


@query(
    "standardise",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem WHERE l_linestatus = 'F')) / "
        f"(SELECT stddev_pop({c}) FROM lineitem WHERE l_linestatus = 'F'), 6) AS {c}"
        for c in ("l_quantity", "l_discount")
    )
    + " FROM lineitem",
)
def standardise(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_quantity", "l_discount")
    out = L.standardise(df.filter("l_linestatus = 'F'"), df, ["l_quantity", "l_discount"])
    return rounded(out.drop("l_linestatus"), 6, "l_quantity", "l_discount")


ROC_SQL = f"""
    WITH s AS ({SCORED_SQL}), g AS (
        SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM s GROUP BY 1),
    r AS (SELECT threshold, p, n, CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER () AS tpr,
                 CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER () AS fpr, sum(n) OVER w - n AS above
          FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
"""


@query("roc_curve", ROC_SQL + "SELECT threshold, tpr, fpr FROM r")
def roc_curve(spark, folder):
    return E.roc(scored(spark, folder), "label", "score")


@query(
    "auc",
    ROC_SQL
    + "SELECT CAST(sum(p * (2 * (t - above) - n)) AS DOUBLE) / (2.0::DOUBLE * sum(p) * max(t)) AS auc "
    "FROM (SELECT *, sum(n) OVER () AS t FROM r)",
)
def auc(spark, folder):
    return E.auc(scored(spark, folder), "label", "score")


def _best_sql(grade: str) -> str:
    return ROC_SQL + (
        f"SELECT threshold, round({grade}, 9) AS grade FROM r ORDER BY {grade} DESC, threshold DESC LIMIT 1"
    )


@query("threshold_product", _best_sql("tpr * (1.0::DOUBLE - fpr)"))
def threshold_product(spark, folder):
    return rounded(E.best_threshold(scored(spark, folder), "label", "score", "product"), 9, "grade")


@query("threshold_youden", _best_sql("tpr - fpr"))
def threshold_youden(spark, folder):
    return rounded(E.best_threshold(scored(spark, folder), "label", "score", "youden"), 9, "grade")


@query(
    "threshold_fold_mean",
    f"""
    WITH s AS ({SCORED_SQL}), g AS (
        SELECT fold, score AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n
        FROM s GROUP BY 1, 2),
    r AS (SELECT fold, threshold, CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER (PARTITION BY fold) AS tpr,
                 CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (PARTITION BY fold) AS fpr
          FROM g WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT fold, arg_max(threshold, (tpr - fpr, threshold)) AS threshold FROM r GROUP BY fold)
    SELECT round(avg(threshold), 9) AS threshold FROM b
    """,
)
def threshold_fold_mean(spark, folder):
    return rounded(E.mean_threshold(scored(spark, folder), "label", "score", "fold"), 9)


@query(
    "confusion",
    f"""
    SELECT label AS actual, predicted, count(*) AS n,
           CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY predicted) AS precision_share,
           CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY label) AS recall_share
    FROM ({SCORED_SQL}) GROUP BY label, predicted
    """,
)
def confusion(spark, folder):
    return E.confusion(scored(spark, folder), "label", "predicted")


@query("accuracy", f"SELECT avg(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS accuracy FROM ({SCORED_SQL})")
def accuracy(spark, folder):
    return E.accuracy(scored(spark, folder), "label", "predicted")


@query(
    "score_label",
    f"""
    SELECT id, score, round_even(score, 2) AS score_rounded,
           CASE WHEN round_even(score, 2) > 0.3741018248484985 THEN 1 ELSE 0 END AS predicted,
           'The customer with this ID ' || CASE WHEN round_even(score, 2) > 0.3741018248484985 THEN 'is' ELSE 'is not' END
           || ' a Potential Defaulter with a probability of ' || CAST(round_even(score, 2) AS VARCHAR) AS message
    FROM ({SCORED_SQL})
    """,
)
def score_label(spark, folder):
    return E.score_label(scored(spark, folder).select("id", "score"), "score", places=2)


# ------------------------------------------------------------------ fitted models (no SQL)

FEATURES = ["total", "quantity", "discount", "n_lines"]


def training_table(spark, folder):
    """One row per order: line totals, and whether the order is finished."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count(F.lit(1)).alias("n_lines")
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("total"),
        F.when((F.col("o_orderpriority") < "3") == (F.col("o_totalprice") > 200000), 1).otherwise(0).alias("label"),
    )
    return orders.join(lines, "o_orderkey", "left")


def _split(spark, folder):
    train, cv, _ = prepare(training_table(spark, folder), "o_orderkey", "label", FEATURES, k=len(FEATURES))
    return train, cv


def _train(kind: str, **params):
    def run(spark, folder):
        train, cv = _split(spark, folder)
        model = L.fit(kind, train, FEATURES, "label", "weight", **params)
        return L.score(model, cv).select("o_orderkey", "label", F.round("score", 6).alias("score"))

    return run


query("train_lr")(_train("logistic", regParam=0.1))
query("train_svm")(_train("svm", regParam=0.1, maxIter=10))
query("train_rf")(_train("forest", numTrees=20, maxDepth=6, seed=42))
query("train_gbt")(_train("boosted", maxDepth=3, maxIter=10, minInstancesPerNode=10, seed=42))


@query("calibrated")
def calibrated(spark, folder):
    train, cv = _split(spark, folder)
    model = L.calibrate("svm", train, "o_orderkey", FEATURES, "label", "weight", folds=3, regParam=0.1, maxIter=10)
    return model.score(cv).select("o_orderkey", "label", "score")


@query("penalty_sweep")
def penalty_sweep(spark, folder):
    train, cv = _split(spark, folder)
    return L.sweep("logistic", train, cv, FEATURES, "label", "regParam", [1e-3, 1e-1, 10.0], "weight")


@query("depth_sweep")
def depth_sweep(spark, folder):
    train, cv = _split(spark, folder)
    return L.sweep("boosted", train, cv, FEATURES, "label", "maxDepth", [2, 4], None, maxIter=5, seed=42)


@query("oof_folds")
def oof_folds(spark, folder):
    df = cut_lineage(L.positive_weight(training_table(spark, folder), "label", 6.01))
    result = L.out_of_fold("boosted", df, "o_orderkey", FEATURES, "label", "weight", 5, maxDepth=3, maxIter=5, seed=42)
    means = result.predict(df, "o_orderkey").withColumnRenamed("score", "mean_score")
    return result.held_out.join(means, "o_orderkey")


@query("random_search")
def random_search(spark, folder):
    train, _ = _split(spark, folder)
    _, draws = L.random_search(
        "forest", train, FEATURES, "label", {"numTrees": (5, 15), "maxDepth": (3, 6)}, draws=2, folds=3, weight="weight"
    )
    return draws


@query("importance_topk")
def importance_topk(spark, folder):
    train, _ = _split(spark, folder)
    model = L.fit("forest", train, FEATURES, "label", "weight", numTrees=10, maxDepth=5, seed=42)
    return L.importance(model, FEATURES, 25)


@query("model_compare")
def model_compare(spark, folder):
    train, cv = _split(spark, folder)
    kinds = {
        "logistic": {"regParam": 0.1},
        "svm": {"regParam": 0.1, "maxIter": 10},
        "forest": {"numTrees": 10, "maxDepth": 5, "seed": 42},
        "boosted": {"maxIter": 5, "maxDepth": 3, "seed": 42},
    }
    return compare_models(train, cv, FEATURES, "label", kinds)
