"""Fits whose result SQL can state: models that are saturated over a few cells of the orders.

A classifier that can tell every cell apart, and is not penalised, gives each cell its
weighted share of positives; one boosting round gives the logistic function of it. So the
scores of whole fits are compared with plain aggregates: split, weights, selection, scaling,
fitting, scoring and folds together. Each cell is noisy, and cells that differ in one flag
have different majorities, so no tree leaves them together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import encode
from loomline.operators import learn as L
from loomline.plans.training import POSITIVE_WEIGHT, compare_models, prepare
from loomline.queries.registry import query, rounded
from loomline.sources.tables import table, written

KEY = "o_orderkey"
URGENT = "CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END"
LARGE = "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END"
# One order in five has the other label than its cell.
FLIPPED = "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END"

# The sweeps of the original.
PENALTIES = [10.0**x for x in range(-5, 2)]
CHILD_WEIGHTS = [5, 6, 7, 8, 9, 10]
DEPTHS = [3, 4, 5, 6, 7, 8, 9, 10]

BASE_SQL = f"""
    base AS (SELECT o_orderkey, urgent, large, same, CASE WHEN flipped = 1 THEN 1 - same ELSE same END AS label
        FROM (SELECT *, CASE WHEN urgent = large THEN 1 ELSE 0 END AS same
            FROM (SELECT o_orderkey, {URGENT} AS urgent, {LARGE} AS large, {FLIPPED} AS flipped FROM orders)))
"""
SPLIT_HASH, FOLD_HASH = (f"md5(concat(CAST(o_orderkey AS VARCHAR), '_{seed}'))" for seed in (0, 42))
PARTS_SQL = f"""
    {BASE_SQL}, parts AS (
        SELECT *, total / (2.0::DOUBLE * n) AS w, CASE WHEN r <= floor(n * 0.2::DOUBLE + 0.5) THEN 'cv' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SPLIT_HASH}) AS r,
                     count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM base))
"""
SHARES_SQL = f"""
    WITH {PARTS_SQL}, cells AS (
        SELECT urgent, large, sum(w * label) / sum(w) AS share FROM parts WHERE split = 'train' GROUP BY 1, 2)
"""
# A score of two values has one corner: its area is the middle of both rates.
AREAS_SQL = f"""
    WITH {PARTS_SQL}, rates AS (
        SELECT split, CAST(sum(same * label) AS DOUBLE) / sum(label) AS tpr,
               CAST(sum(same * (1 - label)) AS DOUBLE) / sum(1 - label) AS fpr FROM parts GROUP BY split),
    areas AS (SELECT max(CASE WHEN split = 'train' THEN round(0.5 + (tpr - fpr) / 2, 9) END) AS train_auc,
                     max(CASE WHEN split = 'cv' THEN round(0.5 + (tpr - fpr) / 2, 9) END) AS cv_auc FROM rates)
"""


def cells(spark, folder):
    """One row per order: its cell, and a label that mostly follows from it."""
    flags = table(spark, folder, "orders").selectExpr(KEY, f"{URGENT} AS urgent", f"{LARGE} AS large", f"{FLIPPED} AS flipped")
    flags = flags.withColumn("same", F.when(F.col("urgent") == F.col("large"), 1).otherwise(0))
    label = F.when(F.col("flipped") == 1, 1 - F.col("same")).otherwise(F.col("same"))
    return flags.select(KEY, "urgent", "large", "same", label.alias("label"))


def _scored(spark, folder, columns, kind, **params):
    train, cv, _ = prepare(cells(spark, folder), KEY, "label", columns, k=len(columns))
    return L.score(L.fit(kind, train, columns, "label", "weight", **params), cv).select(KEY, "label", "score")


@query("fit_lr", SHARES_SQL + "SELECT o_orderkey, label, round(share, 5) AS score FROM parts JOIN cells USING (urgent, large) WHERE split = 'cv'")
def fit_lr(spark, folder):
    return rounded(_scored(spark, folder, ["urgent", "large", "same"], "logistic", maxIter=200, tol=1e-12), 5, "score")


@query("fit_rf", SHARES_SQL + "SELECT o_orderkey, label, round(share, 9) AS score FROM parts JOIN cells USING (urgent, large) WHERE split = 'cv'")
def fit_rf(spark, folder):
    return rounded(_scored(spark, folder, ["urgent", "large"], "forest", numTrees=1, bootstrap=False, maxDepth=2, seed=42), 9, "score")


@query(
    "fit_gbt",
    SHARES_SQL
    + """SELECT o_orderkey, label, round(1 / (1 + exp(-2 * (2 * share - 1))), 9) AS score
    FROM parts JOIN cells USING (urgent, large) WHERE split = 'cv'""",
)
def fit_gbt(spark, folder):
    return rounded(_scored(spark, folder, ["urgent", "large"], "boosted", maxIter=1, maxDepth=2, seed=42), 9, "score")


MAJORITY_SQL = SHARES_SQL + """SELECT o_orderkey, label, CASE WHEN share > 0.5 THEN 1 ELSE 0 END AS predicted
    FROM parts JOIN cells USING (urgent, large) WHERE split = 'cv'"""


@query("fit_svm", MAJORITY_SQL)
def fit_svm(spark, folder):
    """The least hinge loss of a cell is on the side of its majority."""
    out = _scored(spark, folder, ["urgent", "large", "same"], "svm", maxIter=20)
    return out.select(KEY, "label", F.when(F.col("score") > 0, 1).otherwise(0).alias("predicted"))


@query("fit_calibrated", MAJORITY_SQL)
def fit_calibrated(spark, folder):
    columns = ["urgent", "large", "same"]
    train, cv, _ = prepare(cells(spark, folder), KEY, "label", columns, k=3)
    model = L.calibrate("svm", train, KEY, columns, "label", "weight", folds=3, maxIter=20)
    sure = F.when(F.col("score").between(0.5, 1), 1).when(F.col("score").between(0, 0.5), 0)
    return model.score(cv).select(KEY, "label", sure.alias("predicted"))


def _swept(spark, folder, kind, param, values, weight, **params):
    train, cv, _ = prepare(cells(spark, folder), KEY, "label", ["same"], k=1)
    return rounded(L.sweep(kind, train, cv, ["same"], "label", param, values, weight, **params), 9, "train_auc", "cv_auc")


def _sweep_sql(values) -> str:
    rows = ", ".join(f"({float(v)!r}::DOUBLE)" for v in values)
    return AREAS_SQL + f"SELECT value, train_auc, cv_auc FROM areas, (VALUES {rows}) v(value)"


@query("sweep_penalty", _sweep_sql(PENALTIES))
def sweep_penalty(spark, folder):
    return _swept(spark, folder, "logistic", "regParam", PENALTIES, "weight")


@query("sweep_depth", _sweep_sql(DEPTHS))
def sweep_depth(spark, folder):
    return _swept(spark, folder, "boosted", "maxDepth", DEPTHS, None, maxIter=1, seed=42)


@query("sweep_child_weight", _sweep_sql(CHILD_WEIGHTS))
def sweep_child_weight(spark, folder):
    return _swept(spark, folder, "boosted", "minInstancesPerNode", CHILD_WEIGHTS, None, maxIter=1, seed=42)


@query(
    "compare_fits",
    AREAS_SQL
    + """SELECT model, cv_auc AS auc, round(tpr * (1 - fpr), 9) AS grade
    FROM areas, rates, (VALUES ('logistic'), ('svm'), ('forest'), ('boosted')) m(model) WHERE split = 'cv'""",
)
def compare_fits(spark, folder):
    train, cv, _ = prepare(cells(spark, folder), KEY, "label", ["same"], k=1)
    kinds = {
        "logistic": {},
        "svm": {},
        "forest": {"numTrees": 1, "maxDepth": 2, "seed": 42},
        "boosted": {"maxIter": 1, "maxDepth": 2, "seed": 42},
    }
    return rounded(compare_models(train, cv, ["same"], "label", kinds).select("model", "auc", "grade"), 9)


@query(
    "fit_folds",
    f"""
    WITH {BASE_SQL}, folded AS (
        SELECT *, CAST(('0x' || substr({FOLD_HASH}, 1, 8))::BIGINT % 5 AS INTEGER) AS fold,
               CASE WHEN label = 1 THEN {POSITIVE_WEIGHT!r}::DOUBLE ELSE 1 END AS w FROM base),
    fits AS (SELECT i, urgent, large, 1 / (1 + exp(-2 * (2 * sum(w * label) / sum(w) - 1))) AS score
             FROM folded, (SELECT DISTINCT fold AS i FROM folded) WHERE fold <> i GROUP BY 1, 2, 3),
    means AS (SELECT urgent, large, avg(score) AS mean_score FROM fits GROUP BY 1, 2)
    SELECT o_orderkey, label, fold, round(score, 9) AS score, round(mean_score, 9) AS mean_score
    FROM folded JOIN fits USING (urgent, large) JOIN means USING (urgent, large) WHERE i = fold
    """,
)
def fit_folds(spark, folder):
    """Each order by the model that did not see it, and by the mean of all."""
    df = written(L.positive_weight(cells(spark, folder), "label", POSITIVE_WEIGHT))
    found = L.out_of_fold("boosted", df, KEY, ["urgent", "large"], "label", "weight", 5, maxDepth=2, maxIter=1, seed=42)
    means = found.predict(df, KEY).withColumnRenamed("score", "mean_score")
    return rounded(found.held_out.join(means, KEY), 9, "score", "mean_score")


@query("fit_importance", f"WITH {BASE_SQL} SELECT c AS column_name, CAST(max(v) AS DOUBLE) AS importance FROM base, "
       "(VALUES ('same', 1), ('constant', 0)) x(c, v) GROUP BY 1")  # fmt: skip
def fit_importance(spark, folder):
    """A constant explains nothing, so the flag explains all."""
    df = cells(spark, folder).withColumn("constant", F.lit(1))
    model = L.fit("forest", df, ["same", "constant"], "label", numTrees=1, maxDepth=2, seed=42)
    return rounded(L.importance(model, ["same", "constant"], 25), 9, "importance")


@query("search_draws", f"WITH {BASE_SQL} SELECT CAST(d AS INTEGER) AS draw, count(*) > 0 AS within, count(*) > 0 AS better "
       "FROM base, range(10) r(d) GROUP BY 1")  # fmt: skip
def search_draws(spark, folder):
    """Ten draws; each within its bounds and better than chance on the planted signal."""
    train, _, _ = prepare(cells(spark, folder), KEY, "label", ["urgent", "large"], k=2)
    space = {"maxDepth": (2, 5), "minInfoGain": (0.0, 1e-6)}
    _, draws = L.random_search("forest", train, ["urgent", "large"], "label", space, draws=10, folds=3, weight="weight", numTrees=5)
    within = F.col("maxDepth").isin(2.0, 3.0, 4.0) & F.col("minInfoGain").between(0.0, 1e-6)
    return draws.select("draw", within.alias("within"), (F.col("auc") > 0.5).alias("better"))


# ------------------------------------------------------------------ search on fixed folds, calibration

SEARCH_DRAWS, SEARCH_FOLDS = 4, 3
FIXED_FOLD = f"CAST(('0x' || substr({SPLIT_HASH}, 1, 8))::BIGINT % {SEARCH_FOLDS} AS INTEGER)"


@query(
    "search_folds",
    f"""
    WITH {BASE_SQL}, rates AS (
        SELECT {FIXED_FOLD} AS fold, CAST(sum(same * label) AS DOUBLE) / sum(label) AS tpr,
               CAST(sum(same * (1 - label)) AS DOUBLE) / sum(1 - label) AS fpr FROM base GROUP BY 1)
    SELECT CAST(d AS INTEGER) AS draw, (SELECT round(avg(0.5 + (tpr - fpr) / 2), 9) FROM rates) AS auc FROM range({SEARCH_DRAWS}) r(d)
    """,
)
def search_folds(spark, folder):
    """The area of every draw, averaged over folds that follow from the ids."""
    space = {"maxDepth": (2, 5), "minInfoGain": (0.0, 1e-6)}
    _, draws = L.random_search(
        "forest", cells(spark, folder), ["same"], "label", space, draws=SEARCH_DRAWS, folds=SEARCH_FOLDS, id_col=KEY, numTrees=1, bootstrap=False
    )
    return rounded(draws.select("draw", "auc"), 9, "auc")


# Margins of another scale and place in each group, related to the label.
PLATT_ROWS = """SELECT c_nationkey AS g, (c_acctbal - 4000) * (1 + c_nationkey) / 3000 AS m,
    CASE WHEN (c_custkey * 7919) % 100 < 20 + c_acctbal / 150 THEN 1 ELSE 0 END AS y FROM customer"""
PLATT_STEPS = 12


def _platt_sql() -> str:
    """Newton steps from (0, log odds), unrolled, on margins scaled by the group."""
    start = """k AS (SELECT g, sum(y) AS p, sum(1 - y) AS n, avg(m) AS c, stddev_pop(m) AS s FROM r GROUP BY g),
        t AS (SELECT r.g, (m - c) / s AS x, CASE WHEN y = 1 THEN (p + 1.0::DOUBLE) / (p + 2) ELSE 1.0::DOUBLE / (n + 2) END AS t FROM r JOIN k USING (g)),
        z0 AS (SELECT g, 0.0::DOUBLE AS u, ln(avg(t) / (1 - avg(t))) AS v FROM t GROUP BY g)"""
    steps = [
        f"""q{i} AS (SELECT g, u, v, sum((p - t) * x) AS gx, sum(p - t) AS g1, sum(p * (1 - p) * x * x) AS hxx, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p)) AS h1
        FROM (SELECT g, x, t, u, v, 1 / (1 + exp(-(u * x + v))) AS p FROM t JOIN z{i} USING (g)) GROUP BY g, u, v),
        z{i + 1} AS (SELECT g, u - (h1 * gx - hx * g1) / (hxx * h1 - hx * hx) AS u, v - (hxx * g1 - hx * gx) / (hxx * h1 - hx * hx) AS v FROM q{i})"""
        for i in range(PLATT_STEPS)
    ]
    return (
        f"WITH r AS ({PLATT_ROWS.replace('/ 3000', '/ 3000.0::DOUBLE').replace('/ 150', '/ 150.0::DOUBLE')}), {start}, {', '.join(steps)} "
        f"SELECT g, round(-u / s, 6) AS a, round(u * c / s - v, 6) AS b FROM z{PLATT_STEPS} JOIN k USING (g)"
    )


@query("platt_scaling", _platt_sql())
def platt_scaling(spark, folder):
    """Both parameters of the sigmoid of every group, with smoothed targets."""
    rows = table(spark, folder, "customer").selectExpr(
        "c_nationkey AS g", "(c_acctbal - 4000) * (1 + c_nationkey) / 3000 AS m",
        "CASE WHEN (c_custkey * 7919) % 100 < 20 + c_acctbal / 150 THEN 1 ELSE 0 END AS y",
    )
    found = L.platt(rows, "m", "y", "g")
    out = spark.createDataFrame([(int(g), float(a), float(b)) for g, (a, b) in found.items()], "g int, a double, b double")
    return rounded(out.withColumn("g", F.col("g").cast(rows.schema["g"].dataType)), 6, "a", "b")


# ------------------------------------------------------------------ sparse flags

SPARSE_ROWS = "SELECT o_orderstatus, CAST(CASE WHEN o_custkey % 11 > 0 THEN o_custkey END AS VARCHAR) AS customer, o_orderpriority FROM orders"


@query(
    "sparse_shares",
    f"""
    WITH r AS ({SPARSE_ROWS}), f AS (
        SELECT o_orderstatus, 'customer' AS column_name, coalesce(customer, 'nan') AS value FROM r
        UNION ALL SELECT o_orderstatus, 'o_orderpriority', o_orderpriority FROM r),
    n AS (SELECT o_orderstatus, count(*) AS n FROM r GROUP BY 1),
    v AS (SELECT DISTINCT column_name, value FROM f UNION SELECT 'o_orderpriority', 'nan'),
    c AS (SELECT o_orderstatus, column_name, value, count(*) AS c FROM f GROUP BY 1, 2, 3)
    SELECT n.o_orderstatus, v.column_name, v.value, round(coalesce(c, 0) / CAST(n AS DOUBLE), 9) AS share
    FROM n CROSS JOIN v LEFT JOIN c ON c.o_orderstatus = n.o_orderstatus AND c.column_name = v.column_name AND c.value = v.value
    """,
)
def sparse_shares(spark, folder):
    """Every customer is a flag of its own: one sparse vector a row, one vector aggregate a status."""
    customer = F.when(F.col("o_custkey") % 11 > 0, F.col("o_custkey")).cast("string")
    rows = table(spark, folder, "orders").select("o_orderstatus", customer.alias("customer"), "o_orderpriority")
    return rounded(encode.sparse_shares(encode.fit_sparse(rows, ["customer", "o_orderpriority"]), rows, "o_orderstatus"), 9, "share")
