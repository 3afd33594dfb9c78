"""Second-order boosting next to SQL: trees that tell a few cells of the orders apart have closed leaf values."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import learn as L
from loomline.plans.training import POSITIVE_WEIGHT, prepare
from loomline.queries.cell_queries import BASE_SQL, CHILD_WEIGHTS, FOLD_HASH, KEY, PARTS_SQL, SPLIT_HASH, cells
from loomline.queries.registry import query, rounded
from loomline.sources.tables import table, written

#: Cuts that lose are allowed, so that a tree always tells all cells apart.
ANY_GAIN = -1e9
#: Strong enough that a lost penalty shows in the compared digits.
RATE, L1, L2 = 0.5, 1.25, 7.5


def _soft(g: str, l1: float = 0.0) -> str:
    return f"CASE WHEN {g} > {l1} THEN {g} - {l1} WHEN {g} < -{l1} THEN {g} + {l1} ELSE 0 END" if l1 else g


def newton_sql(source: str, rounds: int, keys: str, rate: float = RATE, l1: float = L1, l2: float = L2) -> str:
    """CTEs m0, m1, ... of (keys, sw, swy, m): the margin of each cell after so many Newton steps -S(G) / (H + l2)."""
    out = [f"m0 AS (SELECT {keys}, sum(w) AS sw, sum(w * label) AS swy, 0.0::DOUBLE AS m FROM {source} GROUP BY {keys})"]
    for k in range(rounds):
        s = _soft("g", l1)
        out.append(
            f"m{k + 1} AS (SELECT {keys}, sw, swy, m - {rate}::DOUBLE * ({s}) / (h + {l2}) AS m FROM (SELECT *, p * sw - swy AS g, "
            f"p * (1 - p) * sw AS h FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{k})))"
        )
    return ", ".join(out)


@query(
    "fit_newton",
    f"""
    WITH {PARTS_SQL}, train AS (SELECT * FROM parts WHERE split = 'train'), {newton_sql("train", 4, "urgent, large")}
    SELECT o_orderkey, label, round(1 / (1 + exp(-m)), 6) AS score FROM parts JOIN m4 USING (urgent, large) WHERE split = 'cv'
    """,
)
def fit_newton(spark, folder):
    """Four rounds with L1 and L2 penalties and balanced weights: split, weights, scaling, bins, gradients, leaves, scores."""
    train, cv, _ = prepare(cells(spark, folder), KEY, "label", ["urgent", "large"], k=2)
    model = L.fit(
        "newton", train, ["urgent", "large"], "label", "weight", rounds=4, learning_rate=RATE, max_depth=2, l1=L1, l2=L2, min_gain=ANY_GAIN
    )
    return rounded(L.score(model, cv).select(KEY, "label", "score"), 6, "score")


@query(
    "newton_folds",
    f"""
    WITH {BASE_SQL}, folded AS (
        SELECT *, CAST(('0x' || substr({FOLD_HASH}, 1, 8))::BIGINT % 5 AS INTEGER) AS fold,
               CASE WHEN label = 1 THEN {POSITIVE_WEIGHT!r}::DOUBLE ELSE 1 END AS w FROM base),
    seen AS (SELECT folded.*, i FROM folded, (SELECT DISTINCT fold AS i FROM folded) WHERE fold <> i),
    {newton_sql("seen", 2, "i, urgent, large", 1.0, 0.0, 1.0)}, means AS (SELECT urgent, large, avg(1 / (1 + exp(-m))) AS mean_score FROM m2 GROUP BY 1, 2)
    SELECT o_orderkey, label, fold, round(1 / (1 + exp(-m)), 6) AS score, round(mean_score, 6) AS mean_score
    FROM folded JOIN m2 USING (urgent, large) JOIN means USING (urgent, large) WHERE i = fold
    """,
)
def newton_folds(spark, folder):
    """Out-of-fold scores of the second-order booster, with the weight of the original's fold models."""
    df = written(L.positive_weight(cells(spark, folder), "label", POSITIVE_WEIGHT))
    found = L.out_of_fold(
        "newton", df, KEY, ["urgent", "large"], "label", "weight", 5, 42, rounds=2, learning_rate=1.0, max_depth=2, min_gain=ANY_GAIN
    )
    means = found.predict(df, KEY).withColumnRenamed("score", "mean_score")
    return rounded(found.held_out.join(means, KEY), 6, "score", "mean_score")


# ---------------------------------------------------------------- least hessian of a side

RARE = "CASE WHEN o_orderkey % 400 < 1 THEN 1 ELSE 0 END"
RARE_LABEL = f"CASE WHEN ({RARE}) = 1 THEN CASE WHEN o_orderkey % 1200 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END END"


def _grade(g: str, h: str) -> str:
    return f"({g}) * ({g}) / (({h}) + 1.0)"


RARE_SQL = f"""
    WITH parts AS (
        SELECT *, CASE WHEN r <= floor(n * 0.2::DOUBLE + 0.5) THEN 'cv' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SPLIT_HASH}) AS r, count(*) OVER (PARTITION BY label) AS n
              FROM (SELECT o_orderkey, {RARE} AS rare, {RARE_LABEL} AS label FROM orders))),
    sides AS (SELECT rare, sum(0.5 - label) AS g, 0.25 * count(*) AS h FROM parts WHERE split = 'train' GROUP BY rare),
    grades AS (SELECT min(h) AS least, sum({_grade("g", "h")}) - {_grade("sum(g)", "sum(h)")} AS gain,
                      max(CASE WHEN rare = 1 THEN -g / (h + 1) END) > max(CASE WHEN rare = 0 THEN -g / (h + 1) END) AS up FROM sides),
    rates AS (SELECT split, CAST(sum(rare * label) AS DOUBLE) / sum(label) - CAST(sum(rare * (1 - label)) AS DOUBLE) / sum(1 - label) AS d
              FROM parts GROUP BY split),
    areas AS (SELECT max(CASE WHEN split = 'train' THEN d END) AS t, max(CASE WHEN split = 'cv' THEN d END) AS c FROM rates)
    SELECT value, round(0.5 + used * t / 2, 9) AS train_auc, round(0.5 + used * c / 2, 9) AS cv_auc
    FROM (SELECT value, t, c, CASE WHEN least >= value AND gain > 0 THEN CASE WHEN up THEN 1 ELSE -1 END ELSE 0 END AS used
          FROM grades, areas, (VALUES {", ".join(f"({float(v)!r}::DOUBLE)" for v in CHILD_WEIGHTS)}) v(value))
"""


@query("sweep_hessian_weight", RARE_SQL)
def sweep_hessian_weight(spark, folder):
    """The least hessian of a side, swept: a rare flag is cut off only while its rows carry as much."""
    rows = table(spark, folder, "orders").selectExpr(KEY, f"{RARE} AS rare", f"{RARE_LABEL} AS label")
    train, cv, _ = prepare(rows, KEY, "label", ["rare"], k=1)
    return rounded(L.sweep("newton", train, cv, ["rare"], "label", "min_child_weight", CHILD_WEIGHTS, None, rounds=1, max_depth=1), 9, "train_auc", "cv_auc")


# ---------------------------------------------------------------- missing values, and the order of growth

GAP = "CASE WHEN o_orderkey % 7 < 2 THEN NULL WHEN o_totalprice > 150000 THEN 1 ELSE 0 END"


@query(
    "fit_newton_missing",
    f"""
    WITH rows AS (SELECT o_orderkey, x, CASE WHEN o_orderkey % 3 = 0 THEN 1 - coalesce(x, 1) ELSE coalesce(x, 1) END AS label
                  FROM (SELECT o_orderkey, {GAP} AS x FROM orders)),
    g AS (SELECT sum(CASE WHEN x = 0 THEN 0.5 - label END) AS g0, 0.25 * count(CASE WHEN x = 0 THEN 1 END) AS h0,
                 sum(CASE WHEN x = 1 THEN 0.5 - label END) AS g1, 0.25 * count(CASE WHEN x = 1 THEN 1 END) AS h1,
                 sum(CASE WHEN x IS NULL THEN 0.5 - label END) AS gm, 0.25 * count(CASE WHEN x IS NULL THEN 1 END) AS hm FROM rows),
    ways AS (SELECT *, {_grade("g0 + gm", "h0 + hm")} + {_grade("g1", "h1")} >= {_grade("g0", "h0")} + {_grade("g1 + gm", "h1 + hm")} AS go_left FROM g),
    leaf AS (SELECT go_left, -(g0 + CASE WHEN go_left THEN gm ELSE 0 END) / (h0 + CASE WHEN go_left THEN hm ELSE 0 END + 1.0) AS low,
                    -(g1 + CASE WHEN go_left THEN 0 ELSE gm END) / (h1 + CASE WHEN go_left THEN 0 ELSE hm END + 1.0) AS high FROM ways)
    SELECT o_orderkey, round(1 / (1 + exp(-CAST(CASE WHEN x = 0 OR (x IS NULL AND go_left) THEN low ELSE high END AS DOUBLE))), 6) AS score
    FROM rows, leaf
    """,
)
def fit_newton_missing(spark, folder):
    """Rows without the feature go to the side where they gain more."""
    rows = table(spark, folder, "orders").selectExpr(KEY, f"{GAP} AS x")
    known = F.coalesce("x", F.lit(1))
    rows = rows.withColumn("label", F.when(F.col(KEY) % 3 == 0, 1 - known).otherwise(known))
    model = L.fit("newton", rows, ["x"], "label", rounds=1, learning_rate=1.0, max_depth=1)
    return rounded(L.score(model, rows).select(KEY, "score"), 6, "score")


def _side(flag: str, v: int) -> str:
    return f"sum(CASE WHEN {flag} = {v} THEN g END) AS g_{flag}{v}, sum(CASE WHEN {flag} = {v} THEN h END) AS h_{flag}{v}"


@query(
    "fit_newton_leaves",
    f"""
    WITH {BASE_SQL}, cell AS (SELECT urgent, large, sum(0.5 - label) AS g, 0.25 * count(*) AS h FROM base GROUP BY 1, 2),
    s AS (SELECT {", ".join(_side(f, v) for f in ("urgent", "large") for v in (0, 1))} FROM cell),
    first AS (SELECT {_grade("g_urgent0", "h_urgent0")} + {_grade("g_urgent1", "h_urgent1")}
                     >= {_grade("g_large0", "h_large0")} + {_grade("g_large1", "h_large1")} AS by_urgent FROM s),
    sided AS (SELECT c.*, CASE WHEN by_urgent THEN urgent ELSE large END AS v FROM cell c, first),
    side AS (SELECT v, sum(g) AS sg, sum(h) AS sh, sum({_grade("g", "h")}) - {_grade("sum(g)", "sum(h)")} AS gain FROM sided GROUP BY v),
    second AS (SELECT arg_max(v, (gain, -v)) AS cut FROM side),
    leaf AS (SELECT urgent, large, CASE WHEN v = cut THEN -g / (h + 1.0) ELSE -sg / (sh + 1.0) END AS m FROM sided JOIN side USING (v), second)
    SELECT o_orderkey, label, round(1 / (1 + exp(-CAST(m AS DOUBLE))), 6) AS score FROM base JOIN leaf USING (urgent, large)
    """,
)
def fit_newton_leaves(spark, folder):
    """Three leaves, best leaf first: of the two sides of the first cut only the better one is cut again."""
    rows = cells(spark, folder)
    model = L.fit("newton", rows, ["urgent", "large"], "label", rounds=1, learning_rate=1.0, max_depth=5, max_leaves=3, min_gain=ANY_GAIN)
    return rounded(L.score(model, rows).select(KEY, "label", "score"), 6, "score")
