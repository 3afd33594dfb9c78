"""Splits, feature selection, scaling, and classifiers on Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.expr import nan_to_num
from loomline.operators import boost
from loomline.operators.evaluate import auc
from loomline.operators.rollup import known_keys
from loomline.sources.tables import written

ESTIMATORS = {
    "logistic": LogisticRegression,
    "svm": LinearSVC,
    "forest": RandomForestClassifier,
    "boosted": GBTClassifier,
}
#: The booster of :mod:`loomline.operators.boost`, on the same footing as the kinds above.
NEWTON = "newton"
Model = PipelineModel | boost.Booster


# ---------------------------------------------------------------- splits and weights


# One constant per class goes into an expression. More classes than this raise.
MAX_CLASSES = 1_000


def at_most(per_class: DataFrame, limit: int = MAX_CLASSES) -> list:
    """The rows, one per class, on the driver."""
    rows = per_class.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes")
    return rows


def by_class(label: str, values: Mapping[object, Column], dtype: str) -> Column:
    """The value of a row's class, NULL for classes without one."""
    out = F.lit(None).cast(dtype)
    for key, value in values.items():
        out = F.when(F.col(label) == F.lit(key), value).otherwise(out)
    return out


def id_hash(id_col: str, seed: int | str) -> Column:
    """A repeatable random-looking order of ids."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"_{seed}")))


def stratified_split(df: DataFrame, id_col: str, label: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``split``: 'cv' for exactly ``fraction`` of each class (rounded), else 'train'; NULL without a label.

    Only the hash value at the cut has to be found. Rows are counted per class and
    hash prefix, one prefix bucket per class is sorted, and the cut is then compared
    with every row as a constant of its class: the table itself is neither sorted nor
    shuffled. Labels have at most ``MAX_CLASSES`` values.
    """
    hashed = known_keys(df, [label]).select(F.col(label), id_hash(id_col, seed).alias("_h"))
    hashed = hashed.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    per_label = Window.partitionBy(label)
    # At most 65,536 rows per class reach this window.
    edges = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_here")).select(
        label,
        "_b",
        "_here",
        (F.sum("_here").over(per_label.orderBy("_b")) - F.col("_here")).alias("_before"),
        F.floor(F.sum("_here").over(per_label) * F.lit(fraction) + F.lit(0.5)).alias("_cut"),
    )
    at_cut = edges.filter((F.col("_before") < F.col("_cut")) & (F.col("_cut") <= F.col("_before") + F.col("_here")))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))
    wanted = at_most(at_cut.select(label, "_b", (F.col("_cut") - F.col("_before")).alias("_nth")))
    nth = by_class(label, {r[label]: F.when(F.col("_b") == r["_b"], F.lit(r["_nth"])) for r in wanted}, "long")
    ranked = hashed.withColumn("_nth", nth).filter("_nth IS NOT NULL").withColumn("_r", rank)
    cuts = at_most(ranked.filter("_r = _nth").select(label, "_h"))
    last = by_class(label, {r[label]: F.lit(r["_h"]) for r in cuts}, "string")
    known = F.when(F.col(label).isNotNull(), "train")
    return df.withColumn("split", F.when(id_hash(id_col, seed) <= last, "cv").otherwise(known))


def assign_folds(df: DataFrame, id_col: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold`` in 0..folds-1 from a hash of the id."""
    number = F.conv(F.substring(id_hash(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(number, F.lit(folds)).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = known_keys(df, [label]).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class reaches this window.
    whole = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    )


def balanced_weight(df: DataFrame, label: str, alias: str = "weight") -> DataFrame:
    weights = {r[label]: F.lit(r["weight"]) for r in at_most(class_weights(df, label).select(label, "weight"))}
    return df.withColumn(alias, by_class(label, weights, "double"))


def positive_weight(df: DataFrame, label: str, weight: float, alias: str = "weight") -> DataFrame:
    return df.withColumn(alias, F.when(F.col(label) == 1, float(weight)).otherwise(1.0))


# ---------------------------------------------------------------- selection and scaling


def feature(df: DataFrame, column: str) -> Column:
    """A number with NULL as 0, or a vector as it is."""
    return F.col(column) if isinstance(df.schema[column].dataType, VectorUDT) else nan_to_num(column)


def assemble(df: DataFrame, columns: Sequence[str], alias: str = "features") -> DataFrame:
    """Columns (NULLs as 0), sparse flags among them, to one vector column."""
    if columns and not any(isinstance(df.schema[c].dataType, VectorUDT) for c in columns):
        # One expression over an array: a thousand columns, each with its own, fill the driver and take long to compile.
        numbers = F.transform(F.array(*[F.col(c).cast("double") for c in columns]), nan_to_num)
        return df.withColumn(alias, array_to_vector(numbers))
    clean = df.withColumns({c: feature(df, c) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol=alias).transform(clean)


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(column_name, f): one-way ANOVA F statistic of each column against the classes.

    One vector aggregate per class (count, mean and variance of every column at
    once); what is left is one small row per class.
    """
    vectors = assemble(known_keys(df, [label]), columns)
    stats = vectors.groupBy(label).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s")
    )
    long = stats.select(
        F.col("s.count").alias("n"),
        F.inline(F.arrays_zip(
            F.lit(list(columns)).alias("column_name"),
            vector_to_array("s.mean").alias("m"),
            vector_to_array("s.variance").alias("v"),
        )),
    ).toDF("n", "column_name", "m", "v")
    whole = Window.partitionBy("column_name")
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    parts = long.withColumn("_between", F.col("n") * F.pow(F.col("m") - grand, F.lit(2.0)))
    total = parts.groupBy("column_name").agg(
        F.sum("_between").alias("between"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
    )
    f = F.try_divide(
        F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))
    )
    return total.select("column_name", f.alias("f"))


def anova_topk(df: DataFrame, columns: Sequence[str], label: str, k: int = 500) -> DataFrame:
    """The k columns with the largest F; a column constant within classes has no F and is last."""
    return anova_f(df, columns, label).orderBy(F.desc_nulls_last("f"), F.asc("column_name")).limit(k)


def selected(top: DataFrame) -> list[str]:
    return [r["column_name"] for r in top.select("column_name").collect()]


def standardise(fit_df: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the mean and population deviation found on ``fit_df``.

    NULLs are 0 on both sides, before anything is fitted. A constant column is only centred.
    """
    stats = (
        assemble(fit_df, columns)
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s"))
        .select("s.count", "s.mean", "s.variance")
        .first()
    )
    n = stats["count"]
    scaled = {}
    for i, c in enumerate(columns):
        spread = (float(stats["variance"][i]) * (n - 1) / n) ** 0.5 if n else 0.0
        scaled[c] = (nan_to_num(c) - F.lit(float(stats["mean"][i]))) / F.lit(spread or 1.0)
    return df.withColumns(scaled)


# ---------------------------------------------------------------- fitting and scoring


def fit(
    kind: str,
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    weight: str | None = None,
    **params: object,
) -> Model:
    """Fit one classifier on named columns.

    With ``validationIndicatorCol`` among ``params`` a booster adds trees only while they help
    on the rows where that boolean column is true, and is not trained on them. NULLs are 0,
    but to a ``newton`` booster they are missing.
    """
    held = params.get("validationIndicatorCol")
    if kind == NEWTON:
        return boost.fit(df, columns, label, weight, held=held, **{k: v for k, v in params.items() if k != "validationIndicatorCol"})
    clean = df.filter(F.col(label).isNotNull()).select(
        *[feature(df, c).alias(c) for c in columns],
        F.col(label).cast("double").alias(label),
        *([weight] if weight else []),
        *([held] if held else []),
    )
    return _stages(kind, columns, label, weight, **params).fit(clean)


def _stages(kind: str, columns: Sequence[str], label: str, weight: str | None, **params: object) -> Pipeline:
    estimator = ESTIMATORS[kind](featuresCol="features", labelCol=label, **params)
    if weight:
        estimator = estimator.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), estimator])


def score(model: Model, df: DataFrame, alias: str = "score") -> DataFrame:
    """Add the positive-class probability, or the margin for models without one."""
    if isinstance(model, boost.Booster):
        return boost.score(model, df, alias)
    columns = model.stages[0].getInputCols()
    output = "probability" if model.stages[1].hasParam("probabilityCol") else "rawPrediction"
    # The inputs are cleaned under other names, so the caller's columns stay as they were.
    inputs = {f"_in{i}": feature(df, c) for i, c in enumerate(columns)}
    staged = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df.withColumns(inputs))
    scored = model.stages[1].transform(staged)
    return scored.select(*df.columns, vector_to_array(output)[1].alias(alias))


@dataclass
class Calibrated:
    """Classifiers of several folds, each with the sigmoid 1 / (1 + exp(a margin + b)) of its held-out margins; scores are averaged."""

    models: list[Model]
    sigmoids: list[tuple[float, float]]

    def score(self, df: DataFrame, alias: str = "score") -> DataFrame:
        """One narrow pass for all folds."""
        kept, total = df.columns, F.lit(0.0)
        for i, (model, (a, b)) in enumerate(zip(self.models, self.sigmoids)):
            df = margins(model, df, f"_margin{i}")
            total = total + sigmoid(F.col(f"_margin{i}"), a, b)
        return df.select(*kept, (total / F.lit(float(len(self.models)))).alias(alias))


def sigmoid(margin: Column, a: float | Column, b: float | Column) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return 1 / (1 + F.exp(a * margin + b))


def margins(model: Model, df: DataFrame, alias: str) -> DataFrame:
    if isinstance(model, boost.Booster):
        return boost.margins(model, df, alias)
    columns = model.stages[0].getInputCols()
    inputs = {f"_in{i}": feature(df, c) for i, c in enumerate(columns)}
    staged = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df.withColumns(inputs))
    return model.stages[1].transform(staged).select(*df.columns, vector_to_array("rawPrediction")[1].alias(alias))


#: Newton steps of a sigmoid, and the change of its parameters below which they end.
SIGMOID_STEPS, SIGMOID_CHANGE = 50, 1e-10


def platt(df: DataFrame, margin: str, label: str, by: str) -> dict[object, tuple[float, float]]:
    """For each value of ``by`` the (a, b) of 1 / (1 + exp(a margin + b)) that fits the labels best.

    Labels are smoothed to (positives + 1) / (positives + 2) and 1 / (negatives + 2). All groups take their Newton
    steps together: a step is one aggregate of five sums per group and, where the loss would rise, half as long.
    ``by`` has at most ``MAX_CLASSES`` values; rows without a label or margin are left out. Of a group with one
    label only, or one margin only, ``a`` is 0 and ``b`` its smoothed share.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(margin).isNotNull() & F.col(by).isNotNull())
    known = written(known.select(F.col(by).alias("g"), F.col(margin).cast("double").alias("m"), (F.col(label) == 1).cast("int").alias("y")))
    sizes = {
        r.g: r for r in at_most(known.groupBy("g").agg(
            F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("spread")
        ))
    }
    # Margins are centred and scaled for the steps, so that the two parameters do not hang together.
    scale = {g: (r["mean"], r["spread"] or 1.0) for g, r in sizes.items()}
    high, low = ({g: F.lit(v) for g, v in values.items()} for values in (
        {g: (r.p + 1.0) / (r.p + 2.0) for g, r in sizes.items()}, {g: 1.0 / (r.n + 2.0) for g, r in sizes.items()}
    ))
    share = {g: (r.p * (r.p + 1.0) / (r.p + 2.0) + r.n / (r.n + 2.0)) / (r.p + r.n) for g, r in sizes.items()}
    t = F.when(F.col("y") == 1, by_class("g", high, "double")).otherwise(by_class("g", low, "double"))
    x = (F.col("m") - by_class("g", {g: F.lit(c) for g, (c, _) in scale.items()}, "double")) / by_class("g", {g: F.lit(s) for g, (_, s) in scale.items()}, "double")
    rows = known.select("g", x.alias("x"), t.alias("t"))
    # z = u x + v is the log odds.
    at = {g: (0.0, math.log(s / (1 - s))) for g, s in share.items()}
    open_groups = [g for g, r in sizes.items() if r.p and r.n and r["spread"]]
    before, step = {}, dict.fromkeys(open_groups, (0.0, 0.0))
    for _ in range(SIGMOID_STEPS):
        if not open_groups:
            break
        u, v = (by_class("g", {g: F.lit(at[g][k]) for g in open_groups}, "double") for k in (0, 1))
        z = u * F.col("x") + v
        p = 1 / (1 + F.exp(-z))
        sums = rows.filter(F.col("g").isin(open_groups)).select("g", "x", "t", z.alias("z"), p.alias("p")).groupBy("g").agg(
            F.sum(F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("t") * F.col("z")).alias("loss"),
            F.sum((F.col("p") - F.col("t")) * F.col("x")).alias("gx"), F.sum(F.col("p") - F.col("t")).alias("g1"),
            *[F.sum(F.col("p") * (1 - F.col("p")) * w).alias(n) for n, w in (("hxx", F.col("x") * F.col("x")), ("hx", F.col("x")), ("h1", F.lit(1.0)))],
        )
        left = []
        for r in sums.collect():
            g = r["g"]
            if g in before and r["loss"] > before[g] + 1e-9 * abs(before[g]):
                step[g] = (step[g][0] / 2, step[g][1] / 2)
                at[g] = (at[g][0] + step[g][0], at[g][1] + step[g][1])
            else:
                before[g], det = r["loss"], r["hxx"] * r["h1"] - r["hx"] ** 2
                if det <= 0:
                    continue
                move = ((r["h1"] * r["gx"] - r["hx"] * r["g1"]) / det, (r["hxx"] * r["g1"] - r["hx"] * r["gx"]) / det)
                step[g] = move
                at[g] = (at[g][0] - move[0], at[g][1] - move[1])
            if max(map(abs, step[g])) > SIGMOID_CHANGE:
                left.append(g)
        open_groups = left
    return {g: (-u / scale[g][1], u * scale[g][0] / scale[g][1] - v) for g, (u, v) in at.items()}


def calibrate(
    kind: str,
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    label: str,
    weight: str | None = None,
    folds: int = 3,
    seed: int = 0,
    **params: object,
) -> Calibrated:
    """Sigmoid calibration: each fold's model learns from the other folds, its sigmoid from the fold left out."""
    folded = written(assign_folds(df.filter(F.col(label).isNotNull()), id_col, folds, seed))
    models, held_out = [], None
    for i in range(folds):
        models.append(fit(kind, folded.filter(F.col("fold") != i), columns, label, weight, **params))
        part = margins(models[i], folded.filter(F.col("fold") == i), "_margin").select(label, "fold", "_margin")
        held_out = part if held_out is None else held_out.unionByName(part)
    found = platt(held_out, "_margin", label, "fold")
    used = [i for i in range(folds) if i in found]
    return Calibrated([models[i] for i in used], [found[i] for i in used])


def sweep(
    kind: str,
    train: DataFrame,
    cv: DataFrame,
    columns: Sequence[str],
    label: str,
    param: str,
    values: Sequence[float],
    weight: str | None = None,
    **params: object,
) -> DataFrame:
    """(value, train_auc, cv_auc) for each value of one parameter."""
    out = None
    for v in values:
        model = fit(kind, train, columns, label, weight, **{**params, param: v})
        both = score(model, train.select(*columns, label, F.lit("train").alias("part"))).unionByName(
            score(model, cv.select(*columns, label, F.lit("cv").alias("part")))
        )
        areas = auc(both, label, "score", "part").agg(
            F.lit(float(v)).alias("value"),
            *[F.max(F.when(F.col("part") == p, F.col("auc"))).alias(f"{p}_auc") for p in ("train", "cv")],
        )
        out = areas if out is None else out.unionByName(areas)
    return out


def random_search(
    kind: str,
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    space: Mapping[str, tuple[float, float]],
    draws: int = 10,
    folds: int = 3,
    weight: str | None = None,
    seed: int = 0,
    parallelism: int = 2,
    id_col: str | None = None,
    **params: object,
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated AUC at random parameter draws: (best model, table of draws).

    Whole-number bounds draw whole numbers (upper bound excluded). With ``id_col`` the folds
    are those of :func:`assign_folds`, the same for every draw, run and partitioning; the
    cleaned columns are written once and shared by all fits.
    """
    rng = random.Random(seed)
    stages = _stages(kind, columns, label, weight, **params)
    estimator = stages.getStages()[1]

    def draw(lo: float, hi: float) -> float:
        return rng.randrange(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rng.uniform(lo, hi)

    picks = [{name: draw(*bounds) for name, bounds in space.items()} for _ in range(draws)]
    maps = [{estimator.getParam(name): v for name, v in pick.items()} for pick in picks]
    known = df.filter(F.col(label).isNotNull())
    fixed = {}
    if id_col:
        known, fixed = assign_folds(known, id_col, folds, seed), {"foldCol": "fold"}
    clean = known.select(
        *[nan_to_num(c).alias(c) for c in columns],
        F.col(label).cast("double").alias(label),
        *([weight] if weight else []),
        *fixed.values(),
    )
    search = CrossValidator(
        estimator=stages,
        estimatorParamMaps=maps,
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
        **fixed,
    ).fit(written(clean))
    rows = [(i, *map(float, pick.values()), float(m)) for i, (pick, m) in enumerate(zip(picks, search.avgMetrics))]
    schema = "draw int, " + ", ".join(f"`{name}` double" for name in space) + ", auc double"
    return search.bestModel, df.sparkSession.createDataFrame(rows, schema)


@dataclass
class OutOfFold:
    """Scores of a k-fold training: each row by the model that did not see it."""

    held_out: DataFrame  # id, label, fold, score
    trained_on: DataFrame  # id, label, fold (the fold left out), score
    models: list[Model] = field(default_factory=list)

    def fold_auc(self, label: str) -> DataFrame:
        return auc(self.held_out, label, "score", "fold")

    def overall_auc(self, label: str) -> DataFrame:
        return auc(self.held_out, label, "score")

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, score): the mean over the fold models, in one pass and without a shuffle."""
        for i, model in enumerate(self.models):
            df = score(model, df, f"_score{i}")
        total = sum((F.col(f"_score{i}") for i in range(len(self.models))), F.lit(0.0))
        return df.select(id_col, (total / F.lit(float(len(self.models)))).alias("score"))


def out_of_fold(
    kind: str,
    df: DataFrame,
    id_col: str,
    columns: Sequence[str],
    label: str,
    weight: str | None = None,
    folds: int = 5,
    seed: int = 0,
    stop_early: bool = False,
    **params: object,
) -> OutOfFold:
    """Train on all folds but one, in turn. ``stop_early`` lets the fold left out end a booster's rounds."""
    folded = assign_folds(df.filter(F.col(label).isNotNull()), id_col, folds, seed)
    models, held, seen = [], None, None
    for i in range(folds):
        if stop_early:
            marked = folded.withColumn("_held", F.col("fold") == i)
            model = fit(kind, marked, columns, label, weight, validationIndicatorCol="_held", **params)
        else:
            model = fit(kind, folded.filter(F.col("fold") != i), columns, label, weight, **params)
        keep = [id_col, label, "fold", "score"]
        if isinstance(model, boost.Booster):
            # A booster scores in a step that no filter passes: each part is chosen before it is scored.
            h = score(model, folded.filter(F.col("fold") == i)).select(*keep)
            s = score(model, folded.filter(F.col("fold") != i).withColumn("fold", F.lit(i))).select(*keep)
        else:
            scored = score(model, folded.withColumn("_held", F.col("fold") == i).withColumn("fold", F.lit(i)))
            h, s = scored.filter("_held").select(*keep), scored.filter("NOT _held").select(*keep)
        held = h if held is None else held.unionByName(h)
        seen = s if seen is None else seen.unionByName(s)
        models.append(model)
    return OutOfFold(held, seen, models)


def importance(models: Model | Sequence[Model], columns: Sequence[str], k: int | None = 25) -> DataFrame:
    """(column_name, importance), averaged over models, largest first."""
    models = [models] if isinstance(models, Model) else list(models)

    def weights(model: Model) -> list[float]:
        if isinstance(model, boost.Booster):
            return model.gains()
        last = model.stages[1]
        if hasattr(last, "featureImportances"):
            return [float(x) for x in last.featureImportances.toArray()]
        return [abs(float(x)) for x in last.coefficients.toArray()]

    sums = [sum(w) / len(models) for w in zip(*[weights(m) for m in models])]
    table = SparkSession.active().createDataFrame(list(zip(columns, sums)), "column_name string, importance double")
    ordered = table.orderBy(F.desc("importance"), F.asc("column_name"))
    return ordered if k is None else ordered.limit(k)

