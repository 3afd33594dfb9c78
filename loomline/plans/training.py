"""From a feature matrix to compared models and scored applicants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from loomline.operators import evaluate as E
from loomline.operators import learn as L
from loomline.operators.columns import numeric_columns, without
from loomline.sources.tables import written

# Columns that identify rows and must never become features.
ID_COLUMNS = ["TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index"]
# Fixed value: weight of a positive row in the out-of-fold booster.
POSITIVE_WEIGHT = 6.014158781875895


def feature_columns(matrix: DataFrame) -> list[str]:
    return without(numeric_columns(matrix), *ID_COLUMNS)


def prepare(
    matrix: DataFrame,
    id_col: str,
    label: str,
    columns: Sequence[str],
    k: int = 500,
    fraction: float = 0.2,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, cv, selected columns): split by class, keep the top k by F, scale on train, weigh."""
    split = L.stratified_split(matrix.select(id_col, label, *columns), id_col, label, fraction, seed)
    split = written(split)
    train = split.filter("split = 'train'")
    top = L.selected(L.anova_topk(train, columns, label, k))
    scaled = L.standardise(train, split.select(id_col, label, "split", *top), top)
    # Every training iteration reads the table again, so it starts from files.
    weighed = written(L.balanced_weight(scaled, label))
    return weighed.filter("split = 'train'"), weighed.filter("split = 'cv'"), top


def compare_models(
    train: DataFrame, cv: DataFrame, columns: Sequence[str], label: str, models: Mapping[str, Mapping[str, object]]
) -> DataFrame:
    """(model, auc, threshold, grade) on the held-out part, one row per kind of model."""
    tables = {}
    for kind, params in models.items():
        scored = L.score(L.fit(kind, train, columns, label, "weight", **params), cv).select(label, "score")
        both = E.best_threshold(scored, label, "score", "product")
        tables[kind] = both.withColumn("auc", E.auc(scored, label, "score").scalar())
    return E.compare(tables)


def score_applicants(
    matrix: DataFrame, id_col: str, label: str, columns: Sequence[str], folds: int = 5, fitted_threshold: bool = False,
    stop_early: bool = False, **params: object,
) -> DataFrame:
    """(id, score, score_rounded, predicted, message) for every row, labelled or not.

    The score is the mean over the fold models; one applicant is a filter on the result. The
    threshold is the service's constant or, fitted, the mean over folds of the best one on the
    rows that a fold's model was trained on. ``stop_early``: see :func:`out_of_fold`.
    """
    # Every fold reads the table again, so it starts from files; the columns are one vector there, for hundreds
    # of them take longer to plan in each job of a fold than to read.
    vectors = L.assemble(matrix.select(id_col, label, *columns), columns, "_inputs").select(id_col, label, "_inputs")
    weighted = written(L.positive_weight(vectors, label, POSITIVE_WEIGHT))
    result = L.out_of_fold("boosted", weighted, id_col, ["_inputs"], label, "weight", folds, stop_early=stop_early, **params)
    threshold = E.SERVICE_THRESHOLD
    if fitted_threshold:
        threshold = E.mean_threshold(result.trained_on, label, "score", "fold").first()["threshold"]
    return E.score_label(result.predict(weighted, id_col), "score", threshold)
