"""ROC, AUC, thresholds and confusion tables for a scored frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.expr import round_half_even
from loomline.operators.join import as_list
from loomline.operators.ranks import running_totals

# Fixed value: the decision threshold of the deployed scoring service.
SERVICE_THRESHOLD = 0.3741018248484985


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def roc(df: DataFrame, label: str, score: str, by: str | Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tpr, fpr): one point per distinct score, predicting 1 at or above it."""
    by = as_list(by)
    points = running_totals(_by_score(df, label, score, by), "threshold", ["pos", "neg"], by, descending=True)
    return points.select(
        *by,
        "threshold",
        F.try_divide(F.col("pos_running"), F.col("pos_all")).alias("tpr"),
        F.try_divide(F.col("neg_running"), F.col("neg_all")).alias("fpr"),
    )


def auc(df: DataFrame, label: str, score: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sum, ties counted half: one row (per key)."""
    by = as_list(by)
    points = running_totals(_by_score(df, label, score, by), "threshold", ["pos", "neg"], by)
    # Doubled so that the sum stays whole; decimals keep it exact beyond 64 bits.
    below = (F.col("neg_running") - F.col("neg")) * 2 + F.col("neg")
    twice = F.sum(F.col("pos").cast("decimal(19,0)") * below.cast("decimal(19,0)")).cast("double")
    grouped = points.groupBy(*by).agg(
        twice.alias("_twice"), F.max("pos_all").alias("_p"), F.max("neg_all").alias("_n")
    )
    pairs = F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")
    return grouped.select(*by, F.try_divide(F.col("_twice"), pairs).alias("auc"))


RULES = {
    "product": lambda: F.col("tpr") * (F.lit(1.0) - F.col("fpr")),
    "youden": lambda: F.col("tpr") - F.col("fpr"),
}


def best_threshold(
    df: DataFrame, label: str, score: str, rule: str = "product", by: str | Sequence[str] = ()
) -> DataFrame:
    """The score cut with the best trade-off; the highest threshold wins ties."""
    by = as_list(by)
    graded = roc(df, label, score, by).withColumn("_grade", RULES[rule]())
    # The order of the struct's fields is the order of preference.
    best = F.max(F.struct("_grade", "threshold"))
    return graded.groupBy(*by).agg(best.alias("_best")).select(
        *by, F.col("_best.threshold").alias("threshold"), F.col("_best._grade").alias("grade")
    )


def mean_threshold(df: DataFrame, label: str, score: str, fold: str, rule: str = "youden") -> DataFrame:
    """The per-fold best thresholds, averaged."""
    return best_threshold(df, label, score, rule, fold).agg(F.avg("threshold").alias("threshold"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, precision_share, recall_share): counts with column and row shares."""
    known = df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    cells = known.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per class pair reaches these windows.
    share = lambda c: F.col("n") / F.sum("n").over(Window.partitionBy(c))
    return cells.select("*", share("predicted").alias("precision_share"), share("actual").alias("recall_share"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.avg(F.when(F.col(label) == F.col(predicted), 1).otherwise(0)).alias("accuracy")
    )


def score_label(
    df: DataFrame,
    score: str,
    threshold: float | Column = SERVICE_THRESHOLD,
    places: int = 4,
) -> DataFrame:
    """Round the score, label it 1 above the threshold and phrase the outcome."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    rounded = round_half_even(score, places)
    label = F.when(rounded > threshold, 1).otherwise(0)
    verdict = F.when(rounded > threshold, F.lit("is")).otherwise(F.lit("is not"))
    # Fixed value: the wording the scoring service answers with.
    text = F.concat(
        F.lit("The customer with this ID "),
        verdict,
        F.lit(" a Potential Defaulter with a probability of "),
        rounded.cast("string"),
    )
    return df.withColumns({"score_rounded": rounded, "predicted": label, "message": text})


def compare(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """Stack one-row metric frames under their model names."""
    out = None
    for name, one in metrics.items():
        named = one.select(F.lit(name).alias("model"), "*")
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out
