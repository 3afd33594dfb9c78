"""Monthly point-of-sale balances: applicant rollup plus loan-level completion features."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import expr as X
from loomline.operators import encode
from loomline.operators.lookback import MONTH_WINDOWS, Windows, lookback, tagged_rollup
from loomline.operators.rollup import Exprs, aggregate, first_last_exprs, roll, share_exprs, spec_exprs

ID, LOAN, MONTH = "SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE"

# Aggregates per measure.
POS_SPEC = {
    "SK_DPD_DEF": ["max", "mean", "min"],
    "SK_DPD": ["max", "mean", "min"],
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "CNT_INSTALMENT": ["max", "size"],
    "CNT_INSTALMENT_FUTURE": ["max", "size", "sum"],
}


LOAN_OUTPUTS = [
    "POS_LOAN_COMPLETED_MEAN", "POS_COMPLETED_BEFORE_MEAN", "POS_REMAINING_INSTALMENTS", "POS_REMAINING_INSTALMENTS_RATIO",
]


def pos_features(df: DataFrame) -> DataFrame:
    return df.withColumn("LATE_PAYMENT", X.above("SK_DPD"))


def loan_completion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per loan: share of completed months, early completion, and what remains at the end.

    A loan belongs to one applicant, so the applicant's key is part of the loan's.
    """
    completed = F.col("NAME_CONTRACT_STATUS") == "Completed"
    loans = roll(
        df,
        [*keys, LOAN],
        {"POS_LOAN_COMPLETED_MEAN": F.count_if(completed) / F.count(F.lit(1))}
        | first_last_exprs([MONTH], {"CNT_INSTALMENT": ["first", "last"], "CNT_INSTALMENT_FUTURE": ["last"]}),
    )
    shrunk = F.col("CNT_INSTALMENT_FIRST") - F.col("CNT_INSTALMENT_LAST")
    return loans.select(
        *keys,
        "POS_LOAN_COMPLETED_MEAN",
        X.both_positive(shrunk, "POS_LOAN_COMPLETED_MEAN").alias("POS_COMPLETED_BEFORE_MEAN"),
        F.col("CNT_INSTALMENT_FUTURE_LAST").alias("POS_REMAINING_INSTALMENTS"),
        X.ratio("CNT_INSTALMENT_FUTURE_LAST", "CNT_INSTALMENT_LAST").alias("POS_REMAINING_INSTALMENTS_RATIO"),
    )


def pos_exprs(vocabulary: encode.Vocabulary) -> Exprs:
    return spec_exprs(POS_SPEC, "POS_") | share_exprs(vocabulary, "POS_") | {c: "" for c in LOAN_OUTPUTS}


def _by_loan(df: DataFrame, keys: list[str], exprs: Exprs) -> DataFrame:
    return roll(loan_completion(df, keys), keys, {n: aggregate(n, "sum") for n in exprs})


def _loans(rows: DataFrame, windows: Windows, exprs: Exprs, gathered: bool) -> list[DataFrame]:
    """Loans are a rollup of their own below the applicant's, so their rows are tagged by window."""
    return [tagged_rollup(rows, ID, MONTH, windows, exprs, _by_loan)]


def pos_rollup(df: DataFrame, vocabulary: encode.Vocabulary | None = None) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    return lookback(pos_features(df), ID, MONTH, {"": None}, pos_exprs(vocabulary), own=_loans)


def pos_lookback(
    df: DataFrame,
    vocabulary: encode.Vocabulary | None = None,
    windows: Windows = MONTH_WINDOWS,
    columns: Collection[str] | None = None,
) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    return lookback(pos_features(df), ID, MONTH, windows, pos_exprs(vocabulary), columns, own=_loans)
