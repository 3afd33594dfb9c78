"""Monthly card balances: every numeric column and status flag, four aggregates each."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from loomline.functions import expr as X
from loomline.operators import encode
from loomline.operators.columns import numeric_columns
from loomline.operators.lookback import MONTH_WINDOWS, Windows, lookback
from loomline.operators.rollup import ROWS, Exprs, roll_together, share_exprs, spec_exprs

ID, LOAN, MONTH = "SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE"
CARD_AGGS = ["max", "mean", "sum", "var"]


def card_features(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed({"AMT_RECIVABLE": "AMT_RECEIVABLE"})
    return df.withColumns(
        {
            "LIMIT_USE": X.ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
            "PAYMENT_DIV_MIN": X.ratio("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY"),
            "LATE_PAYMENT": X.above("SK_DPD"),
            "DRAWING_LIMIT_RATIO": X.ratio("AMT_DRAWINGS_ATM_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
        }
    ).drop(LOAN)


def card_exprs(features: DataFrame, vocabulary: encode.Vocabulary) -> Exprs:
    measures = numeric_columns(features, exclude=[ID])
    return (
        spec_exprs({c: CARD_AGGS for c in measures}, "CR_")
        | share_exprs(vocabulary, "CR_", hows=CARD_AGGS)
        | {"CREDIT_COUNT": ROWS}
    )


def card_rollup(df: DataFrame, vocabulary: encode.Vocabulary | None = None) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    features = card_features(df)
    return roll_together(features, ID, card_exprs(features, vocabulary))


def card_lookback(
    df: DataFrame,
    vocabulary: encode.Vocabulary | None = None,
    windows: Windows = MONTH_WINDOWS,
    columns: Collection[str] | None = None,
) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    features = card_features(df)
    return lookback(features, ID, MONTH, windows, card_exprs(features, vocabulary), columns)
