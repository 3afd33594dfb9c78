"""Earlier applications: cleaning, row features, segment rollup over look-back windows."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import expr as X
from loomline.operators import clean, encode
from loomline.operators.lookback import DAY_WINDOWS, Windows, lookback
from loomline.operators.rollup import Exprs, roll_together, segment_exprs, share_exprs, spec_exprs

ID = "SK_ID_CURR"
ZERO_IS_NULL = ["DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]
MAXIMUM_IS_NULL = ["DAYS_FIRST_DRAWING", *ZERO_IS_NULL]

# Aggregates per measure, and prefixes per contract status.
PREVIOUS_SPEC = {
    "AMT_ANNUITY": ["max", "mean"],
    "AMT_APPLICATION": ["max", "mean"],
    "AMT_CREDIT": ["max", "mean"],
    "AMT_DOWN_PAYMENT": ["max", "mean"],
    "AMT_GOODS_PRICE": ["mean", "sum"],
    "HOUR_APPR_PROCESS_START": ["max", "mean"],
    "RATE_DOWN_PAYMENT": ["max", "mean"],
    "RATE_INTEREST_PRIMARY": ["max", "mean"],
    "RATE_INTEREST_PRIVILEGED": ["max", "mean"],
    "DAYS_DECISION": ["max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
    "DAYS_FIRST_DRAWING": ["max", "mean"],
    "DAYS_TERMINATION": ["max", "mean"],
    "APPLICATION_CREDIT_RATIO": ["max", "mean"],
    "DOWN_PAYMENT_TO_CREDIT": ["max", "mean"],
    "DAYS_LAST_DUE_DIFF": ["max", "mean"],
}
STATUS_PREFIX = {"Approved": "CS_APP_", "Refused": "CS_REF_"}


def clean_previous(df: DataFrame) -> DataFrame:
    """Zeros, then each column's maximum, are placeholders for a missing day offset."""
    return clean.null_sentinel(clean.zero_to_null(df, ZERO_IS_NULL), MAXIMUM_IS_NULL)


def previous_features(df: DataFrame) -> DataFrame:
    asked, credit, n = F.col("AMT_APPLICATION"), F.col("AMT_CREDIT"), F.col("CNT_PAYMENT")
    repaid = F.col("AMT_ANNUITY") * n
    return df.withColumns(
        {
            "APPLICATION_CREDIT_DIFF": asked - credit,
            "APPLICATION_CREDIT_RATIO": X.ratio(asked, credit),
            "CREDIT_TO_ANNUITY_RATIO": X.ratio(credit, "AMT_ANNUITY"),
            "DOWN_PAYMENT_TO_CREDIT": X.ratio("AMT_DOWN_PAYMENT", credit),
            "SIMPLE_INTERESTS": X.ratio(X.ratio(repaid, credit) - 1, n),
            "DAYS_LAST_DUE_DIFF": X.difference("DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE"),
        }
    )


def previous_exprs(vocabulary: encode.Vocabulary) -> Exprs:
    return (
        spec_exprs(PREVIOUS_SPEC, "PREV_")
        | share_exprs(vocabulary, "PREV_")
        | segment_exprs("NAME_CONTRACT_STATUS", STATUS_PREFIX, PREVIOUS_SPEC)
    )


def previous_rollup(df: DataFrame, vocabulary: encode.Vocabulary | None = None) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    return roll_together(previous_features(df), ID, previous_exprs(vocabulary))


def previous_lookback(
    df: DataFrame,
    vocabulary: encode.Vocabulary | None = None,
    windows: Windows = DAY_WINDOWS,
    columns: Collection[str] | None = None,
) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    return lookback(previous_features(df), ID, "DAYS_DECISION", windows, previous_exprs(vocabulary), columns)
