"""External credits: loan features and the month -> credit -> applicant rollup."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame

from loomline.functions import expr as X
from loomline.operators import clean, encode
from loomline.operators.join import join_suffix
from loomline.operators.rollup import attach_stats, only, roll_together, segment_exprs, share_exprs, spec_exprs

ID, CREDIT = "SK_ID_CURR", "SK_ID_BUREAU"
NULL_IS_ZERO = ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY"]

# Codes of the credit status, and aggregates per measure.
STATUS_CODES = {"Closed": 0, "Active": 1}
STATUS_OTHER = 2
CREDIT_SPEC = {
    "AMT_CREDIT_SUM_DEBT": ["mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean", "sum"],
    "DAYS_CREDIT": ["mean", "var"],
    "DAYS_CREDIT_UPDATE": ["mean", "min"],
    "CREDIT_DAY_OVERDUE": ["mean", "min"],
    "DAYS_CREDIT_ENDDATE": ["mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean", "max"],
    "AMT_ANNUITY": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM": ["mean", "sum", "max"],
}
BALANCE_AGGS = ["min", "max", "mean", "size"]
SEGMENT_PREFIX = {"Active": "A_", "Closed": "C_"}


def bureau_loan_features(bureau: DataFrame) -> DataFrame:
    """Durations, differences and ratios per credit, plus totals of its applicant."""
    df = bureau.withColumns(
        {
            "CREDIT_DURATION": X.difference("DAYS_CREDIT_ENDDATE", "DAYS_CREDIT"),
            "ENDDATE_DIFF": X.difference("DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT"),
            "UPDATE_DIFF": X.difference("DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE"),
            "DEBT_PERCENTAGE": X.ratio("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
            "DEBT_CREDIT_DIFF": X.difference("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
            "CREDIT_TO_ANNUITY_RATIO": X.ratio("AMT_CREDIT_SUM", "AMT_ANNUITY"),
            "DEBT_TO_ANNUITY_RATIO": X.ratio("AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY"),
            "CREDIT_OVERDUE_DIFF": X.difference("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_OVERDUE"),
            "CREDIT_TYPE_CODE": X.status_code("CREDIT_ACTIVE", STATUS_CODES, STATUS_OTHER),
        }
    )
    df = clean.fill(df, {c: 0 for c in NULL_IS_ZERO})
    df = attach_stats(
        df,
        ID,
        {
            "CUSTOMER_LOAN_COUNT": (CREDIT, "count"),
            "CUSTOMER_CREDIT_TYPES": ("CREDIT_TYPE", "nunique"),
            "CUSTOMER_CREDIT_CODE_MEAN": ("CREDIT_TYPE_CODE", "mean"),
            "TOTAL_CREDIT_SUM": ("AMT_CREDIT_SUM", "sum"),
            "TOTAL_DEBT_SUM": ("AMT_CREDIT_SUM_DEBT", "sum"),
        },
    )
    return df.withColumns(
        {
            "AVG_LOAN_TYPE": X.ratio("CUSTOMER_LOAN_COUNT", "CUSTOMER_CREDIT_TYPES"),
            "CREDIT_DEBT_RATIO": X.ratio("TOTAL_CREDIT_SUM", "TOTAL_DEBT_SUM"),
        }
    )


def bureau_rollup(
    bureau: DataFrame,
    balance: DataFrame,
    bureau_vocabulary: encode.Vocabulary | None = None,
    balance_vocabulary: encode.Vocabulary | None = None,
    segments: Sequence[str] = ("Closed",),
    columns: Collection[str] | None = None,
) -> DataFrame:
    """Months per credit, then credits per applicant, overall and per credit status."""
    bureau_vocabulary = encode.fit_vocabulary(bureau) if bureau_vocabulary is None else bureau_vocabulary
    balance_vocabulary = encode.fit_vocabulary(balance) if balance_vocabulary is None else balance_vocabulary
    per_credit = roll_together(
        balance,
        CREDIT,
        spec_exprs({"MONTHS_BALANCE": BALANCE_AGGS}) | share_exprs(balance_vocabulary, hows=BALANCE_AGGS),
    )
    credits = join_suffix(clean.fill(bureau, {c: 0 for c in NULL_IS_ZERO}), per_credit, CREDIT)
    flags = encode.flag_names(balance_vocabulary, null_flag=True)
    balance_spec = {f"{flag}_{how.upper()}": [how] for flag in flags for how in ("mean", "min", "max")}
    exprs = (
        spec_exprs(CREDIT_SPEC, "BUREAU_", upper=False)
        | share_exprs(bureau_vocabulary, "BUREAU_", hows=["max"], upper=False)
        | spec_exprs(balance_spec, "BUREAU_", upper=False)
        | segment_exprs("CREDIT_ACTIVE", {s: SEGMENT_PREFIX[s] for s in segments}, CREDIT_SPEC)
    )
    return roll_together(credits, ID, only(exprs, columns), probe=bureau)
