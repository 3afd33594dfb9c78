"""Instalment payments: part payments, days past and before due, windowed rollup."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import expr as X
from loomline.operators import clean, encode
from loomline.operators.lookback import DAY_WINDOWS, Windows, depth, lookback, nested
from loomline.operators.rollup import ROWS, Exprs, attach_stat, roll, roll_together, share_exprs, spec_exprs

ID = "SK_ID_CURR"
INSTALMENT = ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER"]
OFFSET = "DAYS_INSTALMENT"

# Days-past-due steps by flag name, the late-share cut, aggregates per measure.
DPD_STEPS = {"DPD_7": 7, "DPD_15": 15, "DPD_30": 30, "DPD_60": 60, "DPD_90": 90, "DPD_180": 180, "DPD_WOF": 720}
LATE_SHARE = 0.05
INSTALMENT_SPEC = {
    "LATE_PAYMENT": ["max", "mean", "min"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "NUM_INSTALMENT_NUMBER": ["max"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "PAYMENT_DIFFERENCE": ["max", "mean", "min", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
    "PAID_OVER_AMOUNT": ["max", "mean", "min"],
}


# What depends on the part payments inside a window.
BY_WINDOW = [f"INS_PAYMENT_DIFFERENCE_{how.upper()}" for how in INSTALMENT_SPEC["PAYMENT_DIFFERENCE"]]


def fill_unpaid(df: DataFrame) -> DataFrame:
    """A payment that never came counts as nothing, paid on the application day."""
    return clean.fill(df, {"DAYS_ENTRY_PAYMENT": 0, "AMT_PAYMENT": 0})


def _payment_columns(df: DataFrame) -> DataFrame:
    """Row features, given AMT_PAYMENT_GROUPED. LATE_PAYMENT flags payment *before* the
    due day, as the feature has always been defined; IS_LATE is the plain meaning."""
    paid_over = X.difference("AMT_PAYMENT", "AMT_INSTALMENT")
    df = df.withColumns(
        {
            "PAYMENT_DIFFERENCE": X.difference("AMT_INSTALMENT", "AMT_PAYMENT_GROUPED"),
            "PAYMENT_RATIO": X.ratio("AMT_INSTALMENT", "AMT_PAYMENT_GROUPED"),
            "PAID_OVER_AMOUNT": paid_over,
            "PAID_OVER": X.above(paid_over),
            "DPD": X.clamp_negative(X.difference("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")),
            "DBD": X.clamp_negative(X.difference("DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT")),
            "INSTALMENT_PAYMENT_RATIO": X.ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
        }
    )
    df = df.withColumns({"LATE_PAYMENT": X.above("DBD"), "IS_LATE": X.above("DPD")})
    df = df.withColumn("LATE_PAYMENT_RATIO", X.keep_where("LATE_PAYMENT", "INSTALMENT_PAYMENT_RATIO"))
    return df.withColumns(
        {
            "SIGNIFICANT_LATE_PAYMENT": X.above("LATE_PAYMENT_RATIO", LATE_SHARE),
            **{name: X.at_least("DPD", days) for name, days in DPD_STEPS.items()},
        }
    )


def instalment_features(df: DataFrame) -> DataFrame:
    """Row features, with the part payments of one instalment added up."""
    return _payment_columns(attach_stat(df, INSTALMENT, "AMT_PAYMENT", "sum", "AMT_PAYMENT_GROUPED"))


def instalment_exprs(vocabulary: encode.Vocabulary) -> Exprs:
    return (
        spec_exprs(INSTALMENT_SPEC, "INS_") | share_exprs(vocabulary, "INS_") | {"INSTALLATION_COUNT": ROWS}
    )


def instalment_rollup(df: DataFrame, vocabulary: encode.Vocabulary | None = None) -> DataFrame:
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    return roll_together(instalment_features(df), ID, instalment_exprs(vocabulary), probe=df)


def _paid_by_window(rows: DataFrame, windows: Windows, gathered: bool) -> DataFrame:
    """Attach, as an array, the part payments of the instalment added up in each window.

    The applicant's key is part of the instalment's, so over gathered rows this is a
    window that moves nothing; a key too large to gather is summed and joined back.
    """
    keys, inside = [ID, *INSTALMENT], depth(OFFSET, windows)
    paid = [F.when(inside > i, F.col("AMT_PAYMENT")) for i in range(len(windows))]
    if not gathered:
        sums = F.array(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in paid])
        return rows.join(roll(rows, keys, {"_paid": sums}), keys, "left")
    same = Window.partitionBy(*keys)
    known = F.col(INSTALMENT[0]).isNotNull() & F.col(INSTALMENT[1]).isNotNull()
    sums = F.array(*[F.coalesce(F.sum(p).over(same), F.lit(0.0)) for p in paid])
    return rows.withColumn("_paid", F.when(known, sums))


def _difference_rollup(rows: DataFrame, suffixes: list[str], exprs: Exprs) -> DataFrame:
    """PAYMENT_DIFFERENCE has another value in each window: one conditional aggregate for each, no copies of rows."""
    out = {}
    for i, suffix in enumerate(suffixes):
        value = f"CASE WHEN _depth > {i} THEN AMT_INSTALMENT - _paid[{i}] END"
        wanted = {how: f"INS_PAYMENT_DIFFERENCE_{how.upper()}" for how in INSTALMENT_SPEC["PAYMENT_DIFFERENCE"]}
        built = {"max": f"max({value})", "min": f"min({value})", "mean": f"avg({value})"}
        built["sum"] = f"CASE WHEN count_if(_depth > {i}) > 0 THEN coalesce(sum({value}), 0) END"
        out |= {name + suffix: built[how] for how, name in wanted.items() if name in exprs}
    return roll(rows.filter("_depth > 0"), ID, out)


def instalment_lookback(
    df: DataFrame,
    vocabulary: encode.Vocabulary | None = None,
    windows: Windows = DAY_WINDOWS,
    columns: Collection[str] | None = None,
) -> DataFrame:
    """Part payments are added up within each window, so the sums differ by window."""
    df = fill_unpaid(df)
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    exprs = instalment_exprs(vocabulary)
    alone = lambda rows: _payment_columns(rows.withColumn("AMT_PAYMENT_GROUPED", F.lit(None).cast("double")))

    def differences(rows: DataFrame, kept: Windows, wanted: Exprs, gathered: bool) -> list[DataFrame]:
        paid = _paid_by_window(rows, kept, gathered).withColumn("_depth", depth(OFFSET, kept))
        return [_difference_rollup(paid, [suffix for suffix, _ in nested(kept)], wanted)]

    return lookback(df, ID, OFFSET, windows, exprs, columns, own=differences, apart=BY_WINDOW, features=alone)
