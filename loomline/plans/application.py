"""The applicant table: cleaning and row features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import expr as X
from loomline.operators import clean, encode
from loomline.operators.join import SMALL_ROWS
from loomline.operators.ranks import group_median
from loomline.sources.tables import cut_lineage

ID = "SK_ID_CURR"
LABEL = "TARGET"

# Replacement texts and the columns they apply to.
UNKNOWN = "Data_Not_Available"
UNKNOWN_COLUMNS = [
    "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_CONT_MOBILE", "FLAG_EMAIL",
    "OCCUPATION_TYPE",
]
ZERO_COLUMNS = ["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

# The median-income columns, by category.
INCOME_MEDIANS = {
    "NAME_CONTRACT_TYPE": "MEDIAN_INCOME_CONTRACT_TYPE",
    "NAME_TYPE_SUITE": "MEDIAN_INCOME_SUITE_TYPE",
    "NAME_HOUSING_TYPE": "MEDIAN_INCOME_HOUSING_TYPE",
    "ORGANIZATION_TYPE": "MEDIAN_INCOME_ORG_TYPE",
    "OCCUPATION_TYPE": "MEDIAN_INCOME_OCCU_TYPE",
    "NAME_EDUCATION_TYPE": "MEDIAN_INCOME_EDU_TYPE",
}

# The one document flag that is kept.
KEPT_DOCUMENT = "FLAG_DOCUMENT_3"


def fit_cleaning(df: DataFrame) -> dict[str, object]:
    """What cleaning takes from the training part: the employment outlier and the commonest family size."""
    return {
        "employed_sentinel": df.agg(F.max("DAYS_EMPLOYED")).first()[0],
        "family_members": clean.mode_value(df, "CNT_FAM_MEMBERS"),
    }


def clean_application(df: DataFrame, employed_sentinel: float | None = None, family_members: object = None) -> DataFrame:
    """Fill, recode and remove the employment outlier (the column maximum by default).

    The outlier is removed once, from every numeric column but the id and the label. Text
    fills apply to text columns; a flag that is numeric keeps its NULLs.
    """
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    if family_members is None:
        df = clean.fill_mode(df, ["CNT_FAM_MEMBERS"])
    else:
        df = clean.fill(df, {"CNT_FAM_MEMBERS": family_members})
    df = clean.null_sentinel(df, "DAYS_EMPLOYED", employed_sentinel, scope="frame", keep=[ID, LABEL])
    df = clean.fill(
        df,
        {
            **{c: UNKNOWN for c in UNKNOWN_COLUMNS if c in text},
            **{c: 0 for c in ZERO_COLUMNS},
            "NAME_TYPE_SUITE": "Unaccompanied",
        },
    )
    return clean.recode(df, {"CODE_GENDER": {"XNA": "M"}, "NAME_FAMILY_STATUS": {"Unknown": "Married"}})


def income_medians(df: DataFrame, columns: Sequence[str] = tuple(INCOME_MEDIANS)) -> dict[str, DataFrame]:
    """Exact median income per category of each column, fitted in one job.

    The result has one row per category and is written before it is used; a column with few
    categories is joined by broadcast, so that the applicants are not shuffled.
    """
    long = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_cat"), "AMT_INCOME_TOTAL") for c in columns])
        )
    )
    fixed = cut_lineage(group_median(long, ["_col", "_cat"], "AMT_INCOME_TOTAL", "_median"))
    sizes = dict(fixed.groupBy("_col").count().collect())
    parts = {c: fixed.filter(F.col("_col") == c).select(F.col("_cat").alias(c), F.col("_median").alias("median")) for c in columns}
    return {c: F.broadcast(p) if sizes.get(c, 0) <= SMALL_ROWS else p for c, p in parts.items()}


def application_row_features(df: DataFrame) -> DataFrame:
    r, d = X.ratio, X.difference
    return df.withColumns(
        {
            "CREDIT_INCOME_PERCENT": r("AMT_CREDIT", "AMT_INCOME_TOTAL"),
            "ANNUITY_INCOME_PERCENT": r("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
            "CREDIT_ANNUITY_PERCENT": r("AMT_CREDIT", "AMT_ANNUITY"),
            "FAMILY_CNT_INCOME_PERCENT": r("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
            "CREDIT_TERM": r("AMT_ANNUITY", "AMT_CREDIT"),
            "BIRTH_EMPLOYED_PERCENT": r("DAYS_EMPLOYED", "DAYS_BIRTH"),
            "CHILDREN_CNT_INCOME_PERCENT": r("AMT_INCOME_TOTAL", "CNT_CHILDREN"),
            "CREDIT_GOODS_DIFF": d("AMT_CREDIT", "AMT_GOODS_PRICE"),
            "EMPLOYED_REGISTRATION_PERCENT": r("DAYS_EMPLOYED", "DAYS_REGISTRATION"),
            "BIRTH_REGISTRATION_PERCENT": r("DAYS_BIRTH", "DAYS_REGISTRATION"),
            "ID_REGISTRATION_DIFF": d("DAYS_ID_PUBLISH", "DAYS_REGISTRATION"),
            "ANNUITY_LENGTH_EMPLOYED_PERCENT": r(r("AMT_ANNUITY", "AMT_CREDIT"), "DAYS_EMPLOYED"),
            "AGE_LOAN_FINISH": X.years_added("DAYS_BIRTH", r("AMT_CREDIT", "AMT_ANNUITY")),
            "CAR_AGE_EMP_PERCENT": r("OWN_CAR_AGE", "DAYS_EMPLOYED"),
            "CAR_AGE_BIRTH_PERCENT": r("OWN_CAR_AGE", "DAYS_BIRTH"),
            "PHONE_CHANGE_EMP_PERCENT": r("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
            "PHONE_CHANGE_BIRTH_PERCENT": r("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
        }
    )


def application_features(
    df: DataFrame,
    vocabulary: encode.Vocabulary | None = None,
    medians: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Row features, group medians, document flags dropped, categories one-hot encoded."""
    vocabulary = encode.fit_vocabulary(df) if vocabulary is None else vocabulary
    medians = income_medians(df) if medians is None else medians
    df = application_row_features(df)
    for category, alias in INCOME_MEDIANS.items():
        df = df.join(medians[category].withColumnRenamed("median", alias), category, "left")
    df = df.withColumns(
        {
            f"{kind}_TYPE_INCOME_PERCENT": X.ratio(f"MEDIAN_INCOME_{kind}_TYPE", "AMT_INCOME_TOTAL")
            for kind in ("ORG", "OCCU", "EDU")
        }
    )
    df = df.drop(*[c for c in df.columns if c.startswith("FLAG_DOCUMENT_") and c != KEPT_DOCUMENT])
    return encode.one_hot(df, vocabulary)[0]
