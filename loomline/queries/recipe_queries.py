"""The feature recipes over the derived loan-application tables, each against plain SQL."""

from __future__ import annotations

import uuid

from loomline.operators import learn as L
from loomline.operators.columns import sanitise_names
from loomline.operators.lookback import DAY_WINDOWS, MONTH_WINDOWS
from loomline.plans import application as A
from loomline.plans import bureau as B
from loomline.plans import cards as C
from loomline.plans import instalments as I
from loomline.plans import matrix as M
from loomline.plans import pos as P
from loomline.plans import previous as V
from loomline.plans import training as T
from loomline.queries import sqlgen as S
from loomline.queries.derived import cte, frame, frames
from loomline.queries.registry import query, rounded
from loomline.sources.schemas import DOCUMENT_FLAGS, SCHEMAS
from loomline.sources.tables import checkpoint_folder, written

ID = "SK_ID_CURR"


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


def _columns(name: str) -> list[str]:
    return [c for names in SCHEMAS[name].values() for c in names.split()]


# ---------------------------------------------------------------- applicants

NUMERIC = [c for d in ("bigint", "int", "double") for c in SCHEMAS["application"][d].split()]


def _clean_application_cte(fitted_on: str = "TRUE") -> str:
    """Cleaned applicants; outlier and mode come from the rows where ``fitted_on`` holds."""
    employed = f"(SELECT max(DAYS_EMPLOYED) FROM application WHERE {fitted_on})"
    mode = (
        f"(SELECT CNT_FAM_MEMBERS FROM application WHERE CNT_FAM_MEMBERS IS NOT NULL AND {fitted_on} GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)"
    )
    exprs = {c: c for c in _columns("application")}
    exprs["CNT_FAM_MEMBERS"] = f"coalesce(CNT_FAM_MEMBERS, {mode})"
    for c in NUMERIC:
        exprs[c] = f"nullif({exprs[c]}, {employed})"
    for c in A.ZERO_COLUMNS:
        exprs[c] = f"coalesce({exprs[c]}, 0)"
    for c in ("NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE"):
        exprs[c] = f"coalesce({c}, 'Data_Not_Available')"
    exprs["NAME_TYPE_SUITE"] = "coalesce(NAME_TYPE_SUITE, 'Unaccompanied')"
    exprs["NAME_FAMILY_STATUS"] = f"CASE WHEN NAME_FAMILY_STATUS = 'Unknown' THEN 'Married' ELSE {exprs['NAME_FAMILY_STATUS']} END"
    exprs["CODE_GENDER"] = "CASE WHEN CODE_GENDER = 'XNA' THEN 'M' ELSE CODE_GENDER END"
    return f"{cte('application')}, cleaned AS (SELECT {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM application)"


@query("clean_application", f"WITH {_clean_application_cte()} SELECT * FROM cleaned")
def clean_application(spark, folder):
    return A.clean_application(frame(spark, folder, "application"))


APPLICATION_VOCABULARY = {
    "NAME_CONTRACT_TYPE": ["Cash loans", "Revolving loans"],
    "NAME_TYPE_SUITE": ["Family", "Unaccompanied"],
    "NAME_HOUSING_TYPE": ["AUTOMOBILE", "BUILDING", "Data_Not_Available", "FURNITURE", "HOUSEHOLD"],
    "ORGANIZATION_TYPE": [f"Org {i}" for i in range(25)],
    "OCCUPATION_TYPE": ["AUTOMOBILE", "BUILDING", "Data_Not_Available", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "NAME_EDUCATION_TYPE": ["Higher", "Secondary"],
    "CODE_GENDER": ["F", "M"],
    "NAME_FAMILY_STATUS": ["Data_Not_Available", "Married"],
    "NAME_INCOME_TYPE": ["Pensioner", "Working"],
    "FLAG_OWN_CAR": ["N", "Y"],
    "FLAG_OWN_REALTY": ["N", "Y"],
    "WEEKDAY_APPR_PROCESS_START": ["FRIDAY", "MONDAY"],
}


def _application_features_sql(fitted_on: str = "TRUE", vocabulary=APPLICATION_VOCABULARY) -> str:
    ratios = {
        "CREDIT_INCOME_PERCENT": _div("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_INCOME_PERCENT": _div("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "CREDIT_ANNUITY_PERCENT": _div("AMT_CREDIT", "AMT_ANNUITY"),
        "FAMILY_CNT_INCOME_PERCENT": _div("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "CREDIT_TERM": _div("AMT_ANNUITY", "AMT_CREDIT"),
        "BIRTH_EMPLOYED_PERCENT": _div("DAYS_EMPLOYED", "DAYS_BIRTH"),
        "CHILDREN_CNT_INCOME_PERCENT": _div("AMT_INCOME_TOTAL", "CNT_CHILDREN"),
        "CREDIT_GOODS_DIFF": "AMT_CREDIT - AMT_GOODS_PRICE",
        "EMPLOYED_REGISTRATION_PERCENT": _div("DAYS_EMPLOYED", "DAYS_REGISTRATION"),
        "BIRTH_REGISTRATION_PERCENT": _div("DAYS_BIRTH", "DAYS_REGISTRATION"),
        "ID_REGISTRATION_DIFF": "DAYS_ID_PUBLISH - DAYS_REGISTRATION",
        "ANNUITY_LENGTH_EMPLOYED_PERCENT": _div(_div("AMT_ANNUITY", "AMT_CREDIT"), "DAYS_EMPLOYED"),
        "AGE_LOAN_FINISH": f"DAYS_BIRTH * (-1.0::DOUBLE / 365) + ({_div('AMT_CREDIT', 'AMT_ANNUITY')}) * (1.0::DOUBLE / 12)",
        "CAR_AGE_EMP_PERCENT": _div("OWN_CAR_AGE", "DAYS_EMPLOYED"),
        "CAR_AGE_BIRTH_PERCENT": _div("OWN_CAR_AGE", "DAYS_BIRTH"),
        "PHONE_CHANGE_EMP_PERCENT": _div("DAYS_LAST_PHONE_CHANGE", "DAYS_EMPLOYED"),
        "PHONE_CHANGE_BIRTH_PERCENT": _div("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
    }
    income = f"CASE WHEN {fitted_on} THEN AMT_INCOME_TOTAL END"
    medians = {a: f"median({income}) OVER (PARTITION BY {c})" for c, a in A.INCOME_MEDIANS.items()}
    kinds = {f"{k}_TYPE_INCOME_PERCENT": _div(f"MEDIAN_INCOME_{k}_TYPE", "AMT_INCOME_TOTAL") for k in ("ORG", "OCCU", "EDU")}
    flags = [
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in vocabulary.items() for v in vs
    ]
    # Rounding drops the sign of a zero in Spark; adding zero does so in DuckDB.
    kept = [c for c in NUMERIC if c not in DOCUMENT_FLAGS or c == A.KEPT_DOCUMENT]
    one = ", ".join(f"{e} AS {c}" for c, e in {**ratios, **medians}.items())
    all_columns = ", ".join(
        [*kept, *[f"round({c}, 9) + 0 AS {c}" for c in ratios], *medians, *[f"round({e}, 9) AS {c}" for c, e in kinds.items()], *flags]
    )
    return f"WITH {_clean_application_cte(fitted_on)}, f AS (SELECT *, {one} FROM cleaned) SELECT {all_columns} FROM f"


def _new_doubles(df) -> list[str]:
    """Fractional columns that the application recipe adds, but for exact medians."""
    return [f.name for f in df.schema if f.dataType.simpleString() == "double" and f.name not in NUMERIC and not f.name.startswith("MEDIAN_")]


@query("application_features", _application_features_sql())
def application_features(spark, folder):
    out = A.application_features(A.clean_application(frame(spark, folder, "application")))
    return rounded(out, 9, *_new_doubles(out))


TRAIN_PART = "WEEKDAY_APPR_PROCESS_START = 'FRIDAY'"
# Monday's applicants are those of one segment, so two more columns have a value that only they have.
TRAIN_VOCABULARY = {c: [v for v in vs if v not in ("MONDAY", "BUILDING")] for c, vs in APPLICATION_VOCABULARY.items()}


@query(
    "train_test_prepare",
    f"""
    SELECT * REPLACE (CASE WHEN WEEKDAY_APPR_PROCESS_START_FRIDAY = 1 THEN TARGET END AS TARGET)
    FROM ({_application_features_sql(TRAIN_PART, TRAIN_VOCABULARY)})
    """,
)
def train_test_prepare(spark, folder):
    """Monday's applicants are the unlabelled part: all that is fitted comes from the others."""
    df = frame(spark, folder, "application")
    out = M.applicants(df.filter(TRAIN_PART), df.filter(f"NOT ({TRAIN_PART})").drop("TARGET"))
    return rounded(out, 9, *_new_doubles(out))


# ---------------------------------------------------------------- external credits


def _bureau_features_sql() -> str:
    zero = {c: f"coalesce({c}, 0)" for c in B.NULL_IS_ZERO}
    rows = {
        "CREDIT_DURATION": "DAYS_CREDIT_ENDDATE - DAYS_CREDIT",
        "ENDDATE_DIFF": "DAYS_CREDIT_ENDDATE - DAYS_ENDDATE_FACT",
        "UPDATE_DIFF": "DAYS_CREDIT_ENDDATE - DAYS_CREDIT_UPDATE",
        "DEBT_PERCENTAGE": _div("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
        "DEBT_CREDIT_DIFF": "AMT_CREDIT_SUM - AMT_CREDIT_SUM_DEBT",
        "CREDIT_TO_ANNUITY_RATIO": _div("AMT_CREDIT_SUM", "AMT_ANNUITY"),
        "DEBT_TO_ANNUITY_RATIO": _div("AMT_CREDIT_SUM_DEBT", "AMT_ANNUITY"),
        "CREDIT_OVERDUE_DIFF": "AMT_CREDIT_SUM - AMT_CREDIT_SUM_OVERDUE",
        "CREDIT_TYPE_CODE": "CASE CREDIT_ACTIVE WHEN 'Closed' THEN 0 WHEN 'Active' THEN 1 ELSE 2 END",
    }
    source = [c for c in _columns("bureau") if c not in zero]
    totals = {
        "CUSTOMER_LOAN_COUNT": "count(SK_ID_BUREAU)",
        "CUSTOMER_CREDIT_TYPES": "count(DISTINCT CREDIT_TYPE)",
        "CUSTOMER_CREDIT_CODE_MEAN": "avg(CREDIT_TYPE_CODE)",
        "TOTAL_CREDIT_SUM": "CAST(sum(AMT_CREDIT_SUM) AS DOUBLE)",
        "TOTAL_DEBT_SUM": "CAST(sum(AMT_CREDIT_SUM_DEBT) AS DOUBLE)",
    }
    r = ", ".join([*source, *[f"{e} AS {c}" for c, e in {**zero, **rows}.items()]])
    t = ", ".join(f"{e} AS {c}" for c, e in totals.items())
    return f"""
    WITH {cte('bureau')}, r AS (SELECT {r} FROM bureau), t AS (SELECT {ID}, {t} FROM r GROUP BY {ID})
    SELECT r.*, t.* EXCLUDE ({ID}), {_div('CUSTOMER_LOAN_COUNT', 'CUSTOMER_CREDIT_TYPES')} AS AVG_LOAN_TYPE,
           {_div('TOTAL_CREDIT_SUM', 'TOTAL_DEBT_SUM')} AS CREDIT_DEBT_RATIO
    FROM r LEFT JOIN t USING ({ID})
    """


@query("bureau_loan_features", _bureau_features_sql())
def bureau_loan_features(spark, folder):
    return B.bureau_loan_features(frame(spark, folder, "bureau"))


BUREAU_VOCABULARY = {
    "CREDIT_ACTIVE": ["Active", "Closed", "Sold", None],
    "CREDIT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", None],
}
BALANCE_VOCABULARY = {"STATUS": ["0", "C", "X", None]}


def _bureau_rollup_sql() -> str:
    per_credit = S.spec_items({"MONTHS_BALANCE": B.BALANCE_AGGS}) + S.share_items(BALANCE_VOCABULARY, hows=B.BALANCE_AGGS)
    flags = ["STATUS_0", "STATUS_C", "STATUS_X", "STATUS_nan"]
    balance = {f"{f}_{h.upper()}": [h] for f in flags for h in ("mean", "min", "max")}
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in B.NULL_IS_ZERO)
    items = (
        S.spec_items(B.CREDIT_SPEC, "BUREAU_", upper=False, default_places=6)
        + S.share_items(BUREAU_VOCABULARY, "BUREAU_", hows=["max"], upper=False)
        + S.spec_items(balance, "BUREAU_", upper=False, default_places=6)
        + S.spec_items(B.CREDIT_SPEC, "C_", where="CREDIT_ACTIVE = 'Closed'", default_places=6)
    )
    return f"""
    WITH {cte('bureau')}, {cte('bureau_balance')},
    b AS (SELECT SK_ID_BUREAU, {', '.join(per_credit)} FROM bureau_balance GROUP BY 1),
    j AS (SELECT * FROM (SELECT * REPLACE ({zero}) FROM bureau) LEFT JOIN b USING (SK_ID_BUREAU))
    SELECT {ID}, {', '.join(items)} FROM j GROUP BY {ID}
    """


@query("bureau_rollup", _bureau_rollup_sql())
def bureau_rollup(spark, folder):
    return rounded(B.bureau_rollup(frame(spark, folder, "bureau"), frame(spark, folder, "bureau_balance")), 6)


# ---------------------------------------------------------------- earlier applications


def _clean_previous_cte() -> str:
    maximum = {c: f"(SELECT max(nullif({c}, 0)) FROM previous_application)" for c in V.ZERO_IS_NULL}
    replaced = [f"nullif(nullif({c}, 0), {maximum[c]}) AS {c}" for c in V.ZERO_IS_NULL]
    drawing = "DAYS_FIRST_DRAWING"
    replaced.append(f"nullif({drawing}, (SELECT max({drawing}) FROM previous_application)) AS {drawing}")
    return f"{cte('previous_application')}, cleaned AS (SELECT * REPLACE ({', '.join(replaced)}) FROM previous_application)"


@query("clean_previous", f"WITH {_clean_previous_cte()} SELECT * FROM cleaned")
def clean_previous(spark, folder):
    return V.clean_previous(frame(spark, folder, "previous_application"))


PREVIOUS_ROWS = {
    "APPLICATION_CREDIT_DIFF": "AMT_APPLICATION - AMT_CREDIT",
    "APPLICATION_CREDIT_RATIO": _div("AMT_APPLICATION", "AMT_CREDIT"),
    "CREDIT_TO_ANNUITY_RATIO": _div("AMT_CREDIT", "AMT_ANNUITY"),
    "DOWN_PAYMENT_TO_CREDIT": _div("AMT_DOWN_PAYMENT", "AMT_CREDIT"),
    "SIMPLE_INTERESTS": _div(f"({_div('AMT_ANNUITY * CNT_PAYMENT', 'AMT_CREDIT')} - 1)", "CNT_PAYMENT"),
    "DAYS_LAST_DUE_DIFF": "DAYS_LAST_DUE_1ST_VERSION - DAYS_LAST_DUE",
}
PREVIOUS_ROWS_SQL = "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in PREVIOUS_ROWS.items()) + " FROM cleaned"


@query("previous_features", f"WITH {_clean_previous_cte()} {PREVIOUS_ROWS_SQL}")
def previous_features(spark, folder):
    return V.previous_features(V.clean_previous(frame(spark, folder, "previous_application")))


PREVIOUS_VOCABULARY = {
    "NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused", None],
    "NAME_CASH_LOAN_PURPOSE": ["XAP", None],
    "NAME_PAYMENT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", None],
    "CODE_REJECT_REASON": ["LIMIT", "XAP", None],
    "NAME_CLIENT_TYPE": ["New", "Repeater", None],
    "NAME_GOODS_CATEGORY": ["Furniture", None],
    "NAME_PORTFOLIO": ["Cards", "POS", None],
    "CHANNEL_TYPE": ["Country-wide", "Stone", None],
}
RATIO_PLACES = {"APPLICATION_CREDIT_RATIO": 6, "DOWN_PAYMENT_TO_CREDIT": 6}


def _previous_items(windows) -> list[str]:
    items = []
    for suffix, where in S.windows_of("DAYS_DECISION", windows).items():
        items += S.spec_items(V.PREVIOUS_SPEC, "PREV_", suffix, where, places=RATIO_PLACES)
        items += S.share_items(PREVIOUS_VOCABULARY, "PREV_", suffix, where)
        for status, prefix in V.STATUS_PREFIX.items():
            test = f"{where} AND NAME_CONTRACT_STATUS = '{status}'"
            items += S.spec_items(V.PREVIOUS_SPEC, prefix, suffix, test, places=RATIO_PLACES)
    return items


def _previous_sql(windows) -> str:
    return (
        f"WITH {_clean_previous_cte()}, f AS ({PREVIOUS_ROWS_SQL}) "
        f"SELECT {ID}, {', '.join(_previous_items(windows))} FROM f GROUP BY {ID}"
    )


def _round_ratio_means(df):
    return rounded(df, 6, *[c for c in df.columns if "MEAN" in c and any(r in c for r in RATIO_PLACES)])


@query("previous_rollup", _previous_sql({"": None}))
def previous_rollup(spark, folder):
    return _round_ratio_means(V.previous_rollup(V.clean_previous(frame(spark, folder, "previous_application"))))


@query("previous_lookback", _previous_sql(DAY_WINDOWS))
def previous_lookback(spark, folder):
    return _round_ratio_means(V.previous_lookback(V.clean_previous(frame(spark, folder, "previous_application"))))


# ---------------------------------------------------------------- point-of-sale balances

POS_VOCABULARY = {"NAME_CONTRACT_STATUS": ["Active", "Completed", None]}
POS_LOAN_COLUMNS = [
    "POS_LOAN_COMPLETED_MEAN", "POS_COMPLETED_BEFORE_MEAN", "POS_REMAINING_INSTALMENTS", "POS_REMAINING_INSTALMENTS_RATIO",
]


def _pos_window(suffix: str, where: str) -> str:
    """One window as a subquery: per applicant, and per loan summed per applicant."""
    def end(f: str, c: str) -> str:
        return f"{f}({c}, (MONTHS_BALANCE, {c})) FILTER (WHERE {c} IS NOT NULL)"

    rows = S.spec_items(P.POS_SPEC, "POS_", suffix) + S.share_items(POS_VOCABULARY, "POS_", suffix)
    sums = [f'round(coalesce(CAST(sum({c}) AS DOUBLE), 0), 6) AS "{c}{suffix}"' for c in POS_LOAN_COLUMNS if "BEFORE" not in c]
    sums.append(f'coalesce(CAST(sum(POS_COMPLETED_BEFORE_MEAN) AS BIGINT), 0) AS "POS_COMPLETED_BEFORE_MEAN{suffix}"')
    return f"""
    (WITH w AS (SELECT * FROM pos_cash_balance WHERE {where}),
    l AS (SELECT SK_ID_PREV, arg_min({ID}, (MONTHS_BALANCE, {ID})) AS {ID},
                 avg(CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END) AS done,
                 {end('arg_min', 'CNT_INSTALMENT')} AS f, {end('arg_max', 'CNT_INSTALMENT')} AS l,
                 {end('arg_max', 'CNT_INSTALMENT_FUTURE')} AS r FROM w GROUP BY SK_ID_PREV),
    m AS (SELECT {ID}, done AS POS_LOAN_COMPLETED_MEAN,
                 CASE WHEN f - l > 0 AND done > 0 THEN 1 ELSE 0 END AS POS_COMPLETED_BEFORE_MEAN,
                 r AS POS_REMAINING_INSTALMENTS, r / nullif(l, 0) AS POS_REMAINING_INSTALMENTS_RATIO FROM l),
    s AS (SELECT {ID}, {', '.join(sums)} FROM m GROUP BY {ID})
    SELECT * FROM (SELECT {ID}, {', '.join(rows)} FROM w GROUP BY {ID}) LEFT JOIN s USING ({ID}))
    """


def _pos_sql(windows) -> str:
    parts = [_pos_window(s, w) for s, w in S.windows_of("MONTHS_BALANCE", windows).items()]
    joined = " LEFT JOIN ".join(f"{p} w{i}" + (f" USING ({ID})" if i else "") for i, p in enumerate(parts))
    return f"WITH {cte('pos_cash_balance')} SELECT * FROM {joined}"


def _round_pos(df):
    return rounded(df, 6, *[c for c in df.columns if c.startswith(tuple(POS_LOAN_COLUMNS))])


@query("pos_rollup", _pos_sql({"": None}))
def pos_rollup(spark, folder):
    return _round_pos(P.pos_rollup(frame(spark, folder, "pos_cash_balance")))


@query("pos_lookback", _pos_sql(MONTH_WINDOWS))
def pos_lookback(spark, folder):
    return _round_pos(P.pos_lookback(frame(spark, folder, "pos_cash_balance")))


# ---------------------------------------------------------------- instalments

UNPAID = "coalesce(DAYS_ENTRY_PAYMENT, 0) AS DAYS_ENTRY_PAYMENT, coalesce(AMT_PAYMENT, 0) AS AMT_PAYMENT"


def _instalment_rows(source: str) -> str:
    g = "coalesce(sum(AMT_PAYMENT) OVER (PARTITION BY SK_ID_PREV, NUM_INSTALMENT_NUMBER), 0)"
    early, late = "DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT", "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT"
    steps = ", ".join(f"CASE WHEN DPD >= {d} THEN 1 ELSE 0 END AS {c}" for c, d in I.DPD_STEPS.items())
    return f"""
    SELECT *, CASE WHEN LATE_PAYMENT_RATIO > 0.05 THEN 1 ELSE 0 END AS SIGNIFICANT_LATE_PAYMENT FROM (
        SELECT *, CASE WHEN LATE_PAYMENT = 1 THEN INSTALMENT_PAYMENT_RATIO ELSE 0 END AS LATE_PAYMENT_RATIO, {steps} FROM (
            SELECT *, AMT_INSTALMENT - AMT_PAYMENT_GROUPED AS PAYMENT_DIFFERENCE,
                   {_div('AMT_INSTALMENT', 'AMT_PAYMENT_GROUPED')} AS PAYMENT_RATIO,
                   AMT_PAYMENT - AMT_INSTALMENT AS PAID_OVER_AMOUNT,
                   CASE WHEN AMT_PAYMENT > AMT_INSTALMENT THEN 1 ELSE 0 END AS PAID_OVER,
                   CAST(CASE WHEN {late} <= 0 THEN 0 ELSE {late} END AS DOUBLE) AS DPD,
                   CAST(CASE WHEN {early} <= 0 THEN 0 ELSE {early} END AS DOUBLE) AS DBD,
                   CASE WHEN {early} > 0 THEN 1 ELSE 0 END AS LATE_PAYMENT,
                   CASE WHEN {late} > 0 THEN 1 ELSE 0 END AS IS_LATE,
                   {_div('AMT_PAYMENT', 'AMT_INSTALMENT')} AS INSTALMENT_PAYMENT_RATIO
            FROM (SELECT *, {g} AS AMT_PAYMENT_GROUPED FROM {source})))
    """


@query("instalment_features", f"WITH {cte('installments_payments')} {_instalment_rows('installments_payments')}")
def instalment_features(spark, folder):
    return I.instalment_features(frame(spark, folder, "installments_payments"))


def _instalment_sql(windows) -> str:
    parts = []
    for i, (suffix, where) in enumerate(S.windows_of("DAYS_INSTALMENT", windows).items()):
        items = S.spec_items(I.INSTALMENT_SPEC, "INS_", suffix) + [f'count(*) AS "INSTALLATION_COUNT{suffix}"']
        rows = _instalment_rows(f"(SELECT * REPLACE ({UNPAID}) FROM installments_payments WHERE {where})")
        parts.append(f"(SELECT {ID}, {', '.join(items)} FROM ({rows}) GROUP BY {ID}) w{i}" + (f" USING ({ID})" if i else ""))
    return f"WITH {cte('installments_payments')} SELECT * FROM {' LEFT JOIN '.join(parts)}"


@query("instalment_rollup", _instalment_sql({"": None}))
def instalment_rollup(spark, folder):
    return I.instalment_rollup(I.fill_unpaid(frame(spark, folder, "installments_payments")))


@query("instalment_lookback", _instalment_sql(DAY_WINDOWS))
def instalment_lookback(spark, folder):
    return I.instalment_lookback(frame(spark, folder, "installments_payments"))


# ---------------------------------------------------------------- cards

CARD_VOCABULARY = {"NAME_CONTRACT_STATUS": ["Active", "Signed", None]}
CARD_ROWS_SQL = f"""
    SELECT * EXCLUDE (AMT_RECIVABLE), AMT_RECIVABLE AS AMT_RECEIVABLE,
           {_div('AMT_BALANCE', 'AMT_CREDIT_LIMIT_ACTUAL')} AS LIMIT_USE,
           {_div('AMT_PAYMENT_CURRENT', 'AMT_INST_MIN_REGULARITY')} AS PAYMENT_DIV_MIN,
           CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS LATE_PAYMENT,
           {_div('AMT_DRAWINGS_ATM_CURRENT', 'AMT_CREDIT_LIMIT_ACTUAL')} AS DRAWING_LIMIT_RATIO
    FROM credit_card_balance
"""
CARD_MEASURES = [
    "MONTHS_BALANCE", "SK_DPD", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY",
    "AMT_DRAWINGS_ATM_CURRENT", "AMT_RECEIVABLE", "CNT_DRAWINGS_CURRENT", "CNT_INSTALMENT_MATURE_CUM", "LIMIT_USE",
    "PAYMENT_DIV_MIN", "LATE_PAYMENT", "DRAWING_LIMIT_RATIO",
]


def _card_items(windows) -> list[str]:
    items = []
    for suffix, where in S.windows_of("MONTHS_BALANCE", windows).items():
        items += S.spec_items({c: C.CARD_AGGS for c in CARD_MEASURES}, "CR_", suffix, where, default_places=6)
        items += S.share_items(CARD_VOCABULARY, "CR_", suffix, where, C.CARD_AGGS, places={"var": 6, "mean": 6})
        items.append(f'{S.agg("*", "size", where)} AS "CREDIT_COUNT{suffix}"')
    return items


def _card_sql(windows) -> str:
    return (
        f"WITH {cte('credit_card_balance')}, f AS ({CARD_ROWS_SQL}) "
        f"SELECT {ID}, {', '.join(_card_items(windows))} FROM f GROUP BY {ID}"
    )


def _round_cards(df):
    return rounded(df, 6, *[c for c in df.columns if any(h in c for h in ("_MEAN", "_SUM", "_VAR"))])


@query("card_rollup", _card_sql({"": None}))
def card_rollup(spark, folder):
    return _round_cards(C.card_rollup(frame(spark, folder, "credit_card_balance")))


@query("card_lookback", _card_sql(MONTH_WINDOWS))
def card_lookback(spark, folder):
    return _round_cards(C.card_lookback(frame(spark, folder, "credit_card_balance")))


# ---------------------------------------------------------------- the matrix and after


MATRIX_COLUMNS = [
    "TARGET", "CREDIT_TERM", "ORG_TYPE_INCOME_PERCENT", "BUREAU_DAYS_CREDIT_mean", "BUREAU_STATUS_C_MEAN_mean",
    "C_AMT_CREDIT_SUM_SUM", "PREV_AMT_CREDIT_MAX_year", "CS_REF_AMT_ANNUITY_MEAN_quarter", "PREV_CHANNEL_TYPE_Stone_MEAN",
    "POS_SK_DPD_MAX_half_year", "POS_REMAINING_INSTALMENTS", "INS_AMT_PAYMENT_SUM_month", "INSTALLATION_COUNT_week",
    "CR_LIMIT_USE_MEAN_quarter", "CREDIT_COUNT",
]


@query(
    "feature_matrix",
    f"""
    WITH base AS ({_application_features_sql()}), bureau_part AS ({_bureau_rollup_sql()}),
    previous_part AS ({_previous_sql(DAY_WINDOWS)}), pos_part AS ({_pos_sql(MONTH_WINDOWS)}),
    instalment_part AS ({_instalment_sql(DAY_WINDOWS)}), card_part AS ({_card_sql(MONTH_WINDOWS)})
    SELECT {', '.join(f'"{c}"' for c in [ID, *MATRIX_COLUMNS])}
    FROM base LEFT JOIN bureau_part USING ({ID}) LEFT JOIN previous_part USING ({ID}) LEFT JOIN pos_part USING ({ID})
    LEFT JOIN instalment_part USING ({ID}) LEFT JOIN card_part USING ({ID})
    """,
)
def feature_matrix(spark, folder):
    """Every recipe joined to every applicant, computing the selected columns of each part."""
    out = rounded(M.feature_matrix(frames(spark, folder), columns=MATRIX_COLUMNS), 9, "CREDIT_TERM", "ORG_TYPE_INCOME_PERCENT")
    return rounded(
        out, 6, "BUREAU_DAYS_CREDIT_mean", "BUREAU_STATUS_C_MEAN_mean", "POS_REMAINING_INSTALMENTS", "CR_LIMIT_USE_MEAN_quarter"
    )


@query(
    "feature_matrix_full",
    f"""
    SELECT * FROM ({_application_features_sql()}) LEFT JOIN ({_bureau_rollup_sql()}) USING ({ID})
    LEFT JOIN ({_previous_sql(DAY_WINDOWS)}) USING ({ID}) LEFT JOIN ({_pos_sql(MONTH_WINDOWS)}) USING ({ID})
    LEFT JOIN ({_instalment_sql(DAY_WINDOWS)}) USING ({ID}) LEFT JOIN ({_card_sql(MONTH_WINDOWS)}) USING ({ID})
    """,
)
def feature_matrix_full(spark, folder):
    """Every column of every recipe, joined to every applicant."""
    out = M.feature_matrix(frames(spark, folder))
    base = out.columns.index(next(c for c in out.columns if c.startswith("BUREAU_")))
    doubles = [f.name for f in out.schema if f.dataType.simpleString() == "double"]
    places = {c: 9 for c in _new_doubles(out.select(*out.columns[:base]))}
    places |= {c: 6 for c in doubles if c.startswith(("BUREAU_", "C_", *POS_LOAN_COLUMNS))}
    places |= {c: 6 for c in doubles if "MEAN" in c and any(r in c for r in RATIO_PLACES)}
    places |= {c: 6 for c in doubles if c.startswith("CR_") and any(h in c for h in ("_MEAN", "_SUM", "_VAR"))}
    return out.selectExpr(*[f"round(`{c}`, {places[c]}) AS `{c}`" if c in places else f"`{c}`" for c in out.columns])


@query("score_applicants")
def score_applicants(spark, folder):
    """From tables to decisions: every feature of every recipe, the best 500 by F, folds, mean score, label and message."""
    parts = f"{checkpoint_folder(spark)}/rollups-{uuid.uuid4().hex}"
    # The selection reads the whole matrix and the folds read what it keeps, so both start from files.
    matrix = written(sanitise_names(M.feature_matrix(frames(spark, folder), parts)))
    top = L.selected(L.anova_topk(matrix, T.feature_columns(matrix), "TARGET"))
    return T.score_applicants(matrix, ID, "TARGET", top, maxDepth=3, maxIter=5, seed=42)
