"""The loan-application schema, derived from the driver's tables.

Each column is one SQL expression that Spark and DuckDB both understand, so that a
recipe and its check start from the same rows. Amounts are whole numbers, which
keeps sums and means exact in any order of addition.

``DAYS(column, 'anchor')`` stands for the day difference in either dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.schemas import DOCUMENT_FLAGS, SCHEMAS
from loomline.sources.tables import table

ORDER_DAYS = "DAYS(o_orderdate, '2001-08-02')"
SHIP_DAYS = "DAYS(l_shipdate, '2001-11-05')"
EVENT_DAYS = "DAYS(ts, '2024-01-30')"
MONTH_OF_SHIPPING = f"floor({SHIP_DAYS} / 30.0)"
MONTH_OF_EVENT = f"floor({EVENT_DAYS} / 2.0)"
# A user holds one "loan" per event type.
LOAN_OF_EVENT = (
    "user_id * 5 + CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 "
    "WHEN 'click' THEN 3 ELSE 4 END"
)
CENTS = "round(c_acctbal * 100)"

SOURCES = {
    "application": "customer",
    "bureau": "orders",
    "bureau_balance": "lineitem",
    "previous_application": "orders",
    "pos_cash_balance": "events",
    "installments_payments": "lineitem JOIN orders ON l_orderkey = o_orderkey",
    "credit_card_balance": "events",
}

COLUMNS: dict[str, dict[str, str]] = {
    "application": {
        "SK_ID_CURR": "c_custkey",
        "TARGET": "CASE WHEN c_acctbal < 500 THEN 1 ELSE 0 END",
        "CNT_CHILDREN": "CASE WHEN c_nationkey < 10 THEN 0 WHEN c_nationkey < 18 THEN 1 ELSE 3 END",
        "DAYS_BIRTH": "-8000 - floor(c_acctbal + 1000)",
        "DAYS_EMPLOYED": "CASE WHEN c_nationkey = 7 THEN 365243 ELSE -1 - floor((c_acctbal + 1000) / 3) END",
        "DAYS_ID_PUBLISH": "0 - floor((c_acctbal + 1000) / 2)",
        "FLAG_MOBIL": "1",
        "FLAG_EMP_PHONE": "CASE WHEN c_nationkey > 3 THEN 1 ELSE 0 END",
        "FLAG_CONT_MOBILE": "1",
        "FLAG_EMAIL": "CASE WHEN c_nationkey > 20 THEN 1 ELSE 0 END",
        **{d: f"CASE WHEN c_nationkey = {i} THEN 1 ELSE 0 END" for i, d in enumerate(DOCUMENT_FLAGS)},
        "AMT_INCOME_TOTAL": f"{CENTS} + 200000",
        "AMT_CREDIT": f"{CENTS} * 2 + 500000",
        "AMT_ANNUITY": "CASE WHEN c_nationkey = 2 THEN NULL WHEN c_nationkey = 3 THEN 0 ELSE 20000 + c_nationkey * 1000 END",
        "AMT_GOODS_PRICE": f"CASE WHEN c_nationkey = 11 THEN NULL ELSE {CENTS} * 2 + 450000 END",
        "CNT_FAM_MEMBERS": "CASE WHEN c_nationkey = 5 THEN NULL WHEN c_nationkey < 10 THEN 2 ELSE 3 END",
        "DAYS_REGISTRATION": "0 - floor(c_acctbal + 1000)",
        "DAYS_LAST_PHONE_CHANGE": "0 - floor((c_acctbal + 1000) / 8)",
        "OWN_CAR_AGE": "CASE WHEN c_nationkey < 12 THEN NULL ELSE c_nationkey END",
        "EXT_SOURCE_1": "CASE WHEN c_nationkey < 6 THEN NULL ELSE c_nationkey / 32.0 END",
        "EXT_SOURCE_2": "c_nationkey / 64.0",
        "EXT_SOURCE_3": "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 0.5 END",
        "NAME_CONTRACT_TYPE": "CASE WHEN c_nationkey = 9 THEN 'Revolving loans' ELSE 'Cash loans' END",
        "NAME_TYPE_SUITE": "CASE WHEN c_nationkey < 4 THEN NULL WHEN c_nationkey < 8 THEN 'Family' ELSE 'Unaccompanied' END",
        "NAME_HOUSING_TYPE": "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END",
        "ORGANIZATION_TYPE": "concat('Org ', CAST(c_nationkey AS VARCHAR(10)))",
        "OCCUPATION_TYPE": "CASE WHEN c_nationkey < 3 THEN NULL ELSE c_mktsegment END",
        "NAME_EDUCATION_TYPE": "CASE WHEN c_acctbal > 5000 THEN 'Higher' ELSE 'Secondary' END",
        "CODE_GENDER": "CASE WHEN c_nationkey = 1 THEN 'XNA' WHEN c_nationkey < 13 THEN 'F' ELSE 'M' END",
        "NAME_FAMILY_STATUS": "CASE WHEN c_nationkey = 1 THEN 'Unknown' WHEN c_nationkey < 15 THEN 'Married' ELSE NULL END",
        "NAME_INCOME_TYPE": "CASE WHEN c_acctbal > 2000 THEN 'Working' ELSE 'Pensioner' END",
        "FLAG_OWN_CAR": "CASE WHEN c_nationkey < 12 THEN 'N' ELSE 'Y' END",
        "FLAG_OWN_REALTY": "CASE WHEN c_acctbal > 0 THEN 'Y' ELSE 'N' END",
        "WEEKDAY_APPR_PROCESS_START": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'MONDAY' ELSE 'FRIDAY' END",
    },
    "bureau": {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_BUREAU": "o_orderkey",
        "CREDIT_ACTIVE": "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Sold' END",
        "CREDIT_TYPE": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END",
        "DAYS_CREDIT": ORDER_DAYS,
        "DAYS_CREDIT_UPDATE": f"{ORDER_DAYS} + 10",
        "CREDIT_DAY_OVERDUE": "CASE WHEN o_orderpriority = '1-URGENT' THEN floor(o_totalprice / 100000) ELSE 0 END",
        "CNT_CREDIT_PROLONG": "CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END",
        "DAYS_CREDIT_ENDDATE": f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {ORDER_DAYS} + 365 END",
        "DAYS_ENDDATE_FACT": f"CASE WHEN o_orderstatus = 'F' THEN {ORDER_DAYS} + 300 ELSE NULL END",
        "AMT_CREDIT_SUM": "CASE WHEN o_totalprice < 20000 THEN NULL ELSE floor(o_totalprice) END",
        "AMT_CREDIT_SUM_DEBT": "CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice / 2) END",
        "AMT_ANNUITY": "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE floor(o_totalprice / 12) END",
        "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN o_orderpriority = '1-URGENT' THEN floor(o_totalprice / 50) ELSE 0 END",
        "AMT_CREDIT_SUM_LIMIT": "CASE WHEN o_totalprice > 400000 THEN NULL ELSE 100000 - floor(o_totalprice / 10) END",
        "AMT_CREDIT_MAX_OVERDUE": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE floor(o_totalprice / 80) END",
    },
    "bureau_balance": {
        "SK_ID_BUREAU": "l_orderkey",
        "MONTHS_BALANCE": MONTH_OF_SHIPPING,
        "STATUS": "CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN '0' WHEN l_returnflag = 'N' THEN 'C' ELSE 'X' END",
    },
    "previous_application": {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_PREV": "o_orderkey",
        "AMT_APPLICATION": "floor(o_totalprice)",
        "AMT_CREDIT": "CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE floor(o_totalprice / 1000) * 1100 END",
        "AMT_ANNUITY": "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE floor(o_totalprice / 12) END",
        "AMT_DOWN_PAYMENT": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice / 20) END",
        "AMT_GOODS_PRICE": "floor(o_totalprice * 0.5)",
        "CNT_PAYMENT": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 12 END",
        "RATE_DOWN_PAYMENT": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(o_totalprice / 10000) / 64.0 END",
        "RATE_INTEREST_PRIMARY": "CASE WHEN o_totalprice > 300000 THEN 0.125 ELSE NULL END",
        "RATE_INTEREST_PRIVILEGED": "CASE WHEN o_totalprice > 450000 THEN 0.75 ELSE NULL END",
        "DAYS_FIRST_DRAWING": f"CASE WHEN o_orderpriority = '1-URGENT' THEN {ORDER_DAYS} ELSE 365243 END",
        "DAYS_FIRST_DUE": f"CASE WHEN o_orderstatus = 'P' THEN 0 ELSE {ORDER_DAYS} + 30 END",
        "DAYS_LAST_DUE_1ST_VERSION": f"CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 365243 ELSE {ORDER_DAYS} + 900 END",
        "DAYS_LAST_DUE": f"CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 365243 ELSE {ORDER_DAYS} + 800 END",
        "DAYS_TERMINATION": f"CASE WHEN o_orderstatus = 'O' THEN 365243 WHEN o_orderstatus = 'P' THEN NULL ELSE {ORDER_DAYS} + 850 END",
        "NFLAG_INSURED_ON_APPROVAL": "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice > 250000 THEN 1 ELSE 0 END",
        "HOUR_APPR_PROCESS_START": "floor(o_totalprice / 25000)",
        "DAYS_DECISION": ORDER_DAYS,
        "NAME_CONTRACT_STATUS": "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END",
        "NAME_CASH_LOAN_PURPOSE": "CASE WHEN o_totalprice > 200000 THEN 'XAP' ELSE NULL END",
        "NAME_PAYMENT_TYPE": "o_orderpriority",
        "CODE_REJECT_REASON": "CASE WHEN o_orderstatus = 'O' THEN 'LIMIT' ELSE 'XAP' END",
        "NAME_CLIENT_TYPE": "CASE WHEN o_totalprice > 300000 THEN 'Repeater' ELSE 'New' END",
        "NAME_GOODS_CATEGORY": "CASE WHEN o_totalprice > 100000 THEN 'Furniture' ELSE NULL END",
        "NAME_PORTFOLIO": "CASE WHEN o_orderpriority = '5-LOW' THEN 'Cards' ELSE 'POS' END",
        "CHANNEL_TYPE": "CASE WHEN o_totalprice > 150000 THEN 'Stone' ELSE 'Country-wide' END",
    },
    "pos_cash_balance": {
        "SK_ID_PREV": LOAN_OF_EVENT,
        "SK_ID_CURR": "user_id",
        "MONTHS_BALANCE": MONTH_OF_EVENT,
        "SK_DPD": "CASE WHEN value > 30 THEN floor(value / 10) ELSE 0 END",
        "SK_DPD_DEF": "CASE WHEN value > 60 THEN 1 ELSE 0 END",
        "CNT_INSTALMENT": "CASE WHEN value < 1 THEN NULL ELSE floor(value / 5) END",
        "CNT_INSTALMENT_FUTURE": "CASE WHEN value < 2 THEN NULL ELSE floor(value / 7) END",
        "NAME_CONTRACT_STATUS": "CASE WHEN value < 0.5 THEN NULL WHEN value > 25 THEN 'Completed' ELSE 'Active' END",
    },
    "installments_payments": {
        "SK_ID_PREV": "l_orderkey",
        "SK_ID_CURR": "o_custkey",
        "NUM_INSTALMENT_NUMBER": "l_linenumber",
        "NUM_INSTALMENT_VERSION": "round(l_tax * 100)",
        "DAYS_INSTALMENT": SHIP_DAYS,
        "DAYS_ENTRY_PAYMENT": f"CASE WHEN l_discount = 0 THEN NULL ELSE {SHIP_DAYS} + l_quantity - 25 END",
        "AMT_INSTALMENT": "floor(l_extendedprice)",
        "AMT_PAYMENT": "CASE WHEN l_discount = 0 THEN NULL ELSE floor(l_extendedprice) - floor(l_quantity) * 10 + 100 END",
    },
    "credit_card_balance": {
        "SK_ID_PREV": LOAN_OF_EVENT,
        "SK_ID_CURR": "user_id",
        "MONTHS_BALANCE": MONTH_OF_EVENT,
        "SK_DPD": "CASE WHEN value > 40 THEN 7 ELSE 0 END",
        "AMT_BALANCE": "floor(value * 3)",
        "AMT_CREDIT_LIMIT_ACTUAL": "CASE WHEN event_type = 'error' THEN 0 ELSE 510 END",
        "AMT_PAYMENT_CURRENT": "CASE WHEN event_type = 'view' THEN NULL ELSE floor(value) END",
        "AMT_INST_MIN_REGULARITY": "CASE WHEN value < 3 THEN 0 ELSE 17 END",
        "AMT_DRAWINGS_ATM_CURRENT": "CASE WHEN event_type = 'purchase' THEN floor(value * 2) ELSE NULL END",
        "AMT_RECIVABLE": "floor(value * 4)",
        "CNT_DRAWINGS_CURRENT": "floor(value / 9)",
        "CNT_INSTALMENT_MATURE_CUM": "CASE WHEN event_type = 'click' THEN NULL ELSE floor(value / 4) END",
        "NAME_CONTRACT_STATUS": "CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'Signed' ELSE 'Active' END",
    },
}

DAYS = re.compile(r"DAYS\((\w+), ('[^']+')\)")


def _typed(name: str) -> dict[str, str]:
    dtype = {c: d for d, names in SCHEMAS[name].items() for c in names.split()}
    cast = {"string": "VARCHAR(100)"}
    return {c: f"CAST({e} AS {cast.get(dtype[c], dtype[c])})" for c, e in COLUMNS[name].items()}


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The derived table as a Spark plan over the driver's files."""
    exprs = []
    for c, e in _typed(name).items():
        e = DAYS.sub(r"datediff(\1, DATE\2)", e).replace("VARCHAR(100)", "STRING").replace("VARCHAR(10)", "STRING")
        exprs.append(f"{e} AS {c}")
    first, _, rest = SOURCES[name].partition(" JOIN ")
    df = table(spark, folder, first)
    if rest:
        other, _, condition = rest.partition(" ON ")
        df = df.join(table(spark, folder, other), F.expr(condition))
    return df.selectExpr(*exprs)


def frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: frame(spark, folder, name) for name in COLUMNS}


def cte(name: str) -> str:
    """``name AS (SELECT ...)`` for the same table in DuckDB."""
    exprs = ", ".join(
        DAYS.sub(r"date_diff('day', DATE \2, CAST(\1 AS DATE))", e) + f" AS {c}" for c, e in _typed(name).items()
    )
    return f"{name} AS (SELECT {exprs} FROM {SOURCES[name]})"
