"""Declared schemas of the loan-application tables.

Only the columns the feature recipes name are listed. A table may carry more: string
columns are one-hot encoded and numeric card columns are aggregated whatever they are.
"""

from __future__ import annotations

from pyspark.sql import types as T


DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]

SCHEMAS: dict[str, dict[str, str]] = {
    "application": {
        "bigint": "SK_ID_CURR",
        "int": "TARGET CNT_CHILDREN DAYS_BIRTH DAYS_EMPLOYED DAYS_ID_PUBLISH FLAG_MOBIL FLAG_EMP_PHONE "
        "FLAG_CONT_MOBILE FLAG_EMAIL " + " ".join(DOCUMENT_FLAGS),
        "double": "AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE CNT_FAM_MEMBERS DAYS_REGISTRATION "
        "DAYS_LAST_PHONE_CHANGE OWN_CAR_AGE EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3",
        "string": "NAME_CONTRACT_TYPE NAME_TYPE_SUITE NAME_HOUSING_TYPE ORGANIZATION_TYPE OCCUPATION_TYPE "
        "NAME_EDUCATION_TYPE CODE_GENDER NAME_FAMILY_STATUS NAME_INCOME_TYPE FLAG_OWN_CAR FLAG_OWN_REALTY "
        "WEEKDAY_APPR_PROCESS_START",
    },
    "bureau": {
        "bigint": "SK_ID_CURR SK_ID_BUREAU",
        "string": "CREDIT_ACTIVE CREDIT_TYPE",
        "int": "DAYS_CREDIT DAYS_CREDIT_UPDATE CREDIT_DAY_OVERDUE CNT_CREDIT_PROLONG",
        "double": "DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_ANNUITY "
        "AMT_CREDIT_SUM_OVERDUE AMT_CREDIT_SUM_LIMIT AMT_CREDIT_MAX_OVERDUE",
    },
    "bureau_balance": {"bigint": "SK_ID_BUREAU", "int": "MONTHS_BALANCE", "string": "STATUS"},
    "previous_application": {
        "bigint": "SK_ID_CURR SK_ID_PREV",
        "double": "AMT_APPLICATION AMT_CREDIT AMT_ANNUITY AMT_DOWN_PAYMENT AMT_GOODS_PRICE CNT_PAYMENT "
        "RATE_DOWN_PAYMENT RATE_INTEREST_PRIMARY RATE_INTEREST_PRIVILEGED DAYS_FIRST_DRAWING DAYS_FIRST_DUE "
        "DAYS_LAST_DUE_1ST_VERSION DAYS_LAST_DUE DAYS_TERMINATION NFLAG_INSURED_ON_APPROVAL",
        "int": "HOUR_APPR_PROCESS_START DAYS_DECISION",
        "string": "NAME_CONTRACT_STATUS NAME_CASH_LOAN_PURPOSE NAME_PAYMENT_TYPE CODE_REJECT_REASON "
        "NAME_CLIENT_TYPE NAME_GOODS_CATEGORY NAME_PORTFOLIO CHANNEL_TYPE",
    },
    "pos_cash_balance": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "int": "MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        "double": "CNT_INSTALMENT CNT_INSTALMENT_FUTURE",
        "string": "NAME_CONTRACT_STATUS",
    },
    "installments_payments": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "int": "NUM_INSTALMENT_NUMBER",
        "double": "NUM_INSTALMENT_VERSION DAYS_INSTALMENT DAYS_ENTRY_PAYMENT AMT_INSTALMENT AMT_PAYMENT",
    },
    "credit_card_balance": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "int": "MONTHS_BALANCE SK_DPD",
        "double": "AMT_BALANCE AMT_CREDIT_LIMIT_ACTUAL AMT_PAYMENT_CURRENT AMT_INST_MIN_REGULARITY "
        "AMT_DRAWINGS_ATM_CURRENT AMT_RECIVABLE CNT_DRAWINGS_CURRENT CNT_INSTALMENT_MATURE_CUM",
        "string": "NAME_CONTRACT_STATUS",
    },
}

DTYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def schema_of(table: str) -> T.StructType:
    return T.StructType(
        [T.StructField(name, DTYPES[d]) for d, names in SCHEMAS[table].items() for name in names.split()]
    )
