"""Feature recipes on hand-made applicants, checked value by value."""

import pytest
from helpers import by_key

from loomline.operators import encode
from loomline.plans import application as A
from loomline.plans import bureau as B
from loomline.plans import cards as C
from loomline.plans import instalments as I
from loomline.plans import matrix as M
from loomline.plans import pos as P
from loomline.plans import previous as V
from loomline.sources.schemas import SCHEMAS, schema_of

ID = "SK_ID_CURR"


@pytest.fixture
def make(spark):
    """Rows given as dicts; columns left out are NULL."""

    def build(table, *records):
        schema = schema_of(table)
        convert = {"double": float, "int": int, "bigint": int, "string": str}
        kinds = {c: convert[d] for d, names in SCHEMAS[table].items() for c in names.split()}
        for r in records:
            assert set(r) <= set(kinds), set(r) - set(kinds)
        data = [tuple(None if r.get(c) is None else kinds[c](r[c]) for c in schema.names) for r in records]
        return spark.createDataFrame(data, schema)

    return build


BASE = dict(
    AMT_INCOME_TOTAL=100, AMT_CREDIT=400, AMT_ANNUITY=50, AMT_GOODS_PRICE=300, CNT_CHILDREN=0, CNT_FAM_MEMBERS=2,
    DAYS_BIRTH=-7300, DAYS_EMPLOYED=-1000, DAYS_REGISTRATION=-2000, DAYS_ID_PUBLISH=-500, DAYS_LAST_PHONE_CHANGE=-100,
    NAME_CONTRACT_TYPE="Cash", NAME_TYPE_SUITE="Family", NAME_HOUSING_TYPE="House", ORGANIZATION_TYPE="Bank",
    OCCUPATION_TYPE="Clerk", NAME_EDUCATION_TYPE="Higher", CODE_GENDER="F", NAME_FAMILY_STATUS="Married",
    NAME_INCOME_TYPE="Working", FLAG_OWN_CAR="N", FLAG_OWN_REALTY="Y", WEEKDAY_APPR_PROCESS_START="MONDAY", FLAG_DOCUMENT_3=1,
)


def application(make, *changes):
    return make("application", *[{**BASE, ID: i, "TARGET": i % 2, **c} for i, c in enumerate(changes, 1)])


def test_clean_application(make):
    df = application(
        make,
        {"DAYS_EMPLOYED": 365243, "CODE_GENDER": "XNA", "AMT_ANNUITY": None},
        {"DAYS_EMPLOYED": 365243, "CNT_FAM_MEMBERS": None, "NAME_TYPE_SUITE": None, "NAME_FAMILY_STATUS": "Unknown"},
        {"OCCUPATION_TYPE": None, "EXT_SOURCE_1": None},
    )
    out = by_key(A.clean_application(df), ID)
    assert [out[i]["DAYS_EMPLOYED"] for i in (1, 2, 3)] == [None, None, -1000]
    assert (out[1]["CODE_GENDER"], out[1]["AMT_ANNUITY"]) == ("M", 0.0)
    assert (out[2]["CNT_FAM_MEMBERS"], out[2]["NAME_TYPE_SUITE"], out[2]["NAME_FAMILY_STATUS"]) == (2.0, "Unaccompanied", "Married")
    assert (out[3]["OCCUPATION_TYPE"], out[3]["EXT_SOURCE_1"]) == ("Data_Not_Available", 0.0)


def test_application_features(make):
    df = application(make, {}, {"AMT_INCOME_TOTAL": 300}, {"ORGANIZATION_TYPE": None, "AMT_ANNUITY": 0})
    out = A.application_features(df)
    got = by_key(out, ID)
    assert got[1]["CREDIT_INCOME_PERCENT"] == 4.0 and got[1]["CHILDREN_CNT_INCOME_PERCENT"] is None
    assert got[1]["AGE_LOAN_FINISH"] == pytest.approx(20 + 8 / 12) and got[3]["CREDIT_ANNUITY_PERCENT"] is None
    assert got[1]["MEDIAN_INCOME_ORG_TYPE"] == 200.0 and got[3]["MEDIAN_INCOME_ORG_TYPE"] is None
    assert got[2]["ORG_TYPE_INCOME_PERCENT"] == pytest.approx(200 / 300)
    assert got[3]["ORGANIZATION_TYPE_Bank"] == 0 and "ORGANIZATION_TYPE_nan" not in out.columns
    assert "FLAG_DOCUMENT_3" in out.columns and "FLAG_DOCUMENT_2" not in out.columns


CREDITS = [
    {ID: 1, "SK_ID_BUREAU": 10, "CREDIT_ACTIVE": "Closed", "CREDIT_TYPE": "card", "DAYS_CREDIT": -100, "DAYS_CREDIT_ENDDATE": 50,
     "AMT_CREDIT_SUM": 100, "AMT_CREDIT_SUM_DEBT": 0, "AMT_ANNUITY": None},
    {ID: 1, "SK_ID_BUREAU": 11, "CREDIT_ACTIVE": "Active", "CREDIT_TYPE": None, "DAYS_CREDIT": -10, "AMT_CREDIT_SUM": 60,
     "AMT_CREDIT_SUM_DEBT": 20, "AMT_ANNUITY": 5},
    {ID: 2, "SK_ID_BUREAU": 12, "CREDIT_ACTIVE": "Sold", "CREDIT_TYPE": "card", "DAYS_CREDIT": -1},
]


def test_bureau_loan_features(make):
    out = by_key(B.bureau_loan_features(make("bureau", *CREDITS)), "SK_ID_BUREAU")
    assert [out[k]["CREDIT_TYPE_CODE"] for k in (10, 11, 12)] == [0, 1, 2]
    assert out[10]["CREDIT_DURATION"] == 150 and out[10]["DEBT_PERCENTAGE"] is None and out[11]["DEBT_PERCENTAGE"] == 3.0
    assert (out[10]["CUSTOMER_LOAN_COUNT"], out[10]["CUSTOMER_CREDIT_TYPES"], out[10]["AVG_LOAN_TYPE"]) == (2, 1, 2.0)
    assert out[11]["CREDIT_DEBT_RATIO"] == 8.0 and out[12]["TOTAL_CREDIT_SUM"] == 0.0 and out[12]["AMT_ANNUITY"] == 0.0


def test_bureau_rollup(make):
    balance = make(
        "bureau_balance",
        {"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -1, "STATUS": "0"}, {"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -2, "STATUS": "C"},
        {"SK_ID_BUREAU": 11, "MONTHS_BALANCE": -5, "STATUS": None},
    )
    credits = make("bureau", *CREDITS)
    out = by_key(B.bureau_rollup(credits, balance), ID)
    assert out[1]["BUREAU_MONTHS_BALANCE_SIZE_sum"] == 3 and out[2]["BUREAU_MONTHS_BALANCE_SIZE_sum"] == 0
    assert out[1]["BUREAU_STATUS_0_MEAN_mean"] == 0.25 and out[1]["BUREAU_STATUS_nan_MAX_max"] == 1
    assert out[1]["BUREAU_CREDIT_TYPE_nan_max"] == 1 and out[2]["BUREAU_STATUS_0_MEAN_mean"] is None
    assert out[1]["C_AMT_CREDIT_SUM_SUM"] == 100.0 and out[2]["C_AMT_CREDIT_SUM_SUM"] is None
    assert not [c for c in out[1] if c.startswith("A_")]
    both = B.bureau_rollup(credits, balance, segments=("Active", "Closed"))
    assert by_key(both, ID)[1]["A_AMT_CREDIT_SUM_MAX"] == 60.0


def test_previous(make):
    df = make(
        "previous_application",
        {ID: 1, "SK_ID_PREV": 5, "DAYS_DECISION": -3, "AMT_APPLICATION": 10, "AMT_CREDIT": 20, "AMT_ANNUITY": 3, "CNT_PAYMENT": 8,
         "NAME_CONTRACT_STATUS": "Approved", "DAYS_LAST_DUE": 0, "DAYS_TERMINATION": 365243, "DAYS_FIRST_DRAWING": 365243},
        {ID: 1, "SK_ID_PREV": 6, "DAYS_DECISION": -300, "AMT_APPLICATION": 40, "AMT_CREDIT": 0, "NAME_CONTRACT_STATUS": "Refused",
         "DAYS_LAST_DUE": -7, "DAYS_TERMINATION": -5, "DAYS_FIRST_DRAWING": -1},
        {ID: 2, "SK_ID_PREV": 7, "DAYS_DECISION": -900, "AMT_APPLICATION": 5, "AMT_CREDIT": 5, "NAME_CONTRACT_STATUS": None},
    )
    cleaned = V.clean_previous(df)
    seen = by_key(cleaned, "SK_ID_PREV")
    # Zero goes first, so -7 is the largest due day left and goes too.
    assert [seen[k]["DAYS_LAST_DUE"] for k in (5, 6)] == [None, None]
    assert (seen[5]["DAYS_TERMINATION"], seen[6]["DAYS_TERMINATION"], seen[6]["DAYS_FIRST_DRAWING"]) == (None, -5.0, -1.0)
    assert by_key(V.previous_features(cleaned), "SK_ID_PREV")[5]["SIMPLE_INTERESTS"] == pytest.approx((3 * 8 / 20 - 1) / 8)
    out = by_key(V.previous_lookback(cleaned), ID)
    assert out[1]["PREV_AMT_APPLICATION_MAX"] == 40.0 and out[1]["PREV_AMT_APPLICATION_MAX_quarter"] == 10.0
    assert out[1]["CS_APP_AMT_APPLICATION_MAX_week"] == 10.0 and out[1]["CS_REF_AMT_APPLICATION_MAX_week"] is None
    assert out[1]["PREV_NAME_CONTRACT_STATUS_Refused_MEAN_year"] == 0.5 and out[1]["PREV_NAME_CONTRACT_STATUS_nan_MEAN"] == 0.0
    assert out[2]["PREV_AMT_APPLICATION_MAX_year"] is None and out[2]["PREV_NAME_CONTRACT_STATUS_nan_MEAN"] == 1.0


def test_pos(make):
    rows = [
        {ID: 1, "SK_ID_PREV": 5, "MONTHS_BALANCE": -10, "CNT_INSTALMENT": 12, "CNT_INSTALMENT_FUTURE": 12, "SK_DPD": 0,
         "NAME_CONTRACT_STATUS": "Active"},
        {ID: 1, "SK_ID_PREV": 5, "MONTHS_BALANCE": -2, "CNT_INSTALMENT": 6, "CNT_INSTALMENT_FUTURE": 3, "SK_DPD": 4,
         "NAME_CONTRACT_STATUS": "Completed"},
        {ID: 1, "SK_ID_PREV": 6, "MONTHS_BALANCE": -1, "CNT_INSTALMENT": None, "CNT_INSTALMENT_FUTURE": None, "SK_DPD": 0},
        {ID: 2, "SK_ID_PREV": 7, "MONTHS_BALANCE": -40, "CNT_INSTALMENT": 0, "CNT_INSTALMENT_FUTURE": 2, "SK_DPD": 1},
    ]
    out = by_key(P.pos_lookback(make("pos_cash_balance", *rows)), ID)
    one = out[1]
    assert (one["POS_MONTHS_BALANCE_SIZE"], one["POS_SK_DPD_MAX"], one["POS_CNT_INSTALMENT_FUTURE_SUM"]) == (3, 4, 15.0)
    assert (one["POS_LOAN_COMPLETED_MEAN"], one["POS_COMPLETED_BEFORE_MEAN"]) == (0.5, 1)
    assert (one["POS_REMAINING_INSTALMENTS"], one["POS_REMAINING_INSTALMENTS_RATIO"]) == (3.0, 0.5)
    # Within three months only the last state of the loan is seen: it no longer shrinks.
    assert (one["POS_LOAN_COMPLETED_MEAN_quarter"], one["POS_COMPLETED_BEFORE_MEAN_quarter"]) == (1.0, 0)
    assert out[2]["POS_REMAINING_INSTALMENTS_RATIO"] == 0.0 and out[2]["POS_SK_DPD_MAX_year"] is None
    few = P.pos_lookback(make("pos_cash_balance", *rows), columns=["POS_REMAINING_INSTALMENTS_year"])
    assert few.columns == [ID, "POS_REMAINING_INSTALMENTS_year"] and by_key(few, ID)[1][few.columns[1]] == 3.0


def test_instalments(make):
    rows = [
        {ID: 1, "SK_ID_PREV": 5, "NUM_INSTALMENT_NUMBER": 1, "NUM_INSTALMENT_VERSION": 1, "DAYS_INSTALMENT": -20,
         "DAYS_ENTRY_PAYMENT": -25, "AMT_INSTALMENT": 10, "AMT_PAYMENT": 4},
        {ID: 1, "SK_ID_PREV": 5, "NUM_INSTALMENT_NUMBER": 1, "NUM_INSTALMENT_VERSION": 2, "DAYS_INSTALMENT": -5,
         "DAYS_ENTRY_PAYMENT": 3, "AMT_INSTALMENT": 10, "AMT_PAYMENT": 6},
        {ID: 1, "SK_ID_PREV": 5, "NUM_INSTALMENT_NUMBER": 2, "NUM_INSTALMENT_VERSION": 1, "DAYS_INSTALMENT": -800,
         "AMT_INSTALMENT": 7},
    ]
    df = make("installments_payments", *rows)
    seen = {(r["DAYS_INSTALMENT"]): r for r in I.instalment_features(df).collect()}
    first, late, unpaid = seen[-20.0], seen[-5.0], seen[-800.0]
    assert (first["AMT_PAYMENT_GROUPED"], first["PAYMENT_DIFFERENCE"], first["PAYMENT_RATIO"]) == (10.0, 0.0, 1.0)
    assert (first["DBD"], first["LATE_PAYMENT"], first["IS_LATE"], first["LATE_PAYMENT_RATIO"]) == (5.0, 1, 0, 0.4)
    assert (late["DPD"], late["DPD_7"], late["DPD_15"], late["LATE_PAYMENT"], late["IS_LATE"]) == (8.0, 1, 0, 0, 1)
    assert unpaid["DPD"] is None and unpaid["DPD_WOF"] == 0 and unpaid["AMT_PAYMENT_GROUPED"] == 0.0
    out = by_key(I.instalment_lookback(df), ID)[1]
    # All history adds both part payments; the last week sees only the second.
    assert out["INS_PAYMENT_DIFFERENCE_SUM"] == 0 + 0 + 7 and out["INS_PAYMENT_DIFFERENCE_SUM_week"] == 4.0
    assert (out["INSTALLATION_COUNT"], out["INSTALLATION_COUNT_year"], out["INS_NUM_INSTALMENT_VERSION_NUNIQUE"]) == (3, 2, 2)
    assert out["INS_AMT_PAYMENT_MIN"] == 0.0 and out["INS_DAYS_ENTRY_PAYMENT_MAX"] == 3.0


def test_instalments_of_a_hot_applicant(make, monkeypatch):
    """The summed-and-joined route gives what the gathered route gives."""
    from loomline.operators import lookback, placement

    df = make(
        "installments_payments",
        *[{ID: i % 3, "SK_ID_PREV": i % 5 or None, "NUM_INSTALMENT_NUMBER": i % 2, "DAYS_INSTALMENT": -3 * i, "AMT_INSTALMENT": 5,
           "AMT_PAYMENT": i % 7} for i in range(60)],
    )
    want = by_key(I.instalment_lookback(df), ID)
    hot = lambda rows, key, fold: placement.together(rows, key, fold, hot_rows=1)
    monkeypatch.setattr(lookback, "together", hot)
    assert by_key(I.instalment_lookback(df), ID) == want and len(want) == 3


def test_cards(make):
    df = make(
        "credit_card_balance",
        {ID: 1, "SK_ID_PREV": 5, "MONTHS_BALANCE": -1, "AMT_BALANCE": 50, "AMT_CREDIT_LIMIT_ACTUAL": 100, "AMT_RECIVABLE": 8,
         "SK_DPD": 1, "NAME_CONTRACT_STATUS": "Active"},
        {ID: 1, "SK_ID_PREV": 5, "MONTHS_BALANCE": -20, "AMT_BALANCE": 10, "AMT_CREDIT_LIMIT_ACTUAL": 0, "SK_DPD": 0,
         "NAME_CONTRACT_STATUS": None},
    )
    out = by_key(C.card_lookback(df), ID)[1]
    assert (out["CR_LIMIT_USE_MAX"], out["CR_AMT_BALANCE_VAR"], out["CR_AMT_BALANCE_VAR_year"]) == (0.5, 800.0, None)
    assert (out["CR_AMT_RECEIVABLE_SUM"], out["CR_LATE_PAYMENT_MEAN"], out["CREDIT_COUNT"], out["CREDIT_COUNT_month"]) == (8.0, 0.5, 2, 1)
    assert out["CR_NAME_CONTRACT_STATUS_nan_VAR"] == 0.5 and "CR_SK_ID_PREV_MAX" not in out


def test_matrix_keeps_every_applicant(make, tmp_path):
    tables = {
        "application": application(make, {}, {"NAME_INCOME_TYPE": "Student"}, {}),
        "application_test": application(make, {ID: 9, "TARGET": None, "NAME_INCOME_TYPE": "Maternity leave"}),
        "bureau": make("bureau", *CREDITS),
        "bureau_balance": make("bureau_balance", {"SK_ID_BUREAU": 10, "MONTHS_BALANCE": -1, "STATUS": "0"}),
        "previous_application": make("previous_application", {ID: 1, "SK_ID_PREV": 5, "DAYS_DECISION": -3, "AMT_CREDIT": 9}),
        "pos_cash_balance": make("pos_cash_balance", {ID: 9, "SK_ID_PREV": 5, "MONTHS_BALANCE": -3, "SK_DPD": 2}),
        "installments_payments": make(
            "installments_payments", {ID: 1, "SK_ID_PREV": 5, "NUM_INSTALMENT_NUMBER": 1, "DAYS_INSTALMENT": -3, "AMT_PAYMENT": 2}
        ),
        "credit_card_balance": make("credit_card_balance", {ID: 2, "SK_ID_PREV": 6, "MONTHS_BALANCE": -1, "AMT_BALANCE": 4}),
    }
    wanted = ["TARGET", "NAME_INCOME_TYPE_Student", "BUREAU_DAYS_CREDIT_mean", "PREV_AMT_CREDIT_MAX_week", "POS_SK_DPD_MAX",
              "INS_AMT_PAYMENT_SUM_year", "CREDIT_COUNT_month"]
    some = M.feature_matrix(tables, columns=wanted)
    full = M.feature_matrix(tables, folder=str(tmp_path))
    out = by_key(full, ID)
    assert set(out) == {1, 2, 3, 9} and full.count() == 4
    assert len({c.lower() for c in full.columns}) == len(full.columns)
    # The vocabulary is the training one: a category seen only in test adds no column.
    assert "NAME_INCOME_TYPE_Maternity leave" not in full.columns and out[9]["NAME_INCOME_TYPE_Student"] == 0
    assert (out[9]["TARGET"], out[9]["POS_SK_DPD_MAX"], out[3]["BUREAU_DAYS_CREDIT_mean"]) == (None, 2, None)
    assert by_key(some, ID) == {i: {c: r[c] for c in [ID, *wanted]} for i, r in out.items()}


def test_vocabulary_gives_every_window_the_same_columns(make):
    df = make("pos_cash_balance", {ID: 1, "SK_ID_PREV": 5, "MONTHS_BALANCE": -30, "NAME_CONTRACT_STATUS": "Signed"},
              {ID: 1, "SK_ID_PREV": 5, "MONTHS_BALANCE": -1, "NAME_CONTRACT_STATUS": "Active"})
    out = by_key(P.pos_lookback(df, encode.fit_vocabulary(df)), ID)[1]
    assert out["POS_NAME_CONTRACT_STATUS_Signed_MEAN"] == 0.5 and out["POS_NAME_CONTRACT_STATUS_Signed_MEAN_month"] == 0.0
