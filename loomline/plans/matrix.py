"""The wide feature matrix: applicants with every rollup joined on."""

from __future__ import annotations

import os
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame

from loomline.operators import encode
from loomline.operators.columns import drop_repeated_columns
from loomline.operators.join import join_suffix, union_by_name
from loomline.plans.application import ID, application_features, clean_application, fit_cleaning, income_medians
from loomline.plans.bureau import bureau_rollup
from loomline.plans.cards import card_lookback
from loomline.plans.instalments import instalment_lookback
from loomline.plans.pos import pos_lookback
from loomline.plans.previous import clean_previous, previous_lookback
from loomline.sources.tables import bucketed, materialise

Tables = Mapping[str, DataFrame]
Columns = Collection[str] | None

ROLLUPS: dict[str, Callable[[Tables, Columns], DataFrame]] = {
    "bureau": lambda t, c: bureau_rollup(t["bureau"], t["bureau_balance"], columns=c),
    "previous_application": lambda t, c: previous_lookback(clean_previous(t["previous_application"]), columns=c),
    "pos_cash_balance": lambda t, c: pos_lookback(t["pos_cash_balance"], columns=c),
    "installments_payments": lambda t, c: instalment_lookback(t["installments_payments"], columns=c),
    "credit_card_balance": lambda t, c: card_lookback(t["credit_card_balance"], columns=c),
}


def rollups(tables: Tables, folder: str | None = None, columns: Columns = None, buckets: int | None = None) -> dict[str, DataFrame]:
    """Every child table rolled up once, for train and test applicants alike.

    With ``folder`` each rollup is written as parquet and read back, so that the wide
    join starts from files and a lost executor does not restart the rollups. With
    ``columns`` only those outputs are computed. With ``buckets`` they are written bucketed
    and sorted by applicant, so that joining them moves nothing.
    """
    out = {}
    for name, build in ROLLUPS.items():
        out[name] = build(tables, columns)
        if buckets:
            out[name] = bucketed(out[name], ID, buckets, folder and os.path.join(folder, name))
        elif folder:
            out[name] = materialise(out[name], os.path.join(folder, name))
    return out


def applicants(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """Cleaned and encoded applicants; vocabulary, outlier, mode and medians are fitted on train."""
    fitted = fit_cleaning(train)
    train = clean_application(train, **fitted)
    vocabulary, medians = encode.fit_vocabulary(train), income_medians(train)
    out = application_features(train, vocabulary, medians)
    if test is not None:
        out = union_by_name(out, application_features(clean_application(test, **fitted), vocabulary, medians))
    return out


def feature_matrix(tables: Tables, folder: str | None = None, columns: Columns = None, buckets: int | None = None) -> DataFrame:
    """Applicants with all features, or with the selected ``columns`` only.

    With ``buckets`` applicants and rollups are written in that many sorted files each, and the
    join of all of them is one pass over the files, without a shuffle or a sort.

    ``tables`` holds 'application' (and optionally 'application_test') and the child tables.
    """
    out = applicants(tables["application"], tables.get("application_test"))
    if buckets:
        out = bucketed(out, ID, buckets, folder and os.path.join(folder, "applicants"))
    for rollup in rollups(tables, folder, columns, buckets).values():
        if rollup.columns != [ID]:
            out = join_suffix(out, rollup, ID, rsuffix="_y")
    out = drop_repeated_columns(out)
    return out if columns is None else out.select(ID, *[c for c in columns if c != ID])
