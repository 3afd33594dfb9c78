"""A profiling report: the tables behind the usual charts of a labelled table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from loomline.operators import profile as P
from loomline.operators.clean import null_counts
from loomline.sources.tables import overview

# Percentile grids.
EVERY_5 = list(range(0, 101, 5))
EVERY_10 = list(range(0, 101, 10))
TOP_PERCENT = [99 + i / 10 for i in range(11)]


def profile(df: DataFrame, label: str, spec: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Tidy frames by name, e.g. ``default_profile:CODE_GENDER``.

    ``spec`` lists columns per kind: categories, flags, measures, tokens.
    """
    out = {"overview": overview(df), "null_counts": null_counts(df), "class_balance": P.class_balance(df, label)}
    for c in spec.get("categories", ()):
        out[f"value_counts:{c}"] = P.value_counts(df, c)
        out[f"default_profile:{c}"] = P.default_profile(df, c, label)
    if spec.get("flags"):
        out["flag_share"] = P.flag_share(df, spec["flags"])
    if spec.get("measures"):
        out["describe"] = P.describe(df, spec["measures"])
        out["global_range"] = P.global_range(df, spec["measures"])
    for c in spec.get("measures", ()):
        out[f"percentile_grid:{c}"] = P.percentile_grid(df, c, EVERY_5, label)
        out[f"histogram:{c}"] = P.histogram(df, c, 50)
        out[f"density:{c}"] = P.density(df, c, 50, label)
        out[f"box_summary:{c}"] = P.box_summary(df, c, label)
    for c in spec.get("tokens", ()):
        out[f"token_counts:{c}"] = P.token_counts(df, c)
    return out
