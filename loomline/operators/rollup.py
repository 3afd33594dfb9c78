"""Rollups driven by a column -> aggregates specification.

A specification turns into ``{output name: SQL aggregate}``. Wide rollups have hundreds
of these, so they are SQL text: Spark parses each in one call, and a caller that needs
only some outputs drops the others before anything is planned.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.encode import Vocabulary, flag_conditions, literal, quote
from loomline.operators.join import as_list, join_suffix
from loomline.operators.placement import together

Spec = Mapping[str, Sequence[str]]
Exprs = dict[str, str | Column]


class Agg(str):
    """SQL text of an aggregate that also names its parts, so that it can be formed from mergeable states."""

    how: str
    value: str
    where: str | None

    def __new__(cls, sql: str, how: str, value: str = "", where: str | None = None) -> Agg:
        self = super().__new__(cls, sql)
        self.how, self.value, self.where = how, value, where
        return self

    def __getnewargs__(self) -> tuple:
        return str(self), self.how, self.value, self.where


ROWS = Agg("count(1)", "size")


def aggregate(column: str, how: str, where: str | None = None) -> Agg:
    """One aggregate of one column, optionally over the rows where a condition holds.

    Sums of nothing but NULL are 0, as long as the group has any row.
    """
    value = quote(column) if where is None else f"CASE WHEN {where} THEN {quote(column)} END"
    rows = ROWS if where is None else f"count_if({where})"
    free = {"min": "min", "max": "max", "mean": "avg", "var": "var_samp"}
    if how in free:
        return Agg(f"{free[how]}({value})", how, value)
    counted = {
        "count": f"count({value})",
        "nunique": f"count(DISTINCT {value})",
        "sum": f"coalesce(sum({value}), 0)",
        "size": rows,
    }
    if how not in counted:
        raise ValueError(f"unknown aggregate {how!r}")
    return Agg(counted[how] if where is None else f"CASE WHEN {rows} > 0 THEN {counted[how]} END", how, value, where)


def spec_exprs(spec: Spec, prefix: str = "", upper: bool = True, where: str | None = None) -> Exprs:
    """Aggregates named ``{prefix}{column}_{AGG}``."""
    return {
        f"{prefix}{column}_{how.upper() if upper else how}": aggregate(column, how, where)
        for column, hows in spec.items()
        for how in hows
    }


def share_exprs(
    vocabulary: Vocabulary, prefix: str = "", null_flag: bool = True, hows: Sequence[str] = ("mean",), upper: bool = True
) -> Exprs:
    """Aggregates of one-hot flags without creating the flags.

    The mean is a count over a count, so each flag costs one long in the buffer.
    """
    out = {}
    for name, hit in flag_conditions(vocabulary, null_flag).items():
        flag = f"CASE WHEN {hit} THEN 1 ELSE 0 END"
        build = {
            "mean": Agg(f"count_if({hit}) / {ROWS}", "ratio", hit),
            "max": Agg(f"max({flag})", "max", flag),
            "min": Agg(f"min({flag})", "min", flag),
            "sum": Agg(f"count_if({hit})", "hits", hit),
            "var": Agg(f"var_samp({flag})", "var", flag),
            "size": ROWS,
        }
        for how in hows:
            out[f"{prefix}{name}_{how.upper() if upper else how}"] = build[how]
    return out


def named(exprs: Exprs) -> list[Column]:
    return [F.expr(f"{e} AS {quote(n)}") if isinstance(e, str) else e.alias(n) for n, e in exprs.items()]


def only(exprs: Exprs, columns: Collection[str] | None) -> Exprs:
    """The wanted outputs; all of them by default."""
    return exprs if columns is None else {n: e for n, e in exprs.items() if n in columns}


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a NULL key belong to no group."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def roll(df: DataFrame, keys: str | Sequence[str], exprs: Exprs) -> DataFrame:
    """One group-by (one shuffle, map-side combined) over the rows whose key is known."""
    keys = as_list(keys)
    known = known_keys(df, keys)
    return known.groupBy(*keys).agg(*named(exprs)) if exprs else known.select(*keys).distinct()


def roll_together(df: DataFrame, key: str, exprs: Exprs, probe: DataFrame | None = None) -> DataFrame:
    """:func:`roll` for wide rollups: see :mod:`loomline.operators.placement`."""
    return together(known_keys(df, [key]), key, lambda rows, _: roll(rows, key, exprs), probe)


def agg_spec(
    df: DataFrame,
    keys: str | Sequence[str],
    spec: Spec,
    prefix: str = "",
    upper: bool = True,
    where: str | None = None,
) -> DataFrame:
    """The whole specification in one group-by."""
    return roll(df, keys, spec_exprs(spec, prefix, upper, where))


def agg_all(
    df: DataFrame,
    keys: str | Sequence[str],
    columns: Sequence[str],
    hows: Sequence[str] = ("max", "mean", "sum", "var"),
    prefix: str = "",
) -> DataFrame:
    return agg_spec(df, keys, {c: hows for c in columns}, prefix)


def segment_exprs(segment: str, values: Mapping[str, str], spec: Spec, upper: bool = True) -> Exprs:
    """The same specification once per segment value: ``{value: prefix}``."""
    out = {}
    for value, prefix in values.items():
        out |= spec_exprs(spec, prefix, upper, f"{quote(segment)} = {literal(value)}")
    return out


def segment_rollup(
    df: DataFrame,
    keys: str | Sequence[str],
    segment: str,
    values: Mapping[str, str],
    spec: Spec,
    prefix: str = "",
    upper: bool = True,
) -> DataFrame:
    """All rows plus each segment in a single group-by; a key without the segment gets NULL."""
    return roll(df, keys, spec_exprs(spec, prefix, upper) | segment_exprs(segment, values, spec, upper))


def two_level_rollup(
    child: DataFrame,
    parent: DataFrame,
    child_key: str | Sequence[str],
    parent_key: str | Sequence[str],
    child_exprs: Exprs,
    parent_exprs: Exprs,
) -> DataFrame:
    """Child rows -> one row per ``child_key`` -> left-joined to parent -> one row per ``parent_key``."""
    inner = roll(child, child_key, child_exprs)
    return roll(join_suffix(parent, inner, child_key), parent_key, parent_exprs)


def first_last_exprs(order: Sequence[str], columns: Mapping[str, Sequence[str]]) -> Exprs:
    """First / last non-null value in order. Ties go to the smaller / larger value,
    so the result does not depend on how rows were partitioned."""
    out = {}
    for c, ends in columns.items():
        known = F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))
        for end in ends:
            out[f"{c}_{end.upper()}"] = {"first": F.min, "last": F.max}[end](known).getField("_v")
    return out


def first_last(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    return roll(df, keys, first_last_exprs(as_list(order), {c: ("first", "last") for c in columns}))


def attach_stats(df: DataFrame, keys: str | Sequence[str], stats: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Attach per-key statistics to every row: ``{alias: (column, aggregate)}``.

    Aggregate then join, not a window: a window would pull every row of a hot key
    into one task, whereas here the hot key is combined map-side and the join back
    has one right-hand row per key, which AQE can split or broadcast.
    """
    keys = as_list(keys)
    per_key = roll(df, keys, {alias: aggregate(c, how) for alias, (c, how) in stats.items()})
    return df.join(per_key, keys, "left")


def attach_stat(df: DataFrame, keys: str | Sequence[str], column: str, how: str, alias: str) -> DataFrame:
    return attach_stats(df, keys, {alias: (column, how)})
