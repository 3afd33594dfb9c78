"""Null filling, outlier removal and recoding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import expr as X
from loomline.operators.columns import numeric_columns
from loomline.operators.encode import quote


def _check_fill(df: DataFrame, column: str, value: object) -> None:
    dtype = df.schema[column].dataType
    numeric = isinstance(dtype, T.NumericType)
    if numeric == isinstance(value, str):
        raise TypeError(f"cannot fill {dtype.simpleString()} column {column} with {value!r}")


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULL with a constant per column. A type mismatch raises: Spark would skip it."""
    for column, value in values.items():
        _check_fill(df, column, value)
    return df.fillna(dict(values))


def recode(df: DataFrame, changes: Mapping[str, Mapping[object, object]]) -> DataFrame:
    """Recode values per column: ``{column: {old: new}}``."""
    for column, pairs in changes.items():
        df = df.replace(dict(pairs), subset=[column])
    return df


def mode_value(df: DataFrame, column: str) -> object:
    """:func:`mode_of` as a value, to be used on another frame; None if there is none."""
    row = df.select(mode_of(df, column).alias("m")).first()
    return None if row is None else row["m"]


def mode_of(df: DataFrame, column: str) -> Column:
    """The most frequent non-null value as a scalar subquery; the lowest value wins ties.

    Counting is a distributed group-by followed by a top-1, so no task holds all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(1).select(column).scalar()


def fill_mode(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), mode_of(df, c)) for c in columns})


def maxima_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """One scalar subquery holding a struct with the maximum of every column."""
    return df.select(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()


def null_sentinel(
    df: DataFrame,
    columns: str | Sequence[str],
    sentinel: object = None,
    scope: str = "column",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Turn a sentinel into NULL. Without ``sentinel`` the column's maximum is the sentinel.

    ``scope='column'`` changes the column itself; ``scope='frame'`` removes the value
    from every numeric column of the frame except ``keep`` (ids and labels).
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if scope not in ("column", "frame"):
        raise ValueError(f"scope must be 'column' or 'frame', not {scope!r}")
    if scope == "frame" and len(columns) != 1:
        raise ValueError("scope='frame' takes exactly one column")
    changed = [c for c in numeric_columns(df) if c not in keep] if scope == "frame" else columns
    source = {c: columns[0] if scope == "frame" else c for c in changed}
    if sentinel is not None:
        return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in changed})
    # One subquery column, read by every changed column: planned and run once.
    held = df.withColumn("_maxima", maxima_of(df, columns))
    # A NULL maximum (an all-null column) equals nothing, so nothing changes.
    exprs = {c: f"CASE WHEN {quote(c)} = _maxima.{quote(source[c])} THEN NULL ELSE {quote(c)} END" for c in changed}
    return held.selectExpr(*[f"{exprs[c]} AS {quote(c)}" if c in exprs else quote(c) for c in df.columns])


def zero_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: X.zero_to_null(c) for c in columns})


def nan_to_num(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: X.nan_to_num(c) for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as a value in Spark aggregates, so it is removed where data enters."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, nulls) for every column, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    lines = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]
    return counts.select(F.inline(F.array(*lines)))


def split_on_null(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows where the column is known, rows where it is not)."""
    return df.filter(F.col(column).isNotNull()), df.filter(F.col(column).isNull())
