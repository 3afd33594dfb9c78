"""Column selection, naming and typing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)

# name, smallest value, largest value, bytes
INT_LADDER = [
    ("tinyint", -(2**7), 2**7 - 1, 1),
    ("smallint", -(2**15), 2**15 - 1, 2),
    ("int", -(2**31), 2**31 - 1, 4),
    ("bigint", -(2**63), 2**63 - 1, 8),
]
FLOAT_LADDER = [
    ("float", -3.4028234663852886e38, 3.4028234663852886e38, 4),
    ("double", -1.7976931348623157e308, 1.7976931348623157e308, 8),
]
WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def columns_containing(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text in c]


def without(columns: Iterable[str], *excluded: str) -> list[str]:
    """A feature list with ids and labels taken out, by name."""
    return [c for c in columns if c not in excluded]


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def add_literal(df: DataFrame, name: str, value: object, dtype: str) -> DataFrame:
    return df.withColumn(name, F.lit(value).cast(dtype))


def cast_key(df: DataFrame, key: str, dtype: str = "int") -> DataFrame:
    """Cast a key; values that do not fit become NULL instead of failing the job."""
    return df.withColumn(key, F.col(key).try_cast(dtype))


def unique_names(names: Sequence[str]) -> list[str]:
    """Suffix repeats with _2, _3, ... so that names differ even ignoring case."""
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    out = []
    for name in names:
        candidate, i = name, 1
        while candidate.lower() in seen or (i > 1 and candidate.lower() in taken):
            i += 1
            candidate = f"{name}_{i}"
        seen.add(candidate.lower())
        out.append(candidate)
    return out


def sanitise_names(df: DataFrame) -> DataFrame:
    """Delete everything outside letters, digits and underscore from column names."""
    return df.toDF(*unique_names([re.sub(r"[^A-Za-z0-9_]+", "", c) for c in df.columns]))


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keep the first of each repeated name (names are compared ignoring case)."""
    first: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c.lower(), i)
    keep = sorted(first.values())
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return positional.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in keep])


def _range_exprs(df: DataFrame) -> list[Column]:
    out = []
    for c in numeric_columns(df):
        out += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
    return out


def _ladder(dtype: T.DataType) -> list[tuple[str, float, float, int]] | None:
    if isinstance(dtype, INT_TYPES):
        return INT_LADDER
    if isinstance(dtype, FLOAT_TYPES):
        return FLOAT_LADDER
    return None


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast each numeric column to the smallest type whose open range holds its values.

    One aggregate finds every minimum and maximum. Integers stay exact; doubles may
    become 32-bit floats, so this step is opt-in.
    """
    stats = df.agg(*_range_exprs(df)).first() if numeric_columns(df) else None
    out = []
    for f in df.schema:
        ladder = _ladder(f.dataType)
        target = None
        if ladder and stats[f"{f.name}__lo"] is not None:
            lo, hi = stats[f"{f.name}__lo"], stats[f"{f.name}__hi"]
            target = next((name for name, a, b, _ in ladder if a < lo and hi < b), None)
        out.append(F.col(f.name).cast(target).alias(f.name) if target else F.col(f.name))
    return df.select(*out)


def type_report(df: DataFrame) -> DataFrame:
    """(column_name, old_type, new_type, old_bytes, new_bytes) for every numeric column.

    The same rule as :func:`narrow_types`, evaluated as columns over a one-row aggregate.
    """
    fields = [f for f in df.schema if _ladder(f.dataType)]
    stats = df.agg(*_range_exprs(df), F.count(F.lit(1)).alias("n__rows"))
    lines = []
    for f in fields:
        old = f.dataType.simpleString()
        lo, hi = F.col(f"{f.name}__lo"), F.col(f"{f.name}__hi")
        new, width = F, F
        for name, a, b, size in _ladder(f.dataType):
            fits = (lo > F.lit(a)) & (hi < F.lit(b))
            new, width = new.when(fits, name), width.when(fits, size)
        rows = F.col("n__rows")
        lines.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(old).alias("old_type"),
                new.otherwise(old).alias("new_type"),
                (rows * WIDTH[old]).alias("old_bytes"),
                (rows * width.otherwise(WIDTH[old])).alias("new_bytes"),
            )
        )
    return stats.select(F.inline(F.array(*lines)))
