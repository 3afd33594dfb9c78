"""Left joins that never multiply or lose rows, and keep column names apart.

Rollups, whose size follows the data, are joined without hints: AQE turns the join into
a broadcast once the measured size allows it, and otherwise splits a skewed left side.
Small statistics are written first and counted, and broadcast only below a bound, so that
the rows they are attached to are not shuffled by a key with few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.tables import cut_lineage

# Statistics of at most so many rows (keys) are broadcast; more are joined by a shuffle.
SMALL_ROWS = 100_000


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def join_suffix(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    lsuffix: str = "",
    rsuffix: str = "",
) -> DataFrame:
    """Join, renaming only the columns that occur on both sides."""
    on = as_list(on)
    lower = {c.lower() for c in on}
    mine = {c.lower() for c in left.columns} - lower
    theirs = {c.lower() for c in right.columns} - lower
    shared = mine & theirs
    if shared and lsuffix == rsuffix:
        raise ValueError(f"columns on both sides and no suffix to tell them apart: {sorted(shared)}")
    left = left.withColumnsRenamed({c: c + lsuffix for c in left.columns if c.lower() in shared})
    right = right.withColumnsRenamed({c: c + rsuffix for c in right.columns if c.lower() in shared})
    return left.join(right, on, how)


def attach(df: DataFrame, stats: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join one row of ``stats`` per key to every row: by broadcast where their number is checked to be small."""
    fixed = cut_lineage(stats)
    return df.join(F.broadcast(fixed) if fixed.count() <= SMALL_ROWS else fixed, as_list(on), how)


def lookup(df: DataFrame, by: str, stat: DataFrame, alias: str) -> DataFrame:
    """Attach a per-category value; categories without one get NULL.

    ``stat`` has the category column ``by`` and one value column.
    """
    value = next(c for c in stat.columns if c != by)
    return attach(df, stat.select(by, F.col(value).alias(alias)), by)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two frames by column name; columns missing on one side are NULL."""
    return a.unionByName(b, allowMissingColumns=True)
