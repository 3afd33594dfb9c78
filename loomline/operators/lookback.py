"""Nested look-back windows: one rollup per cut-off, computed in a single pass.

Aggregates that can be merged come from disjoint panes (:mod:`loomline.operators.panes`).
For a rollup of several levels, or of values that differ by window, every row is tagged
with the windows it falls in (all history, last year, ...), the rollup runs once with the
tag as an extra key, and the tag is then spread to columns. The tagged copies never
travel: rows are brought together by key first, and tagging, rolling up and spreading all
happen there, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.join import as_list
from loomline.operators.panes import PANE, pane_rollup
from loomline.operators.placement import together
from loomline.operators.rollup import Agg, Exprs, known_keys, roll

# {suffix: how far back, or None for the whole history}
Windows = Mapping[str, int | None]

DAY_WINDOWS: Windows = {
    "": None, "_year": 365, "_half_year": 182, "_quarter": 90, "_month": 30, "_fortnight": 14, "_week": 7,
}
MONTH_WINDOWS: Windows = {"": None, "_year": 12, "_half_year": 6, "_quarter": 3, "_month": 1}

TAG = "_window"


def nested(windows: Windows) -> list[tuple[str, int | None]]:
    """Widest first: a row in one window is then in all windows before it."""
    return sorted(windows.items(), key=lambda w: -float("inf") if w[1] is None else -w[1])


def depth(offset: str | Column, windows: Windows) -> Column:
    """How many windows hold the row. A NULL offset falls in the whole history only."""
    offset = F.col(offset) if isinstance(offset, str) else offset
    total = F.lit(0)
    for _, back in nested(windows):
        total = total + (F.lit(1) if back is None else F.when(offset >= -back, 1).otherwise(0))
    return total


def tag_windows(df: DataFrame, offset: str | Column, windows: Windows) -> DataFrame:
    """One copy of each row per window it falls in, numbered by ``_window``."""
    every = F.array(*[F.lit(i) for i in range(len(windows))])
    return df.withColumn(TAG, F.explode(F.slice(every, F.lit(1), depth(offset, windows))))


def spread_windows(long: DataFrame, keys: str | Sequence[str], windows: Windows) -> DataFrame:
    """(keys, window, values) -> one row per key with ``value{suffix}`` columns."""
    keys = as_list(keys)
    values = [c for c in long.columns if c not in keys and c != TAG]
    # At most one row per window reaches the list.
    packed = long.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(TAG), F.struct(*values)))).alias("_by_window")
    )
    slots = [f"_w{i}" for i in range(len(windows))]
    unpacked = packed.select(*keys, *[F.try_element_at("_by_window", F.lit(i)).alias(s) for i, s in enumerate(slots)])
    names = [v + suffix for suffix, _ in nested(windows) for v in values]
    return unpacked.select(*keys, *[f"{s}.*" for s in slots]).toDF(*keys, *names)


def wanted_windows(windows: Windows, names: Collection[str], columns: Collection[str] | None) -> Windows:
    """The windows from which any output is wanted."""
    if columns is None:
        return windows
    return {s: back for s, back in windows.items() if any(n + s in columns for n in names)}


def wanted_exprs(windows: Windows, exprs: Exprs, columns: Collection[str] | None) -> Exprs:
    """The aggregates wanted in any window."""
    return exprs if columns is None else {n: e for n, e in exprs.items() if any(n + s in columns for s in windows)}


def lookback(
    df: DataFrame,
    key: str,
    offset: str | Column,
    windows: Windows,
    exprs: Exprs,
    columns: Collection[str] | None = None,
    own: Callable[[DataFrame, Windows, Exprs, bool], list[DataFrame]] | None = None,
    apart: Collection[str] = (),
    features: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Run one rollup over every window and lay the results side by side.

    ``columns`` names the outputs wanted: aggregates and windows that none of them
    needs are not computed. Keys outside every wanted window have no row.

    Aggregates built by :mod:`loomline.operators.rollup` come from panes, over the rows as
    ``features`` makes them. Those named in ``apart``, and any other expression, come from
    tagged rows, or from ``own(rows, windows, expressions, gathered)``: frames with one row
    per key and a column for each expression and window, joined on the key.
    """
    exprs = wanted_exprs(windows, exprs, columns)
    windows = wanted_windows(windows, exprs, columns)
    known = known_keys(df, [key])
    if not windows:
        return known.select(key).distinct()
    paned = {n: e for n, e in exprs.items() if isinstance(e, Agg) and n not in apart}
    rest = {n: e for n, e in exprs.items() if n not in paned}
    suffixes = [suffix for suffix, _ in nested(windows)]

    def fold(rows: DataFrame, gathered: bool) -> DataFrame:
        parts = []
        if paned or not rest:
            placed = features(rows).withColumn(PANE, depth(offset, windows))
            parts.append(pane_rollup(placed, key, suffixes, paned))
        if rest:
            parts += own(rows, windows, rest, gathered) if own else [tagged_rollup(rows, key, offset, windows, rest)]
        return reduce(lambda a, b: a.join(b, key, "left"), parts)

    out = together(known, key, fold)
    return out if columns is None else out.select(key, *[c for c in out.columns if c in columns])


def tagged_rollup(
    rows: DataFrame, key: str, offset: str | Column, windows: Windows, exprs: Exprs,
    rollup: Callable[[DataFrame, list[str], Exprs], DataFrame] = roll,
) -> DataFrame:
    """A rollup by key and window over one copy of each row per window, spread to one row per key."""
    return spread_windows(rollup(tag_windows(rows, offset, windows), [key, TAG], exprs), key, windows)
