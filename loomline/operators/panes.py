"""Nested windows from disjoint panes: every row is counted once, whatever the number of windows.

A row falls in one pane, the number of nested windows that hold it. States that can be merged (counts,
sums, least and greatest values, squared deviations) are formed per key and pane; a window is then the
merge of the panes deeper than it, a running merge over at most as many rows per key as there are windows.
No row is copied per window.

Distinct values need no sets: a value is in a window if its deepest row is, so the deepest pane of each
(key, value) is found first and values are counted per pane like rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.encode import quote
from loomline.operators.rollup import ROWS, Agg

PANE = "_pane"
# The panes of a window one by one.
EACH = "_each"


class _States:
    """The different states that a set of aggregates needs, each formed and merged once."""

    def __init__(self):
        self.names: dict[tuple[str, str], str] = {}
        self.spreads: dict[str, tuple[str, str, str]] = {}

    def add(self, sql: str, merge: str = "sum") -> str:
        return self.names.setdefault((sql, merge), f"_s{len(self.names)}")

    def spread(self, value: str) -> tuple[str, str, str]:
        """Count, sum and squared deviations of a value."""
        if value not in self.spreads:
            self.spreads[value] = (
                self.add(f"count({value})"), self.add(f"sum({value})"), self.add(f"CAST(var_pop({value}) AS DOUBLE) * count({value})")
            )
        return self.spreads[value]


def _final(a: Agg, states: _States) -> str:
    """The aggregate from merged states, as :func:`rollup.aggregate` defines it."""
    if a.how in ("min", "max"):
        return states.add(f"{a.how}({a.value})", a.how)
    if a.how == "mean":
        n, total = states.add(f"count({a.value})"), states.add(f"sum({a.value})")
        return f"CAST({total} AS DOUBLE) / nullif({n}, 0)"
    if a.how == "var":
        n, total, squares = states.spread(a.value)
        # Every pane's deviations are moved to the mean of the window, so nothing large cancels.
        moved = f"x.{squares} + x.{n} * pow(CAST(x.{total} AS DOUBLE) / x.{n} - CAST({total} AS DOUBLE) / {n}, 2)"
        within = f"aggregate({EACH}, 0D, (a, x) -> a + CASE WHEN x.{n} > 0 THEN {moved} ELSE 0D END)"
        return f"CASE WHEN {n} > 1 THEN {within} / ({n} - 1) END"
    if a.how == "ratio":
        return f"{states.add(f'count_if({a.value})')} / {states.add(ROWS)}"
    rows = states.add(f"count_if({a.where})" if a.where else ROWS)
    counted = {
        "count": lambda: states.add(f"count({a.value})"),
        "sum": lambda: f"coalesce({states.add(f'sum({a.value})')}, 0)",
        "size": lambda: rows,
        "hits": lambda: states.add(f"count_if({a.value})"),
    }[a.how]()
    return f"CASE WHEN {rows} > 0 THEN {counted} END" if a.where else counted


def _deeper(key: str) -> str:
    """The pane and those deeper than it: at most one row per window and key."""
    return f"(PARTITION BY {quote(key)} ORDER BY {PANE} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _merged(partial: DataFrame, key: str, states: _States) -> DataFrame:
    """Each pane with the panes deeper than it."""
    parts = sorted({name for spread in states.spreads.values() for name in spread})
    each = [f"collect_list(struct({', '.join(parts)})) OVER {_deeper(key)} AS {EACH}"] if parts else []
    # Text, as for all wide rollups: one call plans them all.
    return partial.selectExpr(quote(key), PANE, *[f"{how}({name}) OVER {_deeper(key)} AS {name}" for (_, how), name in states.names.items()], *each)


def _spread(long: DataFrame, key: str, values: list[str], suffixes: list[str]) -> DataFrame:
    """(key, pane, values) -> one row per key; a window takes the pane next deeper than it."""
    # At most one row per window reaches the list.
    packed = long.groupBy(key).agg(F.expr(f"map_from_entries(collect_list(struct({PANE}, struct({', '.join(map(quote, values))})))) AS _panes"))
    n = len(suffixes)
    slots = [f"coalesce({', '.join(f'try_element_at(_panes, {p})' for p in range(i + 1, n + 1))}) AS _w{i}" for i in range(n)]
    names = [v + suffix for suffix in suffixes for v in values]
    return packed.selectExpr(quote(key), *slots).select(key, *[f"_w{i}.*" for i in range(n)]).toDF(key, *names)


def pane_rollup(rows: DataFrame, key: str, suffixes: list[str], aggs: Mapping[str, Agg]) -> DataFrame:
    """One row per key with every aggregate in every window; ``rows`` has its pane in ``_pane``, 0 where it is in none.

    ``suffixes`` name the windows, widest first.
    """
    inside, states = rows.filter(F.col(PANE) > 0), _States()
    plain = {n: a for n, a in aggs.items() if a.how != "nunique"}
    distinct = {n: a for n, a in aggs.items() if a.how == "nunique"}
    finals = {n: _final(a, states) for n, a in plain.items()}
    # Tells whether a window has any row, or any of a segment.
    here = {n: states.add(f"count_if({a.where})" if a.where else ROWS) for n, a in distinct.items()}
    if not states.names:
        states.add(ROWS)
    partial = inside.groupBy(key, PANE).agg(*[F.expr(f"{sql} AS {name}") for (sql, _), name in states.names.items()])
    merged = _merged(partial, key, states)
    marks = {f"_here{i}": here[n] for i, n in enumerate(distinct)}
    exprs = [f"{e} AS {quote(n)}" for n, e in {**finals, **marks}.items()]
    out = _spread(merged.selectExpr(key, PANE, *exprs), key, [*finals, *marks], suffixes)
    for i, (name, a) in enumerate(distinct.items()):
        counted = _distinct(inside, key, a.value, suffixes, f"_n{i}")
        out = out.join(counted, key, "left")
        out = out.withColumns({name + s: F.when(F.col(f"_here{i}{s}") > 0, F.coalesce(f"_n{i}{s}", F.lit(0))) for s in suffixes})
        out = out.drop(*[f"{c}{i}{s}" for c in ("_here", "_n") for s in suffixes])
    return out


def _distinct(rows: DataFrame, key: str, value: str, suffixes: list[str], name: str) -> DataFrame:
    """Distinct values per window: the values whose deepest row is in it."""
    known = rows.selectExpr(quote(key), f"{value} AS _value", PANE).filter("_value IS NOT NULL")
    deepest = known.groupBy(key, "_value").agg(F.max(PANE).alias(PANE))
    counts = deepest.groupBy(key, PANE).agg(F.count(F.lit(1)).alias(name))
    return _spread(counts.selectExpr(quote(key), PANE, f"sum({name}) OVER {_deeper(key)} AS {name}"), key, [name], suffixes)
