"""DuckDB SQL text for rollups: plain conditional aggregates, no shared code with the library."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Whole-number columns: their sums are BIGINT and need no rounding.
WHOLE = {
    "l_linenumber", "l_linenumber_SIZE", "MONTHS_BALANCE", "MONTHS_BALANCE_SIZE", "SK_DPD", "LATE_PAYMENT",
    "CNT_CREDIT_PROLONG",
}
FUNCTIONS = {"min": "min", "max": "max", "mean": "avg", "var": "var_samp"}


def agg(column: str, how: str, where: str = "TRUE") -> str:
    """One aggregate over the rows where a condition holds; NULL when there are none."""
    f = f"FILTER (WHERE {where})"
    if how in FUNCTIONS:
        value = f"CAST({column} AS DOUBLE)" if how in ("mean", "var") else column
        return f"{FUNCTIONS[how]}({value}) {f}"
    some = f"CASE WHEN count(*) {f} > 0 THEN"
    if how == "sum":
        return f"{some} coalesce(CAST(sum({column}) {f} AS {'BIGINT' if column in WHOLE else 'DOUBLE'}), 0) END"
    if how == "size":
        return f"{some} count(*) {f} END"
    if how == "count":
        return f"{some} count({column}) {f} END"
    if how == "nunique":
        return f"{some} count(DISTINCT {column}) {f} END"
    raise ValueError(how)


def spec_items(
    spec: Mapping[str, Sequence[str]],
    prefix: str = "",
    suffix: str = "",
    where: str = "TRUE",
    upper: bool = True,
    places: Mapping[str, int] | None = None,
    default_places: int | None = None,
) -> list[str]:
    """``expr AS name`` items; ``places`` rounds means and variances of the columns it names."""
    out = []
    for column, hows in spec.items():
        for how in hows:
            e = agg(column, how, where)
            digits = (places or {}).get(column, default_places)
            if digits is not None and (how in ("mean", "var") or how == "sum" and column not in WHOLE):
                e = f"round({e}, {digits})"
            out.append(f'{e} AS "{prefix}{column}_{how.upper() if upper else how}{suffix}"')
    return out


def share_items(
    vocabulary: Mapping[str, Sequence[str | None]],
    prefix: str = "",
    suffix: str = "",
    where: str = "TRUE",
    hows: Sequence[str] = ("mean",),
    upper: bool = True,
    places: Mapping[str, int] | None = None,
) -> list[str]:
    """Aggregates of 0/1 flags. A None in the vocabulary is the flag of missing values."""
    out = []
    for column, values in vocabulary.items():
        for v in values:
            test = f"{column} IS NULL" if v is None else f"{column} = '{v}'"
            flag = f"(CASE WHEN {test} THEN 1 ELSE 0 END)"
            name = f"{column}_{'nan' if v is None else v}"
            for how in hows:
                e = agg(flag, how, where)
                if how == "sum":
                    e = f"CAST({e} AS BIGINT)"
                if (places or {}).get(how) is not None:
                    e = f"round({e}, {places[how]})"
                out.append(f'{e} AS "{prefix}{name}_{how.upper() if upper else how}{suffix}"')
    return out


def windows_of(offset: str, windows: Mapping[str, int | None]) -> dict[str, str]:
    """{suffix: condition}."""
    return {s: "TRUE" if k is None else f"{offset} >= -{k}" for s, k in windows.items()}
