"""Column expressions. All are built-in Spark expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST_DOUBLE = 1.7976931348623157e308


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str, on_zero: str = "null") -> Column:
    """``a / b``. A zero denominator gives NULL, or a signed infinity with ``on_zero='ieee'``.

    0/0 is NULL in both modes, because missing values are always NULL here, never NaN.
    """
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    safe = F.try_divide(a, b)
    if on_zero == "null":
        return safe
    if on_zero == "ieee":
        inf = F.lit(float("inf"))
        return F.when(b == 0, F.when(a > 0, inf).when(a < 0, -inf)).otherwise(safe)
    raise ValueError(f"on_zero must be 'null' or 'ieee', not {on_zero!r}")


def difference(a: Column | str, b: Column | str) -> Column:
    return as_col(a) - as_col(b)


def status_code(c: Column | str, codes: dict[str, int], other: int) -> Column:
    """Category to integer code; anything else, NULL included, becomes ``other``."""
    c = as_col(c)
    out = F
    for value, code in codes.items():
        out = out.when(c == value, code)
    return out.otherwise(other)


def above(c: Column | str, threshold: float = 0) -> Column:
    """1 where ``c > threshold``, else 0 (NULL counts as 0)."""
    return F.when(as_col(c) > threshold, 1).otherwise(0)


def at_least(c: Column | str, threshold: float) -> Column:
    """1 where ``c >= threshold``, else 0 (NULL counts as 0)."""
    return F.when(as_col(c) >= threshold, 1).otherwise(0)


def clamp_negative(c: Column | str) -> Column:
    """Negatives become 0 and NULL stays NULL."""
    c = as_col(c)
    return F.when(c <= 0, F.lit(0).cast("double")).otherwise(c.cast("double"))


def keep_where(flag: Column | str, c: Column | str) -> Column:
    """The value where ``flag`` is 1, else 0."""
    return F.when(as_col(flag) == 1, as_col(c)).otherwise(0.0)


def both_positive(a: Column | str, b: Column | str) -> Column:
    return F.when((as_col(a) > 0) & (as_col(b) > 0), 1).otherwise(0)


def years_before(days: Column | str) -> Column:
    """A negative day offset as a positive number of years."""
    return -as_col(days) / F.lit(365.0)


def years_added(days: Column | str, months: Column | str) -> Column:
    """Age in years from a negative day offset, plus a number of months."""
    return as_col(days) * F.lit(-1.0 / 365) + as_col(months) * F.lit(1.0 / 12)


def zero_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c != 0, c)


def nan_to_num(c: Column | str) -> Column:
    """NULL and NaN become 0; infinities become the largest finite double of that sign."""
    c = as_col(c).cast("double")
    return (
        F.when(c.isNull() | F.isnan(c), 0.0)
        .when(c == float("inf"), LARGEST_DOUBLE)
        .when(c == float("-inf"), -LARGEST_DOUBLE)
        .otherwise(c)
    )


def round_half_even(c: Column | str, places: int) -> Column:
    """Round halves to even, scaling the binary value first as numeric libraries do."""
    scale = F.lit(float(10**places))
    return F.rint(as_col(c).cast("double") * scale) / scale
