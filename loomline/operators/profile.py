"""Column profiles. Every result is a tidy DataFrame, ready to chart or to check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.expr import round_half_even
from loomline.operators.join import as_list, attach
from loomline.operators.ranks import percentiles
from loomline.operators.rollup import known_keys, roll


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first; NULL is not counted."""
    counts = roll(df, column, {"n": "count(1)"})
    return counts.orderBy(F.desc("n"), F.asc(column))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column; NULL is a value here."""
    return df.select(column).distinct()


def default_profile(df: DataFrame, column: str, label: str, top: int | None = None) -> DataFrame:
    """Positives, total and mean of a 0/1 label per category, largest category first."""
    out = roll(
        df,
        column,
        {"positives": F.count_if(F.col(label) == 1), "total": F.count(label), "share": F.avg(label)},
    )
    return top_k(out, "total", top, column)


def top_k(df: DataFrame, by: str, k: int | None, tie: str) -> DataFrame:
    """Sort by a measure, largest first with a tie-break, and optionally keep k rows."""
    ordered = df.orderBy(F.desc(by), F.asc(tie))
    return ordered if k is None else ordered.limit(k)


def head_and_tail(df: DataFrame, by: str, tie: str, k: int = 5) -> DataFrame:
    """The k first and k last rows by a measure, with their position from either end."""
    first = df.orderBy(F.desc(by), F.asc(tie)).limit(k)
    last = df.orderBy(F.asc(by), F.desc(tie)).limit(k)
    from_top = Window.orderBy(F.desc(by), F.asc(tie))
    from_bottom = Window.orderBy(F.asc(by), F.desc(tie))
    # Only 2k rows reach these windows.
    return first.select("*", F.lit("head").alias("part"), F.row_number().over(from_top).alias("position")).unionByName(
        last.select("*", F.lit("tail").alias("part"), F.row_number().over(from_bottom).alias("position"))
    )


def argmax(df: DataFrame, item: str, score: str) -> DataFrame:
    """The item with the best score; the smallest item wins ties."""
    best = df.filter(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(item)).limit(1)
    return best.select(item, score)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent of the total per class."""
    counts = roll(df, label, {"n": "count(1)"})
    # One row per class reaches this window.
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(label)


def flag_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of 0s and 1s per flag column, rounded to 2 places, in one pass."""
    rows = F.count(F.lit(1))
    counts = df.agg(rows.alias("_n"), *[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    lines = []
    for c in columns:
        zero = round_half_even(F.try_divide(F.col(c) * 100.0, F.col("_n")), 2)
        lines.append(
            F.struct(
                F.lit(c).alias("column_name"),
                zero.alias("percent_0"),
                round_half_even(F.lit(100.0) - zero, 2).alias("percent_1"),
            )
        )
    return counts.select(F.inline(F.array(*lines)))


def percentile_grid(
    df: DataFrame,
    column: str,
    points: Sequence[float],
    by: str | Sequence[str] = (),
    approximate: bool = False,
) -> DataFrame:
    """(by, percentile, value) for percentiles in 0..100, exact unless ``approximate``."""
    by = as_list(by)
    if not approximate:
        grid = percentiles(df, column, [p / 100 for p in points], by)
        return grid.select(*by, (F.col("point") * 100).alias("percentile"), "value")
    sketch = known_keys(df, by).groupBy(*by).agg(
        F.percentile_approx(column, [p / 100 for p in points], 10000).alias("_q")
    )
    pairs = F.arrays_zip(F.lit([float(p) for p in points]).alias("percentile"), F.col("_q").alias("value"))
    return sketch.filter(F.col("_q").isNotNull()).select(*by, F.inline(pairs)).toDF(*by, "percentile", "value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column, all columns in the same passes."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in columns])
    long = df.select(F.inline(cells))
    moments = long.groupBy("column_name").agg(
        F.count("_x").alias("n"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
    )
    quartiles = quartile_columns(percentiles(long, "_x", [0.25, 0.5, 0.75], "column_name"), ["column_name"])
    return moments.join(quartiles, "column_name", "left")


def quartile_columns(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    pick = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    return grid.groupBy(*by).agg(
        *[F.max(F.when(F.col("point") == p, F.col("value"))).alias(name) for p, name in pick.items()]
    )


def global_range(df: DataFrame, columns: Sequence[str], divisor: float = 1.0) -> DataFrame:
    """(column_name, lowest, highest), optionally in other units such as years."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col(f"lo_{c}") / F.lit(divisor)).alias("lowest"),
            (F.col(f"hi_{c}") / F.lit(divisor)).alias("highest"),
        )
        for c in columns
    ]
    return stats.select(F.inline(F.array(*lines)))


def _binned(df: DataFrame, column: str, bins: int, by: Sequence[str]) -> DataFrame:
    """(by, bin, n, _lo, _width) over the range of the whole column."""
    known = known_keys(df, by).filter(F.col(column).isNotNull())
    x = F.col(column).cast("double")
    bounds = known.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    # The last bin is closed; a constant column falls in the first.
    bin_no = F.when(width == 0, 1).otherwise(F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins))).cast("int")
    counts = known.groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"_lo": lo, "_width": width})


def histogram(df: DataFrame, column: str, bins: int, by: str | Sequence[str] = ()) -> DataFrame:
    """(by, bin, bin_start, n) for equal-width bins; empty bins are absent."""
    by = as_list(by)
    return _binned(df, column, bins, by).select(
        *by, "bin", (F.col("_lo") + F.col("_width") * (F.col("bin") - 1)).alias("bin_start"), "n"
    )


def density(df: DataFrame, column: str, bins: int, by: str | Sequence[str] = ()) -> DataFrame:
    """Histogram per group over one shared range, normalised to area 1."""
    by = as_list(by)
    binned = _binned(df, column, bins, by)
    # At most ``bins`` rows per group reach this window.
    total = F.sum("n").over(Window.partitionBy(*by))
    return binned.select(*by, "bin", F.try_divide(F.col("n"), total * F.col("_width")).alias("density"))


def smooth_density(
    df: DataFrame,
    column: str,
    bins: int,
    bandwidth: float,
    grid: Sequence[float],
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Gaussian kernel density at the grid points, from binned counts.

    Rows are binned first, so the kernel runs over ``bins`` counts per group and
    never over pairs of rows.
    """
    by = as_list(by)
    binned = _binned(df, column, bins, by)
    centre = F.col("_lo") + F.col("_width") * (F.col("bin") - F.lit(0.5))
    at = binned.select(*by, "n", centre.alias("_c"), F.explode(F.lit([float(g) for g in grid])).alias("x"))
    z = (F.col("x") - F.col("_c")) / F.lit(bandwidth)
    kernel = F.exp(-z * z / 2) / F.lit((2 * 3.141592653589793) ** 0.5 * bandwidth)
    return at.groupBy(*by, "x").agg((F.sum(F.col("n") * kernel) / F.sum("n")).alias("density"))


def box_summary(df: DataFrame, column: str, by: str | Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier count per group."""
    by = as_list(by)
    known = known_keys(df, by).filter(F.col(column).isNotNull())
    quartiles = quartile_columns(percentiles(known, column, [0.25, 0.5, 0.75], by), by)
    x, reach = F.col(column).cast("double"), (F.col("q3") - F.col("q1")) * F.lit(1.5)
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        attach(known, quartiles, by, "inner")
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def token_counts(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """(token, n) over separator-delimited lists, most frequent first."""
    # The pattern is quoted: a separator is text, not a regular expression.
    tokens = df.select(F.explode(F.split(column, "\\Q" + separator + "\\E")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("token"))


def key_duplicates(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return roll(df, keys, {"n": "count(1)"}).filter(F.col("n") > 1)


def pair_corr(df: DataFrame, x: str, y: str, by: str | Sequence[str]) -> DataFrame:
    """Correlation of two measures per label: what a scatter plot shows, over all rows."""
    return roll(df, by, {"corr": F.corr(x, y), "n": F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())})


def pair_points(df: DataFrame, x: str, y: str, label: str, fractions: dict[object, float], seed: int = 0) -> DataFrame:
    """Points for a scatter plot: a sample per label value."""
    return df.select(x, y, label).sampleBy(label, fractions, seed)


def range_count(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows satisfy a condition, as a one-row frame."""
    return df.agg(F.count_if(condition).alias("n"))
