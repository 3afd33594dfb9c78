"""Running totals and exact order statistics that no single task has to sort.

A window ordered over a whole table, or over one hot key, is one task's work. Running
totals go by sorted ranges and the totals of the ranges before. For order statistics an
approximate sketch first says where to look, and the exact answer is then found from
counts plus a small part of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.join import as_list
from loomline.operators.rollup import known_keys
from loomline.sources.tables import cut_lineage, written

# Running totals go by sorted ranges of about this many rows.
RANGE_ROWS = 200_000
RANGE = "_range"

# The sketch places a value within 1/ACCURACY of its rank; brackets allow twice that.
ACCURACY = 10_000
SLACK = 2 / ACCURACY
# Up to this many rows a group is ranked whole: the slack would be under four ranks wide.
# Sketches of at most so many numbers in all are broadcast.
SKETCH_VALUES = 1_000_000
SMALL_GROUP = int(4 / SLACK)


# ---------------------------------------------------------------- running totals


def running_totals(
    counts: DataFrame,
    order: str,
    amounts: Sequence[str],
    by: str | Sequence[str] = (),
    descending: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``{a}_running`` (up to and with the row) and ``{a}_all`` for each amount.

    ``counts`` has one row per (by, order) value: aggregate ties before calling. The rows are
    written once, so that they are counted without being computed twice, and cut into sorted
    ranges of about ``range_rows`` rows, a large key into many. Each range's totals give the
    later ranges of its key their offset, and the ranges are then summed independently.
    """
    by, counts = as_list(by), written(counts)
    ranges = max(1, -(-counts.count() // range_rows))
    along = F.desc(order) if descending else F.asc(order)
    ranged, offsets = counts.withColumn(RANGE, F.lit(0)), None
    if ranges > 1:
        ranged = written(counts.repartitionByRange(ranges, *by, along).withColumn(RANGE, F.spark_partition_id()))
        # At most one row for each range and key reaches the two windows over the totals.
        whole = Window.partitionBy(*by)
        before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranged.groupBy(*by, RANGE).agg(*[F.sum(a).alias(f"{a}_here") for a in amounts]).select(
            *by,
            RANGE,
            *[F.coalesce(F.sum(f"{a}_here").over(before), F.lit(0)).alias(f"{a}_before") for a in amounts],
            *[F.sum(f"{a}_here").over(whole).alias(f"{a}_all") for a in amounts],
        )
    here = Window.partitionBy(*by, RANGE)
    upto = here.orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if offsets is None:
        return ranged.select(
            *counts.columns, *[F.sum(a).over(upto).alias(f"{a}_running") for a in amounts], *[F.sum(a).over(here).alias(f"{a}_all") for a in amounts]
        )
    return ranged.join(offsets, [*by, RANGE]).select(
        *counts.columns,
        *[(F.col(f"{a}_before") + F.sum(a).over(upto)).alias(f"{a}_running") for a in amounts],
        *[f"{a}_all" for a in amounts],
    )


# ---------------------------------------------------------------- percentiles


def percentiles(df: DataFrame, value: str, points: Sequence[float], by: str | Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated percentiles (points in 0..1), one row per key and point.

    Columns: by, ``point``, ``value``. NULL values and NULL keys are left out.

    A sketch of each group says how large it is and, for every point, between which
    values its two ranks must lie. Small groups are then ranked whole; of the others
    only the rows inside a bracket are shuffled and sorted. The sketch is fixed before
    it is used, so all passes agree whatever order it was merged in.
    """
    by = as_list(by)
    known = known_keys(df, by).filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    asks = [x for p in points for x in (max(p - SLACK, 0.0), min(p + SLACK, 1.0))]
    sketch = known.groupBy(*by).agg(
        F.percentile_approx("_v", asks, ACCURACY).alias("_q"), F.count(F.lit(1)).alias("_n_all")
    )
    if by:
        sketch = cut_lineage(sketch)
        sizes = sketch.agg(F.min("_n_all").alias("least"), F.max("_n_all").alias("most"), F.count(F.lit(1)).alias("groups")).first()
        least, most = sizes["least"] or 0, sizes["most"] or 0
        # Few groups: their sketches go to the rows, and no row is shuffled by its group.
        small = sizes["groups"] * len(asks) <= SKETCH_VALUES
        attach = lambda keep: known.join(F.broadcast(sketch.filter(keep)) if small else sketch.filter(keep), by)
    else:
        only = sketch.first()
        least = most = only["_n_all"]
        attach = lambda keep: known.withColumns(
            {"_q": F.lit(only["_q"]).cast("array<double>"), "_n_all": F.lit(only["_n_all"])}
        )
    is_small = F.col("_n_all") <= SMALL_GROUP
    parts = []
    if least <= SMALL_GROUP:
        parts.append(_small_groups(attach(is_small), points, by))
    if most > SMALL_GROUP:
        parts.append(_bracketed(attach(~is_small), points, by))
    return reduce(DataFrame.unionByName, parts)


def _small_groups(rows: DataFrame, points: Sequence[float], by: Sequence[str]) -> DataFrame:
    """At most ``SMALL_GROUP`` rows per group, so the aggregate's buffer is bounded."""
    points = [float(p) for p in points]
    values = rows.groupBy(*by).agg(F.percentile("_v", F.lit(points)).alias("_values")).filter("_values IS NOT NULL")
    return values.select(*by, F.inline(F.arrays_zip(F.lit(points), "_values"))).toDF(*by, "point", "value")


def _bracketed(rows: DataFrame, points: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Count the rows below every bracket and rank the few inside."""
    n = range(len(points))
    # Written out in place: dozens of aliases would swamp the optimiser's constraint inference.
    low = [F.get("_q", F.lit(2 * i)) if p > SLACK else F.lit(float("-inf")) for i, p in enumerate(points)]
    high = [F.get("_q", F.lit(2 * i + 1)) if p < 1 - SLACK else F.lit(float("inf")) for i, p in enumerate(points)]
    below = rows.groupBy(*by).agg(F.array(*[F.count_if(F.col("_v") < low[i]) for i in n]).alias("_below"))
    inside = [F.col("_v").between(low[i], high[i]) for i in n]
    marks = F.array_compact(F.array(*[F.when(inside[i], F.lit(i)) for i in n]))
    # A sum and not an OR: the optimiser would expand a long OR of ranges into clauses.
    hits = reduce(add, [F.when(i, 1).otherwise(0) for i in inside])
    kept = rows.filter(hits > 0).select(*by, "_n_all", "_v", F.explode(marks).alias("_i"))
    counts = kept.groupBy(*by, "_n_all", "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*by, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_n").over(within))
    ranked = ranked.join(below, by) if by else ranked.withColumn("_below", below.scalar())

    end = F.get("_below", F.col("_i")) + F.col("_upto")
    point = F.get(F.lit([float(p) for p in points]), F.col("_i"))
    position = point * (F.col("_n_all") - 1)
    holds = lambda rank: (rank >= end - F.col("_n")) & (rank < end)
    found = ranked.groupBy(*by, "_n_all", "_i").agg(
        F.max(F.when(holds(F.floor(position)), F.col("_v"))).alias("_low"),
        F.max(F.when(holds(F.ceil(position)), F.col("_v"))).alias("_high"),
    )
    # A rank outside its bracket would be a fault of the sketch: it must not pass as a NULL.
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    low_value, high_value = F.coalesce("_low", missed), F.coalesce("_high", missed)
    value = low_value + (high_value - low_value) * (position - F.floor(position))
    return found.select(*by, point.alias("point"), value.alias("value"))


def group_median(df: DataFrame, by: str | Sequence[str], value: str, alias: str) -> DataFrame:
    """Exact interpolated median per category."""
    return percentiles(df, value, [0.5], by).select(*as_list(by), F.col("value").alias(alias))
