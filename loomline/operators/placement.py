"""Bringing the rows of one key together before a wide rollup.

A rollup with hundreds of aggregates has rows far wider than its input. Combining
before the shuffle only pays when a task sees many rows of the same key; with a few
rows per key, spread over all tasks, it would turn every narrow row into a wide one
and shuffle that. So sparse keys are moved once, as narrow rows, and every later step
on the key runs where they landed. Keys too large for one task keep the map-side
combine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.join import SMALL_ROWS
from loomline.sources.tables import cut_lineage

# A key with more rows than this is not gathered in one task.
HOT_ROWS = 2_000_000
# Rows of one key a task must hold, on average, for combining in place to pay: about
# how many times wider a rolled-up row is than the rows it came from.
COMBINE_GAIN = 50
# Gathered rows a task holds, about: the parts grow with the input, not a fixed count.
TASK_ROWS = 1_000_000


def together(
    df: DataFrame,
    key: str,
    fold: Callable[[DataFrame, bool], DataFrame],
    probe: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``fold`` the frame per ``key``; rows of different keys must not affect each other.

    ``fold(rows, gathered)`` is told whether each key's rows are together: then a key
    has a bounded number of them, and grouping or windowing by it moves nothing.

    A narrow pass over ``probe`` (``df`` unless a cheaper frame has the same keys) counts
    rows and keys. If combining in place does not pay, rows are counted per key, exactly
    and map-side first, and every key over ``hot_rows`` takes the combining way; there are
    at most rows / ``hot_rows`` of them. Both counts only choose the route: the result is
    the same whichever way a key goes. Gathered rows go to one part per ``task_rows`` of
    them, at least as many as the session's shuffle partitions.
    """
    known = (df if probe is None else probe).filter(F.col(key).isNotNull())
    seen = (
        known.select(key, F.spark_partition_id().alias("_task"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.approx_count_distinct(key).alias("keys"),
            F.approx_count_distinct("_task").alias("tasks"),
        )
        .first()
    )
    if seen["n"] >= COMBINE_GAIN * seen["keys"] * seen["tasks"]:
        return fold(df, False)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // task_rows))
    if seen["n"] <= hot_rows:
        return fold(df.repartition(parts, key), True)
    sizes = known.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.filter(F.col("_n") > hot_rows).select("_hot"))
    n_hot = hot.count()
    if not n_hot:
        return fold(df.repartition(parts, key), True)
    flags = F.broadcast(hot) if n_hot <= SMALL_ROWS else hot
    same = F.col(key) == F.col("_hot")
    return fold(df.join(flags, same, "left_anti").repartition(parts, key), True).unionByName(fold(df.join(flags, same, "left_semi"), False))
