"""Connected components of a links table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours, or to the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v, longs): the component is its smallest node.

    Each round is written to the shared folder; it ends when a round changes nothing, after a number of
    rounds that grows with the logarithm of the nodes.
    """
    edges, seen = stash(links.filter("u != v").select("u", "v").distinct()), None
    while True:
        edges = stash(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    rest = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rest.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
