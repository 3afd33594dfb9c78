"""Exact order statistics and running totals, on both sides of the small-group bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import ranks
from loomline.operators.ranks import group_median, percentiles, running_totals

POINTS = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]


def skewed(spark, n=90_000):
    """Key 0 holds a third of all rows; values are heavy with ties and far outliers."""
    rng = np.random.default_rng(5)
    key = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % 7 + 1)
    value = np.where(rng.random(n) < 0.2, 4.0, np.round(rng.lognormal(3, 2, n), 2))
    import pandas as pd

    pdf = pd.DataFrame({"k": key, "v": value})
    return pdf, spark.createDataFrame(pdf)


def test_percentiles_by_key(spark):
    pdf, df = skewed(spark)
    assert (pdf.groupby("k").size() > ranks.SMALL_GROUP).any() and (pdf.groupby("k").size() < ranks.SMALL_GROUP).any()
    got = {(r["k"], r["point"]): r["value"] for r in percentiles(df.repartition(8), "v", POINTS, "k").collect()}
    assert len(got) == 8 * len(POINTS)
    for k, part in pdf.groupby("k"):
        for p in POINTS:
            assert got[(k, p)] == pytest.approx(np.percentile(part["v"], p * 100), rel=1e-12)


def test_percentiles_overall(spark):
    pdf, df = skewed(spark)
    got = {r["point"]: r["value"] for r in percentiles(df, "v", POINTS).collect()}
    for p in POINTS:
        assert got[p] == pytest.approx(np.percentile(pdf["v"], p * 100), rel=1e-12)


def test_percentiles_nulls_and_empty(frame):
    df = frame([("a", 1.0), ("a", None), ("a", 4.0), (None, 9.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in group_median(df, "k", "v", "m").collect()] == [("a", 2.5)]
    assert percentiles(df.filter("v > 100"), "v", [0.5]).collect() == []
    assert percentiles(df.filter("v > 100"), "v", [0.5], "k").collect() == []


@pytest.mark.parametrize("range_rows", [100_000, 300, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending, range_rows):
    """One range, a few, and more than there are rows of most keys."""
    pdf, df = skewed(spark, 6000)
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(counts, "v", ["n"], "k", descending, range_rows).toPandas().sort_values(["k", "v"])
    want = pdf.groupby(["k", "v"]).size().rename("n").reset_index().sort_values(["k", "v"], ascending=[True, not descending])
    want["run"] = want.groupby("k")["n"].cumsum()
    want = want.sort_values(["k", "v"])
    assert got["n_running"].tolist() == want["run"].tolist()
    assert got["n_all"].tolist() == want.groupby("k")["n"].transform("sum").tolist()


def test_one_key_is_summed_in_many_ranges(spark):
    rows = spark.range(20_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 5).alias("n"))
    got = running_totals(rows, "v", ["n"], range_rows=500)
    windows = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line and "_range" in line]
    assert windows
    assert got.agg(F.max("n_running"), F.max("n_all")).first() == (40_000, 40_000)
    assert [r.n_running for r in got.orderBy("v").limit(6).collect()] == [0, 1, 3, 6, 10, 10]
    assert running_totals(rows.filter("v < 0"), "v", ["n"]).collect() == []
