"""Routes and plans that must hold at a scale where nothing small can be assumed from sizes."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from loomline.operators import clean, learn, profile
from loomline.operators.placement import together
from loomline.operators.ranks import group_median, percentiles


def route(df, hot_rows):
    seen = []

    def fold(part, gathered):
        seen.append((gathered, part.select("k").distinct().count()))
        return part.groupBy("k").agg(F.sum("v").alias("s"))

    out = together(df, "k", fold, hot_rows=hot_rows)
    return seen, out


def test_every_large_key_takes_the_combining_route(spark):
    # 1,500 keys of 40 rows among 60,000 keys of one row, over many tasks.
    many = spark.range(0, 120_000, 1, 8).select(F.when(F.col("id") < 60_000, F.col("id") % 1500).otherwise(F.col("id")).alias("k"), F.lit(1).alias("v"))
    seen, out = route(many, 30)
    assert sorted(seen) == [(False, 1500), (True, 60_000)]
    assert out.count() == 61_500


def test_a_key_with_a_small_share_is_found(spark):
    df = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 10_000 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit(1).alias("v"))
    seen, out = route(df, 9)
    assert (False, 1) in seen and out.filter("k = -1").first()["s"] == 10


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(None, 1)] * 3 + [(1, 1)] * 5 + [(i, 1) for i in range(2, 60)], "k long, v int").repartition(6)
    _, out = route(df, 4)
    assert {r["k"]: r["s"] for r in out.collect()}[None] == 3


def test_unlabelled_rows_are_in_no_part(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 600, F.col("id") % 2).alias("y"))
    got = dict(learn.stratified_split(df, "id", "y", 0.2).groupBy("split").count().collect())
    assert got == {"train": 480, "cv": 120, None: 400}


def test_scaling_ignores_unlabelled_rows(spark):
    x = F.when(F.col("id") < 1000, F.col("id") / 1000).otherwise(F.lit(1000.0))
    df = spark.range(2000).select("id", F.when(F.col("id") < 1000, F.col("id") % 2).alias("y"), x.alias("x"))
    split = learn.stratified_split(df, "id", "y", 0.2)
    scaled = learn.standardise(split.filter("split = 'train'"), split, ["x"]).filter("y IS NOT NULL")
    mean, dev = scaled.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean) < 0.1 and abs(dev - 1) < 0.1


def test_a_frame_sentinel_spares_ids_and_labels(spark):
    df = spark.createDataFrame([(5, 0, -5, 7), (0, 1, -3, 0), (1, 0, 0, 0)], "id int, y int, days int, other int")
    got = clean.null_sentinel(df, "days", scope="frame", keep=["id", "y"])
    assert rows(got, "id") == [(0, 1, -3, None), (1, 0, None, None), (5, 0, -5, 7)]


@pytest.fixture
def labelled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200000")
    yield spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 3).alias("y"), F.rand(1).alias("x"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "build",
    [
        lambda d: learn.stratified_split(d, "id", "y"),
        lambda d: learn.balanced_weight(d, "y"),
        lambda d: percentiles(d, "x", [0.5], "y"),
        lambda d: group_median(d, "y", "x", "m"),
        lambda d: profile.box_summary(d, "x", "y"),
    ],
    ids=["split", "weight", "percentiles", "median", "box"],
)
def test_rows_are_not_shuffled_by_their_class(labelled, build):
    """No exchange has the raw rows under it without an aggregate in between."""
    df = build(labelled)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = [line for line in plan.splitlines() if line.strip()]
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = lines[at + 1 : at + 4]
            assert any("HashAggregate" in b or "ObjectHashAggregate" in b for b in below), line
