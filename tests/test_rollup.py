"""Rollups and look-back windows, including the identities they must keep."""

import pytest
from helpers import by_key, rows
from pyspark.sql import functions as F

from loomline.operators.lookback import DAY_WINDOWS, lookback
from loomline.operators.rollup import (
    agg_spec, attach_stats, first_last, roll, segment_exprs, segment_rollup, share_exprs, spec_exprs, two_level_rollup,
)
from loomline.sources.tables import bucketed

ROWS = [
    (1, -3, 5.0, "A"), (1, -40, 7.0, "B"), (1, -400, None, "A"), (1, None, 11.0, None),
    (2, -200, 1.0, "B"), (2, -7, 2.0, "B"),
    (3, -1000, None, "A"),
    (None, -1, 99.0, "A"),
]
SCHEMA = "id int, day int, x double, s string"
SPEC = {"x": ["min", "max", "mean", "sum", "var", "count", "size", "nunique"]}


def test_agg_spec_nulls(frame):
    out = by_key(agg_spec(frame(ROWS, SCHEMA), "id", SPEC, "P_"), "id")
    assert set(out) == {1, 2, 3}  # a NULL key is no group
    assert out[1]["P_x_SIZE"] == 4 and out[1]["P_x_COUNT"] == 3 and out[1]["P_x_SUM"] == 23.0
    assert out[3]["P_x_SUM"] == 0.0 and out[3]["P_x_MEAN"] is None and out[3]["P_x_SIZE"] == 1
    assert out[2]["P_x_VAR"] == 0.5 and out[3]["P_x_VAR"] is None
    with pytest.raises(ValueError):
        agg_spec(frame(ROWS, SCHEMA), "id", {"x": ["mode"]})


def test_single_row_variance_is_null(frame):
    assert rows(agg_spec(frame([(1, 2.0)], "id int, x double"), "id", {"x": ["var"]})) == [(1, None)]


def test_segments_match_filtered_groupbys(frame):
    df = frame(ROWS, SCHEMA)
    out = by_key(segment_rollup(df, "id", "s", {"A": "A_", "B": "B_"}, SPEC), "id")
    for s in "AB":
        apart = by_key(agg_spec(df.filter(F.col("s") == s), "id", SPEC), "id")
        for i, row in out.items():
            for name in [k for k in row if k.startswith("x_")]:
                assert row[f"{s}_{name}"] == (apart[i][name] if i in apart else None)


def test_shares_sum_to_one(frame):
    shares = share_exprs({"s": ["A", "B"]}, "P_")
    for r in roll(frame(ROWS, SCHEMA), "id", shares).collect():
        assert abs(r["P_s_A_MEAN"] + r["P_s_B_MEAN"] + r["P_s_nan_MEAN"] - 1) < 1e-12


def test_first_last_skip_nulls_and_break_ties(frame):
    df = frame([(1, 1, None), (1, 2, 5.0), (1, 2, 3.0), (1, 9, None), (2, 1, None)], "id int, m int, v double")
    assert rows(first_last(df, "id", "m", ["v"])) == [(1, 3.0, 5.0), (2, None, None)]
    assert rows(first_last(df.repartition(4), "id", "m", ["v"])) == [(1, 3.0, 5.0), (2, None, None)]


def test_attach_keeps_rows_and_null_keys(frame):
    out = attach_stats(frame(ROWS, SCHEMA), "id", {"n": ("x", "size"), "kinds": ("s", "nunique")})
    assert out.count() == len(ROWS)
    assert sorted({(r["id"], r["n"], r["kinds"]) for r in out.collect()}, key=str) == sorted(
        {(1, 4, 2), (2, 2, 1), (3, 1, 1), (None, None, None)}, key=str
    )


def test_two_level_rollup(frame):
    child = frame([(10, 1.0), (10, 3.0), (11, 5.0)], "credit int, v double")
    parent = frame([(1, 10), (1, 11), (1, 12), (2, 13)], "id int, credit int")
    out = two_level_rollup(child, parent, "credit", "id", spec_exprs({"v": ["mean"]}), spec_exprs({"v_MEAN": ["sum", "count"]}))
    assert rows(out) == [(1, 7.0, 2), (2, 0.0, 0)]


def naive(df, exprs, windows):
    """Filter, roll up and join once per window."""
    out = None
    for suffix, back in windows.items():
        part = roll(df if back is None else df.filter(F.col("day") >= -back), "id", exprs)
        part = part.toDF("id", *[c + suffix for c in part.columns[1:]])
        out = part if out is None else out.join(part, "id", "left")
    return out


def nearly(table):
    """Variances hang on the order of the rows in their last bit."""
    close = lambda c, v: pytest.approx(v, rel=1e-12, abs=1e-12) if "VAR" in c and v is not None else v
    return {k: {c: close(c, v) for c, v in row.items()} for k, row in table.items()}


def naive_tagged(df, exprs):
    out = lookback(df, "id", "day", DAY_WINDOWS, {n: str(e) for n, e in exprs.items()})
    return out._jdf.queryExecution().optimizedPlan().toString()


def test_lookback_equals_filter_and_join(frame):
    df = frame(ROWS, SCHEMA)
    exprs = spec_exprs(SPEC) | share_exprs({"s": ["A", "B"]})
    got, want = lookback(df, "id", "day", DAY_WINDOWS, exprs), naive(df, exprs, DAY_WINDOWS)
    assert sorted(got.columns) == sorted(want.columns)
    wanted = nearly(by_key(want, "id"))
    assert by_key(got, "id") == wanted
    assert by_key(lookback(df.repartition(7), "id", "day", DAY_WINDOWS, exprs), "id") == wanted
    # Any other expression than those of the specification takes the tagged way, with the same result.
    tagged = lookback(df, "id", "day", DAY_WINDOWS, {n: str(e) for n, e in exprs.items()})
    assert by_key(tagged, "id") == wanted


def test_panes_copy_no_rows(frame):
    exprs = spec_exprs(SPEC) | share_exprs({"s": ["A", "B"]}) | segment_exprs("s", {"A": "A_"}, SPEC)
    df = frame(ROWS, SCHEMA)
    out = lookback(df, "id", "day", DAY_WINDOWS, exprs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "Generate" in naive_tagged(df, exprs)
    assert by_key(out, "id") == nearly(by_key(naive(df, exprs, DAY_WINDOWS), "id"))


@pytest.mark.parametrize("seed", range(3))
def test_panes_equal_tagged_rows(spark, seed):
    """Nulls, rows in no window, segments that some windows lack, values shared between panes."""
    import random

    rng = random.Random(seed)
    data = [
        (rng.choice([1, 2, 3, 4, None]), rng.choice([None, 0, -5, -7, -8, -14, -31, -180, -400]), rng.choice([None, 0.25, 0.25, 2.5, -3.0, 1e6]), rng.choice("AABN"))
        for _ in range(80)
    ]
    df = spark.createDataFrame(data, SCHEMA)
    windows = {"_year": 365, "_month": 30, "_week": 7}
    exprs = spec_exprs(SPEC) | share_exprs({"s": ["A", "B"]}, hows=["mean", "max", "min", "sum", "var", "size"]) | segment_exprs("s", {"B": "B_"}, SPEC)
    got = by_key(lookback(df, "id", "day", windows, exprs), "id")
    assert got == nearly(by_key(lookback(df, "id", "day", windows, {n: str(e) for n, e in exprs.items()}), "id"))


def test_lookback_counts_shrink_with_the_window(frame):
    order = ["", "_year", "_half_year", "_quarter", "_month", "_fortnight", "_week"]
    for r in lookback(frame(ROWS, SCHEMA), "id", "day", DAY_WINDOWS, {"n": "count(1)"}).collect():
        counts = [r["n" + s] or 0 for s in order]
        assert counts == sorted(counts, reverse=True)


def test_lookback_computes_only_wanted_columns(frame):
    df = frame(ROWS, SCHEMA)
    exprs = spec_exprs(SPEC)
    some = lookback(df, "id", "day", DAY_WINDOWS, exprs, columns=["x_MAX_week", "x_SUM"])
    full = lookback(df, "id", "day", DAY_WINDOWS, exprs).select("id", "x_SUM", "x_MAX_week")
    assert some.columns == ["id", "x_SUM", "x_MAX_week"] and rows(some) == rows(full)
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" in plan and "var_samp" not in plan and "avg(" not in plan
    assert rows(lookback(df, "id", "day", DAY_WINDOWS, exprs, columns=[])) == [(1,), (2,), (3,)]


def test_hot_key_is_folded_before_the_shuffle(spark):
    """A third of all rows on one key: one partial row per task and window crosses the shuffle."""
    df = spark.range(30000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), (-(F.col("id") % 500)).alias("day"), F.lit(1.0).alias("x")
    )
    out = by_key(lookback(df, "id", "day", {"": None, "_year": 365}, spec_exprs({"x": ["sum"]})), "id")
    assert out[0]["x_SUM"] == 10000.0 and sum(r["x_SUM"] for r in out.values()) == 30000.0
    assert sum(r["x_SUM_year"] or 0 for r in out.values()) == df.filter("day >= -365").count()


def test_hot_and_sparse_keys_agree(spark):
    """The same rollup, with keys gathered, with hot keys kept apart, and combined in place."""
    from loomline.operators.placement import together

    df = spark.range(3000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("k"), F.col("id").alias("x")
    )
    fold = lambda part, gathered=False: part.groupBy("k").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    want = rows(fold(df))
    assert rows(together(df, "k", fold)) == want
    assert rows(together(df, "k", fold, hot_rows=500)) == want
    assert "Union" in together(df, "k", fold, hot_rows=500)._jdf.queryExecution().optimizedPlan().toString()
    dense = df.withColumn("k", F.col("k") % 5)
    assert "repartition" not in together(dense, "k", fold)._jdf.queryExecution().logical().toString().lower()


def test_gathered_rows_per_task_stay_bounded_as_input_grows(spark):
    """Gathering spreads rows over more tasks as they grow, not over the fixed shuffle partitions."""
    from loomline.operators.placement import together

    df = spark.range(20000, numPartitions=4).select((F.col("id") * 7919 % 20000).alias("k"), F.col("id").alias("x"))
    per_task = lambda part, gathered: part.groupBy(F.spark_partition_id().alias("p")).agg(F.count("x").alias("n"))
    largest = lambda out: max(r["n"] for r in out.collect())
    assert largest(together(df, "k", per_task, task_rows=1000)) < 2000
    assert largest(together(df, "k", per_task, hot_rows=5000, task_rows=1000)) < 2000
    fold = lambda part, gathered=False: part.groupBy("k").agg(F.sum("x").alias("s"))
    assert rows(together(df, "k", fold, task_rows=1000)) == rows(fold(df))


def test_lookback_moves_rows_once(spark, frame):
    """Tagging, rolling up and spreading share the one shuffle that gathered the rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = frame([(i % 50, -i, float(i)) for i in range(100)], "id int, day int, x double")
        plan = lookback(df, "id", "day", DAY_WINDOWS, spec_exprs({"x": ["sum", "max"]}))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bucketed_rollups_join_without_moving(spark, tmp_path):
    left = spark.range(0, 400).selectExpr("id % 97 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("v"))
    right = spark.range(0, 300).selectExpr("id % 50 AS k", "id AS w").groupBy("k").agg(F.max("w").alias("w"))
    a, b = bucketed(left, "k", 4, str(tmp_path / "a")), bucketed(right, "k", 4, str(tmp_path / "b"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = a.join(b, "k", "left")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert rows(out, "k") == rows(left.join(right, "k", "left"), "k")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
