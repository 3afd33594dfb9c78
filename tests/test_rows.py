"""Expressions, cleaning, encoding, columns and joins on small hand-made frames."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from loomline.functions import expr as X
from loomline.operators import clean, columns, encode, join


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_ratio_zero_and_null(frame):
    df = frame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, None), (3.0, 2.0)], "a double, b double")
    assert values(df, X.ratio("a", "b")) == [(None,), (None,), (None,), (None,), (None,), (1.5,)]
    inf = float("inf")
    assert values(df, X.ratio("a", "b", "ieee")) == [(inf,), (-inf,), (None,), (None,), (None,), (1.5,)]
    with pytest.raises(ValueError):
        X.ratio("a", "b", "raise")


def test_flags_and_clamps(frame):
    df = frame([(-2.0,), (0.0,), (7.0,), (None,)], "x double")
    assert values(df, X.above("x"), X.at_least("x", 7), X.clamp_negative("x")) == [
        (0, 0, 0.0), (0, 0, 0.0), (1, 1, 7.0), (0, 0, None),
    ]
    assert values(df, X.keep_where(X.above("x"), "x"), X.both_positive("x", "x")) == [(0.0, 0), (0.0, 0), (7.0, 1), (0.0, 0)]


def test_status_code_counts_null_as_other(frame):
    df = frame([("Closed",), ("Active",), ("Sold",), (None,)], "s string")
    assert values(df, X.status_code("s", {"Closed": 0, "Active": 1}, 2)) == [(0,), (1,), (2,), (2,)]


def test_nan_to_num_and_rounding(frame):
    df = frame([(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (2.5,)], "x double")
    big = X.LARGEST_DOUBLE
    assert values(df, X.nan_to_num("x")) == [(0.0,), (0.0,), (big,), (-big,), (2.5,)]
    df = frame([(0.5,), (1.5,), (2.5,), (0.545,)], "x double")
    assert values(df, X.round_half_even("x", 0)) == [(0.0,), (2.0,), (2.0,), (1.0,)]
    assert values(df.filter("x = 0.545"), X.round_half_even("x", 2)) == [(0.55,)]


def test_years(frame):
    df = frame([(-730, 24.0)], "d int, m double")
    assert values(df, X.years_before("d"), X.years_added("d", "m")) == [(2.0, 4.0)]


def test_fill_checks_types(frame):
    df = frame([(1, None, None)], "k int, s string, x double")
    assert rows(clean.fill(df, {"s": "none", "x": 0})) == [(1, "none", 0.0)]
    with pytest.raises(TypeError):
        clean.fill(df, {"x": "none"})
    with pytest.raises(TypeError):
        clean.fill(df, {"s": 0})


def test_fill_mode_lowest_wins_ties(frame):
    df = frame([(1, 2.0), (2, 3.0), (3, 3.0), (4, 2.0), (5, None)], "k int, x double")
    assert rows(clean.fill_mode(df, ["x"]))[-1] == (5, 2.0)


def test_sentinel_scopes(frame):
    df = frame([(1, 9, 9.0), (2, 9, 1.0), (3, None, None), (9, 4, 2.0)], "k int, a int, b double")
    assert rows(clean.null_sentinel(df, "a")) == [(1, None, 9.0), (2, None, 1.0), (3, None, None), (9, 4, 2.0)]
    framed = clean.null_sentinel(df, "a", scope="frame")
    assert rows(framed) == [(None, 4, 2.0), (1, None, None), (2, None, 1.0), (3, None, None)]
    assert rows(clean.null_sentinel(df, "a", sentinel=4))[-1] == (9, None, 2.0)
    empty = frame([(1, None)], "k int, a int")
    assert rows(clean.null_sentinel(empty, "a")) == [(1, None)]


def test_nan_to_null_and_null_counts(frame):
    df = clean.nan_to_null(frame([(1, float("nan")), (2, 1.0)], "k int, x double"))
    assert rows(df) == [(1, None), (2, 1.0)]
    assert rows(clean.null_counts(df)) == [("k", 0), ("x", 1)]


def test_vocabulary_is_fitted_once(frame):
    train = frame([(1, "b"), (2, "a"), (3, None), (4, "it's")], "k int, c string")
    vocabulary = encode.fit_vocabulary(train)
    assert vocabulary == {"c": ["a", "b", "it's"]}
    test = frame([(1, "z"), (2, None)], "k int, c string")
    coded, names = encode.one_hot(test, vocabulary, null_flag=True)
    assert names == ["c_a", "c_b", "c_it's", "c_nan"]
    assert rows(coded) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 1)]
    with pytest.raises(ValueError):
        encode.fit_vocabulary(train, limit=2)


def test_names(frame):
    df = frame([(1, 2, 3)], "`a b` int, `ab` int, `c(d)` int")
    assert columns.sanitise_names(df).columns == ["ab", "ab_2", "cd"]
    twice = df.select("ab", F.col("c(d)").alias("x"), F.lit(9).alias("AB"))
    assert rows(columns.drop_repeated_columns(twice)) == [(2, 3)]


def test_narrow_types(frame):
    df = frame([(100, 40000, 1.5, "a", 127), (None, -1, 1e300, "b", 0)], "a bigint, b bigint, c double, s string, e bigint")
    kinds = dict(columns.narrow_types(df).dtypes)
    # 127 is the edge of the open range, so that column needs the next size.
    assert kinds == {"a": "tinyint", "b": "int", "c": "double", "s": "string", "e": "smallint"}
    report = {r["column_name"]: r["new_type"] for r in columns.type_report(df).collect()}
    assert report == {"a": "tinyint", "b": "int", "c": "double", "e": "smallint"}
    assert rows(columns.narrow_types(df)) == rows(df)


def test_cast_key_does_not_fail(frame):
    assert rows(columns.cast_key(frame([("1",), ("x",)], "k string"), "k")) == [(None,), (1,)]


def test_join_suffix_only_renames_shared(frame):
    a = frame([(1, 10, "p"), (2, 20, "q"), (None, 30, "r")], "k int, v int, only_a string")
    b = frame([(1, 5, True)], "k int, V int, only_b boolean")
    out = join.join_suffix(a, b, "k", rsuffix="_year")
    assert out.columns == ["k", "v", "only_a", "V_year", "only_b"]
    assert rows(out) == [(None, 30, "r", None, None), (1, 10, "p", 5, True), (2, 20, "q", None, None)]
    with pytest.raises(ValueError):
        join.join_suffix(a, b, "k")


def test_union_by_name(frame):
    a, b = frame([(1, "x")], "k int, s string"), frame([(2.0, 2)], "d double, k int")
    assert rows(join.union_by_name(a, b), "k") == [(1, "x", None), (2, None, 2.0)]
