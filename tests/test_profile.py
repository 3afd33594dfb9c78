import math

import pytest
from helpers import by_key, rows

from loomline.operators import profile as P


@pytest.fixture
def people(frame):
    data = [("a", 1, 1.0), ("a", 0, 2.0), ("b", 1, 3.0), ("b", None, 100.0), (None, 0, 5.0), ("c", 0, None)]
    return frame(data, "c string, y int, x double")


def test_counts_and_profiles(people):
    assert [tuple(r) for r in P.value_counts(people, "c").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(P.default_profile(people, "c", "y")) == [("a", 1, 2, 0.5), ("b", 1, 1, 1.0), ("c", 0, 1, 0.0)]
    assert P.default_profile(people, "c", "y", top=1).count() == 1
    assert rows(P.distinct_values(people, "c")) == [(None,), ("a",), ("b",), ("c",)]
    assert rows(P.class_balance(people, "y")) == [(0, 3, 60.0), (1, 2, 40.0)]
    assert rows(P.key_duplicates(people, "c")) == [("a", 2), ("b", 2)]
    assert rows(P.range_count(people, people.x > 2)) == [(3,)]


def test_head_and_tail(frame):
    df = frame([(i, float(i % 3)) for i in range(6)], "k int, m double")
    got = [(r["part"], r["position"], r["k"]) for r in P.head_and_tail(df, "m", "k", 2).collect()]
    assert sorted(got) == [("head", 1, 2), ("head", 2, 5), ("tail", 1, 3), ("tail", 2, 0)]
    assert rows(P.argmax(df, "k", "m")) == [(2, 2.0)]


def test_flag_share(frame):
    df = frame([(0, 1), (0, 1), (1, 1)], "a int, b int")
    assert rows(P.flag_share(df, ["a", "b"])) == [("a", 66.67, 33.33), ("b", 0.0, 100.0)]


def test_histogram_edges(frame):
    df = frame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert rows(P.histogram(df, "x", 2)) == [(1, 0.0, 1), (2, 5.0, 2)]
    constant = frame([(3.0,), (3.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in P.histogram(constant, "x", 10).collect()] == [(1, 2)]


def test_density_has_area_one(frame):
    df = frame([("a", float(i)) for i in range(11)] + [("b", 2.0)], "g string, x double")
    width = 1.0
    for g in "ab":
        assert sum(r["density"] * width for r in P.density(df, "x", 10, "g").collect() if r["g"] == g) == pytest.approx(1)
    smooth = P.smooth_density(df, "x", 10, 1.0, [2.5], "g").collect()
    b = next(r["density"] for r in smooth if r["g"] == "b")
    assert b == pytest.approx(1 / math.sqrt(2 * math.pi))


def test_box_summary_and_describe(frame):
    df = frame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "g string, x double")
    row = P.box_summary(df, "x", "g").collect()[0].asDict()
    assert row == {"g": "g", "q1": 2.0, "median": 3.0, "q3": 4.0, "n": 5, "whisker_low": 1.0, "whisker_high": 4.0, "outliers": 1}
    stats = by_key(P.describe(df, ["x"]), "column_name")["x"]
    assert (stats["n"], stats["mean"], stats["min"], stats["max"], stats["median"]) == (5, 22.0, 1.0, 100.0, 3.0)
    assert rows(P.global_range(df, ["x"], 2.0)) == [("x", 0.5, 50.0)]


def test_percentile_grid_approximate(frame):
    df = frame([(float(i),) for i in range(101)], "x double")
    exact = rows(P.percentile_grid(df, "x", [0, 50, 100]), "percentile")
    assert exact == [(0.0, 0.0), (50.0, 50.0), (100.0, 100.0)]
    assert rows(P.percentile_grid(df, "x", [0, 50, 100], approximate=True), "percentile") == exact


def test_tokens_separator_is_plain_text(frame):
    df = frame([("a.b.a",), ("b",), (None,)], "t string")
    assert [tuple(r) for r in P.token_counts(df, "t", ".").collect()] == [("a", 2), ("b", 2)]


def test_pairs(frame):
    df = frame([(1.0, 2.0, 0), (2.0, 4.0, 0), (3.0, 6.0, 0), (None, 1.0, 0)], "x double, y double, c int")
    row = P.pair_corr(df, "x", "y", "c").collect()[0]
    assert row["corr"] == pytest.approx(1.0) and row["n"] == 3
    assert P.pair_points(df, "x", "y", "c", {0: 1.0}).count() == 4
