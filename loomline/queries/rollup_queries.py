"""Rollups and look-back windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators.lookback import DAY_WINDOWS, lookback
from loomline.operators.rollup import (
    agg_all, agg_spec, first_last, roll, segment_rollup, share_exprs, spec_exprs, two_level_rollup,
)
from loomline.queries import sqlgen as S
from loomline.queries.registry import query, rounded
from loomline.sources.tables import bucketed, table

STATUSES = {"o_orderstatus": ["F", "O", "P"]}

ORDER_SPEC = {
    "cents": ["count", "sum", "mean", "min", "max"],
    "priority": ["nunique", "count", "size"],
    "thousands": ["var", "mean", "max"],
}
# Whole cents, so that sums and means do not depend on the order of addition.
ORDERS_SQL = (
    "SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice * 100) AS cents, "
    "CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, "
    "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority, "
    "date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) AS days FROM orders"
)


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).alias("cents"),
        F.floor(F.col("o_totalprice") / 1000).alias("thousands"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        F.datediff("o_orderdate", F.lit("2001-08-02")).alias("days"),
    )


def _select(keys: str, items: list[str], source: str) -> str:
    return f"SELECT {keys}, {', '.join(items)} FROM ({source}) GROUP BY {keys}"


@query(
    "agg_spec_customer",
    _select("o_custkey", S.spec_items(ORDER_SPEC, "ORD_", places={"thousands": 6}), ORDERS_SQL),
)
def agg_spec_customer(spark, folder):
    out = agg_spec(_orders(spark, folder), "o_custkey", ORDER_SPEC, "ORD_")
    return rounded(out, 6, "ORD_thousands_VAR", "ORD_thousands_MEAN")


LINE_MEASURES = ["l_quantity", "l_linenumber", "percent_off"]
LINES_SQL = "SELECT *, round(l_discount * 100) AS percent_off FROM lineitem"


@query(
    "agg_all_columns",
    _select(
        "l_suppkey",
        S.spec_items({c: ["max", "mean", "sum", "var"] for c in LINE_MEASURES}, "L_", default_places=6),
        LINES_SQL,
    ),
)
def agg_all_columns(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("percent_off", F.round(F.col("l_discount") * 100))
    return rounded(agg_all(df, "l_suppkey", LINE_MEASURES, prefix="L_"), 6)


@query("category_share", _select("o_custkey", S.share_items(STATUSES, "ORD_"), ORDERS_SQL))
def category_share(spark, folder):
    return roll(_orders(spark, folder), "o_custkey", share_exprs(STATUSES, "ORD_", null_flag=False))


LINE_SPEC = {"l_quantity": ["sum", "max"], "l_linenumber": ["size"]}
TOTAL_SPEC = {"l_quantity_SUM": ["sum", "max"], "l_quantity_MAX": ["mean"], "l_linenumber_SIZE": ["sum"], "cents": ["max"]}


@query(
    "two_level_rollup",
    "WITH per_order AS ("
    + _select("l_orderkey AS o_orderkey", S.spec_items(LINE_SPEC), "SELECT * EXCLUDE (l_orderkey), CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE -l_orderkey END AS l_orderkey FROM lineitem").replace(
        "GROUP BY l_orderkey AS o_orderkey", "GROUP BY l_orderkey"
    )
    + "), p AS (SELECT * FROM ("
    + ORDERS_SQL
    + ") LEFT JOIN per_order USING (o_orderkey)) "
    + _select("o_custkey", S.spec_items(TOTAL_SPEC), "SELECT * FROM p"),
)
def two_level(spark, folder):
    # Lines of other flags get keys that no order has, so some orders have no lines.
    key = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    lines = table(spark, folder, "lineitem").withColumn("l_orderkey", key).withColumnRenamed("l_orderkey", "o_orderkey")
    return two_level_rollup(
        lines, _orders(spark, folder), "o_orderkey", "o_custkey", spec_exprs(LINE_SPEC), spec_exprs(TOTAL_SPEC)
    )


SEGMENTS = {"F": "F_", "O": "O_"}
SEGMENT_SPEC = {"cents": ["mean", "sum", "max"], "days": ["min", "size"]}


@query(
    "segment_rollup",
    _select(
        "o_custkey",
        S.spec_items(SEGMENT_SPEC, "ALL_")
        + [i for v, p in SEGMENTS.items() for i in S.spec_items(SEGMENT_SPEC, p, where=f"o_orderstatus = '{v}'")],
        ORDERS_SQL,
    ),
)
def segments(spark, folder):
    return segment_rollup(_orders(spark, folder), "o_custkey", "o_orderstatus", SEGMENTS, SEGMENT_SPEC, "ALL_")


@query(
    "first_last_ordered",
    """
    WITH e AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                      CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind FROM events)
    SELECT user_id,
           arg_min(value, (ts, value)) FILTER (WHERE value IS NOT NULL) AS "value_FIRST",
           arg_max(value, (ts, value)) FILTER (WHERE value IS NOT NULL) AS "value_LAST",
           arg_min(kind, (ts, kind)) FILTER (WHERE kind IS NOT NULL) AS "kind_FIRST",
           arg_max(kind, (ts, kind)) FILTER (WHERE kind IS NOT NULL) AS "kind_LAST"
    FROM e WHERE user_id IS NOT NULL GROUP BY user_id
    """,
)
def first_last_ordered(spark, folder):
    df = table(spark, folder, "events").select(
        "user_id",
        "ts",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
    )
    return first_last(df, "user_id", "ts", ["value", "kind"])


LOOKBACK_SPEC = {"cents": ["max", "mean", "sum", "size"], "priority": ["nunique"], "days": ["min"]}


def _windowed(keys: str, offset: str, spec, shares, source: str, windows=DAY_WINDOWS, prefix: str = "") -> str:
    items = []
    for suffix, where in S.windows_of(offset, windows).items():
        items += S.spec_items(spec, prefix, suffix, where) + S.share_items(shares, prefix, suffix, where)
    return _select(keys, items, source)


LOOKBACK_ORDERS_SQL = (
    f"SELECT c_custkey, c_mktsegment, r.* EXCLUDE (o_custkey) FROM customer LEFT JOIN "
    f"({_windowed('o_custkey', 'days', LOOKBACK_SPEC, STATUSES, ORDERS_SQL, prefix='ORD_')}) r ON c_custkey = o_custkey"
)


@query("lookback_orders", LOOKBACK_ORDERS_SQL)
def lookback_orders(spark, folder):
    """Orders per customer over seven nested windows, joined to every customer."""
    exprs = spec_exprs(LOOKBACK_SPEC, "ORD_") | share_exprs(STATUSES, "ORD_", null_flag=False)
    rolled = lookback(_orders(spark, folder), "o_custkey", "days", DAY_WINDOWS, exprs)
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(rolled.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")


LINE_LOOKBACK = {"l_quantity": ["max", "mean", "sum"], "percent_off": ["min", "mean"], "l_orderkey": ["nunique"]}
LINE_FLAGS = {"l_returnflag": ["A", "N", "R"]}


@query(
    "lookback_lineitem",
    _windowed(
        "l_suppkey",
        "days",
        LINE_LOOKBACK,
        LINE_FLAGS,
        "SELECT *, round(l_discount * 100) AS percent_off, "
        "date_diff('day', DATE '2001-11-05', CAST(l_shipdate AS DATE)) AS days FROM lineitem",
    ),
)
def lookback_lineitem(spark, folder):
    df = table(spark, folder, "lineitem").withColumns(
        {
            "percent_off": F.round(F.col("l_discount") * 100),
            "days": F.datediff("l_shipdate", F.lit("2001-11-05")),
        }
    )
    exprs = spec_exprs(LINE_LOOKBACK) | share_exprs(LINE_FLAGS, null_flag=False)
    return lookback(df, "l_suppkey", "days", DAY_WINDOWS, exprs)


EVENT_WINDOWS = {"": None, "_fortnight": 14, "_week": 7, "_days": 3}


@query(
    "lookback_events_days",
    _windowed(
        "user_id",
        "days",
        {"cents": ["max", "mean", "sum", "size"]},
        {"event_type": ["click", "error", "purchase", "signup", "view"]},
        "SELECT *, round(value * 100) AS cents, date_diff('day', DATE '2024-01-30', CAST(ts AS DATE)) AS days FROM events",
        EVENT_WINDOWS,
    ),
)
def lookback_events_days(spark, folder):
    df = table(spark, folder, "events").withColumns(
        {"cents": F.round(F.col("value") * 100), "days": F.datediff("ts", F.lit("2024-01-30"))}
    )
    kinds = {"event_type": ["click", "error", "purchase", "signup", "view"]}
    exprs = spec_exprs({"cents": ["max", "mean", "sum", "size"]}) | share_exprs(kinds, null_flag=False)
    return lookback(df, "user_id", "days", EVENT_WINDOWS, exprs)


@query(
    "bucketed_join",
    f"SELECT c_custkey, r.* EXCLUDE (o_custkey), l.* EXCLUDE (k) FROM customer "
    f"LEFT JOIN ({_select('o_custkey', S.spec_items(SEGMENT_SPEC, 'ALL_'), ORDERS_SQL)}) r ON c_custkey = o_custkey "
    "LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n_lines, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY 1) l ON c_custkey = k",
)
def bucketed_join(spark, folder):
    """Rollups written bucketed and sorted by key, joined to the customers without a shuffle or a sort."""
    orders = roll(_orders(spark, folder), "o_custkey", spec_exprs(SEGMENT_SPEC, "ALL_")).withColumnRenamed("o_custkey", "c_custkey")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_linenumber").alias("numbers")
    )
    parts = [bucketed(part, "c_custkey", 8) for part in (table(spark, folder, "customer").select("c_custkey"), orders, lines)]
    return parts[0].join(parts[1], "c_custkey", "left").join(parts[2], "c_custkey", "left")
