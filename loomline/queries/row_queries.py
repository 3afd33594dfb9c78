"""Typing, row expressions, cleaning, encoding and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import expr as X
from loomline.operators import clean, columns, encode, join
from loomline.operators.ranks import group_median
from loomline.operators.rollup import attach_stats
from loomline.queries.registry import query, rounded
from loomline.sources.tables import overview, table


def _range_rows(cols: dict[str, str], ladder_of) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{old}' AS old_type, {ladder_of(c, old)}" for c, old in cols.items()
    )


LINEITEM_NUMBERS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
}


def _ladder_sql(c: str, old: str) -> str:
    size = {"bigint": 8, "int": 4, "double": 8}[old]
    if old == "double":
        steps = [("float", "-3.4e38", "3.4e38", 4)]
    else:
        steps = [("tinyint", -128, 127, 1), ("smallint", -32768, 32767, 2), ("int", -2147483648, 2147483647, 4)]
    name = " ".join(f"WHEN min({c}) > {lo} AND max({c}) < {hi} THEN '{n}'" for n, lo, hi, _ in steps)
    width = " ".join(f"WHEN min({c}) > {lo} AND max({c}) < {hi} THEN {w}" for _, lo, hi, w in steps)
    return (
        f"CASE {name} ELSE '{old}' END AS new_type, count(*) * {size} AS old_bytes, "
        f"count(*) * CASE {width} ELSE {size} END AS new_bytes FROM lineitem"
    )


@query("narrow_types_report", _range_rows(LINEITEM_NUMBERS, _ladder_sql))
def narrow_types_report(spark, folder):
    return columns.type_report(table(spark, folder, "lineitem"))


@query(
    "narrow_types",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS FLOAT)::DOUBLE AS l_quantity, "
    "l_shipdate FROM lineitem",
)
def narrow_types(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    return columns.narrow_types(df).withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query(
    "column_tools",
    "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus AS status, o_orderpriority AS orderpriority, "
    "CAST(NULL AS DOUBLE) AS target FROM orders",
)
def column_tools(spark, folder):
    """Select, rename, sanitise, add, cast, drop repeats, drop."""
    df = table(spark, folder, "orders")
    df = columns.select_columns(df, [*columns.columns_containing(df, "order"), "o_custkey"])
    df = columns.rename(df, {"o_orderstatus": "status", "o_orderpriority": "order priority"})
    df = columns.sanitise_names(columns.add_literal(df, "target", None, "double"))
    df = columns.cast_key(columns.drop_columns(df, "o_orderdate"), "o_orderkey")
    repeated = columns.drop_repeated_columns(df.select("*", F.col("status").alias("STATUS")))
    return repeated.select(*columns.without(repeated.columns, "o_custkey"))


@query(
    "order_ratios",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0) AS price_per_discount,
           o_totalprice / nullif(l_quantity, 0) AS total_per_unit,
           o_totalprice - l_extendedprice AS rest,
           CASE WHEN l_discount = 0 THEN CASE WHEN l_tax > 0 THEN 1 END END AS infinite,
           -date_diff('day', DATE '2001-11-05', CAST(l_shipdate AS DATE)) / 365.0::DOUBLE AS years
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    """,
)
def order_ratios(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        X.ratio("l_extendedprice", "l_discount").alias("price_per_discount"),
        X.ratio("o_totalprice", "l_quantity").alias("total_per_unit"),
        X.difference("o_totalprice", "l_extendedprice").alias("rest"),
        F.when(X.ratio("l_tax", "l_discount", on_zero="ieee") == float("inf"), 1).alias("infinite"),
        X.years_before(F.datediff("l_shipdate", F.lit("2001-11-05"))).alias("years"),
    )


@query(
    "flags_and_clamps",
    """
    WITH d AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_tax, l_quantity, l_returnflag,
               CASE WHEN l_discount = 0 THEN NULL
                    ELSE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS delay
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey, delay,
           CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag_code,
           CASE WHEN delay > 0 THEN 1 ELSE 0 END AS late,
           CASE WHEN delay >= 30 THEN 1 ELSE 0 END AS late_30,
           CASE WHEN delay >= 180 THEN 1 ELSE 0 END AS late_180,
           CAST(CASE WHEN delay <= 0 THEN 0 ELSE delay END AS DOUBLE) AS days_late,
           CASE WHEN delay > 0 THEN l_quantity ELSE 0 END AS late_quantity,
           CASE WHEN delay > 0 AND l_tax > 0 THEN 1 ELSE 0 END AS late_and_taxed
    FROM d
    """,
)
def flags_and_clamps(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").withColumn(
        "delay", F.when(F.col("l_discount") != 0, F.datediff("l_shipdate", "o_orderdate"))
    )
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "delay",
        X.status_code("l_returnflag", {"A": 0, "N": 1}, 2).alias("flag_code"),
        X.above("delay").alias("late"),
        X.at_least("delay", 30).alias("late_30"),
        X.at_least("delay", 180).alias("late_180"),
        X.clamp_negative("delay").alias("days_late"),
        X.keep_where(X.above("delay"), "l_quantity").alias("late_quantity"),
        X.both_positive("delay", "l_tax").alias("late_and_taxed"),
    )


# Orders with gaps, written alike for both engines.
GAPS = {
    "priority": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END",
    "total": "CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END",
    "thousands": "CASE WHEN o_totalprice > 450000 THEN NULL ELSE floor(o_totalprice / 50000) END",
}
GAPS_SQL = "SELECT o_orderkey, o_orderstatus, " + ", ".join(f"{e} AS {c}" for c, e in GAPS.items()) + " FROM orders"


def _gaps(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", *[f"{e} AS {c}" for c, e in GAPS.items()]
    )
    return df.withColumn("thousands", F.col("thousands").cast("double"))


@query(
    "clean_nulls",
    f"SELECT o_orderkey, o_orderstatus, coalesce(priority, 'Data_Not_Available') AS priority, "
    f"coalesce(total, 0) AS total, thousands FROM ({GAPS_SQL})",
)
def clean_nulls(spark, folder):
    return clean.fill(_gaps(spark, folder), {"priority": "Data_Not_Available", "total": 0})


@query(
    "mode_fill",
    f"""
    WITH g AS ({GAPS_SQL}), m AS (
        SELECT (SELECT priority FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mp,
               (SELECT thousands FROM g WHERE thousands IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mt)
    SELECT o_orderkey, o_orderstatus, coalesce(priority, mp) AS priority, total, coalesce(thousands, mt) AS thousands
    FROM g, m
    """,
)
def mode_fill(spark, folder):
    return clean.fill_mode(_gaps(spark, folder), ["priority", "thousands"])


@query(
    "sentinel_null",
    f"""
    WITH g AS ({GAPS_SQL})
    SELECT o_orderkey, o_orderstatus, priority, nullif(total, (SELECT max(total) FROM g)) AS total,
           nullif(thousands, (SELECT max(thousands) FROM g)) AS thousands
    FROM g
    """,
)
def sentinel_null(spark, folder):
    return clean.null_sentinel(_gaps(spark, folder), ["total", "thousands"])


@query(
    "sentinel_null_frame",
    f"""
    WITH g AS ({GAPS_SQL})
    SELECT nullif(o_orderkey, (SELECT max(thousands) FROM g)) AS o_orderkey, o_orderstatus, priority,
           nullif(total, (SELECT max(thousands) FROM g)) AS total,
           nullif(thousands, (SELECT max(thousands) FROM g)) AS thousands
    FROM g
    """,
)
def sentinel_null_frame(spark, folder):
    return clean.null_sentinel(_gaps(spark, folder), "thousands", scope="frame")


@query(
    "zero_to_null",
    "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem",
)
def zero_to_null(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return clean.zero_to_null(df, ["l_discount", "l_tax"])


@query(
    "recode",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment, "
    "CASE c_nationkey WHEN 0 THEN 24 ELSE c_nationkey END AS c_nationkey FROM customer",
)
def recode(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return clean.recode(df, {"c_mktsegment": {"MACHINERY": "BUILDING"}, "c_nationkey": {0: 24}})


@query(
    "nan_to_num",
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0::DOUBLE
                WHEN l_discount = 0 THEN 1.7976931348623157e308::DOUBLE ELSE l_tax / nullif(l_discount, 0) END AS filled
    FROM lineitem
    """,
)
def nan_to_num(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", X.ratio("l_tax", "l_discount", on_zero="ieee").alias("filled")
    )
    return clean.nan_to_num(df, ["filled"])


@query(
    "null_counts",
    f"WITH g AS ({GAPS_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM g"
        for c in ["o_orderkey", "o_orderstatus", *GAPS]
    ),
)
def null_counts(spark, folder):
    return clean.null_counts(_gaps(spark, folder))


@query(
    "split_on_null",
    f"WITH g AS ({GAPS_SQL}) SELECT 'known' AS part, count(*) AS n, max(o_orderkey) AS last FROM g WHERE total IS NOT NULL "
    "UNION ALL SELECT 'unknown', count(*), max(o_orderkey) FROM g WHERE total IS NULL",
)
def split_on_null(spark, folder):
    known, unknown = clean.split_on_null(_gaps(spark, folder), "total")
    parts = known.withColumn("part", F.lit("known")).unionByName(unknown.withColumn("part", F.lit("unknown")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flags_sql(c: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in values)


@query("onehot", f"SELECT o_orderkey, {_flags_sql('o_orderpriority', PRIORITIES)} FROM orders")
def onehot(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return encode.one_hot(df)[0]


@query(
    "onehot_null",
    f"SELECT o_orderkey, {_flags_sql('o_orderstatus', ['F', 'O', 'P'])}, 0 AS o_orderstatus_nan, "
    f"{_flags_sql('priority', PRIORITIES[:4])}, CASE WHEN priority IS NULL THEN 1 ELSE 0 END AS priority_nan "
    f"FROM ({GAPS_SQL})",
)
def onehot_null(spark, folder):
    df = _gaps(spark, folder).select("o_orderkey", "o_orderstatus", "priority")
    return encode.one_hot(df, null_flag=True)[0]


@query(
    "group_median_lookup",
    """
    WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS seg
               FROM customer)
    SELECT c_custkey, seg, round(m, 6) AS median_balance, round(m / nullif(c_acctbal, 0), 6) AS median_share
    FROM c LEFT JOIN (SELECT seg, median(c_acctbal) AS m FROM c WHERE seg IS NOT NULL GROUP BY seg) USING (seg)
    """,
)
def group_median_lookup(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("seg")
    )
    medians = group_median(df, "seg", "c_acctbal", "m")
    out = join.lookup(df, "seg", medians, "median_balance")
    out = out.withColumn("median_share", X.ratio("median_balance", "c_acctbal")).drop("c_acctbal")
    return rounded(out, 6)


@query(
    "partition_stats",
    """
    SELECT o_orderkey, o_custkey, count(*) OVER w AS n_orders, max(o_totalprice) OVER w AS largest,
           kinds, count(*) OVER w / kinds AS orders_per_kind
    FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1) USING (o_custkey)
    WINDOW w AS (PARTITION BY o_custkey)
    """,
)
def partition_stats(spark, folder):
    df = attach_stats(
        table(spark, folder, "orders"),
        "o_custkey",
        {
            "n_orders": ("o_orderkey", "size"),
            "largest": ("o_totalprice", "max"),
            "kinds": ("o_orderpriority", "nunique"),
        },
    )
    df = df.withColumn("orders_per_kind", X.ratio("n_orders", "kinds"))
    return df.select("o_orderkey", "o_custkey", "n_orders", "largest", "kinds", "orders_per_kind")


@query(
    "part_payment_rejoin",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
           sum(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS quantity_together
    FROM lineitem
    """,
)
def part_payment_rejoin(spark, folder):
    df = attach_stats(
        table(spark, folder, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        {"quantity_together": ("l_quantity", "sum")},
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "quantity_together")


@query(
    "join_suffix",
    """
    SELECT c.nation, c.name AS name_x, c.balance AS balance_x, s.name AS name_y, s.balance AS balance_y
    FROM (SELECT c_nationkey AS nation, c_name AS name, c_acctbal AS balance FROM customer) c
    LEFT JOIN (SELECT CASE WHEN s_nationkey % 3 = 0 THEN -s_nationkey - 1 ELSE s_nationkey END AS nation,
               max(s_name) AS name, max(s_acctbal) AS balance FROM supplier GROUP BY 1) s USING (nation)
    """,
)
def join_suffix(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    # A third of the nations get keys that no customer has, so some customers match nothing.
    nation = F.when(F.col("s_nationkey") % 3 == 0, -F.col("s_nationkey") - 1).otherwise(F.col("s_nationkey"))
    suppliers = (
        table(spark, folder, "supplier")
        .groupBy(nation.alias("nation"))
        .agg(F.max("s_name").alias("name"), F.max("s_acctbal").alias("balance"))
    )
    return join.join_suffix(customers, suppliers, "nation", lsuffix="_x", rsuffix="_y")


@query(
    "union_missing",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)
def union_missing(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id")
    )
    return join.union_by_name(customers, suppliers)


@query(
    "overview",
    "SELECT count(*) AS n_rows, 6 AS n_columns, "
    "'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names FROM orders",
)
def overview_orders(spark, folder):
    return overview(table(spark, folder, "orders"))


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark, folder):
    """Rows of one key; the key is the newest order."""
    orders = table(spark, folder, "orders")
    return orders.filter(F.col("o_orderkey") == orders.select(F.max("o_orderkey")).scalar())
