"""Column profiles of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import profile as P
from loomline.plans.report import profile
from loomline.queries.registry import query, rounded
from loomline.sources.tables import table

BALANCE_LABEL = "CASE WHEN c_acctbal < 500 THEN 1 ELSE 0 END"
CUSTOMER_SQL = f"SELECT *, {BALANCE_LABEL} AS label FROM customer"


def _customers(spark, folder):
    return table(spark, folder, "customer").selectExpr("*", f"{BALANCE_LABEL} AS label")


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_counts(spark, folder):
    return P.value_counts(table(spark, folder, "orders"), "o_orderpriority")


@query("distinct_values", "SELECT DISTINCT CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents")
def distinct_values(spark, folder):
    df = table(spark, folder, "documents").select(F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return P.distinct_values(df, "lang")


PROFILE_SQL = f"""
    SELECT c_nationkey, count(*) FILTER (WHERE label = 1) AS positives, count(label) AS total, avg(label) AS share
    FROM ({CUSTOMER_SQL}) GROUP BY 1
"""


@query("default_profile", PROFILE_SQL)
def default_profile(spark, folder):
    return P.default_profile(_customers(spark, folder), "c_nationkey", "label")


@query("default_profile_top", PROFILE_SQL + " ORDER BY total DESC, c_nationkey LIMIT 5")
def default_profile_top(spark, folder):
    return P.default_profile(_customers(spark, folder), "c_nationkey", "label", top=5)


@query(
    "head_and_tail",
    f"""
    WITH p AS ({PROFILE_SQL}), r AS (
        SELECT *, row_number() OVER (ORDER BY total DESC, c_nationkey) AS a,
               row_number() OVER (ORDER BY total, c_nationkey DESC) AS b FROM p)
    SELECT * EXCLUDE (a, b), 'head' AS part, a AS position FROM r WHERE a <= 5
    UNION ALL SELECT * EXCLUDE (a, b), 'tail', b FROM r WHERE b <= 5
    """,
)
def head_and_tail(spark, folder):
    prof = P.default_profile(_customers(spark, folder), "c_nationkey", "label")
    return P.head_and_tail(prof, "total", "c_nationkey")


@query(
    "argmax",
    "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 1",
)
def argmax(spark, folder):
    return P.argmax(P.value_counts(table(spark, folder, "part"), "p_brand"), "p_brand", "n")


@query(
    "class_balance",
    "SELECT quality, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM labels GROUP BY 1",
)
def class_balance(spark, folder):
    return P.class_balance(table(spark, folder, "labels"), "quality")


def _flag_sql(c: str) -> str:
    zero = f"round_even(count(*) FILTER (WHERE {c} = 0) * 100.0::DOUBLE / count(*), 2)"
    return f"SELECT '{c}' AS column_name, {zero} AS percent_0, round_even(100.0::DOUBLE - {zero}, 2) AS percent_1 FROM labels"


@query("flag_share", " UNION ALL ".join(_flag_sql(c) for c in ("quality", "toxic")))
def flag_share(spark, folder):
    return P.flag_share(table(spark, folder, "labels"), ["quality", "toxic"])


EVERY_5 = [p for p in range(0, 101, 5)]


def _grid_sql(points: list[float], value: str, by: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, CAST({p} AS DOUBLE) AS percentile, round(quantile_cont({value}, {p} / 100.0::DOUBLE), 4) AS value "
        f"FROM ({source}) WHERE {by} IS NOT NULL GROUP BY {by}"
        for p in points
    )


@query("percentile_grid", _grid_sql(EVERY_5, "cents", "o_orderstatus", "SELECT *, round(o_totalprice * 100) AS cents FROM orders"))
def percentile_grid(spark, folder):
    df = table(spark, folder, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100))
    return rounded(P.percentile_grid(df, "cents", EVERY_5, "o_orderstatus"), 4)


TOP_PERCENT = [99 + i / 10 for i in range(11)]


@query(
    "percentile_grid_top",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS percentile, round(quantile_cont(round(value * 100), {p} / 100.0::DOUBLE), 3) AS value FROM events"
        for p in TOP_PERCENT
    ),
)
def percentile_grid_top(spark, folder):
    df = table(spark, folder, "events").withColumn("cents", F.round(F.col("value") * 100))
    out = P.percentile_grid(df, "cents", TOP_PERCENT)
    return out.select(F.round("percentile", 1).alias("percentile"), F.round("value", 3).alias("value"))


def _describe_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 6) AS q1, "
        f"round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem"
    )


@query("describe", " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_linenumber")))
def describe(spark, folder):
    return rounded(P.describe(table(spark, folder, "lineitem"), ["l_quantity", "l_linenumber"]), 6)


@query(
    "global_range",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c}) / 365.0::DOUBLE AS lowest, max({c}) / 365.0::DOUBLE AS highest FROM d"
        for c in ("days", "total")
    ).join(
        [
            "WITH d AS (SELECT date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) AS days, "
            "o_totalprice AS total FROM orders) ",
            "",
        ]
    ),
)
def global_range(spark, folder):
    df = table(spark, folder, "orders").select(
        F.datediff("o_orderdate", F.lit("2001-08-02")).alias("days"), F.col("o_totalprice").alias("total")
    )
    return P.global_range(df, ["days", "total"], divisor=365.0)


HISTOGRAM_SQL = """
    WITH b AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part),
    h AS (SELECT p_type, least(floor((p_size - lo) / ((hi - lo) / 10)) + 1, 10)::INTEGER AS bin, lo, (hi - lo) / 10 AS width
          FROM part, b)
"""


@query(
    "histogram",
    HISTOGRAM_SQL + "SELECT p_type, bin, round(lo + width * (bin - 1), 6) AS bin_start, count(*) AS n FROM h GROUP BY p_type, bin, lo, width",
)
def histogram(spark, folder):
    return rounded(P.histogram(table(spark, folder, "part"), "p_size", 10, "p_type"), 6)


@query(
    "density",
    HISTOGRAM_SQL
    + "SELECT p_type, bin, round(count(*) / (sum(count(*)) OVER (PARTITION BY p_type) * width), 6) AS density FROM h GROUP BY p_type, bin, width",
)
def density(spark, folder):
    return rounded(P.density(table(spark, folder, "part"), "p_size", 10, "p_type"), 6)


GRID = [-1000.0, 0.0, 2500.0, 5000.0, 9000.0]


@query(
    "smooth_density",
    """
    WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
    h AS (SELECT c_mktsegment, lo, (hi - lo) / 50 AS width,
                 least(floor((c_acctbal - lo) / ((hi - lo) / 50)) + 1, 50) AS bin FROM customer, b),
    k AS (SELECT c_mktsegment, x, (x - (lo + width * (bin - 0.5::DOUBLE))) / 400.0::DOUBLE AS z
          FROM h, (SELECT unnest([-1000.0, 0.0, 2500.0, 5000.0, 9000.0])::DOUBLE AS x))
    SELECT c_mktsegment, x, round(1e6 * avg(exp(-z * z / 2) / (sqrt(2 * pi()) * 400.0::DOUBLE)), 4) AS per_million
    FROM k GROUP BY 1, 2
    """,
)
def smooth_density(spark, folder):
    out = P.smooth_density(table(spark, folder, "customer"), "c_acctbal", 50, 400.0, GRID, "c_mktsegment")
    return out.select("c_mktsegment", "x", F.round(F.col("density") * 1e6, 4).alias("per_million"))


@query(
    "box_summary",
    """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3
               FROM events GROUP BY 1),
    j AS (SELECT *, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
          FROM events JOIN q USING (event_type))
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
           min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
           count(*) FILTER (WHERE NOT inside) AS outliers
    FROM j GROUP BY event_type, q1, median, q3
    """,
)
def box_summary(spark, folder):
    return rounded(P.box_summary(table(spark, folder, "events"), "value", "event_type"), 6)


@query(
    "token_counts",
    """
    SELECT token, count(*) AS n
    FROM (SELECT unnest(string_split(concat_ws(',', lang, source, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END), ',')) AS token
          FROM documents) GROUP BY 1
    """,
)
def token_counts(spark, folder):
    df = table(spark, folder, "documents").select(
        F.concat_ws(",", "lang", "source", F.when(F.col("n_chars") > 500, "long").otherwise("short")).alias("tags")
    )
    return P.token_counts(df, "tags")


@query(
    "key_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def key_duplicates(spark, folder):
    return P.key_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "pair_corr",
    "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, count(*) AS n FROM lineitem GROUP BY 1",
)
def pair_corr(spark, folder):
    return rounded(P.pair_corr(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 6)


@query("range_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000")
def range_count(spark, folder):
    return P.range_count(table(spark, folder, "orders"), F.col("o_totalprice") > 300000)


@query(
    "class_means",
    f"SELECT label, count(*) AS n, avg(c_nationkey) AS mean_nation FROM ({CUSTOMER_SQL}) GROUP BY label",
)
def class_means(spark, folder):
    """Both classes in one grouping, instead of one filter per class."""
    return _customers(spark, folder).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_nationkey").alias("mean_nation")
    )


@query("pair_points", f"SELECT c_acctbal, c_nationkey, label FROM ({CUSTOMER_SQL})")
def pair_points(spark, folder):
    """The scatter extract with whole strata; smaller fractions are its sampling."""
    return P.pair_points(_customers(spark, folder), "c_acctbal", "c_nationkey", "label", {0: 1.0, 1: 1.0})


# Per part of the report: the column that names a line, and the number that is compared.
REPORT_PARTS = {
    "overview": ("'rows'", "n_rows"),
    "null_counts": ("column_name", "nulls"),
    "class_balance": ("label", "n"),
    "value_counts:c_nationkey": ("c_nationkey", "n"),
    "default_profile:c_nationkey": ("c_nationkey", "positives"),
    "flag_share": ("column_name", "percent_1"),
    "global_range": ("column_name", "highest"),
    "box_summary:c_acctbal": ("label", "median"),
    "token_counts:c_mktsegment": ("token", "n"),
}
REPORT_COLUMNS = ["c_nationkey", "c_acctbal", "c_mktsegment", "label"]
_REPORT_SQL = {
    "overview": "SELECT 'rows' AS item, count(*) AS number FROM c",
    "null_counts": " UNION ALL ".join(f"SELECT '{c}' AS item, count(*) - count({c}) AS number FROM c" for c in REPORT_COLUMNS),
    "class_balance": "SELECT label AS item, count(*) AS number FROM c GROUP BY 1",
    "value_counts:c_nationkey": "SELECT c_nationkey AS item, count(*) AS number FROM c GROUP BY 1",
    "default_profile:c_nationkey": "SELECT c_nationkey AS item, sum(label) AS number FROM c GROUP BY 1",
    "flag_share": "SELECT 'label' AS item, 100.0::DOUBLE - round_even(count(*) FILTER (WHERE label = 0) * 100.0::DOUBLE / count(*), 2) AS number FROM c",
    "global_range": "SELECT 'c_acctbal' AS item, max(c_acctbal) AS number FROM c",
    "box_summary:c_acctbal": "SELECT label AS item, quantile_cont(c_acctbal, 0.5) AS number FROM c GROUP BY 1",
    "token_counts:c_mktsegment": "SELECT c_mktsegment AS item, count(*) AS number FROM c GROUP BY 1",
}


@query(
    "profile_report",
    f"WITH c AS (SELECT {', '.join(REPORT_COLUMNS)} FROM ({CUSTOMER_SQL})) "
    + " UNION ALL ".join(
        f"SELECT '{part}' AS part, CAST(item AS VARCHAR) AS item, round(CAST(number AS DOUBLE), 2) AS number FROM ({sql})"
        for part, sql in _REPORT_SQL.items()
    ),
)
def profile_report(spark, folder):
    """The report's tables, one number of each line; every kind is compared in full by its own query."""
    spec = {"categories": ["c_nationkey"], "flags": ["label"], "measures": ["c_acctbal"], "tokens": ["c_mktsegment"]}
    report = profile(_customers(spark, folder).select(*REPORT_COLUMNS), "label", spec)
    out = None
    for part, (item, number) in REPORT_PARTS.items():
        lines = report[part].selectExpr(f"'{part}' AS part", f"CAST({item} AS STRING) AS item", f"round(CAST({number} AS DOUBLE), 2) AS number")
        out = lines if out is None else out.unionByName(lines)
    return out
