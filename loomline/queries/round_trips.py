"""What is written and read again: CSV tables, parquet, scores, thresholds and models."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from loomline.operators import evaluate as E
from loomline.operators import learn as L
from loomline.queries.cell_queries import BASE_SQL, KEY, cells
from loomline.queries.derived import cte, frame
from loomline.queries.model_queries import SCORED_SQL, scored
from loomline.queries.registry import ORACLES, query, rounded
from loomline.sources import tables as S
from loomline.sources.schemas import schema_of


def _new_path(spark) -> str:
    """A new place in the shared folder."""
    return f"{S.checkpoint_folder(spark)}/round-trip-{uuid.uuid4().hex}"


@query("csv_round_trip", f"WITH {cte('bureau')} SELECT * FROM bureau")
def csv_round_trip(spark, folder):
    path = _new_path(spark)
    frame(spark, folder, "bureau").write.csv(path, header=True)
    return S.scan_csv(spark, path, schema_of("bureau"))


@query("parquet_round_trip", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def parquet_round_trip(spark, folder):
    return S.written(S.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag"))


@query("key_rows", "SELECT * FROM orders WHERE o_custkey = 7")
def key_rows(spark, folder):
    return S.rows_for_key(spark, os.path.join(folder, "orders.parquet"), "o_custkey", 7)


@query("scores_csv", f"SELECT CAST(id AS INTEGER) AS id, score FROM ({SCORED_SQL})")
def scores_csv(spark, folder):
    path = _new_path(spark)
    S.write_scores_csv(scored(spark, folder), "id", "score", path)
    return spark.read.csv(path, header=True, schema="id int, score double")


@query(
    "saved_scores",
    f"SELECT id, score, CASE WHEN score > threshold THEN 1 ELSE 0 END AS predicted FROM ({SCORED_SQL}), ({ORACLES['threshold_youden']})",
)
def saved_scores(spark, folder):
    """Scores and the best threshold are saved by one program and joined up by another."""
    scores, threshold = _new_path(spark), _new_path(spark)
    df = scored(spark, folder)
    S.save_scores(df.select("id", "score"), scores)
    S.save_threshold(E.best_threshold(df, "label", "score", "youden"), threshold)
    cut = S.load_scores(spark, threshold).select("threshold").scalar()
    return S.load_scores(spark, scores).withColumn("predicted", F.when(F.col("score") > cut, 1).otherwise(0))


@query(
    "saved_model",
    f"""
    WITH {BASE_SQL}, shares AS (SELECT urgent, large, avg(label) AS share FROM base GROUP BY 1, 2)
    SELECT o_orderkey, round(share, 9) AS score FROM base JOIN shares USING (urgent, large)
    """,
)
def saved_model(spark, folder):
    path, df = _new_path(spark), cells(spark, folder)
    S.save_model(L.fit("forest", df, ["urgent", "large"], "label", numTrees=1, bootstrap=False, maxDepth=2, seed=42), path)
    return rounded(L.score(S.load_model(path), df).select(KEY, "score"), 9, "score")
