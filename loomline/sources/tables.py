"""Reading and writing: tables, models, scores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.clean import nan_to_null


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV scan. Columns are matched to the header by name; NaN becomes NULL.

    The file may hold its columns in any order and may have more than the schema.
    """
    header = spark.read.option("header", True).csv(path).columns
    wanted = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(c, wanted.get(c, T.StringType())) for c in header])
    missing = [c for c in wanted if c not in header]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    read = spark.read.schema(full).option("header", True).option("mode", "FAILFAST").csv(path)
    return nan_to_null(read.select(*[f.name for f in schema]))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def overview(df: DataFrame) -> DataFrame:
    """One row: how many rows and columns, and the column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("column_names")
    )


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def materialise(df: DataFrame, path: str, mode: str = "ignore") -> DataFrame:
    """Write once, read from then on: later steps start from the files, not the lineage."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only when Spark itself runs on this machine and the
    setting is absent.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="loomline-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for narrow frames that are read whole."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Parquet in the shared folder, for wide frames: later steps read only the columns they need."""
    return materialise(df, f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """A table of ``buckets`` files, each sorted by ``key``: joins and rollups on the key then move and sort nothing.

    It is written to the warehouse, or to ``path`` in a shared folder. Tables that are to be joined have equal
    ``buckets``. One file holds a bucket, so the scan may tell its order; Spark asks for
    ``spark.sql.legacy.bucketedTableScan.outputOrdering`` to be true for that (see :mod:`loomline.session`).
    """
    name = name or f"loomline_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def rows_for_key(spark: SparkSession, path: str, key: str, value: int) -> DataFrame:
    """The rows of one key: a typed literal that reaches the parquet scan as a pushed filter."""
    df = spark.read.parquet(path)
    return df.filter(F.col(key) == F.lit(value).cast(df.schema[key].dataType))


def write_scores_csv(df: DataFrame, id_col: str, score: str, path: str) -> None:
    df.select(F.col(id_col).cast("int").alias(id_col), score).write.mode("overwrite").csv(path, header=True)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_threshold(df: DataFrame, path: str) -> None:
    """A one-row table holding the chosen threshold."""
    df.select("threshold").write.mode("overwrite").parquet(path)


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
