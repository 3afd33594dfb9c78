"""Session settings this library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Everything relies on AQE: runtime broadcast of small rollups, coalescing of
# small partitions, and splitting of skewed ones in the attach-a-statistic joins.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Files of bucketed tables hold one bucket each here, so their order is the bucket's.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "loomline", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the cluster's own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
