"""Written tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, as in tests, a new one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomline-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later steps start from files that outlive executors."""
    path = f"{shared_folder(df.sparkSession)}/loomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_blocks(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts fill: partitions follow the bytes, not the cores."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def in_blocks(docs: DataFrame, keys: list[str], columns: list, blocks: int, block: str = "block") -> DataFrame:
    """``columns`` next to a block number hashed from ``keys``, shuffled so that a block lies in one partition."""
    number = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(blocks)).cast("int")
    return docs.select(number.alias(block), *columns).repartition(blocks, block)
