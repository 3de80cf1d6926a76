"""Folders that the driver and all executors share, and tables kept in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="ledgerspark-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for heavy work on each: a scan has as many tasks as the bytes fill, however much the rows cost."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written to a shared folder and read again: lineage ends, and numbers given by a scan stay as they are."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
