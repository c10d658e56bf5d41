"""The folder that driver and executors share, for states that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Set here only where it is unset and there is one machine; on a cluster without it, raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")  # one machine
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{tag}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in as many parts as there is room for: a small table may lie in one piece and still be much work."""
    return df.repartition(*keys)


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written in the shared folder and read back: its plan ends here, and lost executors cost no state."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
