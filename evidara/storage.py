"""The shared folder: cutting lineage, and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine where that is unset a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one task where rows are dealt out by key.
ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by its keys to as many tasks as its rows need; what then groups or joins by these keys is done in place.

    Spark's own number of partitions is fixed, and adaptive execution merges them by compressed bytes, which
    repeated values make small: a task's groups and sorts would grow with the table.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(parts, *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
