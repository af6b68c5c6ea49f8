"""Reads that check the caller: a view over what the session's caller owns, in which the rest looks as if it did not exist.

The caller is a session variable. Who can set it or read the table beneath can read all: the view keeps
queries honest, a boundary against their authors needs a catalogue that enforces it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt

CALLER = "evidara_caller"
FOUND, NOT_FOUND = 200, 404


def set_caller(spark: SparkSession, caller: str | None) -> None:
    """From now on the session's reads are the caller's; none owns nothing. Frames that are there already keep the caller of their time."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {CALLER} STRING DEFAULT NULL")
    if caller is not None:
        spark.sql(f"SET VARIABLE {CALLER} = :caller", args={"caller": caller})


def owned_view(rows: DataFrame, name: str, owner: str) -> None:
    """A temporary view of the rows whose owner is the caller at the time of the read; rows without an owner are in nobody's."""
    rows.createOrReplaceTempView(f"{name}_all")
    if not _has_caller(rows.sparkSession):
        set_caller(rows.sparkSession, None)
    rows.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {name}_all WHERE CAST({owner} AS STRING) = {CALLER}")


def _has_caller(spark: SparkSession) -> bool:
    try:
        spark.sql(f"SELECT {CALLER}")
    except AnalysisException:
        return False
    return True


def answers(requests: DataFrame, view: str, key: str) -> DataFrame:
    """requests(key) with status and the record's columns: what the caller does not own and what is not there get the same answer."""
    rows = requests.sparkSession.table(view)
    found = rows.withColumn("status", F.lit(FOUND))
    return dealt(requests.select(key), key).join(found, key, "left").withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))
