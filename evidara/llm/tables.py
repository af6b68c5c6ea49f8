"""Reading input tables and cutting lineage; every operator module goes through these."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reread(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows that a task works on at once; a batch that Spark sends has up to twenty times as many.
ROWS = 500


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ROWS at once, so that what is made of them is small and can go on before the rest is done."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and the other columns of right, where the keys are equal or both null."""
    other = {k: f"{k}__right" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in other.items()])
    return left.join(right.withColumnsRenamed(other), on, how).drop(*other.values())


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with `name`, the exact sum of the long `value` over the rows of the group up to and with each row.

    Rows are dealt out by ranges of the order (which must begin with the group and tell rows apart
    well), summed within a partition, and lifted by the totals of earlier partitions, of which there
    is one row for each partition and group.
    """
    dealt = cut(df.withColumn("value_", value).repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    totals = dealt.groupBy("part_", *group).agg(F.sum("value_").alias("total_"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    lifted = totals.withColumn("before_", F.coalesce(F.sum("total_").over(before), F.lit(0))).drop("total_")
    within = Window.partitionBy("part_", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("within_", F.sum("value_").over(within))
    return null_safe_join(summed, lifted, ["part_", *group]).select(*df.columns, (F.col("within_") + F.col("before_")).alias(name))


#: Bytes of a table that may be broadcast.
SMALL = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """df, written down, with a broadcast hint if its size, which is measured, allows it."""
    df = cut(df)
    width = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    size = df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, width) + 32), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= SMALL else df


def sampled(key: str, share: float) -> Column:
    """About that share of the rows by a hash of the key, however small the share is."""
    return F.xxhash64(F.lit(7), key) <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * 2.0**64)))


#: Bits of one row that Spark's bitmap functions give.
BUCKET_BITS = 15


def bit_table(bits: DataFrame, size: int) -> bytes | None:
    """A table of 2^size bits in which those of bits(bit) are set; None without rows. Its size does not depend on how many there are."""
    bit = (F.col("bit") + 1).alias("bit")  # Spark numbers buckets from 1
    rows = bits.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    table = np.zeros((1 << size - BUCKET_BITS, 1 << BUCKET_BITS - 3), np.uint8)
    for r in rows:
        table[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return table.tobytes() if rows else None


def may_hold(table: bytes | None, bit: np.ndarray) -> np.ndarray:
    """Which bits are set in the table."""
    if table is None:
        return np.zeros(len(bit), bool)
    bit = bit.astype(np.int64)
    return (np.frombuffer(table, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
