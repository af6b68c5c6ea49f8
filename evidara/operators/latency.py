"""Latencies as mergeable quantile sketches, of which each has a bounded size however many hits it has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of a sketch: a quantile's rank is within about 1.7 / K ** 0.9 (0.7 % at 400), and exact up to K values.
K = 400


def sketched(hits: DataFrame, group: list[str], value: str, k: int = K) -> DataFrame:
    """group, sketch, n for each group of hits; null values are left out, a group of none has a null sketch and n 0."""
    some = F.count(value)
    return hits.groupBy(*group).agg(F.when(some > 0, F.kll_sketch_agg_double(F.col(value).cast("double"), k)).alias("sketch"), some.alias("n"))


def merged(sketches: DataFrame, group: list[str]) -> DataFrame:
    """group, sketch, n of coarser groups from sketched parts; the parts' hits are not read again."""
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """sketches with a column for each name: the value below which that share of the hits lies, null for a group of none."""
    return sketches.withColumns({name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share))) for name, share in shares.items()})
