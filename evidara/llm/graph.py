"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


#: Edges that one partition takes; small edge tables stay in few files.
PACK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component), component the smallest id reachable from node.

    Every round links each node's larger neighbours to its smallest one and then its smaller ones
    likewise, which halves path lengths, so rounds grow with the logarithm of the longest path. A
    round is two groupings with map-side minima: a node with very many neighbours costs no more
    than its edges. No round makes more edges than the first table has, so that one's count says how
    many partitions the rounds need. Self loops and repeated edges are ignored; no edges give no rows.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    parts = max(8, -(-edges.count() // PACK))
    unlike = lambda df: df.where("a <> b").coalesce(parts).distinct().coalesce(parts)
    edges = edges.coalesce(parts)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour points to the smallest of the neighbourhood
        large = cut(unlike(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        # small star: the smaller neighbours of a node point to its smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = cut(unlike(large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))))
        if small.groupBy("a").count().where("count > 1").isEmpty() and small.select("b").join(small.select("a"), F.col("a") == F.col("b"), "left_semi").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = small
