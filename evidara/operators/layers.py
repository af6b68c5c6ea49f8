"""Layered configuration and keyed arrays as flat rows; manifests and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .trees import lay_over, merge_layers  # noqa: F401  the merge of whole layers is there


def at_path(merged: DataFrame, path: list[str]) -> DataFrame:
    """Dotted-path projection: the leaves at or below a path; a missing path has no row."""
    return merged.where(F.slice("path", 1, len(path)) == F.array(*[F.lit(p) for p in path]))


def by_short_key(merged: DataFrame, group: list[str]) -> DataFrame:
    """group, key, paths, value: each leaf's last path element; value is null where several paths end in it."""
    return merged.groupBy(*group, F.element_at("path", -1).alias("key")).agg(F.count("*").alias("paths"), F.when(F.count("*") == 1, F.min("value")).alias("value"))


def short_values(merged: DataFrame, group: list[str], wanted: DataFrame) -> DataFrame:
    """group, key, path, value for wanted(group, key): the one leaf whose path ends in the key. A key that no leaf has is an error, and so is one that several have, which names them; leaves within arrays don't count."""
    leaves = merged.where(F.size("positions") == 0) if "positions" in merged.columns else merged
    found = leaves.select(*group, F.element_at("path", -1).alias("key"), F.struct(F.array_join("path", ".").alias("path"), "value").alias("leaf"))
    by = found.groupBy(*group, "key").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    joined = wanted.select(*group, "key").join(by, [*group, "key"], "left")
    stop = lambda *c: F.raise_error(F.concat(*c)).cast("struct<path: string, value: string>")
    places = F.array_join(F.transform("leaves", lambda x: x["path"]), ", ")
    one = F.when(F.col("leaves").isNull(), stop(F.lit("missing config value `"), "key", F.lit("`"))).when(F.size("leaves") > 1, stop(F.lit("ambiguous config value `"), "key", F.lit("` found at: "), places)).otherwise(F.get("leaves", 0))
    return joined.withColumn("one_", one).select(*group, "key", "one_.path", "one_.value")


def array_key(code: Column, ident: Column) -> Column:
    """What identifies the items of one array: 'code' if all have one, else 'id' if all have one, else null. Empty identifiers are an error."""
    whole = lambda c: F.bool_and(c.isNotNull())
    name = F.when(whole(code), F.lit("code")).when(whole(ident), F.lit("id"))
    bad = F.bool_or(F.when(code.isNotNull(), code == "").otherwise(ident == ""))
    return F.when(name.isNotNull() & bad, F.raise_error(F.lit("empty identifier in a keyed array"))).otherwise(name)


def merge_keyed(base: DataFrame, override: DataFrame, key: str, pos: str, body: list[str]) -> DataFrame:
    """Keyed array merge: key, pos, body. An override replaces the last base item of its key whole and in place; new keys follow the base in their own order.

    Where an item of either side has a null key the array has none, and the override follows the base, repeats kept.
    """
    rows = lambda df, over: df.select(F.col(key).alias("key"), F.col(pos).cast("long").alias("ord"), F.lit(over).alias("over"), F.struct(*body).alias("body"))
    both = rows(base, False).union(rows(override, True))
    # one row
    info = both.agg(F.bool_and(F.col("key").isNotNull()).alias("whole"), (F.coalesce(F.max(F.when(~F.col("over"), F.col("ord"))), F.lit(-1)) + 1).alias("n"))
    merged = lay_over(both.join(F.broadcast(info)), [], F.when(F.col("whole"), F.col("key")), F.col("n"))
    return merged.select(F.col("key").alias(key), F.col("ord").alias(pos), *[F.col("body")[c].alias(c) for c in body])


def append_arrays(base: DataFrame, override: DataFrame) -> DataFrame:
    """Un-keyed arrays: all items of both, repeats kept."""
    return base.unionByName(override)


def verify_manifest(expected: DataFrame, found: DataFrame, name: str, digest: str) -> DataFrame:
    """name, status (changed, missing, extra) where two file sets differ; no row means equal."""
    both = expected.select(name, F.col(digest).alias("e")).join(found.select(name, F.col(digest).alias("f")), name, "full").where(~F.col("e").eqNullSafe(F.col("f")))
    return both.select(name, F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("changed").alias("status"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, repeats counted, with `side`; no row means that both hold the same."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def duplicate_ids(items: DataFrame, group: list[str], key: str) -> DataFrame:
    return items.groupBy(*group, key).agg(F.count("*").alias("n")).where("n > 1")


def current_ids(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """rows with `key` replaced by its alias's target(key, target), itself where it has none."""
    return rows.join(aliases.select(key, "target"), key, "left").withColumn(key, F.coalesce("target", key)).drop("target")


def first_by_trust(candidates: DataFrame, group: list[str], root: str, priority: str) -> DataFrame:
    return candidates.groupBy(*group).agg(F.min_by(root, priority).alias(root))


def masked_overrides(candidates: DataFrame, group: list[str], priority: str, has_override: str) -> DataFrame:
    """Groups whose first root in trust order has no override while a later one has."""
    return candidates.groupBy(*group).agg(F.min_by(has_override, priority).alias("first_"), F.bool_or(has_override).alias("any_")).where("any_ and not first_").select(*group)


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, node, depth: all pairs that edges(parent, node) connect, with the shortest depth.

    Reach doubles each round: a shortest path of length 2^k to 2^(k+1) begins with one of length 2^k, and
    what follows is a shorter path that is known. So rounds grow with the logarithm of the longest
    shortest path, and a round joins only the pairs exactly 2^k apart with the nearer ones. Cycles end as
    their pairs are found. Each round is written down in the shared folder; rows with a null end are no edges.
    """
    edges = edges.select(F.col("parent").alias("ancestor"), "node").where("ancestor is not null and node is not null").distinct()
    near = span = cut(edges.withColumn("depth", F.lit(1)))
    reach = 1
    while not span.isEmpty():
        first = span.select("ancestor", F.col("node").alias("via"))
        onward = near.select(F.col("ancestor").alias("via"), "node", (F.col("depth") + reach).alias("depth"))
        further = first.join(onward, "via").groupBy("ancestor", "node").agg(F.min("depth").alias("depth"))
        found = cut(further.join(near, ["ancestor", "node"], "left_anti"))
        near, reach = near.union(found), reach * 2
        span = found.where(F.col("depth") == reach)
    return near


def undeclared(references: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """References to what nobody declares; no row means that all are declared."""
    return references.join(declared, key, "left_anti")


def counts(items: DataFrame, group: str) -> DataFrame:
    return items.groupBy(group).agg(F.count("*").alias("items"))


def catalogue_order(rows: DataFrame, module: str, phase: str, ordinal: str) -> DataFrame:
    """By module and phase, blank phases first; within a group the order of the source."""
    return rows.orderBy(F.col(module), F.col(phase).asc_nulls_first(), F.col(ordinal))


def running_total(rows: DataFrame, group: list[str], order: str, amount: str) -> DataFrame:
    """rows with `total`, the sum up to and with each row of the group; meant for aggregates (days of a month, years)."""
    return rows.withColumn("total", F.sum(amount).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
