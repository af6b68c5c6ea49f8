"""Trees of tables, arrays and scalars as rows, one a leaf: layered merge, and canonical JSON.

A leaf has its path (table keys and array positions as strings), `positions` (which path parts, from 1,
are array positions), `kind` (string, integer, float, boolean, other; table or array where it is an
empty one) and its value as a string. Leaves without positions and kind are strings below tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: What identifies the items of an array of tables, in order of choice.
IDENTIFIERS = ("code", "id")


def _complete(leaves: DataFrame, group: list[str]) -> DataFrame:
    """g (the group, nulls equal), layer, path, positions, kind, value."""
    positions = F.coalesce("positions", F.array().cast("array<int>")) if "positions" in leaves.columns else F.array().cast("array<int>")
    kind = F.col("kind") if "kind" in leaves.columns else F.lit("string")
    return leaves.select(F.struct(*group, F.lit(0).alias("_")).alias("g"), "layer", "path", positions.alias("positions"), kind.alias("kind"), "value")


def _above(path: str, least: int = 1) -> Column:
    """The proper prefixes of a path of at least so many parts, as rows."""
    n = F.sequence(F.lit(least), F.size(path) - 1)
    return F.explode(F.when(F.size(path) > least, F.transform(n, lambda k: F.slice(path, F.lit(1), k))))


def _live(rows: DataFrame) -> DataFrame:
    """Rows (g, layer, node, shape, ...) that no later layer replaces.

    Tables merge with tables and arrays with arrays; whatever else a later layer has at a node, or at a node
    above it, takes its place with all that is below. All of it is equi-joins on nodes and the nodes above.
    """
    at = rows.select("g", "layer", "node", "shape").distinct()
    seen = at.union(at.select("g", "layer", _above("node").alias("node"), F.lit("table").alias("shape")))
    last = lambda s: F.max(F.when(F.col("shape") == s, F.col("layer")))
    marks = cut(seen.groupBy("g", "node").agg(last("scalar").alias("s_"), last("array").alias("a_"), last("table").alias("t_")))
    layer = F.col("layer")
    later = lambda *c: F.coalesce(reduce(lambda x, y: x | y, [F.coalesce(F.col(k) > layer, F.lit(False)) for k in c]), F.lit(False))
    gone = F.when(F.col("shape") == "scalar", later("s_", "a_", "t_")).when(F.col("shape") == "array", later("s_", "t_")).otherwise(later("s_", "a_"))
    own = at.join(marks, ["g", "node"]).where(~gone).select("g", "layer", "node")
    closed = marks.select("g", F.col("node").alias("above"), F.greatest("s_", "a_").alias("closed")).where("closed is not null")
    hidden = own.select("g", "layer", "node", _above("node").alias("above")).join(closed, ["g", "above"]).where("closed > layer").select("g", "layer", "node").distinct()
    return rows.join(own.join(hidden, ["g", "layer", "node"], "left_anti"), ["g", "layer", "node"])


def lay_over(both: DataFrame, at: list[str], key: Column, n: Column) -> DataFrame:
    """both(*at, ord, over, ...) with the order of the merged array: base items, and override items (over) laid over them.

    Where key is null everything of the override follows the base, whose positions are below n. Where it is not,
    an override replaces the last base item of its key in place, further keys follow the base in their order,
    and of overrides with one key the last counts, at the place of the first.
    """
    both = both.withColumn("key_", key).withColumn("n_", n)
    loose = both.where("key_ is null").withColumn("ord", F.when(F.col("over"), F.col("ord") + F.col("n_")).otherwise(F.col("ord")))
    same = Window.partitionBy(*at, "key_")
    of = lambda f, over: f(F.when(F.col("over") == F.lit(over), F.col("ord"))).over(same)
    marked = both.where("key_ is not null").withColumns({"base_": of(F.max, False), "first_": of(F.min, True), "last_": of(F.max, True)})
    kept = marked.where(F.when(F.col("over"), F.col("ord") == F.col("last_")).otherwise(F.col("last_").isNull() | (F.col("ord") < F.col("base_"))))
    keyed = kept.withColumn("ord", F.when(F.col("over"), F.coalesce("base_", F.col("n_") + F.col("first_"))).otherwise(F.col("ord"))).drop("base_", "first_", "last_")
    return loose.unionByName(keyed).drop("key_", "n_")


def _identified(f: Callable[[str], Column], otherwise: Column) -> Column:
    """f of the first identifier that all items of a group of tables have."""
    whole = lambda c: F.bool_and(F.col("is_table") & F.col(f"has_{c}"))
    return reduce(lambda w, c: w.when(whole(c), f(c)), IDENTIFIERS[1:], F.when(whole(IDENTIFIERS[0]), f(IDENTIFIERS[0]))).otherwise(otherwise)


def _merged_items(items: DataFrame, arrays: DataFrame) -> DataFrame:
    """g, node, layer, pos, ord of the items that are left, laid layer over layer; arrays(g, node, layer) are the arrays there are."""
    node = ["g", "node"]
    # as many layers as there are files
    layers = [r["layer"] for r in arrays.select("layer").distinct().orderBy("layer").collect()]
    first = cut(arrays.groupBy(*node).agg(F.min("layer").alias("first")))
    items = cut(items.withColumn("ord", F.col("pos").cast("long")))
    current = items.where(F.lit(False))
    for layer in layers:
        new = items.where(F.col("layer") == layer)
        if layer != layers[0]:
            meeting = arrays.where(F.col("layer") == layer).join(first.where(F.col("first") < layer), node).select(*node).withColumn("meets", F.lit(True))
            both = current.withColumn("over", F.lit(False)).unionByName(new.withColumn("over", F.lit(True))).join(meeting, node, "left")
            name, bad = _identified(F.lit, F.lit(None).cast("string")), _identified(lambda c: F.bool_or(f"bad_{c}"), F.lit(False))
            info = both.where("meets").groupBy(*node).agg(name.alias("by"), bad.alias("bad"), (F.coalesce(F.max(F.when(~F.col("over"), F.col("ord"))), F.lit(-1)) + 1).alias("n"))
            error = F.raise_error(F.concat(F.lit("an identifier in a keyed array must be a string and not empty: "), F.array_join("node", "."))).cast("string")
            info = info.select(*node, "n", F.when(F.col("bad"), error).otherwise(F.col("by")).alias("by"))
            joined = both.join(info, node, "left")
            key = F.coalesce(*[F.when(F.col("by") == c, F.col(c)) for c in IDENTIFIERS])
            current = cut(lay_over(joined, node, key, F.coalesce("n", F.lit(0))).select(*items.columns))
        else:
            current = new
    return current.select("g", "node", "layer", "pos", "ord")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`, their place (from 0) within the group in the order; no group is in one task, rows are dealt by ranges and ranges lifted by those before."""
    dealt = cut(rows.repartitionByRange(*group, *order).withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy(*group, "range_").agg(F.count("*").alias("m_"))
    before = Window.partitionBy(*group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    lifted = sizes.withColumn("before_", F.coalesce(F.sum("m_").over(before), F.lit(0))).drop("m_")
    within = F.row_number().over(Window.partitionBy(*group, "range_").orderBy(*order)) - 1
    return dealt.withColumn("within_", within).join(lifted, [*group, "range_"]).withColumn(name, F.col("within_") + F.col("before_")).drop("within_", "before_", "range_")


def merge_layers(leaves: DataFrame, group: list[str]) -> DataFrame:
    """group, path, positions, kind, value of leaves(group, layer, path, value, and positions and kind if there are) after every layer is laid over the ones before.

    Tables merge key by key. Two arrays of tables whose items all have a string `code`, else all an `id`, merge by
    it: an item of the later layer replaces the last one of its identifier whole and in place, or follows at
    the end. Other arrays follow one another. Anything else is replaced by the later layer.

    Defined cases: an identifier that is empty or no string is an error where two arrays meet; an array or table
    without content keeps its row if nothing is merged into it; a null group is a group; of leaves of one layer
    with the same path any one may count; no rows give no rows. Arrays inside an array's item are part of the item and don't merge.
    """
    rows = _complete(leaves, group)
    item = F.try_element_at("positions", F.lit(1))
    node = F.when(item.isNull(), F.col("path")).otherwise(F.slice("path", F.lit(1), item - 1))
    shape = F.when(item.isNotNull() | (F.col("kind") == "array"), "array").when(F.col("kind") == "table", "table").otherwise("scalar")
    live = cut(_live(rows.withColumns({"item": item, "node": node, "shape": shape})))
    out = ["g", "path", "positions", "kind", "value"]
    scalars = live.where("shape = 'scalar'").groupBy("g", "path").agg(F.max_by(F.struct("positions", "kind", "value"), "layer").alias("v")).select("g", "path", "v.*")
    # arrays: which items are left, in what order, and their leaves under their new positions
    within = live.where("item is not null").withColumn("pos", F.element_at("path", F.col("item")).cast("int"))
    items = within.groupBy("g", "node", "layer", "pos").agg(*[c.alias(k) for k, c in _item_flags().items()])
    arrays = cut(live.where("shape = 'array'").select("g", "node", "layer").distinct())
    placed = numbered(_merged_items(items, arrays), ["g", "node"], ["ord", "layer", "pos"], "place").drop("ord")
    moved = within.join(placed, ["g", "node", "layer", "pos"]).withColumn("path", F.concat("node", F.array(F.col("place").cast("string")), F.slice("path", F.col("item") + 1, F.size("path"))))
    full = scalars.select(out).union(moved.select(out))
    # what is empty in all layers
    empty = live.where("item is null and kind in ('table', 'array')").select("g", "path", "positions", "kind", "value").dropDuplicates(["g", "path"])
    above = full.select("g", _above("path").alias("path")).union(empty.select("g", _above("path").alias("path"))).distinct()
    merged = full.union(empty.join(above, ["g", "path"], "left_anti").select(out))
    return merged.select(*[F.col("g")[c].alias(c) for c in group], *([*out[1:]] if "kind" in leaves.columns else ["path", "value"]))


def _item_flags() -> dict[str, Column]:
    """What one array item has of the identifiers: aggregates over its leaves (path, positions, kind, value, item)."""
    n = F.col("item")
    key, deeper = F.get("path", n), ~F.array_contains("positions", n + 1)
    plain = F.coalesce((F.size("path") == n + 1) & (F.col("kind") == "string") & (F.col("value") != ""), F.lit(False))
    out = {"is_table": F.bool_and(F.when(F.size("path") == n, F.col("kind") == "table").otherwise(deeper))}
    for c in IDENTIFIERS:
        here = F.coalesce((key == c) & deeper, F.lit(False))
        out |= {f"has_{c}": F.bool_or(here), f"bad_{c}": F.bool_or(here & ~plain), c: F.max(F.when(here & plain, F.col("value")))}
    return out


# How JSON writes what no string may hold as it is.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(value: Column) -> Column:
    """A string as JSON, letters of any script as they are."""
    rest = {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in ESCAPES}
    replaced = lambda c, table: reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(table[k])), table, c)
    plain = replaced(value, ESCAPES)
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), replaced(plain, rest)).otherwise(plain), F.lit('"'))


def _json_leaf() -> Column:
    value, kind = F.col("value"), F.col("kind")
    special = F.when(value.endswith("nan"), "NaN").when(value == "-inf", "-Infinity").when(value.isin("inf", "+inf"), "Infinity").otherwise(value)
    stop = F.raise_error(F.concat(F.lit("no JSON for a value of kind "), kind, F.lit(" at "), F.array_join("path", "."))).cast("string")
    return (
        F.when(kind == "string", json_string(value)).when(kind.isin("integer", "boolean"), value).when(kind == "float", special)
        .when(kind == "table", "{}").when(kind == "array", "[]").otherwise(stop)
    )


def canonical_json(leaves: DataFrame, group: list[str]) -> DataFrame:
    """group, json: the tree of each group's leaves(group, path, positions, kind, value) with sorted keys and no blanks.

    Built from the deepest level up: each round joins the texts of one level's siblings into their parent's,
    so there are as many rounds as levels, and siblings meet as the one text that they become.
    """
    rows = _complete(leaves.withColumn("layer", F.lit(0)), group)
    rows = cut(rows.select("g", "path", "positions", _json_leaf().alias("json")))
    depth = rows.agg(F.max(F.size("path"))).first()[0] or 0
    while depth:
        deepest = F.size("path") == depth
        item = F.array_contains("positions", depth)
        last = F.element_at("path", -1)
        member = F.struct(F.when(item, last.cast("long")).alias("place"), last.alias("key"), "json")
        members = rows.where(deepest).select("g", F.slice("path", 1, depth - 1).alias("path"), F.filter("positions", lambda p: p < depth).alias("positions"), item.alias("item"), member.alias("m"))
        by = members.groupBy("g", "path", "positions", "item").agg(F.array_sort(F.collect_list("m")).alias("ms"))
        table = F.concat(F.lit("{"), F.array_join(F.transform("ms", lambda m: F.concat(json_string(m["key"]), F.lit(":"), m["json"])), ","), F.lit("}"))
        array = F.concat(F.lit("["), F.array_join(F.transform("ms", lambda m: m["json"]), ","), F.lit("]"))
        parents = by.select("g", "path", "positions", F.when(F.col("item"), array).otherwise(table).alias("json"))
        rows = cut(rows.where(~deepest).union(parents))
        depth -= 1
    return rows.select(*[F.col("g")[c].alias(c) for c in group], "json")
