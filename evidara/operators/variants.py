"""Values of unknown shape as VARIANT: dotted paths, and the predicates that settings must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def _path(parts: list[str]) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)


def field(value: Column, *parts: str) -> Column:
    """What lies at a path of a variant, as a variant; null where there is nothing."""
    return F.try_variant_get(value, _path(list(parts)), "variant")


def at_paths(rows: DataFrame, key: list[str], value: str, paths: list[str]) -> DataFrame:
    """key, path, json for each dotted path that the variant has; a missing path has no row, one that holds null has."""
    each = F.array(*[F.struct(F.lit(p).alias("path"), field(F.col(value), *p.split(".")).alias("found")) for p in paths])
    return rows.select(*key, F.inline(F.filter(each, lambda x: x["found"].isNotNull()))).select(*key, "path", F.to_json("found").alias("json"))


def _kind(value: Column) -> Column:
    """The type of a variant in words."""
    schema = F.schema_of_variant(value)
    return F.when(value.isNull(), "nothing").when(schema.startswith("OBJECT"), "table").when(schema.startswith("ARRAY"), "list").otherwise(F.lower(schema))


def _stop(*message: Column | str, kind: str) -> Column:
    return F.raise_error(F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])).cast(kind)


def string(value: Column, label: Column | str, allow_empty: bool = False) -> Column:
    """The variant's string; another type is an error, and so is a blank one unless allowed."""
    plain = F.try_variant_get(value, "$", "string")
    typed = F.when(value.isNull() | (_kind(value) != "string"), _stop(label, " must be a string, got ", _kind(value), kind="string"))
    return (typed if allow_empty else typed.when(text.stripped(plain) == "", _stop(label, " must not be empty", kind="string"))).otherwise(plain)


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def string_list(value: Column, label: str) -> Column:
    """The variant as a list of strings that are not blank; anything else is an error that names the place."""
    item = lambda x, k: string(x, F.concat(F.lit(f"{label}["), k.cast("string"), F.lit("]")))
    return F.when(value.isNull() | (_kind(value) != "list"), _stop(label, " must be a list, got ", _kind(value), kind="array<string>")).otherwise(F.transform(_items(value), item))


LAYER = "struct<id: string, name: string, instruction: string, when: string>"


def layer_tables(value: Column, label: str) -> Column:
    """The variant as a list of tables: id (which must not repeat), name (the id where there is none), instruction (may be blank) and, if given, when.

    A value that is no list, an item that is no table, and a field that is missing, of another type or blank where it must not be are errors that name the place.
    """
    kind = f"array<{LAYER}>"

    def table(x: Column, k: Column) -> Column:
        place = F.concat(F.lit(f"{label}["), k.cast("string"), F.lit("]"))
        at = lambda name: F.concat(place, F.lit(f".{name}"))
        ident = string(field(x, "id"), at("id"))
        name = F.when(field(x, "name").isNull(), ident).otherwise(string(field(x, "name"), at("name")))
        when = F.when(field(x, "when").isNotNull(), string(field(x, "when"), at("when")))
        made = F.struct(ident.alias("id"), name.alias("name"), string(field(x, "instruction"), at("instruction"), allow_empty=True).alias("instruction"), when.alias("when"))
        return F.when(x.isNull() | (_kind(x) != "table"), _stop(place, " must be a table", kind=LAYER)).otherwise(made)

    made = F.transform(_items(value), table)
    ids = F.transform(made, lambda x: x["id"])
    twice = F.element_at(F.filter(ids, lambda i: F.size(F.filter(ids, lambda j: i == j)) > 1), 1)
    checked = F.when(F.size(F.array_distinct(ids)) < F.size(ids), _stop("duplicate layer id `", twice, "`", kind=kind)).otherwise(made)
    return F.when(value.isNull() | (_kind(value) != "list"), _stop(label, " must be a list of tables", kind=kind)).otherwise(checked)
