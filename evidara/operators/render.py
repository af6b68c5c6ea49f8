"""Templates: tokens, their values, review layers, and the one pass that fills them in."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

KINDS = ("config", "short", "workflow")


def found_tokens(sources: DataFrame, prefix: str = "") -> DataFrame:
    """name, kind, key for every token of sources(name, content), repeats kept."""
    named = lambda k: lambda t: F.struct(F.lit(k).alias("kind"), t.alias("key"))
    each = [F.transform(text.tokens(F.col("content"), k, prefix), named(k)) for k in (*KINDS, "snapshot")]
    return sources.select("name", F.inline(F.concat(*each)))


def undeclared_snapshots(sources: DataFrame, prefix: str = "") -> DataFrame:
    """name, key of snapshot tokens whose target is not one of the sources."""
    wanted = found_tokens(sources, prefix).where("kind = 'snapshot'").select("name", "key")
    return wanted.join(sources.select(F.col("name").alias("key")), "key", "left_anti").select("name", "key")


def looked_up(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """tokens(kind, key, ...) with their value of values(kind, key, value); a token without a value is an error."""
    missing = F.raise_error(F.concat(F.lit("missing value of "), F.col("kind"), F.lit(" "), F.col("key"))).cast("string")
    return tokens.join(values.select("kind", "key", "value"), ["kind", "key"], "left").withColumn("value", F.coalesce("value", missing))


def non_empty(value: Column, label: str) -> Column:
    """The string; null and blank ones are an error."""
    return F.when(text.stripped(value) != "", value).otherwise(F.raise_error(F.lit(f"{label} must not be empty")))


def string_list(json: Column, label: str) -> Column:
    """A JSON text as a list of non-empty strings; anything else is an error."""
    items = F.from_json(json, "array<string>")
    whole = F.schema_of_variant(F.try_parse_json(json)).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(items, lambda x: text.stripped(x) != "")
    return F.when(whole, items).otherwise(F.raise_error(F.lit(f"{label} must be a list of strings")))


def review_layers(groups: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """key, text for every key of groups: the sections of its active layers(key, pos, id, name, when, instruction) in order, or the halt text.

    A layer with a blank instruction is not active; ids that repeat within a key are an error, and so is a condition that is given and blank.
    """
    when = F.when(F.col("when").isNotNull(), non_empty(F.col("when"), "when"))
    section = text.section(F.col("id"), F.col("name"), when, F.col("instruction"))
    active = F.when(text.stripped(F.col("instruction")) != "", F.struct("pos", section.alias("section")))
    by = layers.groupBy(key).agg(F.array_sort(F.collect_list(active)).alias("sections"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    joined = F.when(F.col("n") > F.col("ids"), F.raise_error(F.lit("a review layer's id repeats")).cast("string")).otherwise(F.array_join(F.transform("sections", lambda x: x["section"]), "\n\n"))
    out = groups.select(key).distinct().join(by.select(key, joined.alias("text")), key, "left")
    return out.select(key, F.coalesce(F.nullif("text", F.lit("")), F.lit(text.NO_LAYERS)).alias("text"))


def rendered(sources: DataFrame, values: DataFrame, destination: str, prefix: str = "") -> DataFrame:
    """name, content of sources(name, content) with every token filled in at once from values(kind, key, value).

    Inserted text is never scanned. A snapshot token becomes the target's path below the destination.
    A token without a value, and a snapshot of an undeclared source, are errors. The values of one
    source's tokens travel as a map of its own tokens, so no source meets the whole configuration.
    """
    forms = {"config": ("{{config.", "}}"), "short": ("{{.", "}}"), "workflow": ("{workflow.", "}")}
    spell = reduce(lambda c, k: c.when(F.col("kind") == k, F.concat(F.lit(forms[k][0]), F.col("key"), F.lit(forms[k][1]))), KINDS, F.when(F.lit(False), F.lit("")))
    found = found_tokens(sources, prefix).where("kind <> 'snapshot'").distinct()
    filled = looked_up(found, values).withColumn("token", spell).withColumn("value", text.skill_path(F.col("token"), F.col("value"), destination))
    maps = filled.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("values"))
    bad = undeclared_snapshots(sources, prefix).groupBy("name").agg(F.min("key").alias("bad"))
    plain = lambda p: re.sub(r"(?<!\\)\((?!\?)", "(?:", p)  # noqa: E731  no groups
    pattern = "|".join(plain(text.grammar(k, prefix)) for k in (*KINDS, "snapshot"))
    target = lambda t: F.concat(F.lit(destination.rstrip("/") + "/"), F.regexp_extract(t, text.grammar("snapshot", prefix), 1))
    value = lambda t: F.when(F.startswith(t, F.lit("[[")), target(t)).otherwise(F.try_element_at("values", t))
    joined = sources.join(maps, "name", "left").join(bad, "name", "left")
    stop = F.raise_error(F.concat(F.lit("snapshot of an undeclared source: "), F.col("bad"))).cast("string")
    return joined.select("name", F.when(F.col("bad").isNotNull(), stop).otherwise(text.substitute_found(F.col("content"), pattern, value)).alias("content"))
