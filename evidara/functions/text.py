"""Text expressions of templates, logs, slugs and manifests."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token forms of a template, but for the snapshot's prefix.
TOKENS = {
    "config": r"\{\{config\.([A-Za-z0-9_.-]+)\}\}",
    "short": r"\{\{\.([A-Za-z0-9_]+)\}\}",
    "workflow": r"\{workflow\.([A-Za-z0-9_.-]+)\}",
    "snapshot": r"\[\[snapshot:([A-Za-z0-9_./-]+\.md)\]\]",
}


def grammar(kind: str, prefix: str = "") -> str:
    """The pattern of one token form; a snapshot's name may have a prefix and a hyphen before it."""
    return TOKENS[kind].replace("snapshot:", f"{re.escape(prefix)}-snapshot:" if prefix else "snapshot:")


def tokens(content: Column, kind: str, prefix: str = "") -> Column:
    """Names of the tokens of one kind, in order, repeats kept."""
    return F.regexp_extract_all(content, F.lit(grammar(kind, prefix)), F.lit(1))


def substitute_found(content: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """content with every match of the pattern (without groups) replaced by its value at once; inserted text is never looked at again."""
    between, found = F.split(content, pattern, -1), F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    return F.concat(F.element_at(between, 1), F.array_join(F.zip_with(F.slice(between, F.lit(2), F.size(found)), F.transform(found, value), lambda b, v: F.concat(v, b)), ""))


def substitute(content: Column, values: dict[str, str]) -> Column:
    """content with every key replaced by its value at once. The text is cut into keys and what lies between them, each piece is mapped, and the pieces are joined."""
    keys = sorted(values, key=lambda k: (-len(k), k))
    if not keys:
        return content
    # longer keys come first, so they are tried first
    value = lambda k: reduce(lambda c, x: F.when(k == x, F.lit(values[x])).otherwise(c), keys, k)
    return substitute_found(content, "|".join(re.escape(k) for k in keys), value)


def one_line(text: Column) -> Column:
    """White space of any kind collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slug(text: Column, longest: int = 80, default: str = "project") -> Column:
    """Lower-case ASCII letters and digits joined by hyphens."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(plain, F.lit(longest)), "-+$", ""), F.lit("")), F.lit(default))


def digest(text: Column, length: int = 64) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def canonical_json(pairs: Column) -> Column:
    """A string map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


#: Where lines end, as Python's splitlines has it.
LINE_END = r"(?:\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}])"


def bullets(items: Column) -> Column:
    """An array as a Markdown list, continuation lines indented; empty and null: _None._"""
    item = lambda x: F.regexp_replace(F.regexp_replace(x, LINE_END + r"\z", ""), LINE_END, "\n  ")
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), item(x))), "\n")
    return F.coalesce(F.nullif(lines, F.lit("")), F.lit("_None._"))


# What a review layer's section looks like, and the text that stands where no layer is active.
ONLY_WHEN = "Run only when: "
NO_LAYERS = "No active review layers. HALT with blocking condition `no active review layers`."


def section(ident: Column, name: Column, when: Column, instruction: Column) -> Column:
    """A review layer's section; the line with the condition is left out where that is null or blank, a missing name is the id."""
    head = F.concat(F.lit("#### "), F.coalesce(name, ident), F.lit(" (`"), ident, F.lit("`)"))
    only = F.when(stripped(when) != "", F.concat(F.lit(ONLY_WHEN), when))
    return F.concat_ws("\n\n", head, only, stripped(instruction))


def tagged(kind: Column, by: Column, text: Column) -> Column:
    """A log entry `- (kind by who) text`, the tag left out where both are null."""
    who = F.when(by.isNotNull(), F.concat(F.lit("by "), by))
    tag = F.nullif(F.concat_ws(" ", kind, who), F.lit(""))
    return F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("("), tag, F.lit(") ")), F.lit("")), one_line(text))


def key_value(text: Column, separator: str) -> Column:
    """struct(key, value), cut at the first separator."""
    parts = F.split(text, re.escape(separator), 2)
    return F.struct(F.trim(F.get(parts, 0)).alias("key"), F.trim(F.get(parts, 1)).alias("value"))


def header_value(text: Column) -> Column:
    """Line breaks neutralised."""
    return F.regexp_replace(text, r"\R", " ")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def with_key(pairs: Column, key: str, value: Column) -> Column:
    """The map with one key set."""
    return F.map_concat(F.map_filter(pairs, lambda k, _: k != key), F.create_map(F.lit(key), value))


def touched(meta: Column, ts: Column) -> Column:
    """The header with the time in `updated`, as its last key."""
    return with_key(meta, "updated", stamp(ts))


def root_path(text: Column, root: str) -> Column:
    """{project-root} filled in; a result that is not absolute is null."""
    path = F.replace(text, F.lit("{project-root}"), F.lit(root))
    return F.when(F.startswith(path, F.lit("/")), path)


def skill_path(token: Column, value: Column, root: str) -> Column:
    """{skill-root} filled in, in the values of workflow tokens only."""
    return F.when(F.startswith(token, F.lit("{workflow.")), F.replace(value, F.lit("{skill-root}"), F.lit(root))).otherwise(value)


def complete_tags(tags: Column, required: list[str]) -> Column:
    """All required tags are there, and keys and values are lower-case."""
    missing = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(tags))) == 0
    return missing & F.forall(F.map_entries(tags), lambda e: (F.lower(e["key"]) == e["key"]) & (F.lower(e["value"]) == e["value"]))


def resource_name(parts: list[Column], hyphens: bool = True) -> Column:
    return F.concat_ws("-" if hyphens else "", *parts)


def findings(text: Column, schema: str) -> Column:
    """A JSON array of findings as an array of structs; bad syntax is null."""
    return F.from_json(text, f"array<struct<{schema}>>")


def money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)")
