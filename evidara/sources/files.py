"""File sources and sinks. Everything is read by Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import differences


def _leaves(tree: object, path: list[str], positions: list[int]) -> Iterator[dict]:
    """The leaves of a parsed file as operators.trees has them."""
    if isinstance(tree, dict) and tree:
        for k, v in tree.items():
            yield from _leaves(v, [*path, k], positions)
    elif isinstance(tree, list) and tree:
        for i, v in enumerate(tree):
            yield from _leaves(v, [*path, str(i)], [*positions, len(path) + 1])
    else:
        kind = next((name for t, name in KINDS if isinstance(tree, t)), "other")
        value = None if kind in ("table", "array") else str(tree).lower() if kind == "boolean" else str(tree)
        yield {"path": path, "positions": positions, "kind": kind, "value": value}


#: Python's types of parsed values; bool is an int, too, so it comes first.
KINDS = ((bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), (dict, "table"), (list, "array"))
LEAF = "path: array<string>, positions: array<int>, kind: string, value: string"


def _text(spark: SparkSession, path: str, required: bool) -> DataFrame | None:
    try:
        return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def toml_leaves(spark: SparkSession, paths: list[str], required: int = 1) -> DataFrame:
    """layer, path, positions, kind, value of TOML files, later paths being higher layers; a path may be a folder of many files, each parsed where Spark reads it.

    The first `required` paths must be there, others may be missing; bad syntax is an error. Empty tables and arrays have a row without value, an empty file has none.
    """

    @F.pandas_udf(f"array<struct<{LEAF}>>")
    def parsed(content: pd.Series) -> pd.Series:
        return content.map(lambda text: [leaf for leaf in _leaves(tomllib.loads(text), [], []) if leaf["path"]])

    read = [(layer, _text(spark, path, layer < required)) for layer, path in enumerate(paths)]
    layers = [rows.select(F.lit(layer).alias("layer"), F.inline(parsed("value"))) for layer, rows in read if rows is not None]
    return reduce(DataFrame.union, layers, spark.createDataFrame([], "layer int, " + LEAF.replace(":", "")))


def markdown_sources(spark: SparkSession, folder: str, skip: str = "SKILL.md", required: str = "workflow.md") -> DataFrame:
    """name (below the folder), content of every *.md at any depth but files called `skip`, in order of name; without `required` it is an error."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    full = F.col("_metadata.file_path")
    name = F.substring_index(full, folder.rstrip("/").rpartition("/")[2] + "/", -1)
    found = read.select(name.alias("name"), F.col("value").alias("content")).where(F.substring_index("name", "/", -1) != skip)
    if required and found.where(F.col("name") == required).isEmpty():
        raise ValueError(f"{folder} has no {required}")
    return found.orderBy("name")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalogue with a header and doubled quotes; all columns are strings."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def log_parts(text: Column) -> Column:
    """struct(meta, body) of a log: its header between exact `---` lines as a map, cut at each line's first colon, and the rest; unfenced logs are an error."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "---").cast("int")
    fenced = (F.element_at(lines, 1) == "---") & (end > 0)
    head = F.filter(F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":")))
    meta = F.map_from_entries(F.transform(head, lambda x: F.struct(F.trim(F.get(F.split(x, ":", 2), 0)).alias("key"), F.trim(F.get(F.split(x, ":", 2), 1)).alias("value"))))
    body = F.array_join(F.slice(lines, end + 2, F.size(lines)), "\n")
    return F.when(fenced, F.struct(meta.alias("meta"), body.alias("body"))).otherwise(F.raise_error(F.lit("the log's header is not fenced by --- lines")))


def log_entries(body: Column) -> Column:
    """Array of the body's entries in order: struct(kind, by, text) of lines that begin with `- `."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.startswith(x, F.lit("- ")))
    tag = lambda x: F.regexp_extract(x, r"^- \(([^)]*)\) ", 1)
    part = lambda x, pattern: F.nullif(F.regexp_extract(tag(x), pattern, 1), F.lit(""))
    return F.transform(lines, lambda x: F.struct(part(x, r"^(?!by )(.*?)(?: by .*)?$").alias("kind"), part(x, r"(?:^| )by (.*)$").alias("by"), F.regexp_replace(x, r"^- (\([^)]*\) )?", "").alias("text")))


def append(df: DataFrame, path: str) -> None:
    """The only way rows get into an audit table."""
    df.write.mode("append").parquet(path)


def publish(df: DataFrame, folder: str, name: str, digest: str) -> str:
    """Write a content-addressed snapshot once; the path ends in the digest's first 20 characters. One that is there must hold the same rows, else it is an error."""
    path = f"{folder.rstrip('/')}/{name}-{digest[:20]}"
    df.write.mode("ignore").parquet(path)
    there = df.sparkSession.read.parquet(path)
    if there.columns != df.columns or not differences(there, df).isEmpty():
        raise ValueError(f"{path} holds other rows")
    return path


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Ledger tables as CSV folders with headers, by name."""
    for name, df in tables.items():
        df.write.csv(f"{folder.rstrip('/')}/{name}", header=True, quote='"', escape='"')


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, indented by two blanks, non-ASCII letters as they are."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def acknowledgement(path: Column, entries: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("ok"), path.alias("memlog"), entries.alias("entries")))


def documents_from_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, content of uploaded files; page texts come from a service outside. Files of no bytes give no row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content", F.col("modificationTime").alias("uploaded_at"))
