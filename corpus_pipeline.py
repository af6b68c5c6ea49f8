"""A training corpus from raw documents: five operators in turn, each over all that the one before it kept.

Defined cases: rows with null or empty text are scored like any other, stay in both dedups and are of
size 0 in the mix; of rows that repeat, one stays after near_dedup; a null doc_id never takes a row away
in near_dedup; extra columns of documents go through all stages but the last; an empty table gives no
rows at every stage, and so does a stage that the one before it left without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidara.llm import decontaminate, linededup, mixing, neardup, quality
from evidara.llm.tables import reread, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below quality.THRESHOLD) go; with labels of one class only all or none stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else is left; n_chars stays that of the whole document."""
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, of the document with the smallest doc_id; exact repeats are copies too."""
    return neardup.kept(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of the documents that the mix takes at least once."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can express neither the classifier nor the sketches; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = reread(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
