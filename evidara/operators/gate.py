"""Votes to majority label, agreement and route; human decisions over routed pages."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dealt

EXTRACT, ASK, TRIAGE, REMOVED = "extract", "ask_customer", "triage", "removed"


def vote_confidence(votes: DataFrame, page: list[str], label: str) -> DataFrame:
    """page, label, agree, runs: the most frequent label (ties: the smallest), its votes, and all votes.

    Votes are dealt out by page to as many tasks as they need; a page of very many votes is a row a label in its task.
    Null labels are no votes.
    """
    counted = dealt(votes.select(*page, label), *page).where(F.col(label).isNotNull()).groupBy(*page, label).agg(F.count("*").alias("n"))
    return counted.groupBy(*page).agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"),
        F.max("n").alias("agree"),
        F.sum("n").alias("runs"),
    )


class Classifier(Protocol):
    """page, label, agree, runs for pages; every contender has this shape."""

    def __call__(self, pages: DataFrame) -> DataFrame: ...


def voted(page: list[str], label: str) -> Classifier:
    """The classifier that takes a page's votes in one column and gives the majority."""
    return lambda votes: vote_confidence(votes, page, label)


def contenders(pages: DataFrame, classifiers: dict[str, Classifier]) -> DataFrame:
    """contender and what each classifier gives for the same pages."""
    each = [classify(pages).withColumn("contender", F.lit(name)) for name, classify in classifiers.items()]
    return reduce(DataFrame.unionByName, each)


def route(agree: Column, runs: Column, medical: Column) -> Column:
    """Three-way gate, total. The 90% cut is inclusive and exact in integers; unknown values go to triage."""
    sure = 10 * agree >= 9 * runs
    return F.when(sure & medical, EXTRACT).when(sure & ~medical, ASK).otherwise(TRIAGE)


def latest_decision(decisions: DataFrame, page: list[str], action: str, order: list[str]) -> DataFrame:
    """The last decision of each page by `order`."""
    return decisions.groupBy(*page).agg(F.max_by(action, F.struct(*order)).alias("decision"))


def outcome(routed: Column, decision: Column) -> Column:
    """Where a page goes once people have decided: discard and deny remove it, keep sends it to triage, accept to extraction; undecided pages wait where they are."""
    return (
        F.when(routed == EXTRACT, EXTRACT)
        .when((routed == ASK) & (decision == "discard"), REMOVED)
        .when((routed == ASK) & (decision == "keep"), TRIAGE)
        .when((routed == TRIAGE) & (decision == "accept"), EXTRACT)
        .when((routed == TRIAGE) & (decision == "deny"), REMOVED)
        .otherwise(routed)
    )


def triage_queue(pages: DataFrame) -> DataFrame:
    """What the reviewers see: pages routed to triage, with type, confidence and reason."""
    return pages.where(F.col("route") == TRIAGE).select("page_id", "label", "agree", "runs", F.format_string("%d of %d runs agree", "agree", "runs").alias("reason"))


def customer_prompt(label: Column, agree: Column, runs: Column) -> Column:
    percent = F.floor(100 * agree / runs).cast("int")
    return F.format_string("This looks like a %s (%d%%). Do you want to keep it?", label, percent)
