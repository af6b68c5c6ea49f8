"""Rules triggered by facts, and the verdict they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dealt


def in_band(value: Column) -> Column:
    """Whether the half-open band [lo, hi) holds the value; null bounds are open."""
    return (F.col("lo").isNull() | (value >= F.col("lo"))) & (F.col("hi").isNull() | (value < F.col("hi")))


def triggered(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts(case_id, impairment, value, ...) joined with the rules(rule_id, impairment, lo, hi, action, debit_pct) whose band holds the value."""
    return facts.join(rules.withColumnRenamed("impairment", "of"), (F.col("impairment") == F.col("of")) & in_band(F.col("value"))).drop("of")


def verdicts(cases: DataFrame, hits: DataFrame, unverified: DataFrame | None = None) -> DataFrame:
    """case_id, verdict, loading_pct, rule_ids. Refer beats decline beats loaded beats standard.

    refer: no rule was retrieved, a deciding fact is unverified, or rules of one impairment conflict;
    hits(case_id, impairment, rule_id, action, debit_pct, triggered). Sums are by case and impairment
    first; hits that are dealt out by case stay where they are, and the cases come to them.
    """
    fired = F.col("triggered")
    by = hits.groupBy("case_id", "impairment").agg(
        F.max(F.when(fired & (F.col("action") == "decline"), 1).otherwise(0)).alias("decline"),
        F.size(F.collect_set(F.when(fired, F.col("action")))).alias("actions"),
        F.sum(F.when(fired & (F.col("action") == "debit"), F.col("debit_pct")).otherwise(0)).alias("debit"),
        F.array_sort(F.collect_set(F.when(fired, F.col("rule_id")))).alias("rules"),
    )
    case = by.groupBy("case_id").agg(
        F.max("decline").alias("decline"),
        F.max("actions").alias("actions"),
        F.sum("debit").alias("debit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rule_ids"),
    )
    out = cases.select("case_id").join(case, "case_id", "left")
    doubt = F.lit(False)
    if unverified is not None:
        out = out.join(unverified.select("case_id").distinct().withColumn("unverified", F.lit(True)), "case_id", "left")
        doubt = F.coalesce("unverified", doubt)
    verdict = F.when(F.col("actions").isNull() | (F.col("actions") > 1) | doubt, "refer").when(F.col("decline") == 1, "decline").when(F.col("debit") > 0, "loaded").otherwise("standard")
    return out.select("case_id", verdict.alias("verdict"), F.when(verdict == "loaded", F.col("debit")).otherwise(F.lit(0)).cast("long").alias("loading_pct"), F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"))


def classifier_scores(pages: DataFrame) -> DataFrame:
    """contender, pages, accuracy, calibration (share correct among pages of at least 90% agreement), queue_rate over pages(contender, agree, runs, medical, expected)."""
    right, sure = (F.col("medical") == F.col("expected")).cast("int"), 10 * F.col("agree") >= 9 * F.col("runs")
    return pages.groupBy("contender").agg(
        F.count("*").alias("pages"),
        F.round(F.avg(right), 6).alias("accuracy"),
        F.round(F.avg(F.when(sure, right)), 6).alias("calibration"),
        F.round(F.avg(F.when(sure, 0.0).otherwise(1.0)), 6).alias("queue_rate"),
    )


def accuracy(suggested: DataFrame, expected: DataFrame, contender: list[str]) -> DataFrame:
    """contender, cases, right, accuracy: how often suggested(contender, case_id, verdict) is expected(case_id, verdict); a case without a suggestion is wrong, a suggestion for no case counts nothing.

    Cases meet the suggestions there are, not every contender; how many cases there are is one row.
    """
    cases = expected.agg(F.count("*").alias("cases"))
    known = dealt(expected.select("case_id", F.col("verdict").alias("expected_"), F.lit(True).alias("is_case_")), "case_id")
    joined = suggested.select(*contender, "case_id", "verdict").join(known, "case_id", "left")
    hit = (F.col("is_case_") & F.col("verdict").eqNullSafe(F.col("expected_"))).cast("int")
    right = joined.groupBy(*contender).agg(F.sum(F.coalesce(hit, F.lit(0))).alias("right"))
    return right.join(F.broadcast(cases)).select(*contender, "cases", "right", F.round(F.try_divide("right", "cases"), 6).alias("accuracy"))


def winner(scores: DataFrame, metric: str, contender: str = "contender") -> DataFrame:
    """scores with `winner`, true for the contender with the best metric (ties: the smallest name)."""
    best = scores.agg(F.min_by(contender, F.struct(-F.col(metric), F.col(contender))).alias("best"))
    return scores.join(F.broadcast(best)).select("*", (F.col(contender) == F.col("best")).alias("winner")).drop("best")
