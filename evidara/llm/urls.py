"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest (DataFrame functions and MLlib only).

URLs that a rule fits are the labelled ones; a bounded sample of the distinct ones trains the trees,
which judge every URL that no rule fits. A suffix's block rate is of the labelled URLs of other hosts
than the row's own, for rows that are learned from and rows that are judged alike, so no row's label
comes back to it as a feature.

Defined cases: a null URL or one without `://` has an empty host and path, no rule, and is judged by
its features; with labels of one class only, that class is the verdict for all; without any label
the verdict is allow. Repeated rows are judged alike, extra columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.words import ascii_lower
from .tables import cut, sampled, small

# Verdict, host, path prefix.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: At most about so many distinct labelled URLs train the trees; they are those with the smallest hashes.
MAX_TRAIN = 20_000
ROUNDS, DEPTH, BINS = 12, 4, 32
FEATURES = ["length", "host_length", "path_length", "depth", "host_dots", "hyphens", "digit_ratio", "entropy", "parameters", "suffix_share", "suffix_block_rate", "label_share", "label_block_rate"]


def located(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    fits = [((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p)) for _, h, p in RULES]
    order = sorted(range(len(RULES)), key=lambda k: -len(RULES[k][1] + RULES[k][2]))
    first = lambda value: F.coalesce(*[F.when(fits[k], F.lit(value(RULES[k]))) for k in order])
    return out.withColumns({"rule": first(lambda r: r[1] + r[2]), "rule_verdict": first(lambda r: r[0])})


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double") / n)
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))).otherwise(F.lit(0.0))


def _totals(rows: DataFrame, key: str) -> DataFrame:
    """Rows, labelled rows and blocked ones by key; one row per key after a map-side sum."""
    return small(rows.groupBy(key).agg(F.count("*").alias(f"{key}_n"), F.count("label").alias(f"{key}_labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias(f"{key}_blocked")))


def featured(rows: DataFrame) -> DataFrame:
    """The rows of located() with `label` (1 block, 0 allow, else null) and the columns in FEATURES."""
    url, labels = F.coalesce(F.col("url"), F.lit("")), F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    rows = rows.withColumns(
        {
            "label": F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0),
            "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
            "host_dots": F.size(labels) - 1,
            "hyphens": F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit(""))),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        }
    ).withColumn("top", F.lower(F.substring_index("suffix", ".", -1)))
    totals = rows.agg(F.count("*"), F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    blocked = totals[2] / totals[1] if totals[1] else 0.0
    for key in ("suffix", "top", "host"):
        rows = rows.join(_totals(rows.select(key, "label"), key), key)
    for key, name in (("suffix", "suffix"), ("top", "label")):
        others = F.col(f"{key}_labelled") - F.col("host_labelled") + 10
        rows = rows.withColumns({f"{name}_share": F.col(f"{key}_n") / F.lit(max(totals[0], 1)), f"{name}_block_rate": (F.col(f"{key}_blocked") - F.col("host_blocked") + F.lit(10 * blocked)) / others})
    return rows


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) for every row of pages(page_id, url)."""
    rows = featured(located(pages.select("page_id", "url")))
    counts = {r["label"]: r["n"] for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    final = lambda df, score: df.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
    if len(counts) < 2:
        return final(rows, F.lit(1.0 if 1 in counts else 0.0))
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    labelled = rows.where("label is not null").dropDuplicates(["url"])
    chosen = labelled.where(sampled("url", MAX_TRAIN / max(1, labelled.count())))
    train = cut(pack.transform(chosen).select("features", F.col("label").cast("double")).repartition(6))
    if train.select("label").distinct().count() < 2:
        return final(rows, F.lit(1.0 if counts[1] > counts[0] else 0.0))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, maxBins=BINS, seed=7).fit(train)
    return final(model.transform(pack.transform(rows)), vector_to_array("probability")[1])
