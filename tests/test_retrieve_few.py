"""Few queries against many rules: they are carried to the rules, which changes nothing; many queries still meet cells and shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import retrieve

from . import test_retrieve
from .test_retrieve import bag, plain_vectors, plain_words


def test_many_queries_meet_the_cells_of_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "FEW", 0)
    test_retrieve.test_vectors_equal_plain_python(spark, monkeypatch, 0)


def test_many_queries_meet_the_shards_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "FEW", 0)
    monkeypatch.setattr(retrieve, "HELD", 300)
    test_retrieve.test_words_equal_plain_python(spark, monkeypatch, 0)


@pytest.mark.parametrize("held", [1, 500, retrieve.HELD])
def test_few_queries_equal_plain_python_however_little_is_held(spark, monkeypatch, held):
    for name, value in (("SMALL", 0), ("HELD", held), ("TEXTS", 3)):
        monkeypatch.setattr(retrieve, name, value)
    text = lambda k: " ".join(f"w{k * d % 7}" for d in range(1, 2 + k % 9))
    rules = [(k, text(k)) for k in range(90)] + [(None, "w1 w2"), (200, None), (201, ""), (3, "w5 w5 W5\tw0")]
    queries = [(k, text(k + 3)) for k in range(12)] + [(None, "w1"), (50, None), (51, " "), (52, "nowhere"), (53, "W5 É w6 w5")]
    x = spark.createDataFrame(rules, "rule_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert bag(retrieve.keyword_top_k(q, x, 4)) == plain_words(queries, rules, 4)
    none = spark.createDataFrame([(1, "nowhere"), (2, None)], "query_id long, text string")
    assert retrieve.keyword_top_k(none, x, 4).count() == 0
    r = np.random.default_rng(4)
    rules, queries = ([(k, r.integers(-2, 3, 3).astype(float).tolist()) for k in range(n)] for n in (120, 9))
    x, q = spark.createDataFrame(rules, "rule_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>")
    assert bag(retrieve.vector_top_k(q, x, 5)) == plain_vectors(queries, rules, 5)


def test_few_queries_build_no_index_of_all_words_and_move_no_rules(spark, monkeypatch, tmp_path):
    """Only words asked for are kept of the rules, and neither rules nor queries are shuffled to meet."""
    monkeypatch.setattr(retrieve, "SMALL", 0)
    kept, cut = [], retrieve.cut
    monkeypatch.setattr(retrieve, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rules = spark.range(400).select(F.col("id").alias("rule_id"), F.concat(F.lit("common other "), F.col("id")).alias("text"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    q = spark.createDataFrame([(7, "common 9", [1.0, 3.0])], "query_id long, text string, embedding array<double>")
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (retrieve.keyword_top_k(q, rules, 3), retrieve.vector_top_k(q, rules, 3))]
    assert all("CoGroup" not in p and "Join" not in p and p.count("Exchange") == 1 for p in plans)
    assert len(kept) == 1 and kept[0].agg(F.sum(F.size("terms"))).first()[0] == 401


def test_a_task_holds_few_shards_however_many_there_are(spark, monkeypatch):
    """Spark's own number of partitions is 8, which would put 50 of 400 shards into each."""
    monkeypatch.setattr(retrieve, "SHARD", 100)
    rules = spark.range(4_000).select(F.col("id").alias("rule_id"), F.lpad(F.col("id").cast("string"), 10, "x").alias("text"))
    of = retrieve._index(rules, 40_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in of) == 400
    assert max(r["count"] for r in of) <= 12


def test_best_keeps_what_a_full_sort_keeps():
    r = np.random.default_rng(9)
    for k, n in ((1, 1), (3, 2), (5, 400), (4, 4)):
        best, seen, names = retrieve.Best(np.arange(6), k), np.zeros((6, 0)), np.zeros(0, np.int64)
        for _ in range(5):
            score, rule = np.where(r.random((6, n)) < 0.3, -np.inf, r.integers(0, 9, (6, n)) / 8), r.permutation(10_000)[:n]
            best.add(np.arange(6), score, rule)
            seen, names = np.concatenate([seen, score], 1), np.concatenate([names, rule])
        for i in range(6):
            want = sorted((-s, j) for s, j in zip(seen[i].tolist(), names.tolist(), strict=True) if s > -np.inf)[:k]
            got = [(-s, j) for s, j in zip(best.score[i].tolist(), best.rule[i].tolist(), strict=True) if s > -np.inf]
            assert got == want
