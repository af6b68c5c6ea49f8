"""Exact retrieval: cells and shards that are skipped change nothing, whichever side is carried."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import retrieve


def clustered(r, n, clusters=20, dim=12):
    centre = r.normal(size=(clusters, dim))
    return (centre[r.integers(clusters, size=n)] + 0.12 * r.normal(size=(n, dim))).astype(float)


def plain_vectors(queries, rules, k):
    out = Counter()
    ok = lambda v: bool(v) and None not in v and np.isfinite(v).all() and any(v)
    for i, q in queries:
        if i is None or not ok(q):
            continue
        hits = []
        for j, v in rules:
            if j is not None and j != i and ok(v) and len(v) == len(q):
                a, b = np.array(q, float), np.array(v, float)
                hits.append((-round(float(a / np.sqrt((a * a).sum()) @ (b / np.sqrt((b * b).sum()))), 6), j))
        for s, j in sorted(hits)[:k]:
            out[i, j, -s] += 1
    return out


def bag(df):
    return Counter((r["query_id"], r["rule_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("small", [retrieve.SMALL, 0])
def test_vectors_equal_plain_python(spark, monkeypatch, small):
    monkeypatch.setattr(retrieve, "SMALL", small)
    monkeypatch.setattr(retrieve, "TILE", 20)
    monkeypatch.setattr(retrieve, "SAMPLE", 60)
    monkeypatch.setattr(retrieve, "PIVOTS", 9)
    r = np.random.default_rng(6)
    rules = [(k, v.tolist()) for k, v in enumerate(clustered(r, 180))] + [(1000 + k, v.tolist()) for k, v in enumerate(r.normal(size=(15, 3)))]
    rules += [(None, rules[0][1]), (900, None), (901, [0.0] * 12), (902, [1.0, None] * 6), (903, [float("nan")] * 12), (904, []), (905, rules[3][1]), (906, rules[3][1]), (907, [1.0] * 5)]
    queries = [(k, v.tolist()) for k, v in enumerate(clustered(r, 50))] + [(500, rules[182][1]), (None, rules[1][1]), (501, None), (502, [0.0] * 12), (503, rules[3][1]), (905, rules[3][1]), (504, [1.0] * 5), (505, [1.0] * 7)]
    q, x = spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(rules, "rule_id long, embedding array<double>")
    got = retrieve.vector_top_k(q, x, 4)
    assert bag(got) == plain_vectors(queries, rules, 4)
    assert {r["rank"] for r in got.collect()} == {1, 2, 3, 4}
    assert retrieve.vector_top_k(q.limit(0), x, 4).count() == retrieve.vector_top_k(q, x.limit(0), 4).count() == 0


def test_cells_skip_most_products_of_clustered_vectors(spark):
    r = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, q = unit(clustered(r, 6_000, clusters=60)), unit(clustered(r, 500, clusters=60))
    q = unit(x[r.integers(len(x), size=500)] + 0.02 * r.normal(size=q.shape))
    import pyarrow as pa

    carried = retrieve.Carried(pa.table({"id": np.arange(len(x)), "dim": np.full(len(x), 12), "x": [v.tobytes() for v in x]}))
    best = carried.top(-1 - np.arange(len(q)), q, 5, 6)
    whole = np.round(q @ x.T, 6)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), whole.shape), -whole), axis=1)[:, :5]
    assert (best.rule == want).all()
    assert carried.products < 0.2 * len(q) * len(x)


def plain_words(queries, rules, k):
    cut = lambda t: [w for w in (t or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    docs = [(j, cut(t), t is not None) for j, t in rules]
    n, size, whole = len(docs), sum(len(d) for _, d, _ in docs), sum(ok for _, _, ok in docs)
    mean = size / whole if size else 1.0
    df = Counter(w for _, d, _ in docs for w in set(d))
    out = Counter()
    for i, t in queries:
        if i is None:
            continue
        hits = []
        for j, d, _ in docs:
            tf = Counter(d)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in sorted(set(cut(t))) if tf[w])
            if j is not None and round(s, 6) > 0:
                hits.append((-round(s, 6), j))
        for s, j in sorted(hits)[:k]:
            out[i, j, -s] += 1
    return out


@pytest.mark.parametrize("small", [retrieve.SMALL, 0])
def test_words_equal_plain_python(spark, monkeypatch, small):
    monkeypatch.setattr(retrieve, "SMALL", small)
    monkeypatch.setattr(retrieve, "SHARD", 900)
    monkeypatch.setattr(retrieve, "MET", 7)
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rules = [(k, text(r.randint(1, 40))) for k in range(200)] + [(None, text(20)), (300, None), (301, ""), (302, " \n\t"), (303, "Rare W1 word"), (304, "rare w1 WORD")]
    queries = [(k, text(r.randint(1, 8))) for k in range(60)] + [(None, "w1"), (100, None), (101, ""), (102, "nowhere"), (103, "RARE rare word"), (104, "w1 w2 w3 w4")]
    q, x = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(rules, "rule_id long, text string")
    assert bag(retrieve.keyword_top_k(q, x, 3)) == plain_words(queries, rules, 3)
    assert retrieve.keyword_top_k(q.limit(0), x, 3).count() == retrieve.keyword_top_k(q, x.limit(0), 3).count() == 0


def test_queries_are_not_collected_and_rules_scanned_once_for_many(spark, tmp_path):
    """A hundred thousand queries meet the rules without a pass over them for each block."""
    r = random.Random(5)
    spark.createDataFrame([(k, " ".join(r.choice("abcdefgh") * 2 for _ in range(9))) for k in range(300)], "rule_id long, text string").write.parquet(str(tmp_path / "rules"))
    rules = spark.read.parquet(str(tmp_path / "rules"))
    queries = spark.range(100_000).select(F.col("id").alias("query_id"), F.concat_ws(" ", *[F.element_at(F.array(*[F.lit(c * 2) for c in "abcdefgh"]), (F.col("id") / d % 8 + 1).cast("int")) for d in (1, 8, 64)]).alias("text"))
    got = retrieve.keyword_top_k(queries, rules, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "FileScan" not in plan
    assert got.count() == 200_000


def test_the_scoreboard_works_out_hits_and_quotes_once(spark, sf_dir):
    from evidara.plans import adjudication

    plan = adjudication.scoreboard_retrieval(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "MapInArrow" not in plan and "parquet" not in plan.lower()
