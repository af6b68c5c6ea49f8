"""Layered merge and canonical JSON of trees against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import layers, trees
from evidara.sources import files

LEAVES = "g int, layer int, path array<string>, positions array<int>, kind string, value string"


def plain_merge(base, over):
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: plain_merge(base[k], v) if k in base else v for k, v in over.items()}
    if not (isinstance(base, list) and isinstance(over, list)):
        return over
    items = base + over
    tables = items and all(isinstance(x, dict) for x in items)
    key = next((k for k in ("code", "id") if tables and all(k in x for x in items)), None)
    if key is None:
        return items
    if any(not isinstance(x[key], str) or not x[key] for x in items):
        raise ValueError(key)
    out = list(base)
    for x in over:
        at = [i for i, y in enumerate(out) if y[key] == x[key]]
        if at:
            out[at[-1]] = x
        else:
            out.append(x)
    return out


def random_tree(r, depth=0):
    kind = r.random()
    if kind < 0.45 and depth < 4 or not depth:
        return {k: random_tree(r, depth + 1) for k in r.sample("abcd", r.randint(0 if depth else 2, 3))}
    if kind < 0.75:
        if r.random() < 0.6:
            key = r.choice(["code", "id"])
            items = [{key: r.choice("xyz")} | ({"id": r.choice("pq")} if r.random() < 0.3 else {}) | {"body": r.choice([1, "t", [], {}, [1, [2, {"code": "n"}]], {"deep": {"code": "m"}}])} for _ in range(r.randint(0, 3))]
            return items + ([r.choice([1, {"z": 1}, ["code"]])] if r.random() < 0.15 else [])
        return [r.choice([1, "s", True, 2.5, [3, "i"], [], {}]) for _ in range(r.randint(0, 3))]
    return r.choice(["s", "", 1, -2, True, False, 1.5, 'quo"te\\', "line\n\ttab\x01\x1f é 漢   😀"])


def rows_of(g, layer, tree):
    return [(g, layer, x["path"], x["positions"], x["kind"], x["value"]) for x in files._leaves(tree, [], []) if x["path"]]


def canonical(tree):
    return json.dumps(tree, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@pytest.fixture(scope="module")
def forest():
    r = random.Random(12)
    return {g: [random_tree(r) for _ in range(r.randint(1, 4))] for g in range(150)}


def test_merge_and_canonical_json_equal_plain_python(spark, forest):
    rows = [x for g, ts in forest.items() for layer, t in enumerate(ts) for x in rows_of(g, layer, t)]
    merged = layers.merge_layers(spark.createDataFrame(rows, LEAVES), ["g"])
    got = {r["g"]: r["json"] for r in trees.canonical_json(merged, ["g"]).collect()}
    arrays = 0
    for g, ts in forest.items():
        want = {}
        for t in ts:
            want = plain_merge(want, t)
        assert got.get(g, "{}") == canonical(want), (g, ts)
        arrays += canonical(want).count("[{")
    assert arrays > 50


def test_merge_keeps_null_groups_and_takes_no_rows(spark):
    rows = [(None, 0, ["a"], [], "string", "1"), (None, 1, ["a"], [], "string", "2"), (1, 0, ["l", "0"], [2], "string", "x"), (None, 1, ["l", "0"], [2], "string", "y")]
    got = layers.merge_layers(spark.createDataFrame(rows, LEAVES), ["g"]).collect()
    assert sorted((r["g"] is None, r["path"], r["value"]) for r in got) == [(False, ["l", "0"], "x"), (True, ["a"], "2"), (True, ["l", "0"], "y")]
    assert layers.merge_layers(spark.createDataFrame([], LEAVES), ["g"]).collect() == []
    assert trees.canonical_json(spark.createDataFrame([], LEAVES), ["g"]).collect() == []


@pytest.mark.parametrize("bad", ["", 7, {"x": 1}, []])
def test_bad_identifier_is_an_error_where_arrays_meet(spark, bad):
    alone = rows_of(1, 0, {"m": [{"code": bad}]})
    assert layers.merge_layers(spark.createDataFrame(alone, LEAVES), ["g"]).count() == 1
    both = alone + rows_of(1, 1, {"m": [{"code": "ok"}]})
    with pytest.raises(Exception, match="identifier in a keyed array"):
        layers.merge_layers(spark.createDataFrame(both, LEAVES), ["g"]).collect()


def test_no_json_for_dates(spark):
    with pytest.raises(Exception, match="no JSON for a value of kind other"):
        trees.canonical_json(spark.createDataFrame([(1, 0, ["d"], [], "other", "2020-01-01")], LEAVES), ["g"]).collect()


def test_a_large_array_is_numbered_in_many_tasks(spark, monkeypatch):
    n = 20_000
    monkeypatch.setattr(trees, "cut", lambda df, real=trees.cut: tasks.append(df.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"].max()) or real(df))
    tasks = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("ord"))
    got = trees.numbered(rows.repartition(8), ["g"], ["ord"], "place")
    assert got.where("place <> ord").count() == 0 and got.count() == n
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(tasks) < n / 2


def test_keyed_merge_with_null_keys_appends(spark):
    base = spark.createDataFrame([("a", 0, "b0"), (None, 1, "b1"), ("a", 2, "b2")], "code string, pos int, body string")
    over = spark.createDataFrame([("a", 0, "o0")], "code string, pos int, body string")
    got = layers.merge_keyed(base, over, "code", "pos", ["body"]).orderBy("pos").collect()
    assert [(r["code"], r["pos"], r["body"]) for r in got] == [("a", 0, "b0"), (None, 1, "b1"), ("a", 2, "b2"), ("a", 3, "o0")]
    whole = layers.merge_keyed(base.where("code is not null"), over.union(over.selectExpr("'n'", "5", "'n5'")), "code", "pos", ["body"]).orderBy("pos").collect()
    assert [(r["code"], r["body"]) for r in whole] == [("a", "b0"), ("a", "o0"), ("n", "n5")]


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(layers, "cut", lambda df, real=layers.cut: rounds.append(1) or real(df))
    n = 1500
    got = layers.closure(spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("node")))
    assert got.agg(F.count("*").alias("n"), F.sum(F.col("node") - F.col("ancestor") - F.col("depth")).alias("off"), F.max("depth").alias("d")).first()[:] == (n * (n + 1) // 2, 0, n)
    assert len(rounds) <= 13


def test_closure_equals_search(spark):
    r = random.Random(3)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(60)}
    want = {}
    for a in range(40):
        frontier, depth = {a}, 0
        while frontier:
            depth += 1
            frontier = {y for x in frontier for p, y in edges if p == x and (a, y) not in want}
            want |= {(a, y): depth for y in frontier}
    rows = [*edges, (1, None), (None, 2)]
    assert {(r["ancestor"], r["node"]): r["depth"] for r in layers.closure(spark.createDataFrame(rows, "parent int, node int")).collect()} == want


def test_bullets_end_lines_where_python_does(spark):
    from evidara.functions import text

    r = random.Random(1)
    items = ["", "a\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "x\n\n"] + ["".join(r.choice("ab\n\r\x85\x1e ") for _ in range(8)) for _ in range(200)]
    got = spark.createDataFrame([([x],) for x in items], "items array<string>").select("items", text.bullets(F.col("items")).alias("t")).collect()
    for row in got:
        lines = row["items"][0].splitlines() or [""]
        assert row["t"] == "\n".join(["- " + lines[0], *("  " + x for x in lines[1:])])


def test_short_keys_that_are_missing_or_ambiguous_are_errors(spark):
    merged = spark.createDataFrame([(1, ["a", "k"], [], "1"), (1, ["b", "k"], [], "2"), (1, ["b", "m"], [], "3"), (1, ["l", "0", "m"], [2], "4")], "g int, path array<string>, positions array<int>, value string")
    find = lambda key: layers.short_values(merged, ["g"], spark.createDataFrame([(1, key)], "g int, key string")).collect()
    assert find("m")[0][:] == (1, "m", "b.m", "3")
    with pytest.raises(Exception, match="ambiguous config value `k` found at: a.k, b.k"):
        find("k")
    with pytest.raises(Exception, match="missing config value `z`"):
        find("z")


def test_a_blank_condition_is_an_error(spark):
    from evidara.operators import render

    rows = lambda when: spark.createDataFrame([(1, 1, "a", "A", when, "do")], "k int, pos int, id string, name string, when string, instruction string")
    keys = spark.createDataFrame([(1,)], "k int")
    assert "Run only when" not in render.review_layers(keys, rows(None), "k").first()["text"]
    with pytest.raises(Exception, match="when must not be empty"):
        render.review_layers(keys, rows(" \n"), "k").collect()
