"""Pages, owned reads, variants and latency sketches: errors and odd values."""

import pytest
from pyspark.sql import functions as F

from evidara.operators import latency, ownership, variants
from evidara.sources import pages


def test_pages_of_odd_texts(spark):
    rows = [(1, "ab\fcde\f\ff"), (2, None), (3, ""), (4, "x" * 7), (4, "x" * 7), (5, "é😀" * 3), (6, "a\f")]
    docs = spark.createDataFrame(rows, "id int, text string").withColumn("page", F.lit("clash"))
    got = {}
    for r in pages.paged(docs, ["id"], 3).orderBy("id", "page_no").collect():
        got.setdefault(r["id"], []).append((r["page_no"], r["start"], r["page"]))
    assert got == {1: [(1, 0, "ab"), (2, 3, "cde"), (3, 7, ""), (4, 8, "f")], 4: [(1, 0, "xxx")] * 2 + [(2, 3, "xxx")] * 2 + [(3, 6, "x")] * 2, 5: [(1, 0, "é😀é"), (2, 3, "😀é😀")], 6: [(1, 0, "a"), (2, 2, "")]}


def test_what_is_not_owned_looks_like_not_found(spark):
    rows = spark.createDataFrame([(1, "ann", "x"), (2, "bob", "y"), (3, None, "z")], "id int, owner string, body string")
    ownership.owned_view(rows, "notes", "owner")
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id int")
    answer = lambda: {r["id"]: (r["status"], r["body"]) for r in ownership.answers(asked, "notes", "id").collect()}
    ownership.set_caller(spark, "ann")
    before = ownership.answers(asked, "notes", "id")
    assert answer() == {1: (200, "x"), 2: (404, None), 3: (404, None), 9: (404, None)}
    ownership.set_caller(spark, "bob' OR '1'='1")
    assert {s for s, _ in answer().values()} == {404}
    ownership.set_caller(spark, None)
    assert {s for s, _ in answer().values()} == {404}
    assert {r["id"]: r["status"] for r in before.collect()}[1] == 200


def value(spark, json, f):
    return spark.createDataFrame([(json,)], "j string").select(f(F.parse_json("j")).alias("x")).first()["x"]


def test_variant_predicates(spark):
    assert value(spark, '["a","b c"]', lambda v: variants.string_list(v, "l")) == ["a", "b c"]
    assert value(spark, "[]", lambda v: variants.string_list(v, "l")) == []
    got = value(spark, '[{"id":"a","instruction":""},{"id":"b","name":"B","instruction":"do","when":"now","more":1}]', lambda v: variants.layer_tables(v, "l"))
    assert [tuple(x) for x in got] == [("a", "a", "", None), ("b", "B", "do", "now")]
    assert value(spark, "[]", lambda v: variants.layer_tables(v, "l")) == []


@pytest.mark.parametrize(
    ("json", "message"),
    [
        ('{"a":1}', "l must be a list of tables"), ("3", "l must be a list of tables"), ('["a"]', r"l\[0\] must be a table"), ("[null]", r"l\[0\] must be a table"),
        ('[{"instruction":"x"}]', r"l\[0\].id must be a string, got nothing"), ('[{"id":7,"instruction":"x"}]', r"l\[0\].id must be a string, got bigint"), ('[{"id":" ","instruction":"x"}]', r"l\[0\].id must not be empty"),
        ('[{"id":"a","instruction":"x"},{"id":"a","instruction":"y"}]', "duplicate layer id `a`"), ('[{"id":"a"}]', r"l\[0\].instruction must be a string"), ('[{"id":"a","instruction":["x"]}]', "instruction must be a string, got list"),
        ('[{"id":"a","instruction":"x","when":""}]', r"l\[0\].when must not be empty"), ('[{"id":"a","instruction":"x","name":"\\n"}]', r"l\[0\].name must not be empty"), ('[{"id":"a","instruction":"x"},{"id":"b","instruction":"x","name":{}}]', r"l\[1\].name must be a string, got table"),
    ],
)
def test_bad_layer_tables_are_errors(spark, json, message):
    with pytest.raises(Exception, match=message):
        value(spark, json, lambda v: variants.layer_tables(v, "l"))


@pytest.mark.parametrize(("json", "message"), [('"a"', "l must be a list, got string"), ('["a",3]', r"l\[1\] must be a string, got bigint"), ('["a",""]', r"l\[1\] must not be empty")])
def test_bad_string_lists_are_errors(spark, json, message):
    with pytest.raises(Exception, match=message):
        value(spark, json, lambda v: variants.string_list(v, "l"))


def test_sketches_of_parts_merge(spark):
    n = 50_000
    hits = spark.range(n).select((F.col("id") % 7).alias("part"), F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("ms"))
    hits = hits.union(spark.createDataFrame([(99, "empty", None), (1, "few", 5.0), (2, "few", 7.0)], "part long, g string, ms double"))
    got = {r["g"]: r for r in latency.quantiles(latency.merged(latency.sketched(hits, ["g", "part"], "ms"), ["g"]), {"p50": 0.5, "p95": 0.95}).collect()}
    for p, share in (("p50", 0.5), ("p95", 0.95)):
        assert abs(hits.where((F.col("g") == "a") & (F.col("ms") <= got["a"][p])).count() / n - share) < 0.02
    assert got["a"]["n"] == n and got["few"]["p50"] == 5.0 and got["few"]["p95"] == 7.0
    assert got["empty"]["n"] == 0 and got["empty"]["p50"] is None
    assert len(bytes(got["a"]["sketch"])) < 20_000
