"""Edge cases of single operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from evidara.functions import text
from evidara.operators import audit, evidence, gate, layers, ledger, render, retrieve, verdict
from evidara.sources import files


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_gate_is_total_and_inclusive(spark):
    votes = [(1, "lab")] * 9 + [(1, "invoice")] + [(2, "lab")] * 8 + [(2, "invoice")] + [(3, "invoice")] + [(4, "a"), (4, "b"), (5, None)]
    pages = gate.vote_confidence(spark.createDataFrame(votes, "p int, label string"), ["p"], "label")
    routed = pages.withColumn("route", gate.route(F.col("agree"), F.col("runs"), F.col("label") == "lab"))
    assert collected(routed, "p", "label", "route") == [(1, "lab", "extract"), (2, "lab", "triage"), (3, "invoice", "ask_customer"), (4, "a", "triage")]
    assert value(spark, gate.route(F.lit(None).cast("int"), F.lit(3), F.lit(True))) == "triage"


def test_latest_decision_wins(spark):
    rows = spark.createDataFrame([(1, "keep", 1), (1, "discard", 2), (2, "accept", 1)], "p int, action string, ts int")
    assert collected(gate.latest_decision(rows, ["p"], "action", ["ts"]), "p", "decision") == [(1, "discard"), (2, "accept")]


def test_quote_on_its_page(spark):
    pages = spark.createDataFrame([(1, "BMI  was\n31 "), (2, "other")], "page int, text string")
    facts = spark.createDataFrame([(1, 1, "BMI  was"), (2, 1, "BMI was 31"), (3, 2, "BMI"), (4, 9, "BMI"), (5, 1, None)], "fact int, page int, quote string")
    got = evidence.verify_on_page(facts, pages, ["page"])
    assert collected(got, "fact", "quote_verified", "quote_verified_loose", "quote_position") == [(1, True, True, 1), (2, False, True, 0), (3, False, False, 0), (4, False, False, 0), (5, False, False, 0)]


def test_vector_search_handles_bad_vectors(spark):
    rules = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [0.0, 1.0])], "rule_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (7, None)], "query_id long, embedding array<double>")
    assert collected(retrieve.vector_top_k(queries, rules, 2), "query_id", "rule_id", "rank") == [(1, 5, 1), (1, 6, 2)]


def test_verdict_precedence(spark):
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "case_id int")
    hit = "case_id int, impairment string, rule_id string, action string, debit_pct int, triggered boolean"
    hits = [(1, "a", "r1", "debit", 50, True), (1, "b", "r2", "debit", 25, True), (2, "a", "r3", "decline", 0, True), (3, "a", "r1", "debit", 50, True), (3, "a", "r3", "decline", 0, True), (4, "a", "r1", "debit", 50, False), (6, "a", "r1", "debit", 50, True)]
    got = verdict.verdicts(cases, spark.createDataFrame(hits, hit), spark.createDataFrame([(6,)], "case_id int"))
    assert collected(got, "case_id", "verdict", "loading_pct") == [(1, "loaded", 75), (2, "decline", 0), (3, "refer", 0), (4, "standard", 0), (5, "refer", 0), (6, "refer", 0)]


def test_layers(spark):
    rows = [(0, ["a", "x"], "1"), (0, ["b"], "2"), (0, ["c"], "3"), (0, ["d", "y"], "0"), (1, ["a"], "flat"), (1, ["b", "z"], "deep"), (1, ["d"], "9"), (2, ["d", "w"], "7"), (2, ["c"], "4")]
    merged = layers.merge_layers(spark.createDataFrame([(1, *r) for r in rows], "g int, layer int, path array<string>, value string"), ["g"])
    assert collected(merged.withColumn("path", F.array_join("path", ".")), "path", "value") == [("a", "flat"), ("b.z", "deep"), ("c", "4"), ("d.w", "7")]
    assert layers.at_path(merged, ["b"]).count() == 1 and layers.at_path(merged, ["nope"]).count() == 0
    assert collected(layers.by_short_key(merged, ["g"]), "key", "paths") == [("a", 1), ("c", 1), ("w", 1), ("z", 1)]


def test_keyed_merge_replaces_whole_and_in_place(spark):
    base = spark.createDataFrame([("a", 0, "x", "p"), ("b", 1, "y", "q"), ("a", 2, "z", "r")], "code string, pos int, one string, two string")
    over = spark.createDataFrame([("n", 0, "new", None), ("a", 1, "own", None)], "code string, pos int, one string, two string")
    got = layers.merge_keyed(base, over, "code", "pos", ["one", "two"]).orderBy("pos").collect()
    assert [(r["code"], r["one"], r["two"]) for r in got] == [("a", "x", "p"), ("b", "y", "q"), ("a", "own", None), ("n", "new", None)]


def test_array_key(spark):
    of = lambda rows: spark.createDataFrame(rows, "code string, id string").agg(layers.array_key(F.col("code"), F.col("id")).alias("k")).first()["k"]
    assert of([("a", "1"), ("b", "2")]) == "code"
    assert of([(None, "1"), ("b", "2")]) == "id"
    assert of([(None, "1"), ("b", None)]) is None
    with pytest.raises(Exception, match="empty identifier"):
        of([("", "1")])


def test_manifest_and_sets(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "name string, sha string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "name string, sha string")
    assert collected(layers.verify_manifest(a, b, "name", "sha"), "name", "status") == [("w", "extra"), ("y", "changed"), ("z", "missing")]
    assert layers.differences(a, a).count() == 0


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, node string")
    assert layers.closure(edges).count() == 9


def test_closure_has_no_depth_limit(spark):
    edges = spark.range(70).select(F.format_string("%d", "id").alias("parent"), F.format_string("%d", F.col("id") + 1).alias("node"))
    assert layers.closure(edges).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()[:] == (70 * 71 // 2, 70)


def test_rendering_errors(spark):
    sources = lambda content: spark.createDataFrame([("a.md", content), ("b.md", None)], "name string, content string")
    values = spark.createDataFrame([("short", "k", "{{.k}}")], "kind string, key string, value string")
    assert collected(render.rendered(sources("{{.k}} [[snapshot:b.md]]"), values, "/d/"), "name", "content") == [("a.md", "{{.k}} /d/b.md"), ("b.md", None)]
    with pytest.raises(Exception, match="missing value of config x"):
        render.rendered(sources("{{config.x}}"), values, "/d").collect()
    with pytest.raises(Exception, match=r"undeclared source: c\.md"):
        render.rendered(sources("[[snapshot:c.md]]"), values, "/d").collect()
    assert value(spark, render.string_list(F.lit('["a", "b"]'), "x")) == ["a", "b"] and value(spark, render.string_list(F.lit("[]"), "x")) == []
    for bad in ('"a"', "[1]", '["a", " "]', "[", '[["a"]]'):
        with pytest.raises(Exception, match="x must be a list of strings"):
            value(spark, render.string_list(F.lit(bad), "x"))
    with pytest.raises(Exception, match="x must not be empty"):
        value(spark, render.non_empty(F.lit(" "), "x"))
    layer = "k int, pos int, id string, name string, when string, instruction string"
    with pytest.raises(Exception, match="id repeats"):
        render.review_layers(spark.range(1).select(F.lit(1).alias("k")), spark.createDataFrame([(1, 1, "a", None, None, "x"), (1, 2, "a", None, None, "y")], layer), "k").collect()


def test_keyword_search(spark):
    rules = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, ""), (5, "B c"), (6, "d")], "rule_id long, text string")
    queries = spark.createDataFrame([(1, "b c c"), (2, "nothing"), (3, None), (4, "")], "query_id long, text string")
    got = retrieve.keyword_top_k(queries, rules, 2).collect()
    assert sorted((r["query_id"], r["rule_id"], r["rank"]) for r in got) == [(1, 2, 1), (1, 5, 2)] and len({r["score"] for r in got}) == 1
    assert retrieve.keyword_top_k(queries, rules.limit(0), 2).count() == 0 and retrieve.keyword_top_k(queries.limit(0), rules, 2).count() == 0


def test_aliases_and_roots(spark):
    rows, alias = spark.createDataFrame([("old",), ("kept",)], "id string"), spark.createDataFrame([("old", "new")], "id string, target string")
    assert collected(layers.current_ids(rows, alias, "id"), "id") == [("kept",), ("new",)]
    roots = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, True), (2, "a", 1, True)], "g int, root string, p int, has boolean")
    assert collected(layers.masked_overrides(roots, ["g"], "p", "has"), "g") == [(1,)]
    assert collected(layers.first_by_trust(roots, ["g"], "root", "p"), "root") == [("a",), ("a",)]


def test_substitution_never_rescans(spark):
    values = {"{a}": "{b}", "{b}": "$1\\", "{ab}": "long"}
    assert value(spark, text.substitute(F.lit("x {a}{b} {ab} {c}"), values)) == "x {b}$1\\ long {c}"
    assert value(spark, text.substitute(F.lit(""), values)) == ""


def test_text_functions(spark):
    doc = F.lit("{{config.a.b}} {{.key}} {{.no-key}} {workflow.x} [[snapshot:n.md]] [[x-snapshot:d/n.md]] [[snapshot:a b.md]]")
    assert [value(spark, text.tokens(doc, k)) for k in ("config", "short", "workflow", "snapshot")] == [["a.b"], ["key"], ["x"], ["n.md"]]
    assert value(spark, text.tokens(doc, "snapshot", "x")) == ["d/n.md"]
    assert value(spark, text.slug(F.lit("  Über --Ärger 7! "))) == "ber-rger-7"
    assert value(spark, text.slug(F.lit("***"))) == "project"
    assert value(spark, text.one_line(F.lit(" a\n b\t c "))) == "a b c"
    assert value(spark, text.bullets(F.array(F.lit("a\nb"), F.lit("c")))) == "- a\n  b\n- c"
    assert value(spark, text.bullets(F.array().cast("array<string>"))) == "_None._"
    assert value(spark, text.tagged(F.lit("note"), F.lit("me"), F.lit("x\ny"))) == "- (note by me) x y"
    assert value(spark, text.tagged(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("x"))) == "- x"
    assert value(spark, text.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'
    assert value(spark, text.root_path(F.lit("{project-root}/x"), "/r")) == "/r/x"
    assert value(spark, text.root_path(F.lit("x"), "/r")) is None
    assert value(spark, text.complete_tags(F.create_map(F.lit("env"), F.lit("dev")), ["env"]))
    assert tuple(value(spark, text.key_value(F.lit("a: b: c"), ":"))) == ("a", "b: c")
    none = F.lit(None).cast("string")
    assert value(spark, text.section(F.lit("i"), none, F.lit(" "), F.lit(" body "))) == "#### i (`i`)\n\nbody"
    assert value(spark, text.section(F.lit("i"), F.lit("N"), F.lit("x"), F.lit("body"))) == "#### N (`i`)\n\nRun only when: x\n\nbody"
    assert value(spark, text.with_key(F.create_map(F.lit("a"), F.lit("1")), "a", F.lit("2"))) == {"a": "2"}


def test_log(spark):
    log = "---\ntitle: a --- b: c\nno colon\n---\nbody\n- (note by me) one\n- two\n"
    parts = value(spark, files.log_parts(F.lit(log)))
    assert parts["meta"] == {"title": "a --- b: c"}
    entries = value(spark, files.log_entries(F.lit(parts["body"])))
    assert [tuple(e) for e in entries] == [("note", "me", "one"), (None, None, "two")]
    with pytest.raises(Exception, match="not fenced"):
        value(spark, files.log_parts(F.lit("---\nx: 1")))


def test_files(spark, tmp_path):
    (tmp_path / "base.toml").write_text("[a]\nx = 1\nlist = ['p', 'q']\n[b]\nok = true\n")
    (tmp_path / "user.toml").write_text("a = 'flat'\n")
    leaves = files.toml_leaves(spark, [str(tmp_path / "base.toml"), str(tmp_path / "user.toml")])
    merged = layers.merge_layers(leaves.withColumn("g", F.lit(1)), ["g"])
    assert collected(merged.withColumn("path", F.array_join("path", ".")), "path", "value") == [("a", "flat"), ("b.ok", "true")]
    (tmp_path / "md" / "sub").mkdir(parents=True)
    for name in ("workflow.md", "SKILL.md", "sub/x.md"):
        (tmp_path / "md" / name).write_text(name)
    assert collected(files.markdown_sources(spark, str(tmp_path / "md")), "name", "content") == [("sub/x.md", "sub/x.md"), ("workflow.md", "workflow.md")]
    (tmp_path / "c.csv").write_text('name,note\nx,"a, ""b"""\n')
    assert collected(files.catalogue(spark, str(tmp_path / "c.csv")), "name", "note") == [("x", 'a, "b"')]
    one, two = spark.range(3), spark.range(5)
    path = files.publish(one, str(tmp_path), "snap", "f" * 64)
    assert files.publish(spark.range(3).orderBy(F.desc("id")), str(tmp_path), "snap", "f" * 64) == path and spark.read.parquet(path).count() == 3
    for other in (two, one.withColumnRenamed("id", "other")):
        with pytest.raises(ValueError, match="other rows"):
            files.publish(other, str(tmp_path), "snap", "f" * 64)
    assert files.toml_leaves(spark, [str(tmp_path / "base.toml"), str(tmp_path / "none.toml")]).count() == leaves.where("layer = 0").count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.toml_leaves(spark, [str(tmp_path / "none.toml")])
    (tmp_path / "md" / "XSKILL.md").write_text("kept")
    assert [r["name"] for r in files.markdown_sources(spark, str(tmp_path / "md")).collect()] == ["XSKILL.md", "sub/x.md", "workflow.md"]
    with pytest.raises(ValueError, match=r"no workflow\.md"):
        files.markdown_sources(spark, str(tmp_path / "md" / "sub"))


def test_trail_over_days_and_rates(spark):
    rows = [(1, 1, "a", "2024-01-01 23:59:59"), (1, 2, "b", "2024-01-02 00:00:01"), (1, 3, "c", "2024-01-04 00:00:01"), (2, 4, "a", "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "u int, e int, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert collected(audit.trail(events, "u", "k", "ts", "e"), "e", "seq", "previous", "seconds_since") == [(1, 1, None, None), (2, 2, "a", 2.0), (3, 3, "b", 172800.0), (4, 1, None, None)]
    assert collected(audit.rate(events, "u", "ts", "e", 3600), "e", "in_window") == [(1, 1), (2, 2), (3, 1), (4, 1)]
    assert collected(audit.within_retention(events, "ts", 2), "e") == [(2,), (3,)]


def test_credentials(spark):
    at = lambda rows, schema, c: spark.createDataFrame(rows, schema).withColumn(c, F.col(c).cast("timestamp"))
    grants = at([(1, "2024-01-01 10:00:00")], "r int, issued string", "issued")
    uses = at([(1, 1, "2024-01-01 10:05:00"), (2, 1, "2024-01-01 10:05:01"), (3, 1, "2024-01-01 09:59:59"), (4, 2, "2024-01-01 10:01:00"), (5, 1, "2024-01-01 10:00:00")], "use int, r int, ts string", "ts")
    assert collected(audit.credentials_in_force(uses, grants, ["r"], 5, "use"), "use", "valid") == [(1, True), (2, False), (3, False), (4, False), (5, True)]


def test_ledger(spark):
    years = spark.createDataFrame([("p", 1, -5), ("p", 2, 3), ("p", 3, 2), ("q", 1, -1)], "project string, year int, net int")
    assert collected(ledger.payback(years, "project", "year", "net"), "project", "payback_year") == [("p", 3), ("q", None)]
    stories = spark.createDataFrame([(1, "done"), (1, "done"), (2, "done"), (3, "open")], "epic int, status string")
    assert collected(ledger.delivered(stories, "epic", "status", spark.createDataFrame([(2,)], "epic int")), "epic") == [(1,)]


def test_streams(spark, tmp_path):
    from evidara.streaming import events as stream

    rows = [(1, "u", "2024-01-01 00:00:00", 2.0), (1, "u", "2024-01-01 00:00:00", 2.0), (2, "u", "2024-01-01 10:00:00", 3.0), (3, "u", "2024-01-05 00:00:00", 1.0)]
    table = spark.createDataFrame(rows, "id int, user string, ts string, amount double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    stream.run_available(stream.windowed(source(), "ts", "amount", "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    # the last day's window is still open
    assert collected(spark.read.parquet(str(tmp_path / "out")).select("events", F.col("total").cast("double").alias("total")), "events", "total") == [(3, 7.0)]
    stream.run_available(stream.deduplicated(source(), "id", "ts"), str(tmp_path / "once"), str(tmp_path / "ck2"))
    assert collected(spark.read.parquet(str(tmp_path / "once")), "id") == [(1,), (2,), (3,)]
    stream.run_available(stream.session_traces(source(), "user", "ts"), str(tmp_path / "s"), str(tmp_path / "ck3"))
    assert collected(spark.read.parquet(str(tmp_path / "s")), "events") == [(1,), (2,)]
    stale = stream.stale_write_alerts(source(), spark.createDataFrame([("u", 3)], "user string, current int"), "user", "id")
    stream.run_available(stale, str(tmp_path / "w"), str(tmp_path / "ck4"))
    assert collected(spark.read.parquet(str(tmp_path / "w")), "id") == [(1,), (1,), (2,)]


def test_uploaded_files(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("empty.pdf", b""), ("b.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    got = files.documents_from_files(spark, str(tmp_path))
    assert got.columns == ["path", "content", "uploaded_at"]
    assert {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in got.collect()} == {"a.pdf": b"%PDF-1"}
    assert [r["path"].rsplit("/", 1)[1] for r in files.documents_from_files(spark, str(tmp_path), "*.txt").collect()] == ["b.txt"]


def test_rows_are_dealt_by_key_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from evidara import storage
    from evidara.operators import gate, ownership, verdict

    monkeypatch.setattr(storage, "ROWS", 10)
    n = 30
    votes = spark.range(10 * n).select((F.col("id") % 200).alias("page"), F.lit("A").alias("label"))
    assert storage.dealt(votes, "page").rdd.getNumPartitions() == n
    confident = gate.vote_confidence(votes, ["page"], "label")
    assert confident.rdd.getNumPartitions() == n and confident.count() == 200
    ownership.owned_view(votes.select("page", F.lit("1").alias("owner")), "dealt_votes", "owner")
    assert ownership.answers(votes, "dealt_votes", "page").rdd.getNumPartitions() == n
    cases = votes.select(F.col("page").alias("case_id"), F.col("label").alias("verdict"))
    plan = verdict.accuracy(cases.withColumn("contender", F.lit("c")), cases, ["contender"])._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(case_id#" in plan and f", {n})" in plan


def test_a_few_rules_are_carried_to_the_facts(spark, sf_dir):
    from evidara.plans import adjudication

    plan = adjudication.rule_trigger(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(impairment" not in plan and "BroadcastHashJoin" in plan
