"""Queries of the toolkit: templates, logs, layers, catalogues, file sinks.

Nations, customers, parts and conversations stand in for sources, settings, catalogue rows and logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import layers, render, trees
from ..sources import files
from ..storage import scratch
from .registry import query, read

text_ = lambda c: F.col(c).cast("string")


@query(
    r"""SELECT n_name AS name, kind, key FROM nation, LATERAL (VALUES ('config', 'region.' || n_regionkey), ('short', 'n_' || n_nationkey), ('short', 'n_' || n_nationkey),
        ('workflow', 'step-' || n_nationkey), ('snapshot', 'regions/' || n_regionkey || '.md')) t(kind, key)"""
)
def token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token form once or twice a nation, beside text that looks like one and is none."""
    n, r = text_("n_nationkey"), text_("n_regionkey")
    content = F.concat(F.lit("{{config.region."), r, F.lit("}} {{.n_"), n, F.lit("}}{{.n_"), n, F.lit("}} {workflow.step-"), n, F.lit("} [[x-snapshot:regions/"), r, F.lit(".md]] {{.no-hyphen}} [[y-snapshot:a.md]] [[x-snapshot:a b.md]] {{ config.a}} {flow.x}"))
    return render.found_tokens(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), content.alias("content")), "x")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = text_("r_regionkey")
    content = F.concat(F.lit("Region {{config.region."), r, F.lit("}} {{.of}}: {workflow.how} see [[x-snapshot:"), r, F.lit(".md]] {{.of}}"))
    return read(spark, sf_dir, "region").select(F.concat(r, F.lit(".md")).alias("name"), content.alias("content"))


@query("SELECT r_regionkey || '.md' AS name, 'Region ' || r_name || ' {{.of}} {skill-root} all: run /out/run see /out/' || r_regionkey || '.md all' AS content FROM region")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that look like tokens are not filled in again, and {skill-root} only in workflow values."""
    config = read(spark, sf_dir, "region").select(F.lit("config").alias("kind"), F.concat(F.lit("region."), text_("r_regionkey")).alias("key"), F.concat("r_name", F.lit(" {{.of}} {skill-root}")).alias("value"))
    fixed = spark.createDataFrame([("short", "of", "all"), ("workflow", "how", "run {skill-root}/run"), ("config", "unused", "x")], "kind string, key string, value string")
    return render.rendered(_regions(spark, sf_dir), config.union(fixed), "/out", "x")


@query("SELECT n_name AS name, n_regionkey || '.md' AS key FROM nation WHERE n_regionkey > 2")
def snapshot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations refer to their region's source, and only the first three regions have one."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("[[snapshot:"), text_("n_regionkey"), F.lit(".md]]")).alias("content"))
    return render.undeclared_snapshots(nations.union(_regions(spark, sf_dir).where("name < '3.md'")))


@query(
    """WITH l AS (SELECT c_nationkey, c_custkey, '#### ' || CASE WHEN c_acctbal < 0 THEN 'c' || c_custkey ELSE c_name END || ' (`c' || c_custkey || '`)' || chr(10) || chr(10)
                  || CASE WHEN c_acctbal > 5000 THEN 'Run only when: ' || c_mktsegment || chr(10) || chr(10) ELSE '' END || 'Ask ' || c_name AS section
                  FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT n_nationkey, coalesce(string_agg(section, chr(10) || chr(10) ORDER BY c_custkey), 'No active review layers. HALT with blocking condition `no active review layers`.') AS text
    FROM nation LEFT JOIN l ON c_nationkey = n_nationkey GROUP BY 1"""
)
def review_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as layers of their nation; those of one segment have a blank instruction."""
    c = read(spark, sf_dir, "customer")
    name, when = F.when(F.col("c_acctbal") >= 0, render.non_empty(F.col("c_name"), "name")), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    instruction = F.when(F.col("c_mktsegment") == "BUILDING", " \n").otherwise(F.concat(F.lit(" Ask "), "c_name"))
    rows = c.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("pos"), F.concat(F.lit("c"), text_("c_custkey")).alias("id"), name.alias("name"), when.alias("when"), instruction.alias("instruction"))
    return render.review_layers(read(spark, sf_dir, "nation"), rows, "n_nationkey")


@query("SELECT conv_id, sha256(coalesce(string_agg('- ' || replace(text, chr(10), chr(10) || '  '), chr(10) ORDER BY turn) FILTER (role = 'user'), '_None._')) AS list_sha256 FROM conversations GROUP BY 1")
def bullet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user said in each conversation as a list."""
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(said, lambda x: x["text"]).alias("items"))
    return by.select("conv_id", F.sha2(text.bullets(F.col("items")), 256).alias("list_sha256"))


ONE_LINE_SQL = r"trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))"


@query(
    f"""SELECT conv_id, 'talk: ' || conv_id AS title, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS seq, count(*) OVER (PARTITION BY conv_id)::INT AS entries,
           CASE WHEN turn % 3 <> 2 THEN role END AS kind, CASE WHEN turn % 3 <> 1 THEN 'u' || conv_id END AS by, sha256({ONE_LINE_SQL}) AS text_sha256 FROM conversations"""
)
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as logs, with types, authors or both in the entries' tags, and read again."""
    turn = F.col("turn") % 3
    entry = text.tagged(F.when(turn != 2, F.col("role")), F.when(turn != 1, F.concat(F.lit("u"), text_("conv_id"))), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), "\n")
    log = F.concat(F.lit("---\ntitle: talk: "), text_("conv_id"), F.lit("\nno colon here\n---\n\n"), "body", F.lit("\n"))
    logs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body")).select("conv_id", files.log_parts(log).alias("log"))
    each = logs.select("conv_id", F.col("log.meta")["title"].alias("title"), files.log_entries(F.col("log.body")).alias("entries"))
    rows = each.select("conv_id", "title", F.size("entries").alias("entries"), F.posexplode("entries").alias("seq", "e"))
    return rows.select("conv_id", "title", (F.col("seq") + 1).alias("seq"), "entries", "e.kind", "e.by", F.sha2("e.text", 256).alias("text_sha256"))


@query(
    r"""SELECT event_id, 'title,user,updated' AS keys, strftime(ts, '%Y-%m-%dT%H:%M') AS updated, 'a b  c ' || event_type AS title FROM events"""
)
def log_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header whose `updated` stands in the middle is stamped again and has it last; line breaks in values go."""
    title = text.header_value(F.concat(F.lit("a\nb\r\n\nc\r"), "event_type"))
    meta = text.touched(F.create_map(F.lit("title"), title, F.lit("updated"), F.lit("old"), F.lit("user"), text_("user_id")), F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", meta.alias("m")).select("event_id", F.array_join(F.map_keys("m"), ",").alias("keys"), F.col("m")["updated"].alias("updated"), F.col("m")["title"].alias("title"))


@query("""SELECT c_custkey, '{"name":"' || c_name || '","nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}' AS json, c_name AS key, c_mktsegment || ': ' || c_nationkey AS value FROM customer""")
def canonical_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as JSON with sorted keys, and a setting cut at its first separator."""
    pairs = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), text_("c_nationkey"), F.lit("name"), "c_name")
    line = text.key_value(F.concat_ws(": ", "c_name", "c_mktsegment", text_("c_nationkey")), ":")
    return read(spark, sf_dir, "customer").select("c_custkey", text.canonical_json(pairs).alias("json"), line["key"].alias("key"), line["value"].alias("value"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/root/' || p_name WHEN p_size % 3 = 1 THEN '/' || p_name END AS path, p_size % 4 <> 0 AND p_size % 5 <> 0 AS tagged,
           lower(p_type) || '-' || p_size || '-dev' AS resource, lower(p_type) || p_size || 'dev' AS plain, p_retailprice::DECIMAL(18,2) AS money FROM part"""
)
def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below the project's root, tags (one missing where the size is divisible by 4, one in capitals where by 5), names and prices."""
    size = F.col("p_size")
    path = text.root_path(F.concat(F.when(size % 3 == 0, "{project-root}/").when(size % 3 == 1, "/").otherwise("").cast("string"), "p_name"), "/root")
    tags = F.map_concat(F.create_map(F.when(size % 5 == 0, "Type").otherwise("type"), F.lower("p_type")), F.when(size % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("env"), F.lit("dev"))))
    names = [F.lower("p_type"), text_("p_size"), F.lit("dev")]
    complete = text.complete_tags(F.map_filter(tags, lambda k, _: k != "none"), ["env"])
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), complete.alias("tagged"), text.resource_name(names).alias("resource"), text.resource_name(names, hyphens=False).alias("plain"), text.money(F.col("p_retailprice")).alias("money"))


@query(
    """SELECT c_custkey, key, CASE WHEN key = 'segment' AND c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS paths,
           CASE WHEN key = 'key' THEN c_nationkey::VARCHAR WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS value FROM customer, (VALUES ('key'), ('segment')) k(key)"""
)
def short_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by the last part of their path; a third of the customers have two of one name."""
    c = read(spark, sf_dir, "customer")
    leaf = lambda rows, path, value: rows.select("c_custkey", F.array(*[F.lit(p) for p in path]).alias("path"), value.cast("string").alias("value"))
    rows = leaf(c, ["segment"], F.col("c_mktsegment")).union(leaf(c, ["nation", "key"], F.col("c_nationkey"))).union(leaf(c.where("c_custkey % 3 = 0"), ["old", "segment"], F.lit("x")))
    return layers.by_short_key(rows, ["c_custkey"])


@query("SELECT c_custkey, key, CASE key WHEN 'key' THEN 'nation.key' ELSE 'segment' END AS path, CASE key WHEN 'key' THEN c_nationkey::VARCHAR ELSE c_mktsegment END AS value FROM customer, (VALUES ('key'), ('segment')) k(key) WHERE key = 'key' OR c_custkey % 3 <> 0")
def short_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings looked up by the last part of their path, where it is the only one of its name."""
    c = read(spark, sf_dir, "customer")
    leaf = lambda rows, path, value: rows.select("c_custkey", F.array(*[F.lit(p) for p in path]).alias("path"), value.cast("string").alias("value"))
    rows = leaf(c, ["segment"], F.col("c_mktsegment")).union(leaf(c, ["nation", "key"], F.col("c_nationkey"))).union(leaf(c.where("c_custkey % 3 = 0"), ["old", "segment"], F.lit("x")))
    wanted = c.select("c_custkey", F.explode(F.array(F.lit("key"), F.lit("segment"))).alias("key")).where("key = 'key' or c_custkey % 3 <> 0")
    return layers.short_values(rows, ["c_custkey"], wanted)


@query("SELECT c_custkey, 'nation.key' AS path, c_nationkey::VARCHAR AS value FROM customer WHERE c_acctbal <= 9000 UNION ALL SELECT c_custkey, 'nation.name', 'n' || c_nationkey FROM customer WHERE c_acctbal <= 9000")
def dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies below `nation`; customers that don't have it have no row."""
    c = read(spark, sf_dir, "customer")
    leaf = lambda rows, path, value: rows.select("c_custkey", F.array(*[F.lit(p) for p in path]).alias("path"), value.cast("string").alias("value"))
    some = c.where("c_acctbal <= 9000")
    rows = leaf(c, ["segment"], F.col("c_mktsegment")).union(leaf(some, ["nation", "key"], F.col("c_nationkey"))).union(leaf(some, ["nation", "name"], F.concat(F.lit("n"), text_("c_nationkey"))))
    return layers.at_path(rows, ["nation"]).withColumn("path", F.array_join("path", "."))


@query(
    """SELECT p_size, CASE WHEN bool_and(p_partkey % 7 <> 0) THEN 'code' WHEN bool_and(p_partkey % 11 <> 0) THEN 'id' END AS identified_by FROM part GROUP BY 1"""
)
def array_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size as an array whose items may lack a code or an id."""
    code, ident = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), F.when(F.col("p_partkey") % 11 != 0, text_("p_partkey"))
    return read(spark, sf_dir, "part").groupBy("p_size").agg(layers.array_key(code, ident).alias("identified_by"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS items FROM orders GROUP BY 1")
def current_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("F", "finished"), ("O", "open")], "status string, target string")
    return layers.counts(layers.current_ids(read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), aliases, "status"), "status")


@query(
    """SELECT s_nationkey, arg_min(s_name, s_suppkey) AS root, NOT arg_min(s_acctbal > 3000, s_suppkey) AND bool_or(s_acctbal > 3000) AS masked FROM supplier GROUP BY 1"""
)
def trusted_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a nation's candidate roots in order of trust; the rich ones have an override."""
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_name").alias("root"), (F.col("s_acctbal") > 3000).alias("has"))
    masked = layers.masked_overrides(rows, ["s_nationkey"], "s_suppkey", "has").withColumn("masked", F.lit(True))
    return layers.first_by_trust(rows, ["s_nationkey"], "root", "s_suppkey").join(masked, "s_nationkey", "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.duplicate_ids(read(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT nationkey, count(*) AS items FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def array_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = lambda name, c: read(spark, sf_dir, name).select(F.col(c).alias("nationkey"))
    return layers.counts(layers.append_arrays(column("customer", "c_nationkey"), column("supplier", "s_nationkey")), "nationkey")


@query("SELECT p_brand, count(*) AS items FROM part GROUP BY 1")
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills, brands as modules."""
    return layers.counts(read(spark, sf_dir, "part"), "p_brand")


@query("SELECT user_id, count(*) AS findings, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events WHERE event_type = 'error' GROUP BY 1")
def json_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's errors as a JSON array, read again; a user whose text is broken counts nothing."""
    errors = read(spark, sf_dir, "events").where("event_type = 'error'")
    texts = errors.groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_id", F.col("value").cast("decimal(18,2)").alias("value")))).alias("json"))
    broken = spark.createDataFrame([(-1, '[{"event_id": 1')], "user_id long, json string")
    each = texts.union(broken).select("user_id", F.inline(text.findings(F.col("json"), "event_id: long, value: decimal(18,2)")))
    return each.groupBy("user_id").agg(F.count("*").alias("findings"), F.sum("value").cast("double").alias("total"))


@query("""SELECT r_regionkey, '{' || chr(10) || '  "r_regionkey" : ' || r_regionkey || ',' || chr(10) || '  "r_name" : "' || r_name || ' é"' || chr(10) || '}' AS value FROM region""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit(" é")).alias("r_name"))
    path = scratch(spark, "json")
    files.as_json(rows).write.option("lineSep", "\u0000").text(path)
    out = spark.read.option("lineSep", "\u0000").text(path)
    return out.select(F.get_json_object("value", "$.r_regionkey").cast("int").alias("r_regionkey"), "value")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"' || p_brand || '\"' AS p_name, CASE WHEN p_size > 5 THEN p_type END AS p_type, (row_number() OVER (ORDER BY p_brand, CASE WHEN p_size > 5 THEN p_type END NULLS FIRST, p_partkey))::INT AS place FROM part")
def catalogue_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with quoted commas and quotes, written as CSV, read again and put in order."""
    parts = read(spark, sf_dir, "part").select(text_("p_partkey").alias("p_partkey"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_name"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("p_type"), "p_brand")
    folder = scratch(spark, "csv")
    files.export({"catalogue": parts}, folder)
    rows = files.catalogue(spark, f"{folder}/catalogue").withColumn("ordinal", F.col("p_partkey").cast("long"))
    # few rows a catalogue: their place in the order is counted along one range after the other
    ordered = layers.catalogue_order(rows, "p_brand", "p_type", "ordinal")
    return _numbered(ordered).select("p_partkey", "p_name", "p_type", "place")


def _numbered(ordered: DataFrame) -> DataFrame:
    """Sorted rows with `place` from 1: ranges and rows within them, lifted by the ranges before."""
    held = ordered.withColumns({"range_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()})
    path = scratch(ordered.sparkSession, "ordered")
    held.write.parquet(path)
    held = ordered.sparkSession.read.parquet(path)
    sizes = held.groupBy("range_").agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    other = sizes.select(F.col("range_").alias("earlier_"), F.col("n_").alias("m_"))
    # as many rows as the sort has ranges
    before = sizes.join(F.broadcast(other), F.col("earlier_") < F.col("range_"), "left").groupBy("range_", "first_").agg(F.coalesce(F.sum("m_"), F.lit(0)).alias("before_"))
    return held.join(F.broadcast(before), "range_").withColumn("place", (F.col("row_") - F.col("first_") + F.col("before_") + 1).cast("int"))


@query("""SELECT '{"ok":true,"memlog":"events","entries":' || (SELECT count(*) FROM events) || '}' AS ack, event_type, count(*) AS rows FROM events GROUP BY 2""")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in two writes, and the acknowledgement."""
    events, path = read(spark, sf_dir, "events"), scratch(spark, "events")
    files.append(events.where("event_id % 2 = 0"), path)
    files.append(events.where("event_id % 2 = 1"), path)
    rows = spark.read.parquet(path)
    counted = rows.groupBy("event_type").agg(F.count("*").alias("rows"))
    return counted.join(F.broadcast(rows.agg(F.count("*").alias("n")))).select(files.acknowledgement(F.lit("events"), F.col("n")).alias("ack"), "event_type", "rows")


@query("SELECT 'suppliers-' || left(sha256('suppliers'), 20) AS name, count(*) AS rows, sum(s_suppkey)::BIGINT AS keys FROM supplier")
def snapshot_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot published twice is written once and verified the second time."""
    rows, folder = read(spark, sf_dir, "supplier"), scratch(spark, "snapshots")
    digest = spark.range(1).select(text.digest(F.lit("suppliers")).alias("d")).first()["d"]
    files.publish(rows, folder, "suppliers", digest)
    path = files.publish(rows.orderBy(F.col("s_name").desc()), folder, "suppliers", digest)
    return spark.read.parquet(path).agg(F.lit(path.rsplit("/", 1)[-1]).alias("name"), F.count("*").alias("rows"), F.sum("s_suppkey").alias("keys"))


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p FROM nation),
    c AS (SELECT r_regionkey AS r, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS p FROM region WHERE r_regionkey % 2 = 1)
    SELECT 'region.' || r_regionkey || '.name' AS path, CASE WHEN r_regionkey = 1 THEN 'mine' ELSE r_name END AS value FROM region
    UNION ALL SELECT 'region.' || r || '.nations.' || p, k::VARCHAR FROM n
    UNION ALL SELECT 'region.' || r || '.nations.' || p, (100 + r)::VARCHAR FROM c
    UNION ALL SELECT 'region.' || r || '.office.' || p || '.id', 'n' || k FROM n
    UNION ALL SELECT 'region.' || r || '.office.' || p || '.note', CASE WHEN r % 2 = 1 AND k % 2 = 0 THEN 'mine' ELSE 'base' END FROM n
    UNION ALL SELECT 'region.' || r || '.office.' || p || x.k, x.v FROM c, (VALUES ('.id', 'new'), ('.note', 'mine')) x(k, v)
    UNION ALL SELECT 'user.on', 'true'"""
)
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required TOML layer of a file a region, an optional one that is missing, and one that adds to an array without keys and replaces items of one with keys."""
    folder, regions = scratch(spark, "toml"), read(spark, sf_dir, "region")
    r, k = text_("r_regionkey"), text_("n_nationkey")
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    in_order = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("n_nationkey", c.alias("c"))))), lambda x: x["c"]), sep)
    office = lambda ident, note: F.concat(F.lit("[[region."), r, F.lit(".office]]\nid = \""), ident, F.lit(f"\"\nnote = '{note}'\n"))
    listed = nations.groupBy("r_regionkey").agg(in_order(k, ", ").alias("keys"), in_order(office(F.concat(F.lit("n"), k), "base"), "").alias("offices"), in_order(F.when(F.col("n_nationkey") % 2 == 0, office(F.concat(F.lit("n"), k), "mine")), "").alias("mine"))
    both = regions.join(listed, "r_regionkey")
    head = F.concat(F.lit("[region."), r, F.lit("]\n"))
    base = F.concat(head, F.lit('name = "'), "r_name", F.lit('"\nnations = ['), "keys", F.lit("]\n"), "offices")
    user = F.concat(head, F.when(F.col("r_regionkey") == 1, "name = 'mine'\n").otherwise(""), F.lit("nations = ["), (F.col("r_regionkey") + 100).cast("string"), F.lit("]\n"), "mine", office(F.lit("new"), "mine"))
    # a file a region
    both.select("r_regionkey", base.alias("value")).write.partitionBy("r_regionkey").text(f"{folder}/base")
    both.where("r_regionkey % 2 = 1").select("r_regionkey", user.alias("value")).union(spark.createDataFrame([(-1, "user.on = true\n")], "r_regionkey int, value string")).write.partitionBy("r_regionkey").text(f"{folder}/user")
    leaves = files.toml_leaves(spark, [f"{folder}/base", f"{folder}/team", f"{folder}/user"])
    return layers.merge_layers(leaves.withColumn("all", F.lit(1)), ["all"]).select(F.array_join("path", ".").alias("path"), "value")


@query(
    r"""WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, '{"name":"n\"' || c_nationkey || '","open":true,"segments":[' || string_agg('{"code":"' || c_mktsegment || '"}', ',' ORDER BY c_mktsegment) || '],"stats":{"by":{' || string_agg('"' || c_mktsegment || '":' || n, ',' ORDER BY c_mktsegment)
           || '},"count":' || sum(n) || ',"none":[]}}' AS json FROM s GROUP BY 1"""
)
def canonical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's settings, tables and arrays three levels deep, as JSON with sorted keys."""
    segments = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")) - 1
    by = segments.withColumn("p", place.cast("string"))
    leaf = lambda kind, value, *path, positions=(): F.struct(F.array(*path).alias("path"), F.array(*map(F.lit, positions)).cast("array<int>").alias("positions"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    each = F.array(leaf("string", F.col("c_mktsegment"), F.lit("segments"), F.col("p"), F.lit("code"), positions=[2]), leaf("integer", F.col("n"), F.lit("stats"), F.lit("by"), F.col("c_mktsegment")))
    once = F.array(
        leaf("string", F.concat(F.lit('n"'), text_("c_nationkey")), F.lit("name")), leaf("boolean", F.lit("true"), F.lit("open")),
        leaf("integer", F.col("n"), F.lit("stats"), F.lit("count")), leaf("array", F.lit(None), F.lit("stats"), F.lit("none")),
    )
    rows = by.select("c_nationkey", F.inline(each)).union(segments.groupBy("c_nationkey").agg(F.sum("n").alias("n")).select("c_nationkey", F.inline(once)))
    return trees.canonical_json(rows, ["c_nationkey"])
