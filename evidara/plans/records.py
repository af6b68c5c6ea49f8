"""Queries of the record side: audit, layers and manifests, templates, ledgers.

Events stand in for audit events (a user for a page or case), conversations for assistant writes,
customers and parts for configuration, orders and line items for usage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, evidence, layers, ledger
from .registry import query, read


@query(
    """SELECT user_id, event_id, event_type, row_number() OVER w AS seq, lag(event_type) OVER w AS previous,
           (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000 AS seconds_since
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.trail(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS status, count(*) AS events FROM events GROUP BY 1")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_status(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query(
    """WITH c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM events)
    SELECT *, in_window > 2 AS limited FROM c"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rate(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600).withColumn("limited", F.col("in_window") > 2)


@query(
    """SELECT ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS total, 100 * sum(value::DECIMAL(18,2)) >= 90 * 16000 AS alert,
           sum(value::DECIMAL(18,2)) > 16000 AS over FROM events GROUP BY 1"""
)
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.daily_cap(read(spark, sf_dir, "events"), "ts", "value", 16_000)


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh
                  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS n FROM g)
    SELECT user_id, min(us) AS started, count(*) AS events FROM s GROUP BY user_id, n"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sessions(read(spark, sf_dir, "events"), "user_id", "ts")


@query(
    """SELECT conv_id, turn, current FROM conversations JOIN (SELECT conv_id, max(turn) AS current FROM conversations GROUP BY 1) USING (conv_id)
    WHERE role = 'assistant' AND turn <> current"""
)
def stale_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return audit.stale_writes(turns.where("role = 'assistant'").drop("role"), turns, "conv_id", "turn")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g')) AS redacted_sha256 FROM documents")
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(evidence.redact(F.col("text"), {"EMAIL": EMAIL}), 256).alias("redacted_sha256"))


@query("SELECT event_id, event_type FROM events WHERE left(sha256(event_id::VARCHAR), 2) < '1a'")
def sample_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all traces, fixed by their ids' hashes."""
    return read(spark, sf_dir, "events").where(audit.sampled("event_id", 26)).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.within_retention(read(spark, sf_dir, "events"), "ts", 7).select("event_id")


@query(
    """SELECT c_custkey, 'segment' AS path, CASE WHEN c_acctbal < 0 THEN 'ON HOLD' ELSE c_mktsegment END AS value FROM customer
    UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'nation' ELSE 'nation.key' END, CASE WHEN c_acctbal > 9000 THEN 'any' ELSE c_nationkey::VARCHAR END FROM customer"""
)
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as three layers: defaults, a scalar replaced for those in debt, and a table replaced by a scalar for the rich."""
    customer = read(spark, sf_dir, "customer")
    leaf = lambda rows, layer, path, value: rows.select("c_custkey", F.lit(layer).alias("layer"), F.array(*[F.lit(p) for p in path]).alias("path"), value.cast("string").alias("value"))
    rows = (
        leaf(customer, 0, ["segment"], F.col("c_mktsegment"))
        .union(leaf(customer, 0, ["nation", "key"], F.col("c_nationkey")))
        .union(leaf(customer.where("c_acctbal < 0"), 1, ["segment"], F.lit("ON HOLD")))
        .union(leaf(customer.where("c_acctbal > 9000"), 2, ["nation"], F.lit("any")))
    )
    return layers.merge_layers(rows, ["c_custkey"]).withColumn("path", F.array_join("path", "."))


@query(
    """SELECT coalesce(p_partkey, s_suppkey * 30) AS code, coalesce(p_partkey, (SELECT max(p_partkey) + 1 FROM part) + s_suppkey) AS pos, coalesce(s_name, p_name) AS body
    FROM part FULL JOIN supplier ON p_partkey = s_suppkey * 30"""
)
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("body"))
    override = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 30).alias("code"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("body"))
    return layers.merge_keyed(base, override, "code", "pos", ["body"])


@query(
    """SELECT doc_id AS name, CASE WHEN toxic = 1 THEN 'missing' ELSE 'changed' END AS status FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0
    UNION ALL SELECT 1000000000 + item_id, 'extra' FROM benchmark"""
)
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy that lost the toxic ones, changed those of quality 0 and gained the benchmark."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    named = lambda rows, name, content: rows.select(name.alias("name"), F.sha2(content, 256).alias("sha256"))
    copy = docs.join(labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    changed = F.when(F.col("quality") == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    extra = named(read(spark, sf_dir, "benchmark"), F.col("item_id") + 1_000_000_000, F.col("text"))
    return layers.verify_manifest(named(docs, F.col("doc_id"), F.col("text")), named(copy, F.col("doc_id"), changed).union(extra), "name", "sha256")


@query(r"SELECT left(sha256(regexp_replace(trim(text), '[ \n\t\r]+', ' ', 'g')), 20) AS digest, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.regexp_replace(F.trim("text"), "[ \n\t\r]+", " ")
    return read(spark, sf_dir, "documents").groupBy(text.digest(content, 20).alias("digest")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS token FROM pages)
    SELECT token, count(*) AS uses, count(DISTINCT page_id) AS pages FROM t GROUP BY 1"""
)
def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("token"))
    by_page = found.groupBy("token", "page_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("token").agg(F.sum("n").alias("uses"), F.count("*").alias("pages"))


@query(
    """SELECT page_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', ''), ''), 'project') AS slug
    FROM pages"""
)
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


EDGES_SQL = """edges(parent, node) AS (
    SELECT 'nation' || c_nationkey, 'customer' || c_custkey FROM customer UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey FROM supplier
    UNION ALL SELECT 'region' || n_regionkey, 'nation' || n_nationkey FROM nation UNION ALL SELECT 'world', 'region' || r_regionkey FROM region)"""


@query(
    f"""WITH RECURSIVE {EDGES_SQL},
    reached(ancestor, node, depth) AS (SELECT parent, node, 1 FROM edges UNION SELECT r.ancestor, e.node, r.depth + 1 FROM reached r JOIN edges e ON r.node = e.parent)
    SELECT ancestor, node, min(depth)::INT AS depth FROM reached GROUP BY 1, 2"""
)
def dep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda name, parent, p, node, n: read(spark, sf_dir, name).select(F.concat(F.lit(parent), F.col(p).cast("string")).alias("parent"), F.concat(F.lit(node), F.col(n).cast("string")).alias("node"))
    edges = edge("customer", "nation", "c_nationkey", "customer", "c_custkey").union(edge("supplier", "nation", "s_nationkey", "supplier", "s_suppkey")).union(edge("nation", "region", "n_regionkey", "nation", "n_nationkey"))
    regions = read(spark, sf_dir, "region").select(F.lit("world").alias("parent"), F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("node"))
    return layers.closure(edges.union(regions))


@query(
    """SELECT nationkey, side, count(*) AS n FROM (
        SELECT *, 'left' AS side FROM (SELECT c_nationkey AS nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
        UNION ALL SELECT *, 'right' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)) GROUP BY 1, 2"""
)
def catalogue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    right = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return layers.differences(left, right).groupBy("nationkey", "side").agg(F.count("*").alias("n"))


CENTS_SQL = "({}::DECIMAL(18,2) * 100)::BIGINT"


@query(
    f"""WITH days AS (SELECT o_orderdate::DATE AS day, sum({CENTS_SQL.format("o_totalprice")}) AS cents FROM orders GROUP BY 1),
    budget AS (SELECT sum(cents) // count(DISTINCT date_trunc('month', day)) AS budget FROM days),
    so_far AS (SELECT day, sum(cents) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS spent FROM days)
    SELECT day, spent::BIGINT AS spent, CASE WHEN 100 * spent >= 110 * budget THEN 110 WHEN 100 * spent >= 100 * budget THEN 100 WHEN 100 * spent >= 90 * budget THEN 90 ELSE 0 END AS level,
           100 * spent * day(last_day(day)) > 110 * budget * day(day) AS forecast_over FROM so_far, budget"""
)
def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values against the mean month's."""
    orders = read(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    months = orders.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.sum(ledger.cents(F.col("o_totalprice"))).alias("c"))
    budget = months.agg(F.expr("sum(c) div count(*)").alias("budget"))
    return ledger.budget_alerts(orders, "o_orderdate", "o_totalprice", budget)


@query(
    f"""SELECT o_orderpriority, o_orderstatus, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS grouping, count(*) AS rows, sum({CENTS_SQL.format("l_extendedprice")})::BIGINT AS cents
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"""
)
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return ledger.summary(read(spark, sf_dir, "orders").join(lines, "o_orderkey"), ["o_orderpriority", "o_orderstatus"], "l_extendedprice")


@query(f"SELECT l_partkey, sum({CENTS_SQL.format('l_extendedprice')})::BIGINT AS cents FROM lineitem GROUP BY 1 ORDER BY cents DESC, l_partkey LIMIT 10")
def top_cost_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.top_drivers(read(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice", 10)


@query(
    f"""WITH u AS (SELECT l_returnflag, l_orderkey, sum({CENTS_SQL.format("l_extendedprice")}) AS c FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, count(*) AS units, sum(c)::BIGINT AS cents, round(sum(c) / count(*), 6) AS cents_per_unit FROM u GROUP BY 1"""
)
def cost_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cost_per_unit(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_extendedprice")


@query(
    """WITH r AS (SELECT source, 2 - toxic + 3 * quality AS rating, [lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END] AS categories FROM documents JOIN labels USING (doc_id)),
    e AS (SELECT source, rating, unnest(['all'] || CASE WHEN rating <= 2 THEN categories ELSE [] END) AS category FROM r)
    SELECT source, category, count(*) AS responses, round(avg(rating), 6) AS mean_rating FROM e GROUP BY 1, 2"""
)
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as epics, rated 1 to 5 by their documents' labels."""
    rated = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    kinds = F.array("lang", F.when(F.col("n_chars") > 1000, "long").otherwise("short"))
    return ledger.feedback(rated.select("source", (2 - F.col("toxic") + 3 * F.col("quality")).alias("rating"), kinds.alias("categories")), "source", "rating", "categories")
