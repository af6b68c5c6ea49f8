"""Queries of pages, owned reads, settings of unknown shape and latency sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latency, ownership, variants
from ..sources import pages
from .registry import query, read


@query(
    """SELECT doc_id, (k + 1)::INT AS page_no, (k * 1000)::INT AS start, sha256(substr(text, (k * 1000 + 1)::BIGINT, 1000)) AS page_sha256
    FROM documents, LATERAL (SELECT unnest(generate_series(0, (length(text) - 1) // 1000)) AS k) WHERE length(text) > 0"""
)
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, in pages of a thousand characters."""
    return pages.paged(read(spark, sf_dir, "documents"), ["doc_id"], 1000).select("doc_id", "page_no", "start", F.sha2("page", 256).alias("page_sha256"))


@query(
    """SELECT caller, r.k AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 404 ELSE 200 END AS status, o_totalprice FROM (VALUES (1), (4), (7)) c(caller)
    CROSS JOIN (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey < 100) r LEFT JOIN orders ON o_orderkey = r.k AND o_custkey % 10 = caller"""
)
def owned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three callers ask for every order, and for some that are not there; each owns those of a tenth of the customers."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 10).alias("owner"))
    ownership.owned_view(orders, "owned_orders", "owner")
    asked = orders.select("o_orderkey").union(orders.where("o_orderkey < 100").select(-F.col("o_orderkey") - 1))

    def of(caller: int) -> DataFrame:
        ownership.set_caller(spark, str(caller))
        return ownership.answers(asked, "owned_orders", "o_orderkey").select(F.lit(caller).alias("caller"), "o_orderkey", "status", "o_totalprice")

    return reduce(DataFrame.union, [of(c) for c in (1, 4, 7)])


@query(
    """SELECT c_custkey, 'contact.name' AS path, '"' || c_name || '"' AS json FROM customer UNION ALL SELECT c_custkey, 'contact.nation.key', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'tags', '["' || c_mktsegment || '",null]' FROM customer UNION ALL SELECT c_custkey, 'none', 'null' FROM customer"""
)
def variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON settings of which a third lack a table; a missing path has no row, and one that holds null has."""
    c = read(spark, sf_dir, "customer")
    nation = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(',"nation":{"key":'), F.col("c_nationkey").cast("string"), F.lit("}"))).otherwise("")
    json = F.concat(F.lit('{"contact":{"name":"'), "c_name", F.lit('"'), nation, F.lit('},"tags":["'), "c_mktsegment", F.lit('",null],"none":null}'))
    return variants.at_paths(c.select("c_custkey", F.parse_json(json).alias("v")), ["c_custkey"], "v", ["contact.name", "contact.nation.key", "tags", "none", "contact.name.deeper"])


@query(
    """SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey))::INT AS pos, 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'c' || c_custkey ELSE c_name END AS name,
           CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Ask ' || c_name END AS instruction, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS "when"
    FROM nation JOIN customer ON c_nationkey = n_nationkey"""
)
def layer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as a JSON list of layer tables, checked and taken apart."""
    c = read(spark, sf_dir, "customer")
    ident = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    item = F.struct(ident.alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("Ask "), "c_name")).alias("instruction"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("when"))
    lists = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("i")))), lambda x: x["i"]).alias("items"))
    tables = variants.layer_tables(F.parse_json(F.to_json("items")), "layers")
    return lists.select("n_nationkey", F.posexplode(tables).alias("pos", "t")).select("n_nationkey", (F.col("pos") + 1).alias("pos"), "t.*")


@query(
    """WITH e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, true AS p50_close, true AS p95_close FROM e GROUP BY 1"""
)
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as latencies, sketched by day and merged by type; the quantiles' true ranks are within two hundredths."""
    e = read(spark, sf_dir, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    merged = latency.merged(latency.sketched(e, ["event_type", "day"], "value"), ["event_type"])
    found = latency.quantiles(merged, {"p50": 0.5, "p95": 0.95}).select("event_type", "n", "p50", "p95")
    # a row a type
    ranks = e.where("value is not null").join(F.broadcast(found), "event_type").groupBy("event_type", "n").agg(*[(F.count_if(F.col("value") <= F.col(p)) / F.first("n") - share).alias(p) for p, share in (("p50", 0.5), ("p95", 0.95))])
    return ranks.select("event_type", "n", *[(F.abs(p) <= 0.02).alias(f"{p}_close") for p in ("p50", "p95")])
