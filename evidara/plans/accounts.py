"""Queries of accounts and access: budgets, prices, deliveries, credentials, streams.

Orders and line items stand in for epics, stories and calls, events for turns and grants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, ledger, verdict
from ..storage import scratch
from ..streaming import events as stream
from ..streaming.alerts import misdirected_write_alerts
from . import adjudication
from .registry import ORACLE_SQL, query, read

CENTS_SQL = "({}::DECIMAL(18,2) * 100)::BIGINT"


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, max(l_shipdate) AS source FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey WHERE source > o_orderdate + INTERVAL 100 DAYS")
def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (a hundred days on) older than their last shipment."""
    artefacts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")).alias("updated"))
    sources = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("updated"), F.min("l_linenumber").alias("l_linenumber"))
    return ledger.drifted(artefacts, sources, "l_orderkey", "updated").join(sources.drop("updated"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE NOT (user_id % 3 = 0 OR event_type = 'view')")
def not_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did against a list of what they may do."""
    did = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return ledger.not_allowed(did, did.where("user_id % 3 = 0 OR event_type = 'view'"), ["user_id", "event_type"])


@query(
    """SELECT event_id, EXISTS (SELECT 1 FROM events g WHERE g.user_id = u.user_id AND g.event_type = 'signup' AND g.ts <= u.ts AND u.ts - g.ts <= INTERVAL 600 MINUTES) AS valid
    FROM events u WHERE event_type = 'purchase'"""
)
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup grants its user ten hours of purchases."""
    events = read(spark, sf_dir, "events")
    grants = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("issued"))
    return audit.credentials_in_force(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), grants, ["user_id"], 600, "event_id").select("event_id", "valid")


@query(
    """WITH w AS (SELECT conv_id, turn, conv_id + (turn % 3 = 1)::INT AS record FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, max(turn) AS current FROM conversations GROUP BY 1)
    SELECT conv_id, turn, record, CASE WHEN record <> conv_id THEN 'record' ELSE 'turn' END AS reason FROM w JOIN c USING (conv_id) WHERE record <> conv_id OR turn <> current"""
)
def misdirected_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is bound to the record of its own id; every third answer writes to the next one."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    writes = turns.where("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") + (F.col("turn") % 3 == 1).cast("int")).alias("record"))
    return audit.misdirected_writes(writes, turns, turns.select("conv_id", F.col("conv_id").alias("record")).distinct(), "conv_id", "turn", "record")


@query(
    r"""WITH c AS (SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1)::INT AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'syntax' WHEN k >= 25 THEN 'id' END AS problem FROM c"""
)
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as arguments whose k must name a nation; some are cut short, some have a word for k."""
    e, props = F.col("event_id"), F.col("props")
    sent = F.when(e % 5 == 0, F.left(props, F.length(props) - 1)).when(e % 7 == 0, F.lit('{"k": "x"}')).otherwise(props)
    allowed = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return audit.checked_arguments(read(spark, sf_dir, "events").select("event_id", sent.alias("args")), "args", "k int", "k", allowed).select("event_id", "problem")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-31'")
def retiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("retires"))
    return ledger.retiring(models, "retires", "1996-01-01", 30).select("o_orderkey")


EXPECTED_SQL = "SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'refer' WHEN o_totalprice > 200000 THEN 'decline' ELSE 'loaded' END AS expected FROM orders"


@query(
    f"""WITH s AS (SELECT case_id, verdict FROM ({ORACLE_SQL["case_verdict"]})), e AS ({EXPECTED_SQL}),
    both_ AS (SELECT 'rules' AS contender, * FROM s UNION ALL SELECT 'careful', case_id, CASE WHEN verdict = 'decline' THEN 'refer' ELSE verdict END FROM s WHERE verdict <> 'standard')
    SELECT c.contender, count(*) AS cases, sum((verdict IS NOT DISTINCT FROM expected)::INT)::BIGINT AS right, round(avg((verdict IS NOT DISTINCT FROM expected)::INT), 6) AS accuracy
    FROM (VALUES ('rules'), ('careful')) c(contender) CROSS JOIN e LEFT JOIN both_ b ON b.contender = c.contender AND b.case_id = e.case_id GROUP BY 1"""
)
def verdict_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contenders against expected verdicts; the careful one refers what it would decline and leaves standard cases open."""
    suggested = adjudication.case_verdict(spark, sf_dir).select("case_id", "verdict")
    careful = F.when(F.col("verdict") == "decline", "refer").when(F.col("verdict") != "standard", F.col("verdict"))
    each = F.array(F.struct(F.lit("rules").alias("contender"), "verdict"), F.struct(F.lit("careful").alias("contender"), careful.alias("verdict")))
    both = suggested.select("case_id", F.inline(each)).where("contender = 'rules' OR verdict IS NOT NULL")
    o = read(spark, sf_dir, "orders")
    expected = F.when(F.col("o_orderstatus") == "P", "refer").when(F.col("o_totalprice") > 200_000, "decline").otherwise("loaded")
    return verdict.accuracy(both, o.select(F.col("o_orderkey").alias("case_id"), expected.alias("verdict")), ["contender"])


@query(
    f"""WITH a AS (SELECT o_orderpriority, sum({CENTS_SQL.format("o_totalprice")})::BIGINT AS actual FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1),
    b(o_orderpriority, budget) AS (VALUES ('1-URGENT', 5000000000::BIGINT), ('2-HIGH', 1::BIGINT), ('5-LOW', 700::BIGINT))
    SELECT o_orderpriority, coalesce(budget, 0) AS budget, coalesce(actual, 0) AS actual, coalesce(budget, 0) - coalesce(actual, 0) AS left, round(coalesce(actual, 0) / budget, 6) AS used FROM a FULL JOIN b USING (o_orderpriority)"""
)
def budget_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as sprints: some without a budget, one without costs."""
    spent = read(spark, sf_dir, "orders").where("o_orderpriority NOT LIKE '5%'")
    budget = spark.createDataFrame([("1-URGENT", 5_000_000_000), ("2-HIGH", 1), ("5-LOW", 700)], "o_orderpriority string, budget long")
    return ledger.against_budget(spent, budget, ["o_orderpriority"], "o_totalprice")


@query("SELECT date_trunc('month', l_shipdate)::DATE AS month, sum((round(l_quantity::DECIMAL(18,2) * l_discount::DECIMAL(18,2), 2) * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1")
def monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.monthly_cost(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "l_discount")


@query(
    f"""WITH m AS (SELECT l_returnflag, l_linestatus, sum({CENTS_SQL.format("l_extendedprice")})::BIGINT AS monthly FROM lineitem GROUP BY 1, 2)
    SELECT *, 12 * monthly AS annual, round(12 * monthly / 365, 6) AS daily, round(monthly / sum(monthly) OVER (PARTITION BY l_returnflag), 6) AS share FROM m"""
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as environments, line states as epics."""
    return ledger.estimate(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")


@query(
    """WITH c AS (SELECT o_orderpriority, l_returnflag, count(*) AS calls, sum(l_quantity::DECIMAL(18,0)) AS tokens, min(o_orderdate) AS a, max(l_shipdate) AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    p(l_returnflag, price) AS (VALUES ('A', 0.1250::DECIMAL(10,4)), ('N', 2.5000::DECIMAL(10,4)))
    SELECT o_orderpriority, sum(calls)::BIGINT AS calls, sum(CASE WHEN price IS NULL THEN calls ELSE 0 END)::BIGINT AS unpriced,
           sum(coalesce(round(tokens * price * 100, 0)::BIGINT, 0))::BIGINT AS cents, date_diff('day', min(a)::DATE, max(z)::DATE)::INT AS days FROM c LEFT JOIN p USING (l_returnflag) GROUP BY 1"""
)
def list_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls, their quantity as tokens, their flag as the model; one model has no price."""
    calls = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    prices = spark.createDataFrame([("A", "0.125"), ("N", "2.5")], "l_returnflag string, price string")
    return ledger.at_list_price(calls, prices, "o_orderpriority", "l_returnflag", "l_quantity", "o_orderdate", "l_shipdate")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def unrated_epics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return ledger.unrated(orders, orders.where("o_orderstatus = 'O'"), "o_custkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1 HAVING bool_and(l_linestatus = 'F')")
def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose lines are finished; every tenth is closed already."""
    stories = read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", "done").otherwise("open").alias("status"))
    return ledger.delivered(stories, "l_orderkey", "status", read(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey")))


@query(
    f"""WITH y AS (SELECT o_orderpriority, year(o_orderdate)::INT AS year, sum({CENTS_SQL.format("o_totalprice")})::BIGINT AS cents FROM orders GROUP BY 1, 2),
    n AS (SELECT o_orderpriority, year, sum(cents - (SELECT sum(cents) // 18 FROM y) * (2 - (year - 1992) % 3)) OVER (PARTITION BY o_orderpriority ORDER BY year) AS net FROM y)
    SELECT o_orderpriority, min(year) FILTER (net >= 0) AS payback_year FROM n GROUP BY 1"""
)
def payback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as projects; yearly costs are a share of all orders' value."""
    years = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.sum(ledger.cents(F.col("o_totalprice"))).alias("cents"))
    share = years.agg(F.expr("sum(cents) div 18").alias("part"))
    net = F.col("cents") - F.col("part") * (2 - (F.col("year") - 1992) % 3)
    return ledger.payback(years.join(F.broadcast(share)).withColumn("net", net), "o_orderpriority", "year", "net")


@query(
    f"""WITH y AS (SELECT o_orderpriority, year(o_orderdate)::INT AS year, sum({CENTS_SQL.format("o_totalprice")})::BIGINT AS gain, sum(CASE WHEN o_orderstatus = 'F' THEN {CENTS_SQL.format("o_totalprice")} ELSE 0 END)::BIGINT AS cost FROM orders GROUP BY 1, 2),
    n AS (SELECT *, sum(gain - cost) OVER w AS running_net, sum(cost) OVER w AS spent FROM y WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year))
    SELECT o_orderpriority, year, gain - cost AS net, running_net::BIGINT AS running_net, round(running_net::DOUBLE / nullif(spent, 0)::DOUBLE, 6) AS running_return FROM n"""
)
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as projects: all orders are gains, finished ones costs."""
    cents = ledger.cents(F.col("o_totalprice"))
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", cents).alias("cost"), cents.alias("gain"))
    return ledger.returns(rows, "o_orderpriority", "year", "cost", "gain")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; the pattern names a file or a folder alike."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(spark: SparkSession, out: DataFrame) -> DataFrame:
    folder = scratch(spark, "stream")
    stream.run_available(out, f"{folder}/out", f"{folder}/log")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


CLOSED_SQL = "(SELECT epoch_us(max(ts)) - 3600000000 FROM events)"


@query(
    f"""WITH d AS (SELECT epoch_us(ts) // 86400000000 * 86400000000 AS start, count(*) AS events, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1)
    SELECT * FROM d WHERE start + 86400000000 <= {CLOSED_SQL}"""
)
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of days that are over, an hour of lateness allowed."""
    return _ran(spark, stream.windowed(_events(spark, sf_dir), "ts", "value", "1 day")).select(F.unix_micros("start").alias("start"), "events", F.col("total").cast("double").alias("total"))


@query(
    f"""WITH w AS (SELECT user_id, (epoch_us(ts) // 3600000000 - k) * 3600000000 AS start FROM events, (VALUES (0), (1), (2), (3), (4), (5)) s(k))
    SELECT user_id, start, count(*) AS events FROM w WHERE start + 21600000000 <= {CLOSED_SQL} GROUP BY 1, 2 HAVING count(*) > 2"""
)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than two events in six hours, every hour."""
    return _ran(spark, stream.windowed(_events(spark, sf_dir), "ts", "value", "6 hours", slide="1 hour", keys=("user_id",)).where("events > 2")).select("user_id", F.unix_micros("start").alias("start"), "events")


@query(
    f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS n FROM g)
    SELECT user_id, min(us) AS start, count(*) AS events FROM s GROUP BY user_id, n HAVING max(us) + 1800000000 <= {CLOSED_SQL}"""
)
def stream_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, stream.session_traces(_events(spark, sf_dir), "user_id", "ts")).select("user_id", F.unix_micros("start").alias("start"), "events")


@query("SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice and counts once."""
    twice = _events(spark, sf_dir).select("event_id", "ts", "event_type").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _ran(spark, stream.deduplicated(twice, "event_id", "ts")).groupBy("event_type").agg(F.count("*").alias("events"))


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS status FROM events GROUP BY 1")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "stream")
    stream.run_updates(stream.live_status(_events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"]), f"{folder}/out", f"{folder}/log")
    return stream.latest(spark.read.parquet(f"{folder}/out"), "user_id", "status")


@query("SELECT conv_id, turn, current FROM conversations JOIN (SELECT conv_id, max(turn) AS current FROM conversations GROUP BY 1) USING (conv_id) WHERE role = 'assistant' AND turn <> current")
def stream_stale_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("current"))
    writes = _stream(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    return _ran(spark, stream.stale_write_alerts(writes, current, "conv_id", "turn"))


@query(
    """WITH w AS (SELECT conv_id, 1000 * conv_id + turn AS write_id, turn - 1 - CASE WHEN turn % 5 = 3 THEN 2 ELSE 0 END AS turn, turn AS at, conv_id + (turn % 3 = 1)::INT AS record FROM conversations WHERE role = 'assistant'),
    j AS (SELECT w.*, (SELECT max(t.turn) FROM conversations t WHERE t.conv_id = w.conv_id AND t.role = 'user' AND t.turn <= w.at) AS now,
                 (SELECT count(*) FROM conversations t WHERE t.conv_id = w.conv_id AND t.role = 'user' AND t.turn <= w.at AND t.turn % 4 = 0) AS bound FROM w)
    SELECT conv_id, write_id, turn, record, CASE WHEN bound = 0 OR record <> conv_id THEN 'record' ELSE 'turn' END AS reason FROM j WHERE bound = 0 OR record <> conv_id OR now IS NULL OR turn <> now"""
)
def stream_misdirected_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns and assistants' writes as two live streams, a turn a minute; every fourth turn binds the conversation to its record."""
    rows = _stream(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    at = lambda s: F.timestamp_seconds(s + 1_700_000_000)
    said = rows.where("role = 'user'").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.col("conv_id")).alias("record"), at(60 * F.col("turn")).alias("ts"))
    folder = scratch(spark, "alerts")
    # a tick of another conversation, years later, ends the lateness of all rows; it comes once, however many rows there are
    spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("record"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts")).write.parquet(f"{folder}/tick")
    turns = said.union(spark.readStream.schema(said.schema).parquet(f"{folder}/tick"))
    number = F.col("turn")
    writes = rows.where("role = 'assistant'").select(
        "conv_id", (1000 * F.col("conv_id") + number).alias("write_id"), (number - 1 - F.when(number % 5 == 3, 2).otherwise(0)).alias("turn"), (F.col("conv_id") + (number % 3 == 1).cast("int")).alias("record"), at(60 * number + 30).alias("ts")
    )
    alerts = misdirected_write_alerts(turns, writes, "ts")
    stream.run_stateful(alerts, f"{folder}/out", f"{folder}/log")
    return spark.read.schema(alerts.schema).parquet(f"{folder}/out")
