"""Queries of the document path: votes, gate, quotes, retrieval, rules, verdicts, scoreboards.

The driver's tables stand in for the domain's: an order is a page (or a case), its line items are the
classifier's runs (or the extracted facts), documents are pages, benchmark items are quotes, and a
vector's id names a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, gate, retrieve, verdict
from ..storage import cut, dealt
from .registry import query, read

MEDICAL = ["A", "N"]

MAJORITY_SQL = """
votes AS (SELECT l_orderkey, l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2),
majority AS (SELECT l_orderkey, first(label ORDER BY n DESC, label) AS label, max(n) AS agree, sum(n)::BIGINT AS runs FROM votes GROUP BY 1),
routed AS (SELECT *, CASE WHEN 10 * agree >= 9 * runs AND label IN ('A', 'N') THEN 'extract'
                          WHEN 10 * agree >= 9 * runs THEN 'ask_customer' ELSE 'triage' END AS route FROM majority)
"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = gate.vote_confidence(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")
    return pages.withColumn("route", gate.route(F.col("agree"), F.col("runs"), F.col("label").isin(MEDICAL)))


@query(f"WITH {MAJORITY_SQL} SELECT route, count(*) AS pages FROM routed GROUP BY 1")
def gate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).groupBy("route").agg(F.count("*").alias("pages"))


@query(f"WITH {MAJORITY_SQL} SELECT l_orderkey, label, agree, runs, round(agree / runs, 6) AS confidence FROM majority")
def page_vote_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = gate.vote_confidence(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")
    return pages.withColumn("confidence", F.round(F.col("agree") / F.col("runs"), 6))


@query(
    f"""WITH {MAJORITY_SQL},
    decided AS (SELECT r.*, CASE WHEN o_orderstatus = 'F' THEN CASE route WHEN 'ask_customer' THEN 'keep' ELSE 'accept' END
                                 WHEN o_orderstatus = 'O' THEN CASE route WHEN 'ask_customer' THEN 'discard' ELSE 'deny' END END AS decision
                FROM routed r LEFT JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, route, decision,
           CASE WHEN route = 'extract' THEN 'extract'
                WHEN route = 'ask_customer' AND decision = 'discard' THEN 'removed'
                WHEN route = 'ask_customer' AND decision = 'keep' THEN 'triage'
                WHEN route = 'triage' AND decision = 'accept' THEN 'extract'
                WHEN route = 'triage' AND decision = 'deny' THEN 'removed' ELSE route END AS outcome
    FROM decided"""
)
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    asked, status = F.col("route") == gate.ASK, F.col("o_orderstatus")
    decision = F.when(status == "F", F.when(asked, "keep").otherwise("accept")).when(status == "O", F.when(asked, "discard").otherwise("deny"))
    decided = _routed(spark, sf_dir).join(orders, "l_orderkey", "left").withColumn("decision", decision)
    return decided.select("l_orderkey", "route", "decision", gate.outcome(F.col("route"), F.col("decision")).alias("outcome"))


@query(
    f"""WITH {MAJORITY_SQL}
    SELECT l_orderkey AS page_id, label, agree, runs, concat(agree, ' of ', runs, ' runs agree') AS reason FROM routed WHERE route = 'triage'"""
)
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.triage_queue(_routed(spark, sf_dir).withColumnRenamed("l_orderkey", "page_id"))


@query(
    f"""WITH {MAJORITY_SQL}
    SELECT l_orderkey, concat('This looks like a ', label, ' (', (100 * agree) // runs, '%). Do you want to keep it?') AS prompt
    FROM routed WHERE route = 'ask_customer'"""
)
def customer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _routed(spark, sf_dir).where(F.col("route") == gate.ASK)
    return asked.select("l_orderkey", gate.customer_prompt(F.col("label"), F.col("agree"), F.col("runs")).alias("prompt"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")


@query(
    """SELECT item_id AS quote_id, count(doc_id) AS documents, count(doc_id) > 0 AS verified
    FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY item_id"""
)
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.verify_anywhere(_quotes(spark, sf_dir), read(spark, sf_dir, "documents"))


@query("SELECT item_id AS quote_id, doc_id, instr(d.text, b.text)::BIGINT AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> ''")
def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.locate_quotes(_quotes(spark, sf_dir), read(spark, sf_dir, "documents"))


@query(
    r"""WITH facts AS (SELECT d.doc_id AS fact_id, split(d.text, chr(10))[-1] AS quote, d.doc_id + 1 - l.quality AS page
                       FROM documents d JOIN labels l USING (doc_id))
    SELECT fact_id, coalesce(contains(p.text, quote), false) AS quote_verified,
           coalesce(contains(regexp_replace(trim(p.text), '\s+', ' ', 'g'), regexp_replace(trim(quote), '\s+', ' ', 'g')), false) AS quote_verified_loose,
           coalesce(instr(p.text, quote), 0)::INT AS quote_position
    FROM facts LEFT JOIN documents p ON p.doc_id = page"""
)
def quote_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document's last line as a quote; those of quality 0 cite the page after their own."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    facts = docs.join(labels, "doc_id").select(F.col("doc_id").alias("fact_id"), F.element_at(F.split("text", "\n"), -1).alias("quote"), (F.col("doc_id") + 1 - F.col("quality")).alias("page"))
    checked = evidence.verify_on_page(facts, docs.select(F.col("doc_id").alias("page"), "text"), ["page"])
    return checked.select("fact_id", "quote_verified", "quote_verified_loose", "quote_position")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS cited FROM documents")
def citations_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    cited = evidence.cited_only(docs, labels, ["doc_id"]).withColumn("cited", F.lit(True))
    return cited.union(evidence.uncited(docs, labels, ["doc_id"]).withColumn("cited", F.lit(False)))


def _top_sql(name: str, which: str) -> str:
    return f"""
{name}_s AS (SELECT q.vec_id AS query_id, r.vec_id AS rule_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
             FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND {which}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id)::INT AS rank FROM {name}_s QUALIFY rank <= 5)
"""


KEYWORD_SQL = r"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
terms AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM words) GROUP BY ALL),
holders AS (SELECT term, count(*) AS df FROM terms GROUP BY 1),
asked AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda x: x <> '')) AS term FROM benchmark),
keyword_s AS (SELECT item_id AS query_id, doc_id AS rule_id,
                     round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
              FROM terms JOIN holders USING (term) JOIN asked USING (term), corpus GROUP BY 1, 2),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id)::INT AS rank FROM keyword_s QUALIFY rank <= 5)
"""
ASKED_SQL = "q.vec_id IN (SELECT item_id FROM benchmark)"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rule_id"), "embedding")


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as facts: an item's vector is the one with its id."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    queries = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "query_id").join(items, "query_id", "left_semi")
    return retrieve.vector_top_k(queries, _rules(spark, sf_dir), 5)


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.keyword_top_k(queries, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rule_id"), "text"), 5)


@query(f"WITH {_top_sql('vector', 'q.vec_id % 50 = 0')} SELECT * FROM vector")
def retrieve_vector_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are the vectors whose id is divisible by 50, against all rules."""
    queries = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieve.vector_top_k(queries, _rules(spark, sf_dir), 5)


@query(f"WITH {KEYWORD_SQL} SELECT * FROM keyword")
def retrieve_keyword_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir)


@query(
    f"""WITH {KEYWORD_SQL}, {_top_sql("vector", ASKED_SQL)},
    fused AS (SELECT query_id, rule_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM keyword UNION ALL SELECT * FROM vector) GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id)::INT AS rank FROM fused QUALIFY rank <= 5"""
)
def retrieve_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.hybrid([_keyword(spark, sf_dir), _vector(spark, sf_dir)], 5)


@query(
    f"""WITH {KEYWORD_SQL}, {_top_sql("vector", ASKED_SQL)}
    SELECT query_id, rule_id, k.rank AS rank_a, v.rank AS rank_b, k.rank IS DISTINCT FROM v.rank AS differs FROM keyword k FULL JOIN vector v USING (query_id, rule_id)"""
)
def retriever_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.compare(_keyword(spark, sf_dir), _vector(spark, sf_dir))


@query(
    f"""WITH {_top_sql("vector", "q.vec_id % 50 = 0")},
    hit AS (SELECT DISTINCT query_id FROM vector JOIN embeddings r ON r.vec_id = rule_id JOIN embeddings q ON q.vec_id = query_id AND q.label = r.label)
    SELECT count(*) AS cases, round(avg((vec_id IN (SELECT query_id FROM hit))::INT), 6) AS recall FROM embeddings WHERE vec_id % 50 = 0"""
)
def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's own label is the expected rule, the labels of its five hits are those retrieved."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    expected = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("label").alias("rule_id"))
    hits = retrieve_vector_top5(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.col("rule_id").alias("vec_id")).join(labels, "vec_id")
    return retrieve.recall(expected, hits.select("case_id", F.col("label").alias("rule_id")), "case_id")


@query(
    f"""WITH {KEYWORD_SQL}, {_top_sql("vector", ASKED_SQL)},
    hits AS (SELECT 'keyword' AS contender, * FROM keyword UNION ALL SELECT 'vector', * FROM vector),
    expected AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> ''),
    missed AS (SELECT DISTINCT contender, item_id FROM expected CROSS JOIN (VALUES ('keyword'), ('vector')) c(contender)
               WHERE (contender, item_id, doc_id) NOT IN (SELECT (contender, query_id, rule_id) FROM hits)),
    cases AS (SELECT count(DISTINCT item_id) AS n FROM expected)
    SELECT contender, (SELECT n FROM cases) AS cases,
           round(1 - (SELECT count(*) FROM missed m WHERE m.contender = h.contender) / (SELECT n FROM cases), 6) AS recall,
           avg((query_id * 7 + rank * 13) % 50) AS latency_mean, quantile_cont((query_id * 7 + rank * 13) % 50, 0.5) AS latency_p50,
           round(quantile_cont(((query_id * 7 + rank * 13) % 50)::DOUBLE, 0.95), 6) AS latency_p95
    FROM hits h GROUP BY 1"""
)
def scoreboard_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the documents that hold a quote, and latency (a stand-in computed from ids) for each retriever."""
    # both are used more than once, and hold a row a quote and document, and five a query
    expected = cut(quote_locate(spark, sf_dir).select(F.col("quote_id").alias("case_id"), F.col("doc_id").alias("rule_id")))
    board = None
    for name, hits in (("keyword", cut(_keyword(spark, sf_dir))), ("vector", cut(_vector(spark, sf_dir)))):
        found = retrieve.recall(expected, hits.select(F.col("query_id").alias("case_id"), "rule_id"), "case_id")
        ms = (F.col("query_id") * 7 + F.col("rank") * 13) % 50
        speed = hits.agg(F.avg(ms).alias("latency_mean"), F.percentile(ms, 0.5).alias("latency_p50"), F.round(F.percentile(ms, 0.95), 6).alias("latency_p95"))
        # each side is one row
        row = found.join(F.broadcast(speed)).select(F.lit(name).alias("contender"), "*")
        board = row if board is None else board.union(row)
    return board


# Rule, impairment, lower bound, upper bound, action, debit in percent.
RULES = [("R1", "R", 45.0, None, "decline", 0), ("R2", "R", 30.0, 45.0, "debit", 50), ("R3", "R", 10.0, 30.0, "debit", 25), ("R4", "A", 40.0, None, "debit", 30), ("R5", "A", 48.0, None, "decline", 0)]
RULES_SQL = f"rules(rule_id, impairment, lo, hi, action, debit_pct) AS (VALUES {', '.join(str(r).replace('None', 'NULL') for r in RULES)})"
TRIGGERED_SQL = "(lo IS NULL OR l_quantity >= lo) AND (hi IS NULL OR l_quantity < hi)"


def _manual(spark: SparkSession) -> DataFrame:
    """Five rules, carried to the facts: a join by impairment would have three tasks."""
    return F.broadcast(spark.createDataFrame(RULES, "rule_id string, impairment string, lo double, hi double, action string, debit_pct int"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("impairment"), F.col("l_quantity").alias("value"))
    return dealt(facts, "case_id")


@query(f"WITH {RULES_SQL} SELECT rule_id, action, count(*) AS facts, count(DISTINCT l_orderkey) AS cases FROM lineitem JOIN rules ON l_returnflag = impairment AND {TRIGGERED_SQL} GROUP BY 1, 2")
def rule_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = verdict.triggered(_facts(spark, sf_dir), _manual(spark))
    by_case = hits.groupBy("rule_id", "action", "case_id").agg(F.count("*").alias("n"))
    return by_case.groupBy("rule_id", "action").agg(F.sum("n").alias("facts"), F.count("*").alias("cases"))


@query(
    f"""WITH {RULES_SQL},
    hits AS (SELECT l_orderkey AS case_id, impairment, rule_id, action, debit_pct, {TRIGGERED_SQL} AS triggered FROM lineitem JOIN rules ON l_returnflag = impairment),
    by_impairment AS (SELECT case_id, impairment, max((triggered AND action = 'decline')::INT) AS decline, count(DISTINCT CASE WHEN triggered THEN action END) AS actions,
                             sum(CASE WHEN triggered AND action = 'debit' THEN debit_pct ELSE 0 END) AS debit FROM hits GROUP BY 1, 2),
    by_case AS (SELECT case_id, max(decline) AS decline, max(actions) AS actions, sum(debit)::BIGINT AS debit FROM by_impairment GROUP BY 1),
    reasons AS (SELECT case_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids FROM hits WHERE triggered GROUP BY 1),
    judged AS (SELECT o_orderkey AS case_id, debit, rule_ids, CASE WHEN actions IS NULL OR actions > 1 OR o_orderstatus = 'P' THEN 'refer'
                      WHEN decline = 1 THEN 'decline' WHEN debit > 0 THEN 'loaded' ELSE 'standard' END AS verdict
               FROM orders LEFT JOIN by_case ON o_orderkey = by_case.case_id LEFT JOIN reasons ON o_orderkey = reasons.case_id)
    SELECT case_id, verdict, CASE WHEN verdict = 'loaded' THEN debit ELSE 0 END AS loading_pct, coalesce(rule_ids, '') AS rule_ids FROM judged"""
)
def case_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases; those of status P hold an unverified deciding fact."""
    orders = read(spark, sf_dir, "orders")
    retrieved = _facts(spark, sf_dir).join(_manual(spark).withColumnRenamed("impairment", "of"), F.col("impairment") == F.col("of"))
    hits = retrieved.withColumn("triggered", verdict.in_band(F.col("value")))
    unverified = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("case_id"))
    out = verdict.verdicts(orders.select(F.col("o_orderkey").alias("case_id")), hits, unverified)
    return out.withColumn("rule_ids", F.array_join("rule_ids", ","))


@query(
    """WITH runs AS (SELECT 'by_flag' AS contender, l_orderkey, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL
                     UNION ALL SELECT 'by_status', l_orderkey, l_linestatus, count(*) FROM lineitem GROUP BY ALL),
    best AS (SELECT contender, l_orderkey, first(label ORDER BY n DESC, label) AS label, max(n) AS agree, sum(n) AS runs FROM runs GROUP BY 1, 2),
    judged AS (SELECT contender, 10 * agree >= 9 * runs AS sure, ((label IN ('A', 'N', 'F')) = (o_orderstatus <> 'O'))::INT AS ok FROM best JOIN orders ON l_orderkey = o_orderkey),
    board AS (SELECT contender, count(*) AS pages, round(avg(ok), 6) AS accuracy, round(avg(CASE WHEN sure THEN ok END), 6) AS calibration,
                     round(avg(CASE WHEN sure THEN 0.0 ELSE 1.0 END), 6) AS queue_rate FROM judged GROUP BY 1)
    SELECT *, contender = (SELECT first(contender ORDER BY accuracy DESC, contender) FROM board) AS winner FROM board"""
)
def scoreboard_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "O").alias("expected"))
    page = ["l_orderkey"]

    def judged(label: str) -> gate.Classifier:
        """Each contender's pages meet the orders where they lie; after their union they would have to be dealt again."""
        return lambda votes: gate.voted(page, label)(votes).join(orders, page)

    pages = gate.contenders(votes, {"by_flag": judged("l_returnflag"), "by_status": judged("l_linestatus")})
    # two rows, used twice
    scores = cut(verdict.classifier_scores(pages.withColumn("medical", F.col("label").isin(*MEDICAL, "F"))))
    return verdict.winner(scores, "accuracy")
