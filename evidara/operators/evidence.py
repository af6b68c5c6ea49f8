"""Quotes in documents: verification, positions, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def verify_on_page(facts: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """facts with quote_verified, quote_verified_loose (white space collapsed) and quote_position (1-based, 0 if absent): the quote must stand on the fact's own page.

    A fact without a page, quote or text is not verified.
    """
    joined = facts.join(pages.select(*page, F.col("text").alias("page_text")), page, "left")
    plain = lambda c: F.regexp_replace(F.trim(c), r"(?U)\s+", " ")
    no = F.lit(False)
    return joined.select(
        *facts.columns,
        F.coalesce(F.contains("page_text", "quote"), no).alias("quote_verified"),
        F.coalesce(F.contains(plain(F.col("page_text")), plain(F.col("quote"))), no).alias("quote_verified_loose"),
        F.coalesce(F.position("quote", "page_text"), F.lit(0)).alias("quote_position"),
    )


#: What parts tokens: a token is a run without any of these.
SEPARATORS = " \n\t\r"
#: Characters of the grams by which parts of tokens are looked up in the vocabulary.
GRAM = 3


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SEPARATORS}]+"), "")


def _grams(word: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))


def _anchors(quotes: DataFrame, held: DataFrame) -> DataFrame:
    """q, token for quotes(q, tokens) of three tokens and more. A token with separators on both sides within the quote is a token of every document that holds it; the rarest one of the rows held(token) is taken, and a quote one of whose tokens is nowhere has none."""
    inner = quotes.select("q", F.explode(F.array_distinct(F.slice("tokens", F.lit(2), F.size("tokens") - 2))).alias("token"))
    known = held.join(inner.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = inner.join(known, "token", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    return rarest.where("r.n > 0").select("q", "r.token")


def _containing(quotes: DataFrame, held: DataFrame) -> DataFrame:
    """q, token for quotes(q, tokens) of one or two tokens: the tokens of the vocabulary that contain the quote's longer one, looked up by the rarest of its grams."""
    parts = quotes.select("q", F.array_max(F.transform("tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("part"))))["part"].alias("part"))
    grams = parts.select("q", "part", F.explode(_grams(F.col("part"), F.least(F.length("part"), F.lit(GRAM)))).alias("gram"))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: n <= F.length("token"))
    within = held.distinct().select("token", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("token"), n)))).alias("gram"))
    within = cut(within.join(grams.select("gram").distinct(), "gram", "left_semi"))
    count = within.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(count, "gram").groupBy("q", "part").agg(F.min(F.struct("n", "gram")).alias("r")).select("q", "part", "r.gram")
    return rarest.join(within, "gram").where(F.contains("token", "part")).select("q", "token")


def locate_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, position (1-based, in characters) of each quote's first occurrence in each document that holds it.

    quotes(quote_id, text), docs(doc_id, text). The page is not known; documents are cut into tokens, and a quote meets
    only those that hold its rarest token, or for quotes of one or two tokens a token that contains its longer one. What
    meets is verified on the texts themselves.

    Defined cases: empty and null quotes and texts are found nowhere; a quote of separators alone meets the documents with such a
    character; quotes and documents that repeat, and null ids, have a row each.
    """
    rows = quotes.where(F.length("text") > 0).select("quote_id", F.col("text").alias("quote"))
    named = rows.withColumn("q", F.struct(F.xxhash64("quote").alias("a"), F.xxhash64(F.lit(1), "quote").alias("b")))
    asked = cut(named.select("q", "quote").distinct().withColumn("tokens", _tokens(F.col("quote"))).withColumn("kind", F.least(F.floor((F.size("tokens") + 1) / 2), F.lit(2))))
    # quotes of three tokens and more are of kind 2, of one or two of kind 1, of separators alone of kind 0
    kinds = {r["kind"] for r in asked.select("kind").distinct().collect()}
    texts = docs.select("doc_id", "text").where(F.length("text") > 0).withColumn("d", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    held = texts.select("d", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token"))
    of = lambda kind: asked.where(F.col("kind") == kind)
    anchors = [f(of(kind), held.select("token")) for kind, f in ((2, _anchors), (1, _containing)) if kind in kinds]
    met = [held.join(cut(reduce(DataFrame.union, anchors)), "token").select("q", "d")] if anchors else []
    if 0 in kinds:
        chars = texts.select("d", F.explode(F.array(*[F.when(F.contains("text", F.lit(c)), F.lit(c)) for c in SEPARATORS])).alias("char"))
        met.append(of(0).select("q", F.left("quote", F.lit(1)).alias("char")).join(chars, "char").select("q", "d"))
    met = reduce(DataFrame.union, met) if met else texts.select(F.col("d").alias("q"), "d").limit(0)
    found = texts.join(met.distinct(), "d").join(asked.select("q", "quote"), "q").select("q", "doc_id", F.position("quote", "text").cast("long").alias("position")).where("position > 0")
    return found.join(named.select("q", "quote_id"), "q").select("quote_id", "doc_id", "position")


def verify_anywhere(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, documents, verified for every quote, those found nowhere included."""
    hits = locate_quotes(quotes, docs).groupBy("quote_id").agg(F.count("*").alias("documents"))
    return quotes.select("quote_id").join(hits, "quote_id", "left").select("quote_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("documents").isNotNull().alias("verified"))


def cited_only(claims: DataFrame, citations: DataFrame, key: list[str]) -> DataFrame:
    """Claims that some citation backs."""
    return claims.join(citations, key, "left_semi")


def uncited(claims: DataFrame, citations: DataFrame, key: list[str]) -> DataFrame:
    return claims.join(citations, key, "left_anti")


def redact(text: Column, patterns: dict[str, str]) -> Column:
    """text with every match of each pattern replaced by its name in brackets."""
    return reduce(lambda c, p: F.regexp_replace(c, p[1], f"[{p[0]}]"), patterns.items(), text)
