"""PII detection and information-theoretic sanitisation.

Base entities are e-mail addresses, IPv4 addresses, card and phone numbers found by pattern. Terms
that stand near an entity may give it away: over all documents, with p the share of documents,
PMI(entity, term) = log2 p(entity, term) / (p(entity) p(term)), and its ratio to the entity's own
information -log2 p(entity) is how much of the entity the term discloses (1: the term never stands
anywhere else). Terms at or above GENERALISE in at least MIN_SUPPORT documents are replaced by a
mark, those at or above REMOVE are deleted, wherever they stand: near the entity, away from it and in
documents without it, but for places inside an entity.

A pair (entity, term) is counted once a document, from a window of WINDOW words on each side, so
the pairs grow with the entities' mentions and not with the square of anything. A second pass over
the texts finds the places: a bit table of fixed size lets all disclosing terms through and few
others, and a join on the term settles it.

A word is a run of ASCII letters and non-ASCII characters, however long; in scripts without blanks a
whole run is one word. Pairs that only one document holds (MIN_SUPPORT) disclose nothing, so what adds
terms is an entity that several documents name.

Defined cases: null text counts as empty and has no spans; a null doc_id is kept; repeated rows are
documents of their own (and support each other); extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.words import ascii_lower
from .tables import bit_table, cut, small

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
MIN_SUPPORT, GENERALISE, REMOVE = 2, 0.75, 0.95
MIN_TERM = 3
TABLE_BITS = 22

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the head of a run of digits, so the look-behind changes no match but keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: for each @ in turn, the run before it down to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def entities(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def outside(found: dict[str, list[tuple[int, int]]]) -> Callable[[int, int], bool]:
    """Whether a span lies outside all entities."""
    taken: list[list[int]] = []  # disjoint, in order
    for s, e in sorted(s for spans in found.values() for s in spans):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    stops = [e for _, e in taken]
    return lambda s, e: (i := bisect_right(stops, s)) == len(taken) or taken[i][0] >= e


def lowered(text: str) -> str:
    """A-Z lower-cased; no place moves."""
    return text.encode().lower().decode()


def nearby(text: str, found: dict[str, list[tuple[int, int]]]) -> list[tuple[str, str]]:
    """(entity, term) of the terms among the WINDOW words before and after each entity and outside all entities."""
    free = outside(found)
    words = [m.span() for m in TERM.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    out = []
    for kind, spans in found.items():
        for a, b in spans:
            entity = f"{kind}:{hashlib.md5(text[a:b].encode(errors='replace')).hexdigest()}"
            # a run of letters that goes on beside the entity counts as the word next to it
            before, after = bisect_right(ends, a), bisect_left(starts, b)
            for s, e in words[max(0, before - WINDOW) : before] + words[after : after + WINDOW]:
                if e - s >= MIN_TERM and free(s, e):
                    out.append((entity, text[s:e].translate(LOWER)))
    return out


def occurrences(text: str, found: dict[str, list[tuple[int, int]]], table: bytes) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms that the bit table lets through, outside all entities."""
    low = lowered(text)
    hits = set()
    for t in set(TERM.findall(low)):
        if len(t) >= MIN_TERM:
            bit = crc32(t.encode()) & (1 << TABLE_BITS) - 1
            if table[bit >> 3] >> (bit & 7) & 1:
                hits.add(t)
    if not hits:
        return []
    free = outside(found)
    return [(m[0], *m.span()) for m in TERM.finditer(low) if m[0] in hits and free(*m.span())]


FOUND = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, hits array<struct<term:string,start:int,end:int>>"
NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
HITS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near, the distinct pairs of a row, for rows that have any."""
    for b in batches:
        near = []
        for text in b.column("text"):
            text = text.as_py() or ""
            if any((found := entities(text)).values()) and (pairs := set(nearby(text, found))):
                near.append([{"entity": n, "term": t} for n, t in pairs])
        yield pa.RecordBatch.from_arrays([pa.array(near, NEAR)], ["near"])


def _find(batches: Iterator[pa.RecordBatch], keep_text: bool, table: bytes | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        base, hits = [], []
        for text in b.column("text"):
            text = text.as_py() or ""
            found = entities(text)
            for k, kind in enumerate(KINDS):
                counts[k].append(len(found[kind]))
            base.append(",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in found[kind]))
            hits.append([{"term": t, "start": s, "end": e} for t, s, e in occurrences(text, found, table)] if table else [])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(hits, HITS), *[b.column("text")] * keep_text],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base", "hits", *["text"] * keep_text],
        )


def disclosing(docs: DataFrame) -> DataFrame:
    """term, action for every term that discloses an entity; the entity it discloses most decides.

    All counts are over all documents and are summed in the map tasks first, so neither a common
    word nor an entity that a third of the documents share meets in one task.
    """
    # the row's key is fixed by writing it down
    near = cut(docs.select("text").mapInArrow(_near, "near array<struct<entity:string,term:string>>").withColumn("row", F.monotonically_increasing_id()))
    once = near.select(F.explode("near").alias("x"), "row").select("row", "x.*")
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= MIN_SUPPORT)
    holders = once.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    pairs = cut(pairs.join(holders, "entity"))
    term = F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), NOT_TERM)))
    # where the terms in question are few, the others leave the texts' own tasks no more
    terms = docs.select(term.alias("term")).join(small(pairs.select("term").distinct()), "term", "left_semi")
    frequency = terms.groupBy("term").agg(F.count("*").alias("with_term"))
    n = docs.count()
    pmi = F.log2(F.col("both") * F.lit(float(max(n, 1))) / (F.col("with_entity") * F.col("with_term")))
    own = F.log2(F.lit(float(max(n, 1))) / F.col("with_entity"))
    ratio = pairs.join(frequency, "term").select("term", F.when(own > 0, pmi / own).alias("ratio")).where(F.col("ratio") >= GENERALISE)
    return ratio.groupBy("term").agg(F.when(F.max("ratio") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """row (a key of the input row), doc_id, n_<kind>, base (kind:start:end, comma-joined), terms (array of start, end, action), and text if kept."""
    docs = docs.select("doc_id", "text")
    actions = small(disclosing(docs))
    table = bit_table(actions.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << TABLE_BITS)).alias("bit")), TABLE_BITS)
    # the row's key is fixed by writing it down
    found = cut(docs.mapInArrow(lambda batches: _find(batches, keep_text, table), FOUND + ", text string" * keep_text).withColumn("row", F.monotonically_increasing_id()))
    # a term may stand in a third of the documents: short lists are joined without dealing by term
    places = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*").join(actions, "term")
    # a document's terms are as many as it has words
    terms = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    return found.drop("hits").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with every entity replaced by [KIND] and every disclosing term by [TERM] or nothing."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, base, terms in zip(b.column("text").to_pylist(), b.column("base").to_pylist(), b.column("terms").to_pylist(), strict=True):
                marks = [(int(s), int(e), f"[{kind.upper()}]") for kind, s, e in (x.split(":") for x in base.split(",") if x)]
                marks += [(t["start"], t["end"], "" if t["action"] == "remove" else "[TERM]") for t in terms]
                parts, last = [], 0
                for s, e, mark in sorted(marks):
                    if s >= last:  # of overlapping spans the first replaces
                        parts += [text[last:s], mark]
                    last = max(last, e)
                out.append(None if text is None else "".join([*parts, text[last:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return find(docs, keep_text=True).mapInArrow(clean, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document as joined strings."""
    terms = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))), ",")
    return find(docs).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))
