"""Line dedup: later copies of repeated line runs are deleted (DataFrame functions only).

Lines become IDs of 128 bits, and only lines whose ID occurs again stay in play. The suffix array over
the line sequences is built by prefix doubling and kept in its inverse form, as each place's rank:
level 0 ranks the IDs, level k + 1 sorts the pairs (rank at a place, rank 2^k lines on), and places
whose rank is unique drop out, as no other suffix follows them so far. Ranks keep the order of the
suffixes, so equal ranks of level k are neighbours in the array with a common prefix of 2^k lines at
least. The LCP interval of depth L of a suffix, all suffixes that begin with the same L lines, is the
range of the array where the level-k ranks agree both at the start and 2^k lines before the L-th
line, 2^k <= L < 2^(k+1). A run counts from MIN_WORDS words on; every such repeated run is the union
of its shortest windows of so many words, from each line forward and to each line backward, so those
windows' depths are the only ones to look up. Each interval's first member, by doc_id and place,
stays; the lines of the others are deleted. That deletes exactly the lines that lie in a later copy of
a maximal repeated run of at least MIN_WORDS words.

Ranks are given to distinct pairs after a map-side count and joined back, so a line that a third of
the documents share is one row of what is sorted, and intervals are gathered by map-side minima, not
by walking the array. A document's own lines stand together in one task, as its text did. Every level
is written down before the next, so no plan grows with the number of levels, and the joins of lines
are never broadcast, as nothing bounds them.

Defined cases: a line's words are those of size_of, parted by any white space; null text stays null and
has no lines, empty text has one empty line; rows that repeat doc_id and text are one document and
keep the same lines; a null doc_id comes before all others; extra columns are kept; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import size_of
from .tables import cut

MIN_WORDS = 20
#: A document: its doc_id (the smallest number for null) and a hash of its text.
DOC = ["doc", "key"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _doc() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("key")]


def _places(docs: DataFrame) -> DataFrame:
    """doc, key, pos, one, two (the line's ID), words of every line."""
    exploded = docs.select(*_doc(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    return exploded.select(*DOC, "pos", F.xxhash64("line").alias("one"), F.xxhash64(F.length("line"), F.lit(1), F.col("line")).alias("two"), size_of(F.col("line")).alias("words"))


def _ranked(pairs: DataFrame, *others: str) -> DataFrame:
    """doc, key, pos, rank, others over pairs(doc, key, pos, one, two, others): ranks in the order of (one, two), for pairs that occur at least twice."""
    distinct = pairs.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    # sorted ranges, numbered by range and row: an order, if not without gaps
    ranks = distinct.repartitionByRange("one", "two").sortWithinPartitions("one", "two").select("one", "two", F.monotonically_increasing_id().alias("rank"))
    return pairs.join(cut(ranks).hint("merge"), ["one", "two"]).select(*DOC, "pos", "rank", *others)


def _active(places: DataFrame) -> DataFrame:
    """doc, key, pos, rank, words, run (of lines in play that follow each other) of lines that occur again; repeated rows once."""
    order = Window.partitionBy(*DOC).orderBy("pos")
    once = _ranked(places, "words").withColumn("before", F.lag("pos").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("pos"))).drop("before")
    return once.withColumn("run", F.col("pos") - F.row_number().over(order))


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """doc, key, pos, length, level: the shortest windows of min_words words from each line and to each line, within runs of lines in play."""
    run = Window.partitionBy(*DOC, "run").orderBy("pos")
    at = F.coalesce(F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = active.withColumns({"at": at, "last": F.lead("pos").over(run).isNull()})
    # points between lines: one before each line, and one after a run's last
    point = lambda pos, at: F.struct(pos.alias("pos"), at.alias("at"))
    points = F.when(F.col("last"), F.array(point(F.col("pos"), F.col("at")), point(F.col("pos") + 1, F.col("at") + F.col("words")))).otherwise(F.array(point(F.col("pos"), F.col("at"))))
    points = placed.select(*DOC, "run", F.inline(points))
    # words between two points: RANGE frames that only grow, so a document's points cost one pass
    ends = Window.partitionBy(*DOC, "run").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    starts = Window.partitionBy(*DOC, "run").orderBy("at").rangeBetween(Window.unboundedPreceding, -min_words)
    both = points.select(*DOC, "pos", F.min("pos").over(ends).alias("end"), F.max("pos").over(starts).alias("begin"))
    pairs = both.select(*DOC, F.inline(F.array(F.struct("pos", F.col("end").alias("e")), F.struct(F.col("begin").alias("pos"), F.col("pos").alias("e")))))
    lengths = pairs.select(*DOC, "pos", (F.col("e") - F.col("pos")).alias("length")).where("length > 0")
    return lengths.distinct().withColumn("level", (F.length(F.bin("length")) - 1).cast("int"))


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """The ranks of the next level from those of prefixes of `step` lines."""
    further = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step)
    pairs = ranks.select(*DOC, "pos", F.col("rank").alias("one"), F.max("rank").over(further).alias("two")).where(F.col("two").isNotNull())
    return cut(_ranked(pairs))


def _later(windows: DataFrame, ranks: DataFrame, level: int) -> DataFrame:
    """Of a level's windows, those that are not the first of their LCP interval."""
    own = windows.where(F.col("level") == level).withColumn("tail", F.col("pos") + F.col("length") - (1 << level))
    own = own.join(ranks.select(*DOC, "pos", F.col("rank").alias("front")).hint("merge"), [*DOC, "pos"])
    if level:
        own = own.join(ranks.select(*DOC, F.col("pos").alias("tail"), F.col("rank").alias("back")).hint("merge"), [*DOC, "tail"])
    else:
        own = own.withColumn("back", F.col("front"))
    own = cut(own)
    interval = ["length", "front", "back"]
    place = F.struct(*DOC, "pos")
    first = own.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return cut(own.join(first.drop("n").hint("merge"), interval).where(place != F.col("first")).select(*DOC, "pos", "length"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, key, removed: array of struct(start, end) of lines, disjoint and in order; documents that lose lines only."""
    active = cut(_active(cut(_places(docs.where("text is not null")))))
    windows = cut(_windows(active, min_words))
    # at most 31 levels, as an array holds so many lines
    levels = sorted(r["level"] for r in windows.select("level").distinct().collect())
    ranks, later = active.select(*DOC, "pos", "rank"), []
    for level in range(levels[-1] + 1 if levels else 0):
        if level:
            ranks = _doubled(ranks, 1 << (level - 1))
        if level in levels:
            later.append(_later(windows, ranks, level))
    found = reduce(DataFrame.union, later) if later else windows.select(*DOC, "pos", "length").limit(0)
    spans = found.select(*DOC, "pos", (F.col("pos") + F.col("length")).alias("end"))
    before = Window.partitionBy(*DOC).orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = spans.withColumn("new", (F.col("pos") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    joined = opens.withColumn("span", F.sum("new").over(Window.partitionBy(*DOC).orderBy("pos", "end")))
    merged = joined.groupBy(*DOC, "span").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return cut(merged.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with every column, and text without the lines that are deleted; documents that lose all their lines go."""
    removed = deletions(docs.select("doc_id", "text"), min_words)
    # the whole row is one column beside the join's, so no extra column can clash
    rows = docs.select(F.struct("*").alias("row"), *_doc())
    inside = lambda i: F.exists("removed", lambda r: (r["start"] <= i) & (i < r["end"]))
    kept = F.filter(_lines(F.col("row.text")), lambda _, i: ~inside(i))
    out = rows.join(removed, DOC, "left").select("row", F.when(F.col("removed").isNotNull(), kept).alias("kept")).where(F.col("kept").isNull() | (F.size("kept") > 0))
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (start:end of line runs, comma-joined) for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    text = F.col("text")
    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    small = docs.select("doc_id", *_doc(), lines.cast("long").alias("n_lines"))
    out = small.join(deletions(docs), DOC, "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>"))
    count = F.aggregate(removed, F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", "n_lines", count.cast("long").alias("n_removed"), F.array_join(F.transform(removed, lambda r: F.concat(r["start"].cast("string"), F.lit(":"), r["end"].cast("string"))), ",").alias("removed"))
