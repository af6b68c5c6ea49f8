"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Document rates stay as close to 1 as the targets let them (least
relative entropy, no rate above CAP), so by the dual a source's rates are min(CAP, exp(lambda size)).
Newton iterations on the dual run over the (source, size) histogram, all sources at once, each with
a bracket that a step may not leave. Rates are rounded to millionths and sums are exact integers and
decimals, so reruns agree to the last copy whatever the order of rows.

Copies come from systematic rounding: in order of source, size and a hash, a document gets as many
copies as its rate carries the running sum over whole numbers. A source's taken words then differ
from its target by a part of its longest document. Running sums are over range partitions with their
offsets, so a source with a third of all documents is spread over many tasks.

Defined cases: null text is of size 0 and takes 0 words; null sources are one source, ordered last;
repeated rows are taken each on its own; a corpus without words has targets 0; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, null_safe_join, running, small

CAP = 3
MICRO = 1_000_000
TOLERANCE, ROUNDS = 1e-5, 40
PHASES = 32
WORD_BREAK = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: all sizes shared by weights 1, 2, 3, repeating, no target above CAP times its source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = running(sources, [], [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "rank")
    sources = cut(sources.withColumn("weight", (F.col("rank") - 1) % 3 + 1).drop("rank"))
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    # words for a unit of weight: it only grows as sources reach their caps
    level = None
    while True:
        capped = F.lit(False) if level is None else CAP * F.col("source_size") < F.col("weight") * F.lit(level)
        x = sources.agg(F.sum(F.when(capped, F.col("source_size"))).alias("s"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        new = (total - CAP * (x["s"] or 0)) / x["w"] if x["w"] else 0.0
        if level is not None and new <= level:
            break
        level = new
    goal = F.least(F.col("weight") * F.lit(float(level)), (CAP * F.col("source_size")).cast("double"))
    return sources.select("source", "source_size", goal.alias("target"))


def _micro(tilt: str, full: Column) -> Column:
    """The rate in millionths: min(CAP, exp(tilt * size / mean)); `full` marks sources of which every document is taken CAP times."""
    power = F.least(F.col(tilt) * F.col("size") / F.col("mean"), F.lit(2.0))
    return F.when(full, F.lit(CAP * MICRO)).otherwise(F.least(F.round(F.exp(power) * MICRO), F.lit(float(CAP * MICRO)))).cast("long")


def tilts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, mean, tilt, full: the dual's solution for each source."""
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n")).where("size > 0")
    means = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = null_safe_join(goals, means, ["source"]).select("source", "target", "mean", (F.col("target") >= CAP * F.col("source_size")).alias("full"))
    state = cut(state.select("*", F.lit(0.0).alias("tilt"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi")))
    histogram = cut(histogram)
    exact = lambda c: c.cast("decimal(38,0)")
    for _ in range(ROUNDS):
        rows = null_safe_join(histogram, state, ["source"]).select("source", "size", "n", "mean", "target", "tilt", "lo", "hi", _micro("tilt", F.col("full")).alias("micro"), "full")
        free = F.when(F.col("micro") < CAP * MICRO, F.col("micro")).otherwise(F.lit(0))
        at = rows.groupBy("source", "target", "mean", "full", "tilt", "lo", "hi").agg(
            F.sum(exact(F.col("n")) * exact(F.col("size") * F.col("micro"))).cast("double").alias("words"),
            F.sum(exact(F.col("n")) * exact(F.col("size") * F.col("size")) * exact(free)).cast("double").alias("slope"),
        )
        over = F.col("words") / MICRO > F.col("target")
        off = F.log(F.greatest(F.col("words"), F.lit(1.0)) / MICRO / F.col("target"))
        at = at.withColumns({"lo": F.when(over, F.col("lo")).otherwise(F.col("tilt")), "hi": F.when(over, F.col("tilt")).otherwise(F.col("hi")), "off": F.when(F.col("full"), F.lit(0.0)).otherwise(off)})
        step = F.col("tilt") - F.col("off") * F.col("words") * F.col("mean") / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        tilt = F.when(F.abs("off") <= TOLERANCE, F.col("tilt")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(at.select("source", "target", "mean", "full", tilt.alias("tilt"), "lo", "hi", F.abs("off").alias("off")))
        if (state.agg(F.max("off").alias("off")).first()["off"] or 0) <= TOLERANCE:
            return state.select("source", "mean", "tilt", "full")
    raise ArithmeticError(f"{ROUNDS} Newton rounds did not bring every source within {TOLERANCE} of its target")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, text, source)."""
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    goals = targets(sized)
    solved = tilts(sized, goals)
    # one row a source; where they are few, a source with a third of all rows is not dealt to one task
    sources = small(null_safe_join(goals, solved, ["source"], "left"))
    rated = null_safe_join(sized, sources, ["source"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce(_micro("tilt", F.col("full")), F.lit(MICRO)).alias("micro"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.xxhash64("doc_id").asc(), F.col("doc_id").asc()]
    summed = running(rated, ["source"], order, F.col("micro"), "upto")
    summed = cut(summed)
    # where a source's running sum begins between two whole numbers is free: of PHASES beginnings the one that comes nearest to the target is taken
    copies = lambda phase: (F.floor((F.col("upto") + phase) / MICRO) - F.floor((F.col("upto") - F.col("micro") + phase) / MICRO)).cast("long")
    begin = [k * MICRO // PHASES for k in range(PHASES)]
    totals = summed.groupBy("source").agg(*[F.sum(copies(F.lit(p)) * F.col("size")).alias(f"p{k}") for k, p in enumerate(begin)], F.first("target").alias("goal"))
    best = totals.select("source", F.array_min(F.array(*[F.struct(F.abs(F.col(f"p{k}") - F.col("goal")).alias("off"), F.lit(p).alias("phase")) for k, p in enumerate(begin)]))["phase"].alias("phase"))
    taken = null_safe_join(summed, small(best), ["source"], "left").select("doc_id", "source", "size", "source_size", "target", copies(F.col("phase")).alias("copies"))
    return taken.withColumn("taken", F.col("copies") * F.col("size"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
