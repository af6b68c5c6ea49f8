"""Append-only event analytics: trails, rate limits, sessions, caps, stale writes, credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trail(events: DataFrame, case: str, action: str, ts: str, tie: str) -> DataFrame:
    """Events of each case in order, with their number, the action before and the seconds since it.

    Windows run within a case's day. What a day needs of the days before it (how many events, the
    last one) is one row a case and day, so a case with a third of all events is spread over its days.
    """
    events = events.select(case, tie, action, micros(ts).alias("at")).withColumn("day", F.floor(F.col("at") / 86_400_000_000))
    order = F.struct("at", tie)
    days = events.groupBy(case, "day").agg(F.count("*").alias("n"), F.max_by(F.struct("at", F.col(action).alias("action")), order).alias("last"))
    earlier = Window.partitionBy(case).orderBy("day")
    days = days.select(case, "day", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(earlier).alias("carried"))
    within = Window.partitionBy(case, "day").orderBy("at", tie)
    first = F.row_number().over(within) == 1
    numbered = events.join(days, [case, "day"]).withColumns({"k": F.row_number().over(within), "a": F.when(first, F.col("carried.action")).otherwise(F.lag(action).over(within)), "t": F.when(first, F.col("carried.at")).otherwise(F.lag("at").over(within))})
    return numbered.select(case, tie, action, (F.col("before") + F.col("k")).cast("long").alias("seq"), F.col("a").alias("previous"), ((F.col("at") - F.col("t")) / 1_000_000).alias("seconds_since"))


def page_status(events: DataFrame, page: list[str], status: str, order: list[str]) -> DataFrame:
    """Current status of each page: that of its last event."""
    return events.groupBy(*page).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("events"))


def rate(events: DataFrame, user: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """user, tie, in_window: events of the user in the `seconds` up to and with each event.

    Each event is seen by its own slot of that length and the next, so a window never holds more than
    two slots of one user.
    """
    length = seconds * 1_000_000
    slotted = events.select(user, tie, micros(ts).alias("at")).withColumn("home", F.floor(F.col("at") / length))
    seen = slotted.select("*", F.explode(F.array("home", F.col("home") + 1)).alias("slot"))
    w = Window.partitionBy(user, "slot").orderBy("at").rangeBetween(-length, 0)
    return seen.withColumn("in_window", F.count("*").over(w)).where("slot = home").select(user, tie, "in_window")


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """user, started (microseconds), events of each session; works on streams with a watermark, too."""
    return events.groupBy(user, F.session_window(F.col(ts).cast("timestamp"), gap).alias("s")).agg(F.count("*").alias("events")).select(user, F.unix_micros("s.start").alias("started"), "events")


def daily_cap(events: DataFrame, ts: str, amount: str, cap: int, alert_percent: int = 90) -> DataFrame:
    """day, total, alert, over: daily sums against a cap in whole units. Decimals keep sums exact."""
    day = F.window(F.col(ts).cast("timestamp"), "1 day")["start"].cast("date")
    total = F.sum(F.col(amount).cast("decimal(18,2)"))
    sums = events.groupBy(day.alias("day")).agg(total.alias("total"))
    return sums.select("day", F.col("total").cast("double").alias("total"), (100 * F.col("total") >= alert_percent * cap).alias("alert"), (F.col("total") > cap).alias("over"))


def stale_writes(writes: DataFrame, turns: DataFrame, conv: str, turn: str) -> DataFrame:
    """Writes bound to a turn that is not the current (last) one of their conversation, or to none."""
    current = turns.groupBy(conv).agg(F.max(turn).alias("current"))
    return writes.join(current, conv, "left").where(~F.col(turn).eqNullSafe(F.col("current")))


def misdirected_writes(writes: DataFrame, turns: DataFrame, bound: DataFrame, conv: str, turn: str, record: str) -> DataFrame:
    """Writes(conv, turn, record) to a record other than their conversation's in bound(conv, record), or of a turn that is not current, with `reason`."""
    current = turns.groupBy(conv).agg(F.max(turn).alias("current_"))
    joined = writes.join(bound.select(conv, F.col(record).alias("record_")), conv, "left").join(current, conv, "left")
    other = ~F.col(record).eqNullSafe(F.col("record_"))
    reason = F.when(other, "record").when(~F.col(turn).eqNullSafe(F.col("current_")), "turn")
    return joined.select(*writes.columns, reason.alias("reason")).where(F.col("reason").isNotNull())


def checked_arguments(calls: DataFrame, arguments: str, schema: str, ident: str, allowed: DataFrame) -> DataFrame:
    """calls with `problem`: syntax (no JSON object of the schema), id (not in allowed(id)), or null. What the caller sent is never trusted, only compared."""
    parsed = F.from_json(arguments, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    named = calls.withColumn("args_", parsed).withColumn("id_", F.col(f"args_.{ident}"))
    known = allowed.select(F.col(ident).alias("id_")).distinct().withColumn("known_", F.lit(True))
    bad = F.col("args_").isNull() | F.col("args_._corrupt_record").isNotNull() | F.col("id_").isNull()
    return named.join(known, "id_", "left").select(*calls.columns, F.when(bad, "syntax").when(F.col("known_").isNull(), "id").alias("problem"))


def credentials_in_force(uses: DataFrame, grants: DataFrame, keys: list[str], minutes: int, use: str) -> DataFrame:
    """uses(use, keys, ts) with `valid`: some grant(keys, issued) of the same record and turn was issued at most `minutes` before. `use` tells uses apart.

    Uses and grants meet by the last grant up to each use, so no use meets all grants of its key: the
    grants' running latest time within the key's day, and the latest of the day before, decide.
    """
    length = minutes * 60_000_000
    day = lambda at: F.floor(at / F.lit(max(length, 1)))
    asked = uses.select(*keys, micros("ts").alias("at"), F.col(use).alias("use_"), F.lit(None).cast("long").alias("given"))
    given = grants.select(*keys, micros("issued").alias("at"), F.lit(None).cast(uses.schema[use].dataType).alias("use_"), micros("issued").alias("given"))
    slots = asked.withColumn("slot", day(F.col("at"))).unionByName(given.withColumn("slot", F.explode(F.array(day(F.col("at")), day(F.col("at")) + 1))))
    # a grant counts for uses of its own slot of that length and of the next
    last = F.max("given").over(Window.partitionBy(*keys, "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    held = slots.withColumn("last_", last).where(F.col("use_").isNotNull()).select(F.col("use_").alias(use), F.coalesce(F.col("at") - F.col("last_") <= length, F.lit(False)).alias("valid"))
    return uses.join(held, use)


def within_retention(events: DataFrame, ts: str, days: int) -> DataFrame:
    """Events of the last `days` days before the newest one."""
    newest = events.agg(F.max(ts).alias("newest_"))
    return events.join(F.broadcast(newest), F.col(ts) >= F.col("newest_") - F.expr(f"INTERVAL {days} DAYS")).drop("newest_")


def sampled(key: str, share_of_256: int) -> Column:
    """A fixed sample of traces by the first byte of the key's SHA-256."""
    return F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(2)) < F.lit(f"{share_of_256:02x}")
