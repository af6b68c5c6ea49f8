"""Streaming forms of the audit analytics. Event times must be TIMESTAMP: cast TIMESTAMP_NTZ first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alerts import PROVIDER


def live_status(events: DataFrame, page: str, status: str, order: list[str]) -> DataFrame:
    """The current status of each page; for `update` mode."""
    return events.groupBy(page).agg(F.max_by(status, F.struct(*order)).alias("status"))


def deduplicated(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """An append-only audit stream: deliveries repeated within `late` count once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str, amount: str, length: str, late: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """start, keys, events, total for tumbling windows (daily caps) or sliding ones (rate limits)."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    sums = events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("events"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("total"))
    return sums.select(F.col("window.start").alias("start"), *keys, "events", "total")


def session_traces(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row a trace: user, start, events."""
    found = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events"))
    return found.select(user, F.col("s.start").alias("start"), "events")


def stale_write_alerts(writes: DataFrame, current: DataFrame, conv: str, turn: str) -> DataFrame:
    """Writes of a stream against a table current(conv, current) of each conversation's turn now."""
    return writes.join(current, conv, "left").where(~F.col(turn).eqNullSafe(F.col("current")))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that is there now, append it to a Parquet folder and stop; the next call goes on from there."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer.format("parquet").start(path).awaitTermination()


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> None:
    """run_available for streams with state of their own, which needs a store with column families."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER[0])
    conf.set(*PROVIDER)
    try:
        run_available(stream, path, checkpoint)
    finally:
        conf.set(PROVIDER[0], before)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all that is there now in `update` mode; every batch's changed rows are kept with its number, once however often it is tried."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start().awaitTermination()


def latest(updates: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key in the last batch(key, value, batch) that changed it."""
    return updates.groupBy(key).agg(F.max_by(value, "batch").alias(value))
