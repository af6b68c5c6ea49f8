"""Live alerts on misdirected writes: a conversation's current turn and record held as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of the two streams as one: micros since the epoch, whether it is a write, its id, its turn and record.
EVENT = "at long, is_write boolean, write_id long, turn long, record long"
ALERT = "conv_id long, write_id long, turn long, record long, reason string"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Misdirected(StatefulProcessor):
    """Judges each write once the watermark has passed it, so that the order of arrival does not matter.

    State of one conversation: its turn and record so far, the time of its last event, and the events that the watermark has not passed.
    A call to the state costs far more than an event, so a conversation's events go in together and wait for one timer, the earliest's.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "turn long, record long, at long")
        self.open = handle.getListState("open", EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803  Spark's names
        writes, turns = [], {}
        for r in rows:
            event = (r["at"], r["is_write"], r["write_id"], r["turn"], r["record"])
            if r["is_write"]:
                writes.append(event)
            else:
                turns[event] = None  # a turn that is delivered again changes nothing
        events = [*turns, *writes]
        if events:
            self.open.appendList(events)
            # timers are in milliseconds
            self.handle.registerTimer(-(-min(e[0] for e in events) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803  Spark's names
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.open.get())
        due, rest = [e for e in waiting if e[0] <= upto * 1000], [e for e in waiting if e[0] > upto * 1000]
        turn, record, at = self.now.get() or (None, None, None)
        alerts = []
        # at one time turns come before writes
        for when, is_write, write_id, its_turn, its_record in sorted(due, key=lambda e: (e[0], e[1], e[3] is not None, e[3] or 0, e[2] or 0)):
            at = max(when, at or when)
            if not is_write:
                turn, record = its_turn if its_turn is not None else turn, its_record if its_record is not None else record
            elif its_record is None or its_record != record:
                alerts.append(Row(conv_id=key[0], write_id=write_id, turn=its_turn, record=its_record, reason="record"))
            elif its_turn is None or its_turn != turn:
                alerts.append(Row(conv_id=key[0], write_id=write_id, turn=its_turn, record=its_record, reason="turn"))
        if due and rest:
            self.open.put(rest)
        elif due:
            self.open.clear()
        over = at // 1000 + self.keep if at is not None else upto
        if not rest and over <= upto:
            self.now.clear()  # nothing for so long: the conversation is over
        elif due:
            self.now.update((turn, record, at))
        if rest:
            self.handle.registerTimer(-(-min(e[0] for e in rest) // 1000))
        elif over > upto:
            self.handle.registerTimer(over)
        return iter(alerts)

    def close(self) -> None:
        pass


def misdirected_write_alerts(turns: DataFrame, writes: DataFrame, ts: str, late: str = "1 minute", keep: str = "1 day") -> DataFrame:
    """conv_id, write_id, turn, record, reason of writes that miss their conversation, as they happen.

    `turns` streams (conv_id, turn, record, ts): from ts on the conversation is at that turn, and bound to that record if one is
    given. `writes` streams (conv_id, write_id, turn, record, ts). A write is judged by the last turn up to its time: `record` where
    it writes to another record than the conversation's, or the conversation has none, else `turn` where its turn is not the current one.

    Defined cases: rows that come more than `late` after the latest time seen are dropped, before that any order of arrival gives the
    same alerts; a write without turn or record is an alert, a turn without either changes nothing of it; rows without a conversation or
    time are dropped; deliveries that repeat are alerted again, so deduplicate the streams first; a conversation silent for `keep` is forgotten, and what it writes then is an alert.
    """
    spark = turns.sparkSession
    ms = spark.range(1).select(F.expr(f"cast(unix_millis(timestamp'2000-01-01' + interval {keep}) - unix_millis(timestamp'2000-01-01') as long)").alias("ms")).first()["ms"]
    event = lambda df, is_write, write_id: df.select(F.col("conv_id").cast("long"), F.col(ts).alias("time"), F.unix_micros(ts).alias("at"), F.lit(is_write).alias("is_write"), write_id.cast("long").alias("write_id"), F.col("turn").cast("long"), F.col("record").cast("long"))
    both = event(turns, False, F.lit(None)).union(event(writes, True, F.col("write_id"))).where("conv_id is not null and time is not null")
    return both.withWatermark("time", late).groupBy("conv_id").transformWithState(Misdirected(ms), ALERT, "append", "eventTime")
