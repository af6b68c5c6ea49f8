"""Live alerts on misdirected writes over runs of two streams."""

from datetime import datetime, timedelta, timezone

import pytest

from evidara.streaming import events as stream
from evidara.streaming.alerts import misdirected_write_alerts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
TURN, WRITE = "conv_id long, turn long, record long, ts timestamp", "conv_id long, write_id long, turn long, record long, ts timestamp"


@pytest.fixture
def live(spark, tmp_path):
    """A function that delivers turns and writes (times in seconds) and returns all alerts so far as (write_id, reason)."""
    n = [0]
    at = lambda s: None if s is None else START + timedelta(seconds=s)

    def run(turns=(), writes=(), **kw):
        n[0] += 1
        for name, rows, schema in (("turns", turns, TURN), ("writes", writes, WRITE)):
            spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], schema).write.parquet(str(tmp_path / name / str(n[0])))
        read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
        alerts = misdirected_write_alerts(read("turns", TURN), read("writes", WRITE), "ts", **kw)
        stream.run_stateful(alerts, str(tmp_path / "out"), str(tmp_path / "log"))
        return sorted((r["write_id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return run


TICK = lambda s: [(99, 1, None, s)]  # noqa: E731  moves the watermark on


def test_an_update_between_two_runs_changes_the_alerts(live):
    got = live([(1, 1, 10, 0), (2, 1, 20, 0)] + TICK(500), [(1, 100, 1, 10, 60), (2, 200, 1, 21, 60)])
    assert got == [(200, "record")]
    # turn 2 begins, so a write of turn 1 is stale, and one of turn 2 is not; conversation 2 moves to record 21
    got = live([(1, 2, None, 600), (2, None, 21, 600)] + TICK(2000), [(1, 101, 1, 10, 700), (1, 102, 2, 10, 700), (2, 201, 1, 21, 700)])
    assert got == [(101, "turn"), (200, "record")]


def test_order_of_arrival_does_not_matter_within_lateness(live):
    # the write comes a run before the turn that makes it current
    assert live([(1, 1, 10, 0)] + TICK(100), [(1, 100, 2, 10, 90), (1, 101, 1, 10, 50)]) == []
    assert live([(1, 2, None, 80)] + TICK(400), []) == []
    # later than the lateness: the turn of 390 is dropped, so the write of turn 3 is an alert
    assert live(TICK(3000), []) == []
    assert live([(1, 3, None, 390)] + TICK(3100), [(1, 102, 3, 10, 3050)]) == []
    assert live(TICK(9000), []) == [(102, "turn")]


def test_defined_cases(live):
    writes = [(1, 1, None, 10, 5), (1, 2, 1, None, 5), (3, 3, 1, 30, 5), (None, 4, 1, 10, 5), (1, 5, 1, 10, None), (1, 6, 1, 10, 5), (1, 6, 1, 10, 5), (1, 7, 2, 10, 5), (1, 7, 2, 10, 5)]
    turns = [(1, 1, 10, 5), (None, 2, 11, 5), (1, 9, 11, None)]
    assert live(turns + TICK(900), writes) == [(1, "turn"), (2, "record"), (3, "record"), (7, "turn"), (7, "turn")]


def test_a_silent_conversation_is_forgotten(live):
    assert live([(1, 1, 10, 0)] + TICK(5000), [(1, 1, 1, 10, 60)], keep="1 hour") == []
    assert live(TICK(9000), [(1, 2, 1, 10, 5100)], keep="1 hour") == [(2, "record")]
    assert live(TICK(9900), [(1, 3, 1, 10, 9500)], keep="1 hour") == [(2, "record"), (3, "record")]


def test_a_conversation_waits_for_one_timer_and_keeps_repeated_turns_once():
    """Whatever the number of rows, a few calls to the state take them in."""
    from types import SimpleNamespace

    from evidara.streaming.alerts import Misdirected

    calls = []
    record = lambda name: lambda *a: calls.append((name, *a))
    m = Misdirected(1000)
    m.handle, m.open = SimpleNamespace(registerTimer=record("timer")), SimpleNamespace(appendValue=record("value"), appendList=record("list"))
    rows = [{"at": 5_000, "is_write": False, "write_id": None, "turn": 1, "record": 1}] * 500 + [{"at": 9_000 + k, "is_write": True, "write_id": 7, "turn": 1, "record": 1} for k in (0, 0, 1)]
    assert list(m.handleInputRows((1,), iter(rows), None)) == []
    assert [c[0] for c in calls] == ["list", "timer"]
    assert len(calls[0][1]) == 4 and calls[1][1] == 5
