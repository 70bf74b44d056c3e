"""Session histories as a stream: order, repeats, late events, forgotten sessions."""

import datetime as dt

import pandas as pd

from tessera.operators.collection import Collection
from tessera.streaming import sessions

SCHEMA = "s string, t timestamp, k long, what string"
DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def run(spark, folder, batches, **options):
    """Histories after each batch."""
    out = []
    stored = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        told = sessions.histories(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), "s", "t", "k", ["what"], **options)
        stored = stored or Collection.create(spark, f"{folder}/out", told.schema, "session", 4)
        sessions.kept(told, stored, f"{folder}/checkpoint").awaitTermination()
        out.append(sorted((r.session, r.n, r.id) for r in sessions.listed(stored.read()).collect()))
    return out


def test_order_and_repeats(spark, tmp_path):
    rows = [("a", at(i), i, f"x{i}") for i in range(12)]
    found = run(spark, f"file://{tmp_path}", [rows[6:], [*rows[:6], *rows[8:], ("b", at(3), 99, "y"), (None, at(1), 5, "z"), ("b", None, 6, "z")]])
    assert found[0] == [("a", n, 12 - n) for n in range(1, 7)]
    assert found[1] == [("a", n, 12 - n) for n in range(1, 11)] + [("b", 1, 99)]


def test_late_events_and_forgotten_sessions(spark, tmp_path):
    batches = [[("a", at(0), 1, "x"), ("b", at(1), 2, "x")], [("b", at(100), 3, "x")], [("b", at(101), 4, "x"), ("b", at(20), 5, "too late")], [("b", at(102), 6, "x")]]
    found = run(spark, f"file://{tmp_path}", batches, time_to_live_ms=24 * 3600 * 1000, late="1 hour")
    assert found[0] == [("a", 1, 1), ("b", 1, 2)]
    assert found[-1] == [("b", 1, 6), ("b", 2, 4), ("b", 3, 3), ("b", 4, 2)] and all(5 not in [r[2] for r in f] for f in found)


class Stored:
    """A state as Spark keeps it between batches."""

    exists, hasTimedOut, watermark, calls = False, False, 0, 0

    def getCurrentWatermarkMs(self):  # noqa: N802
        self.calls += 1
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists = False

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at > self.watermark
        self.until = at


def test_many_sessions_are_one_group(spark, tmp_path):
    """Python is called for a bucket of sessions, not for each; sessions of one bucket are told and forgotten apart."""
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}")
    told = sessions.histories(stream, "s", "t", "k", ["what"], buckets=3)
    assert "bucket" in next(line for line in told._jdf.queryExecution().analyzed().toString().splitlines() if "WithState" in line)
    state, run = Stored(), sessions._kept_up(2, 1000)

    def batch(rows, watermark=0, timed_out=False):
        state.watermark, state.hasTimedOut = watermark, timed_out
        parts = [pd.DataFrame(rows[i : i + 2], columns=["session", "at", "id", "item"]) for i in range(0, len(rows), 2)]
        return sorted((s, ids) for out in run((0,), iter(parts), state) for s, ids in zip(out["session"], out["id"]))

    first = [("a", 1_000_000, 1, "x"), ("b", 2_000_000, 2, "x"), ("a", 3_000_000, 3, "x"), ("a", 2_000_000, 4, "x"), ("a", 2_000_000, 4, "again")]
    assert batch(first) == [("a", [3, 4]), ("b", [2])]
    assert batch([("c", 9_000_000, 5, "x")]) == [("c", [5])] and state.until == 3000
    assert batch([("a", 3_500_000, 6, "x")], 3500) == [("a", [6, 3]), ("b", [])]
    assert batch([], 4600, True) == [("a", [])] and state.until == 10000
    assert batch([], 10001, True) == [("c", [])] and not state.exists
    assert batch([("a", 20_000_000, 7, "x")], 10001) == [("a", [7])]
