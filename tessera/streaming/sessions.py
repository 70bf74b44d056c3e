"""Session history as a stream: the last events of each session, kept up to date.

Sessions are dealt to ``buckets`` groups by their hash, and a group keeps the histories of all its sessions as one state: calls of Python, which take
milliseconds each, grow with the number of buckets and not with that of sessions. A batch writes the states of the buckets that it touches anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.collection import Collection

MOST, TIME_TO_LIVE_MS, LATE, BUCKETS = 10, 7 * 24 * 3600 * 1000, "1 day", 1024
COLUMNS = ["at", "id", "item"]
TOLD = "at array<bigint>, id array<bigint>, item array<string>"


def latest(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The latest rows of each session, each id once, the latest first; of rows with one id the first that came stays."""
    rows = rows.drop_duplicates(["session", "id"]).sort_values(["at", "id"], ascending=False).sort_values("session", kind="stable")
    return rows[rows.groupby("session", sort=False).cumcount() < most]


def _kept_up(most: int, time_to_live_ms: int):
    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rows, until, touched = state.getCurrentWatermarkMs(), None, {}, set()
        if state.exists:
            sessions, deadlines, sizes, *columns = state.get
            until = dict(zip(sessions, deadlines))
            rows = pd.DataFrame({"session": pd.Series(sessions).repeat(sizes).to_numpy()} | dict(zip(COLUMNS, columns)))
        for part in () if state.hasTimedOut else parts:
            touched.update(part["session"].tolist())
            part = part[["session", *COLUMNS]]
            rows = latest(part if rows is None else pd.concat([rows, part]), most)
        gone = [s for s, t in until.items() if t < now and s not in touched]
        if gone:
            rows = rows[~rows["session"].isin(gone)]
            yield pd.DataFrame({"session": gone} | {c: [[]] * len(gone) for c in COLUMNS})
        if not len(rows):
            state.remove()
            return
        own = rows["session"].to_numpy()
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ends, sessions = [*begins[1:].tolist(), len(own)], rows["session"].iloc[begins].tolist()
        columns, begins = [rows[c].tolist() for c in COLUMNS], begins.tolist()
        until = {s: max(columns[0][b] // 1000 + time_to_live_ms, now + 1) if s in touched else until[s] for s, b in zip(sessions, begins)}
        state.update((sessions, list(until.values()), [b - a for a, b in zip(begins, ends)], *columns))
        state.setTimeoutTimestamp(max(min(until.values()), now + 1))
        new = [(s, a, b) for s, a, b in zip(sessions, begins, ends) if s in touched]
        if new:
            yield pd.DataFrame({"session": [s for s, _, _ in new]} | {c: [x[a:b] for _, a, b in new] for c, x in zip(COLUMNS, columns)})

    return run


def histories(events: DataFrame, session: str, at: str, key: str, columns: list[str], most: int = MOST, time_to_live_ms: int = TIME_TO_LIVE_MS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """session, at, id, item: after each batch, the sessions that it touched with their last events, the latest first, items as JSON.

    Events may come in any order up to ``late`` behind the latest; an event that comes again changes nothing. A session whose last event is
    older than ``time_to_live_ms`` by the stream's watermark is forgotten: it comes once more, empty. Events without a session, time or id are left out.
    """
    whole = F.col(session).isNotNull() & F.col(at).isNotNull() & F.col(key).isNotNull()
    rows = events.filter(whole).withColumn("__ts", F.col(at).cast("timestamp")).withWatermark("__ts", late)
    own = rows.select(F.col(session).alias("session"), "__ts", F.unix_micros("__ts").alias("at"), F.col(key).cast("bigint").alias("id"), F.to_json(F.struct(*columns)).alias("item"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(buckets)))
    kind = dict(own.dtypes)["session"]
    stored = f"session array<{kind}>, until array<bigint>, size array<int>, {TOLD}"
    return own.groupBy("bucket").applyInPandasWithState(_kept_up(most, time_to_live_ms), f"session {kind}, {TOLD}", stored, "update", GroupStateTimeout.EventTimeTimeout)


def kept(stream: DataFrame, into: Collection, checkpoint: str, max_wait: bool = True):
    """Write what ``histories`` tells to a collection by session, which can be read at any time. A batch that is done again changes nothing."""

    def put(rows: DataFrame, _: int) -> None:
        into.upsert(rows)

    writer = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if max_wait else writer).start()


def listed(rows: DataFrame) -> DataFrame:
    """session, n (1 for the latest), at, id, item: a row for each event."""
    zipped = F.arrays_zip("at", "id", "item")
    return rows.select("session", F.posexplode(zipped).alias("n", "e")).select("session", (F.col("n") + 1).alias("n"), F.timestamp_micros("e.at").alias("at"), F.col("e.id").alias("id"), F.col("e.item").alias("item"))
