"""Streams with state by key: events that go on where a batch ends, and snapshots that have changed.

Both keep their state in RocksDB (`started` sets that for the query it starts, not for the session), so a restart from
the checkpoint goes on with it. Events have key, seq, event and payload; snapshots have key, seq and snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.session import ship

EVENTS = "key string, seq long, event string, payload string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Follow(StatefulProcessor):
    """The number of the last event passed on, and the events behind a gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.held = handle.getMapState("held", "seq long", "event string, payload string")

    def handleInitialState(self, key, initial, timers) -> None:  # noqa: N802
        self.last.update((int(initial["seq"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Each access to the state is a call to the JVM, so only events that stay behind a gap go there, and `last` once a batch of rows."""
        last, waiting = self.last.get()[0] if self.last.exists() else -1, None
        for batch in rows:
            came = {}
            for seq, event, payload in zip(batch["seq"].tolist(), batch["event"].tolist(), batch["payload"].tolist(), strict=True):
                if seq > last:
                    came.setdefault(int(seq), (event, payload))
            if not came:
                continue
            waiting = self.held.exists() if waiting is None else waiting
            out = []
            while True:
                if waiting and self.held.containsKey((last + 1,)):
                    event, payload = self.held.getValue((last + 1,))
                    self.held.removeKey((last + 1,))
                    came.pop(last + 1, None)
                elif last + 1 in came:
                    event, payload = came.pop(last + 1)
                else:
                    break
                last += 1
                out.append((key[0], last, event, payload))
            for seq, said in came.items():
                if not (waiting and self.held.containsKey((seq,))):
                    self.held.updateValue((seq,), said)
            waiting = waiting or bool(came)
            if out:
                self.last.update((last,))
                yield pd.DataFrame(out, columns=["key", "seq", "event", "payload"])

    def close(self) -> None:
        pass


def follow(events: DataFrame, past: DataFrame) -> DataFrame:
    """The events of a stream behind those of `past`, each once and in the order of seq by key, without gap or repeat.

    seq counts from 0 without gaps in each key; a key of which `past` (key, seq) has nothing begins at 0. Numbers that `past` has, and
    numbers seen before, are passed over; an event that comes before its turn is held in the state until the
    ones before it are there. Of events with one number the first to come counts. Events without a key or number are dropped.
    """
    ship(events.sparkSession)
    known = past.where("key IS NOT NULL AND seq IS NOT NULL").groupBy("key").agg(F.max("seq").alias("seq"))
    rows = events.where("key IS NOT NULL AND seq IS NOT NULL").select("key", "seq", "event", "payload")
    return rows.groupBy("key").transformWithStateInPandas(_Follow(), EVENTS, "Append", "None", initialState=known.groupBy("key"))


class _Changed(StatefulProcessor):
    """The last snapshot passed on; with a time to live the state of a key that is quiet goes."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, snapshot string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        seq, snapshot = self.last.get() if self.last.exists() else (None, None)
        first, out = seq is None, []
        batch = pd.concat(list(rows)).sort_values(["seq", "snapshot"], kind="stable", na_position="first")
        for n, said in zip(batch["seq"], batch["snapshot"], strict=True):
            said = None if pd.isna(said) else said
            if not first and n < seq:
                continue
            if first or said != snapshot:
                out.append((key[0], int(n), said))
            seq, snapshot, first = int(n), said, False
        self.last.update((seq, snapshot))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "snapshot"]).astype({"snapshot": object})

    def close(self) -> None:
        pass


def changed(snapshots: DataFrame, keep: int | None = 3600) -> DataFrame:
    """The snapshots of a stream that differ from the one before them in their key; the first of a key always.

    Equals the batch form (`changed_only`) over the same rows whatever the batches, as long as they come in order; one that comes after
    a later one has been seen is dropped. `keep` is the time to live, in seconds: of a key that is quiet for longer the next
    snapshot counts as the first. Null snapshots are values; without a key or number they are dropped.
    """
    ship(snapshots.sparkSession)
    rows = snapshots.where("key IS NOT NULL AND seq IS NOT NULL").select("key", "seq", "snapshot")
    mode = "None" if keep is None else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(_Changed(None if keep is None else keep * 1000), "key string, seq long, snapshot string", "Append", mode)


def started(writer: DataStreamWriter, spark) -> StreamingQuery:
    """Starts a query with its state in RocksDB, and leaves the session's setting as it was."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
