"""State that time alone changes: leases of queue entries, cooldowns of services, entries that die.

Each is a stateful processor with timers or a time to live. In event time (a replay, a log) a timer fires when the
watermark passes it; in processing time (a live stream) when the clock does, also if no row arrives any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def backoff(errors: int) -> timedelta:
    """Pause after so many errors in a row: doubling from 30 seconds up to five minutes."""
    return timedelta(seconds=min(300.0, 15.0 * 2 ** min(errors, 5)))


class _Deadlines(StatefulProcessor):
    """A key's state and the moment at which it lapses, kept with one timer; rows come in the order of their time.

    A row that comes at or after that moment finds the state lapsed, so the result does not depend on how rows fall
    into batches. Subclasses say what a row does to the state (step) and what of it outlives the moment (after).
    """

    def __init__(self, clock: bool = False):
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, due timestamp")

    def step(self, state: dict, due: pd.Timestamp | None, at: pd.Timestamp, row) -> tuple[dict, pd.Timestamp | None]:
        raise NotImplementedError

    def after(self, state: dict) -> dict:
        return {}

    def _due_ms(self, due: pd.Timestamp) -> int:
        return int(due.value // 1_000_000)

    def _lapsed(self, key, due: list[pd.Timestamp]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(due), dtype=object), "at": pd.Series(due, dtype="datetime64[ns]"), "event": pd.Series(["lapsed"] * len(due), dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, due = {}, None
        if self.held.exists():
            text, due = self.held.get()
            state, due = json.loads(text), None if due is None else pd.Timestamp(due)
        old, out = due, []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at", "number"])
        for row in pdf.itertuples():
            at = pd.Timestamp(row.at) if not self.clock else pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms")
            if due is not None and at >= due:
                out.append(due)
                state, due = self.after(state), None
            state, due = self.step(state, due, at, row)
        if old is not None and old != due:
            self.handle.deleteTimer(self._due_ms(old))
        if due is not None and old != due:
            self.handle.registerTimer(self._due_ms(due))
        if state or due is not None:
            self.held.update((json.dumps(state), None if due is None else due.to_pydatetime()))
        else:
            self.held.clear()
        yield self._lapsed(key, out)  # one frame a key: frames cost more than rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            text, due = self.held.get()
            if due is not None and self._due_ms(pd.Timestamp(due)) <= expiredTimerInfo.getExpiryTimeInMs():
                state = self.after(json.loads(text))
                if state:
                    self.held.update((json.dumps(state), None))
                else:
                    self.held.clear()
                yield self._lapsed(key, [pd.Timestamp(due)])

    def close(self) -> None:
        pass


class Leases(_Deadlines):
    """An entry that is taken is active for so long; if nothing is heard of it, it is pending again (lapsed)."""

    def __init__(self, seconds: float = 600, clock: bool = False):
        super().__init__(clock)
        self.span = timedelta(seconds=seconds)

    def step(self, state, due, at, row):
        return ({}, at + self.span) if row.what == "take" else ({}, None)


class Cooldowns(_Deadlines):
    """A service pauses after errors, longer after each in a row; a success ends the row, not the pause. Lapsed: open again."""

    def step(self, state, due, at, row):
        if row.what != "error":
            return {}, due
        errors = state.get("errors", 0) + 1
        until = at + backoff(errors)
        return {"errors": errors}, until if due is None else max(due, until)

    def after(self, state):
        return state


class Answers(StatefulProcessor):
    """Kept answers with a time to live: a row with a value stores it, one without asks for it; every question gives key, value (null: none alive)."""

    def __init__(self, seconds: float = 7 * 86400):
        self.milliseconds = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "value string", self.milliseconds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows), ignore_index=True).sort_values(["at", "number"]).itertuples():
            if isinstance(row.value, str):
                self.kept.update((row.value,))
            else:
                out.append((key[0], row.number, self.kept.get()[0] if self.kept.exists() else None))
        yield pd.DataFrame({"key": pd.Series([o[0] for o in out], dtype=object), "number": pd.Series([o[1] for o in out], dtype="int64"), "value": pd.Series([o[2] for o in out], dtype=object)})

    def close(self) -> None:
        pass


def lapses(rows: DataFrame, processor: _Deadlines, late: str = "0 seconds") -> DataFrame:
    """A stream of rows(key string, at timestamp, number long, what string) -> key, at, event: when a key's state lapsed."""
    if not processor.clock:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(processor, "key string, at timestamp, event string", "Append", "ProcessingTime" if processor.clock else "EventTime")


def answered(rows: DataFrame, processor: Answers) -> DataFrame:
    """A stream of rows(key string, at timestamp, number long, value string) -> key, number, value of the questions."""
    return rows.groupBy("key").transformWithStateInPandas(processor, "key string, number long, value string", "Append", "ProcessingTime")


def started(spark: SparkSession, writer):
    """Start a stream whose state needs timers or times to live: they are kept by RocksDB. The session's setting stays as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def replayed(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the rows there are now, written below a shared folder and read again."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    started(spark, writer).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def as_rows(events: DataFrame, key: str, at: str, number: str, what) -> DataFrame:
    """A stream in the form that lapses takes; rows without a key or time are left out."""
    out = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(number).cast("long").alias("number"), what.alias("what"))
    return out.filter("key IS NOT NULL AND at IS NOT NULL")
