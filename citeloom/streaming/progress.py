"""Reading progress as a stateful stream: one value of state for each (user, work), folded by the engine, or in Python where keys expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citeloom.operators.folds import fold_progress
from citeloom.schemas import PROGRESS_STATES
from citeloom.shipping import ship_package

_STATE = "last_seq long, status string, completed long, start_seq long, started long, updated long"
_OUT = "user_id string, work_id string, status string, started long, completed long, updated long, expired boolean"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EMPTY = (None,) * 6


def _whole(x: float | None) -> int | None:
    """A number of a pandas column, where one null makes all of them fractions."""
    return None if x is None or pd.isna(x) else int(x)


def advance(state: tuple, rows: Iterator[tuple]) -> tuple:
    """The state after events (seq, status, micros), in any order and however often they come.

    What counts is the sequence number, not the arrival: the last event gives
    status and completion, the first start the start, the latest time the
    update. An event without a number only moves the update.
    """
    last, status, completed, start_seq, started, updated = state
    for seq, now, micros in rows:
        if micros is not None and (updated is None or micros > updated):
            updated = micros
        if seq is None:
            continue
        if last is None or seq > last:
            last = seq
            status = now if now in PROGRESS_STATES else None
            completed = micros if now == "completed" else None
        if now == "in_progress" and (start_seq is None or seq < start_seq):
            start_seq, started = seq, micros
    return last, status, completed, start_seq, started, updated


class ProgressProcessor(StatefulProcessor):
    """Emits the state of each key that a micro-batch touches; ``idle`` milliseconds after its last event a key is emitted as expired and forgotten."""

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _STATE)

    def _row(self, key: tuple, state: tuple, expired: bool) -> pd.DataFrame:
        _, status, completed, _, started, updated = state
        columns = ["user_id", "work_id", "status", "started", "completed", "updated", "expired"]
        return pd.DataFrame([(*key, status, started, completed, updated, expired)], columns=columns).astype({c: "Int64" for c in ("started", "completed", "updated")})

    def _state(self) -> tuple:
        return tuple(self.progress.get()) if self.progress.exists() else _EMPTY

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        for batch in rows:
            events = zip(batch["seq"], batch["status"], batch["micros"], strict=True)
            state = advance(state, ((_whole(seq), status, _whole(micros)) for seq, status, micros in events))
        self.progress.update(state)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        self.progress.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs Spark's RocksDB store, and a large state a store outside the heap; a provider that the session names is kept."""
    if "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def stream_progress(log: DataFrame, idle: int | None = None) -> DataFrame:
    """The progress of every (user, work) that a micro-batch of a log stream (seq, user_id, work_id, status, ts) touches.

    A row is the state after all events so far: user_id, work_id, status,
    started_at, completed_at, updated_at and ``expired``; the last row of a key
    is its progress, and equals ``fold_progress`` of the whole log, however the
    log is cut into batches. Without ``idle`` the engine folds the stream, as it
    does a table, and keeps the state. With ``idle`` (milliseconds of processing time) a
    key without events is emitted once more, as expired, and its state goes;
    such a stream waits for its timers, so it needs a processing-time trigger
    and never ends by itself.
    """
    spark = log.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    if idle is None:
        return fold_progress(log).withColumn("expired", F.lit(False))
    events = log.select("user_id", "work_id", F.col("seq").cast("long").alias("seq"), "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    out = events.groupBy("user_id", "work_id").transformWithStateInPandas(
        statefulProcessor=ProgressProcessor(idle), outputStructType=_OUT, outputMode="Update", timeMode="ProcessingTime"
    )
    times = [F.timestamp_micros(c).alias(f"{c}_at") for c in ("started", "completed", "updated")]
    return out.select("user_id", "work_id", "status", *times, "expired")
