"""Workflow sessions with event-time timers: those in which nothing happens fail."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .events import step

#: transformWithState keeps its state in this store; the session must name it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_COLUMNS = ["state", "transitions", "refused", "expired", "last"]
_STATE = "state string, transitions bigint, refused bigint, expired bigint, last bigint"
_NEW = ("initializing", 0, 0, 0, None)
#: States in which nothing is waited for.
_AT_REST = ("completed", "failed")


def _expire(now: tuple) -> tuple:
    state, done, refused, expired, last = now
    return ("failed", done, refused, expired + 1, last)


def fold(now: tuple, log: Iterable[tuple[int, str]], stuck: int) -> tuple:
    """The state after triggers (ms, trigger) in order: a session at work fails first
    where `stuck` ms or more have passed since its last trigger."""
    for at, trigger in log:
        if now[4] is not None and at - now[4] >= stuck and now[0] not in _AT_REST:
            now = _expire(now)
        state, done, refused, expired, last = now
        following = step(state, trigger)
        last = at if last is None else max(last, at)
        now = (state, done, refused + 1, expired, last) if following is None else (following, done + 1, refused, expired, last)
    return now


class Sessions(StatefulProcessor):
    """One value of state and one timer for each session, `stuck` ms after its last trigger."""

    def __init__(self, key: str, stuck: int) -> None:
        self.key, self.stuck = key, stuck

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _STATE)

    def _row(self, key, now: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *now[:4])], columns=[self.key, *_COLUMNS[:4]])

    def handleInputRows(self, key, rows, timerValues):
        frames = [f for f in rows if len(f)]  # a batch of timers alone hands over empty ones
        if not frames:
            return
        frame = pd.concat(frames).sort_values(["ms_", "trigger"])
        before = tuple(self.session.get()) if self.session.exists() else _NEW
        now = fold(before, zip(frame["ms_"].tolist(), frame["trigger"].tolist()), self.stuck)
        self.session.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[0] not in _AT_REST:
            self.handle.registerTimer(now[4] + self.stuck)
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = _expire(tuple(self.session.get()))
        self.session.update(now)
        yield self._row(key, now)

    def close(self) -> None:
        pass


def workflow_timers(log: DataFrame, key: str = "session_id", at: str = "at", stuck: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(key, state, transitions, refused, expired) of a stream (key, at timestamp, trigger),
    a row whenever a session changes: the state as workflow_stream keeps it, but a session
    that is neither completed nor failed fails once the watermark (the newest `at` less
    `late`) is `stuck` past its last trigger, whether or not another one comes. Triggers
    behind the watermark are dropped; triggers of one moment count in their order by name.
    Rows without a key, time or trigger are left out. Needs STORE in the session."""
    kind, ms = log.schema[key].dataType.simpleString(), int(pd.Timedelta(stuck).total_seconds() * 1000)
    rows = log.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col("trigger").isNotNull())
    # No name that begins with an underscore: a processor gets such columns under other names.
    rows = rows.select(key, at, "trigger", F.unix_millis(at).alias("ms_")).withWatermark(at, late)
    return rows.groupBy(key).transformWithStateInPandas(
        Sessions(key, ms), f"`{key}` {kind}, state string, transitions bigint, refused bigint, expired bigint", "update", "EventTime"
    )


def workflow_until(log: DataFrame, key: str = "session_id", at: str = "at", stuck: str = "1 hour") -> DataFrame:
    """The same over a whole log, up to its newest time."""
    kind, ms = log.schema[key].dataType.simpleString(), int(pd.Timedelta(stuck).total_seconds() * 1000)
    rows = log.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col("trigger").isNotNull()).select(key, F.unix_millis(at).alias("ms_"), "trigger")
    newest = rows.agg(F.max("ms_").alias("_newest"))  # one row

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms_", "trigger"])
        now = fold(_NEW, zip(pdf["ms_"].tolist(), pdf["trigger"].tolist()), ms)
        if now[0] not in _AT_REST and pdf["_newest"].iloc[0] - now[4] >= ms:
            now = _expire(now)
        return pd.DataFrame([(k[0], *now[:4])], columns=[key, *_COLUMNS[:4]])

    return rows.crossJoin(F.broadcast(newest)).groupBy(key).applyInPandas(run, f"`{key}` {kind}, state string, transitions bigint, refused bigint, expired bigint")
