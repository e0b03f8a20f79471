"""Keyed state in streams: interrupted work that is tried once more, and streaks of failures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts of an update before it is dropped, and failures in a row that are told.
MOST_ATTEMPTS, ALERT_AT = 2, 6
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark) -> None:
    """State with timers and values of their own needs this store; queries that are started afterwards use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _InFlight(StatefulProcessor):
    """Per update: attempts so far, and a timer for the end of the present one."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "attempts int, preview string, finished boolean")

    def _until(self, when: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(when + self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: (r.ts, r.event == "done"))
        attempts, preview, finished = self.attempts.get() or (0, "", False)
        if finished:
            return
        for r in events:
            if r.event == "done":
                finished = True
            elif not finished and attempts == 0:
                attempts, preview = 1, (r.text or "")[:80]
                self._until(int(r.ts.timestamp() * 1000))
        self.attempts.update((attempts, preview, finished))
        if finished:  # what is known stays until the timer ends, for a start that comes late
            self._until(int(events[-1].ts.timestamp() * 1000))
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempts, preview, finished = self.attempts.get() or (0, "", True)
        if finished:
            self.attempts.clear()
            return
        if attempts < MOST_ATTEMPTS:
            self.attempts.update((attempts + 1, preview, False))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.patience)
            yield Row(update_id=key[0], action="retry", attempt=attempts + 1, preview=preview)
        else:
            self.attempts.clear()
            yield Row(update_id=key[0], action="drop", attempt=attempts, preview=preview)

    def close(self) -> None:
        pass


def recovered(events: DataFrame, patience: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """What to do with updates that began and didn't end: update_id, action (retry, then drop), attempt, preview.

    events: update_id, event ("start" or "done"), ts, text. An update whose end doesn't come within the
    patience, by the stream's own time, is tried once more; when that doesn't end either it is dropped, with
    the first 80 characters of its text for a notice. Started or done again changes nothing; state outlives a
    restart. An update is forgotten when it is dropped or, done, when its patience has passed.
    """
    keyed_state(events.sparkSession)
    timed = events.withWatermark("ts", patience)
    return timed.groupBy("update_id").transformWithState(_InFlight(patience_ms), "update_id long, action string, attempt int, preview string", "Append", "EventTime")


class _Streak(StatefulProcessor):
    def __init__(self, alert_at: int):
        self.alert_at = alert_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "failures int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (failures,) = self.streak.get() or (0,)
        for r in sorted(rows, key=lambda r: (r.ts, r.run_id)):
            failures = 0 if r.ok else failures + 1
            if failures == self.alert_at:
                yield Row(job=key[0], ts=r.ts, run_id=r.run_id, failures=failures, error=r.error)
        self.streak.update((failures,))

    def close(self) -> None:
        pass


def streak_alerts(runs: DataFrame, alert_at: int = ALERT_AT) -> DataFrame:
    """An alert when a job has failed so often in a row: once a streak; a success ends it.

    runs: job, ts, run_id, ok (null is a failure), error. Runs of one batch are taken in order of ts; a run of
    an earlier time that comes in a later batch counts after those before it. State outlives a restart.
    """
    keyed_state(runs.sparkSession)
    return runs.groupBy("job").transformWithState(_Streak(alert_at), "job string, ts timestamp, run_id long, failures int, error string", "Append", "None")
