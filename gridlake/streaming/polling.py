"""A streaming source that polls a feed of numbered updates; the query's checkpoint keeps the offset.

A feed is an object with last(), the largest number there is or None, and between(after, upto), the updates
(number, body) with after < number <= upto; commit(upto), if it has one, is told what a batch has finished. A
failed call raises an error with the status of the answer. The object is sent to executors, so it holds
addresses, not connections.

The first start of a query skips what is there already: it begins behind the last update. Later starts go on
from the checkpoint, so nothing is lost; a batch that was cut off is read again, so sinks are keyed by number.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Seconds to wait after a conflict with another reader, and after any other failure.
CONFLICT, CONFLICT_WAIT, FAILURE_WAIT = 409, 15.0, 10.0


def backing_off(call: Callable, attempts: int = 6, sleep: Callable[[float], None] = time.sleep):
    """call(), again after a pause where it failed: longer after a conflict; the last failure goes up."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception as e:
            if not left:
                raise
            sleep(CONFLICT_WAIT if getattr(e, "status", None) == CONFLICT else FAILURE_WAIT)


class HttpFeed:
    """A JSON address that answers ?offset=N&limit=K with {"result": [{"update_id": ..., ...}]}, offset -1 with the last one."""

    def __init__(self, address: str, page: int = 100, timeout: float = 65.0):
        self.address, self.page, self.timeout = address, page, timeout

    def _get(self, offset: int) -> list[dict]:
        mark = "&" if "?" in self.address else "?"
        with urllib.request.urlopen(f"{self.address}{mark}offset={offset}&limit={self.page}", timeout=self.timeout) as answer:  # an error has the status
            return json.load(answer).get("result") or []

    def last(self) -> int | None:
        found = self._get(-1)
        return found[-1]["update_id"] if found else None

    def between(self, after: int, upto: int) -> Iterator[tuple[int, str]]:
        while after < upto and (page := self._get(after + 1)):
            for update in page:
                if update["update_id"] > upto:
                    return
                yield update["update_id"], json.dumps(update, ensure_ascii=False, sort_keys=True)
            after = page[-1]["update_id"]


class _Numbers(InputPartition):
    def __init__(self, after: int, upto: int):
        super().__init__((after, upto))
        self.after, self.upto = after, upto


class _PollReader(DataSourceStreamReader):
    def __init__(self, feed, span: int | None, attempts: int, sleep: Callable[[float], None]):
        self.feed, self.span, self.attempts, self.sleep = feed, span, attempts, sleep

    def _last(self) -> int | None:
        return backing_off(self.feed.last, self.attempts, self.sleep)

    def initialOffset(self) -> dict:
        try:
            return {"after": self._last() or 0}
        except Exception:  # noqa: BLE001  without an answer nothing is known to be old
            return {"after": 0}

    def latestOffset(self) -> dict:
        self.seen = max(getattr(self, "seen", 0), self._last() or 0)
        return {"after": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = start["after"], end["after"]
        step = self.span or max(1, upto - after)
        return [_Numbers(a, min(a + step, upto)) for a in range(after, upto, step)]

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        yield from backing_off(lambda: list(self.feed.between(partition.after, partition.upto)), self.attempts, self.sleep)

    def commit(self, end: dict) -> None:
        if hasattr(self.feed, "commit"):
            self.feed.commit(end["after"])


def polling_source(feed, name: str = "polled_updates", span: int | None = None, attempts: int = 6, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """A source to register: update_id, body. span: numbers a task reads; without it one task reads a batch,
    as feeds need that forget what was read past."""

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "update_id long, body string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _PollReader(feed, span, attempts, sleep)

    return Polled
