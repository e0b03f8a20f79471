"""Workbooks as a data source: a tab is a request of its own, so tabs that a query rules out aren't read.

A client is an object with workbooks(), the ids; tabs(workbook), the titles in order; and grid(workbook, tab),
the rows of cells. It is sent to executors, so it holds addresses, not connections. Every call is tried once
more after one of the transient statuses. readers.workbooks reads files by any path that Spark's readers open.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, Not, StringContains, StringEndsWith, StringStartsWith

from gridlake.sources.readers import retrying

#: Rows and columns of a tab that are read.
MOST_ROWS, MOST_COLUMNS = 1000, 78
SCHEMA = "workbook string, ordinal int, tab string, grid array<array<string>>, ok boolean, error string"


class HttpWorkbooks:
    """JSON answers of /workbooks (a list of ids), /workbooks/ID/tabs (titles) and /workbooks/ID/values/TAB?rows=&columns= (rows)."""

    def __init__(self, address: str, timeout: float = 60.0):
        self.address, self.timeout = address.rstrip("/"), timeout

    def _get(self, *path: str, **options) -> list:
        at = "/".join([self.address, *(urllib.parse.quote(p, safe="") for p in path)])
        with urllib.request.urlopen(f"{at}?{urllib.parse.urlencode(options)}" if options else at, timeout=self.timeout) as answer:  # an error has the status
            return json.load(answer)

    def workbooks(self) -> list[str]:
        return self._get("workbooks")

    def tabs(self, workbook: str) -> list[str]:
        return self._get("workbooks", workbook, "tabs")

    def grid(self, workbook: str, tab: str) -> list[list]:
        return self._get("workbooks", workbook, "values", tab, rows=MOST_ROWS, columns=MOST_COLUMNS)


class FolderWorkbooks:
    """JSON files {"tabs": {title: rows}} in a folder of any filesystem that pyarrow opens by its URI."""

    def __init__(self, folder: str):
        self.folder = folder if "://" in folder else os.path.abspath(folder)

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def _load(self, workbook: str) -> dict:
        system, path = self._at()
        with system.open_input_stream(f"{path.rstrip('/')}/{workbook}") as f:
            return json.loads(f.read())["tabs"]

    def workbooks(self) -> list[str]:
        from pyarrow import fs

        system, path = self._at()
        return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and i.base_name.endswith(".json"))

    def tabs(self, workbook: str) -> list[str]:
        return list(self._load(workbook))

    def grid(self, workbook: str, tab: str) -> list[list]:
        return self._load(workbook)[tab]


def _test(f: Filter) -> tuple[str, Callable[[str], bool]] | None:
    """(column, test) of a filter on a name; None for others."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (inner[0], lambda name: not inner[1](name))
    found = {
        EqualTo: lambda n: n == f.value,
        EqualNullSafe: lambda n: n == f.value,
        In: lambda n: n in f.value,
        StringStartsWith: lambda n: n.startswith(f.value),
        StringEndsWith: lambda n: n.endswith(f.value),
        StringContains: lambda n: f.value in n,
    }.get(type(f))
    return found and len(f.attribute) == 1 and f.attribute[0] in ("workbook", "tab") and (f.attribute[0], found) or None


class _Tabs(InputPartition):
    def __init__(self, workbook: str, tabs: list[tuple[int, str]] | None, error: str | None = None):
        super().__init__(workbook)
        self.workbook, self.tabs, self.error = workbook, tabs, error


class _PlainReader(DataSourceReader):
    def __init__(self, client, excluded: set[str], per_task: int, sleep: Callable[[float], None]):
        self.client, self.excluded, self.per_task, self.sleep = client, excluded, per_task, sleep
        self.tests: dict[str, list[Callable[[str], bool]]] = {"workbook": [], "tab": []}

    def _wanted(self, column: str, name: str) -> bool:
        return all(test(name) for test in self.tests[column])

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for book in retrying(self.client.workbooks, sleep=self.sleep):
            if not self._wanted("workbook", book):
                continue
            try:
                titles = retrying(lambda book=book: self.client.tabs(book), sleep=self.sleep)
                tabs = [(i, t) for i, t in enumerate(titles) if t not in self.excluded and self._wanted("tab", t)]
                out += [_Tabs(book, tabs[a : a + self.per_task]) for a in range(0, len(tabs), self.per_task)]
            except Exception as e:  # noqa: BLE001  one workbook's failure is a row; the others go on
                out.append(_Tabs(book, None, f"{type(e).__name__}: {e}"))
        return out

    def read(self, partition: _Tabs) -> Iterator[tuple]:
        if partition.tabs is None:
            yield (partition.workbook, None, None, None, False, partition.error)
            return
        for i, tab in partition.tabs:
            try:
                rows = retrying(lambda tab=tab: self.client.grid(partition.workbook, tab), sleep=self.sleep)
                yield (partition.workbook, i, tab, [[None if c is None else str(c) for c in r[:MOST_COLUMNS]] for r in rows[:MOST_ROWS]], True, None)
            except Exception as e:  # noqa: BLE001  one tab's failure is a row
                yield (partition.workbook, i, tab, None, False, f"{type(e).__name__}: {e}")


class _WorkbookReader(_PlainReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = _test(f)
            if found:
                self.tests[found[0]].append(found[1])
            yield f  # Spark filters too: rows of failures have no tab


def workbook_source(client, name: str = "workbooks", per_task: int = 1, sleep: Callable[[float], None] = time.sleep, pushdown: bool = True) -> type[DataSource]:
    """A source to register: workbook, ordinal, tab, grid, ok, error. per_task: tabs that a task reads.

    Option excludedTabs: titles, with commas between. With pushdown, which spark.sql.python.filterPushdown.enabled
    must allow, conditions on workbook and tab reach the client, too: what they rule out is never asked for. A
    workbook or tab that can't be read is a row with ok = false.
    """

    class Workbooks(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            found = client if client is not None else FolderWorkbooks(self.options["path"])
            return (_WorkbookReader if pushdown else _PlainReader)(found, set(filter(None, self.options.get("excludedTabs", "").split(","))), per_task, sleep)

    return Workbooks


#: spark.read.format("grid_directory").option("path", folder), once registered.
GridDirectory = workbook_source(None, "grid_directory", per_task=1000, pushdown=False)
