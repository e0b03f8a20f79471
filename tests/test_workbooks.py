"""Workbooks by requests and by files: what is ruled out isn't read, what fails is a row."""

import http.server
import io
import json
import threading
import urllib.parse
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlake.sources import readers, workbooks


@pytest.fixture
def server():
    state = {"books": {"b1": {"Main": [["k", 1, None]], "Off": [["x"]], "Iyul a/b": [["z"] * 100] * 1200}, "b2": {"Main": [["m"]]}}, "failures": {}, "asked": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = urllib.parse.urlparse(self.path).path
            parts = [urllib.parse.unquote(p) for p in path.strip("/").split("/")]
            state["asked"].append(tuple(parts))
            left = state["failures"].get(tuple(parts), [])
            status = left.pop(0) if left else 200
            found = list(state["books"])
            if len(parts) > 2:
                book = state["books"].get(parts[1], {})
                found = list(book) if parts[2] == "tabs" else book.get(parts[3], [])
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *args):
            pass

    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", state
    found.shutdown()


def no_wait(_):
    pass


@pytest.fixture
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def grids_asked(state):
    return sorted(a[1:] for a in state["asked"] if len(a) == 4)


def test_excluded_tabs_are_not_asked_for(spark, server, pushdown):
    address, state = server
    spark.dataSource.register(workbooks.workbook_source(workbooks.HttpWorkbooks(address), "books", sleep=no_wait))
    load = lambda **o: spark.read.format("books").options(**o).load()
    got = {(r.workbook, r.ordinal, r.tab): r for r in load(excludedTabs="Off").collect()}
    assert set(got) == {("b1", 0, "Main"), ("b1", 2, "Iyul a/b"), ("b2", 0, "Main")} and all(r.ok for r in got.values())
    assert got["b1", 0, "Main"].grid == [["k", "1", None]]
    big = got["b1", 2, "Iyul a/b"].grid
    assert (len(big), len(big[0])) == (1000, 78)
    assert grids_asked(state) == [("b1", "values", "Iyul a/b"), ("b1", "values", "Main"), ("b2", "values", "Main")]

    for condition, want in (
        ("tab NOT IN ('Off', 'Main')", [("b1", "values", "Iyul a/b")]),
        ("tab <> 'Main' AND tab LIKE 'O%'", [("b1", "values", "Off")]),
        ("workbook = 'b2'", [("b2", "values", "Main")]),
        ("tab = 'Main' AND workbook IN ('b1')", [("b1", "values", "Main")]),
    ):
        state["asked"].clear()
        rows = load().where(condition).collect()
        assert grids_asked(state) == want == sorted((r.workbook, "values", r.tab) for r in rows)
    state["asked"].clear()
    load().where("workbook = 'b2'").collect()
    assert ("workbooks", "b1", "tabs") not in state["asked"]


def test_failures_are_rows_and_transient_ones_are_tried_again(spark, server):
    address, state = server
    state["failures"] = {("workbooks", "b1", "values", "Main"): [503], ("workbooks", "b1", "values", "Off"): [429, 500], ("workbooks", "b2", "tabs"): [404], ("workbooks",): [502]}
    source = workbooks.workbook_source(workbooks.HttpWorkbooks(address), "books_failing", per_task=5, sleep=no_wait, pushdown=False)
    spark.dataSource.register(source)
    got = {(r.workbook, r.tab): (r.ok, r.error) for r in spark.read.format("books_failing").load().collect()}
    assert got["b1", "Main"] == (True, None) and got["b1", "Iyul a/b"] == (True, None)
    assert not got["b1", "Off"][0] and "500" in got["b1", "Off"][1]
    assert not got["b2", None][0] and "404" in got["b2", None][1]
    assert sum(a == ("workbooks", "b2", "tabs") for a in state["asked"]) <= 2
    errors = spark.read.format("books_failing").load().where("NOT ok")
    assert set(readers.run_errors(errors.select("workbook", "ok", "error")).first().asDict()) == {"n_ok", "n_failed", "failed"}


def test_folder_by_uri(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tabs": {"T": [["x", 1]]}}')
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.txt").write_text("")
    spark.dataSource.register(workbooks.GridDirectory)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = [(r.workbook, r.tab, r.ok) for r in spark.read.format("grid_directory").option("path", path).load().orderBy("workbook").collect()]
        assert got == [("a.json", "T", True), ("b.json", None, False)]


def test_days_by_listing(spark, tmp_path):
    for name in ("2026-07-01", "2026-07-02", "2026-13-01", "other", "2026-07-03x"):
        (tmp_path / name).mkdir()
    (tmp_path / "2026-07-09").write_text("a file")
    days = readers.snapshot_days(spark, str(tmp_path))
    assert sorted(str(r.day) for r in readers.available_days(days).collect()) == ["2026-07-01", "2026-07-02"]
    assert str(readers.previous_day(days, F.lit("2026-07-02").cast("date")).first().day) == "2026-07-01"
    assert readers.previous_day(days, F.lit("2026-07-01").cast("date")).first().day is None
    assert readers.snapshot_days(spark, f"{tmp_path}/none").count() == 0


def test_one_broken_file_is_told_in_its_row(spark, tmp_path, monkeypatch):
    good = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "good.docx").write_bytes(good.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip at all")
    (tmp_path / "short.xlsx").write_bytes(b"PK")
    (tmp_path / "long.txt").write_text("é" * (readers.MOST_CHARS + 5))
    (tmp_path / "x.rtf").write_text(r"{\rtf1 a\par b}")
    got = {r.origin.rpartition("/")[2]: r for r in readers.extracted(spark, f"file://{tmp_path}").collect()}
    assert (got["good.docx"].text, got["good.docx"].error, got["good.docx"].cut) == ("hi", None, False)
    assert got["broken.docx"].text is None and "BadZipFile" in got["broken.docx"].error
    assert got["short.xlsx"].text is None and got["short.xlsx"].error
    assert len(got["long.txt"].text) == readers.MOST_CHARS and got["long.txt"].cut
    assert got["x.rtf"].text == "a\nb" and not got["x.rtf"].cut and got["x.rtf"].error is None
