"""Registry, retries, daily logs, pruning and indexes."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlake.operators import routing
from gridlake.sources import readers, sinks
from gridlake.streaming import jobs


class Answer(Exception):
    def __init__(self, status):
        self.status = status


def test_retrying():
    tried, slept = [], []

    def call(*statuses):
        left = list(statuses)

        def run():
            tried.append(1)
            if left:
                raise Answer(left.pop(0))
            return "ok"

        return run

    assert readers.retrying(call(503), sleep=slept.append) == "ok" and slept == [20.0]
    with pytest.raises(Answer):
        readers.retrying(call(503, 429), sleep=slept.append)
    tried.clear()
    with pytest.raises(Answer):
        readers.retrying(call(404), sleep=slept.append)
    assert len(tried) == 1


def test_registry(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"sheets": [{"id": "a", "name": "A", "aliases": ["x"]}, {"id": "SHEET_ID_1"}, {"name": "none"}, {"id": "q", "qa_only": true, "pm_kpi": false}]}')
    assert [tuple(r)[1:4] for r in readers.registry(spark, str(path)).collect()] == [("a", "A", True)]
    assert [r.sheet_id for r in readers.registry(spark, str(path), True).orderBy("ordinal").collect()] == ["a", "q"]
    scan = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "workbook string, ok boolean")
    assert tuple(readers.run_errors(scan).first()) == (1, 1, False) and readers.run_errors(scan.where("NOT ok")).first().failed


def test_daily_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = lambda *x: spark.createDataFrame(list(x), "ts string, q string, a string").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.append_daily_log(sinks.log_pieces(rows(("2026-07-20 10:00:00", "q2", "a2"), ("2026-07-20 09:00:00", " q1 ", None))), path)
    sinks.append_daily_log(sinks.log_pieces(rows(("2026-07-20 11:00:00", "q3", "a3"), ("2026-07-21 08:00:00", "q" * 9000, ""))), path)
    text = lambda d: "\n".join(sorted(r.value for r in spark.read.text(f"{path}/day={d}", wholetext=True).collect()))
    first = text("2026-07-20")
    assert first.count("# 2026-07-20") == 1 and first.index("09:00 question\nq1") < first.index("10:00 question\nq2") and "q3" in first
    assert text("2026-07-21").startswith("# 2026-07-21") and 8000 < len(text("2026-07-21")) < 8100


def test_prune_and_index(spark, tmp_path):
    for name, at in (("old", 1_000), ("new", 3_000)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (at, at))
    assert sinks.prune_older(spark, str(tmp_path), 2_000_000) == ["old"] and (tmp_path / "new").exists()
    index = spark.createDataFrame([("a", "1"), ("b", "2")], "link string, day string")
    new = spark.createDataFrame([("b", "2"), ("c", "3"), ("c", "3")], "link string, day string")
    assert [r.link for r in sinks.newest_first(index, new).collect()] == ["c", "b", "a"]


def test_freshness(spark):
    now = F.lit("2026-07-20 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2026-07-20", "2026-07-20 06:00:00"), ("2026-07-20", "2026-07-20 05:59:59"), ("2026-07-19", "2026-07-20 11:00:00"), (None, None)], "day string, m string")
    got = rows.select(routing.fresh(F.col("day").cast("date"), F.col("m"), now).alias("x"), routing.needs_live(F.lit("hozir qanday"), ["hozir"]).alias("y")).collect()
    assert [r.x for r in got] == [True, False, False, False] and got[0].y


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tabs": {"T": [["x", 1, null], ["y"]], "Off": [["z"]]}}')
    (tmp_path / "b.json").write_text("{nothing")
    (tmp_path / "c.txt").write_text("no workbook")
    got = {(r.workbook, r.tab): (r.grid, r.excluded, r.ok, r.error) for r in readers.workbooks(spark, f"file://{tmp_path}", ("Off",)).collect()}
    assert got == {("a.json", "T"): ([["x", "1", None], ["y"]], False, True, None), ("a.json", "Off"): (None, True, True, None), ("b.json", None): (None, False, False, "no tabs")}
    cut = readers.workbooks(spark, f"file://{tmp_path}", most_rows=1, most_columns=2).where("tab = 'T'").first()
    assert cut.grid == [["x", "1"]]


def test_single_run(spark, tmp_path):
    lock = f"file://{tmp_path}/job.lock"
    with jobs.single_run(spark, lock) as first, jobs.single_run(spark, lock) as second:
        assert first and not second
        with jobs.single_run(spark, lock) as third:
            assert not third
    with jobs.single_run(spark, lock) as again:
        assert again


def test_sheets_by_relation():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda t: f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>{t}</t></is></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" r:id="rId2"/><sheet name="B" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("of b"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("of a"))
    assert readers.extract_bytes("x.xlsx", data.getvalue()).split("\n") == ["## A", "of a", "## B", "of b"]
