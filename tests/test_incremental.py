"""Results kept by day, files mirrored once, and jobs started when due."""

import datetime
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from gridlake.plans import cache
from gridlake.sources import mirror
from gridlake.streaming import jobs


def month_snapshot(folder, day, sheets):
    at = folder / day
    at.mkdir(parents=True, exist_ok=True)
    for name, rows in sheets.items():
        head = ["Proekt nomi", "Kpi ideal bali", "Proekt bali", "Kechga qolgan"]
        doc = {"id": name, "name": name, "ranges": {"'Iyul '!A1:BZ1000": {"actual_range": "x", "values": [["list"], head, *rows]}}}
        (at / f"{name}.json").write_text(json.dumps(doc))


def test_only_changed_days_are_read(spark, tmp_path, monkeypatch):
    raw, kept = tmp_path / "snapshots", f"file://{tmp_path}/kept"
    for i in range(1, 13):
        month_snapshot(raw, f"2026-07-{i:02}", {"s1": [["p", str(i), "1", "0"]], "s2": [["q", "0", "5", "0"]]})
    (raw / "notes").mkdir()
    read = []
    monkeypatch.setattr(cache, "snapshots", lambda spark, folder, day, f=cache.snapshots: read.append(day) or f(spark, folder, day))
    run = lambda today: cache.daily_scorecards(spark, f"file://{raw}", today, kept)
    cards, computed = run("2026-07-12")
    assert computed == read == [f"2026-07-{i:02}" for i in range(2, 12)]
    assert {(str(r.day), r.sheet_id, r.plan) for r in cards.collect()} == {(f"2026-07-{i:02}", "s1", i) for i in range(2, 12)}  # s2 plans nothing
    read.clear()
    cards, computed = run("2026-07-13")
    assert computed == read == ["2026-07-12"] and cards.count() == 10
    month_snapshot(raw, "2026-07-05", {"s1": [["p", "50", "1", "0"], ["r", "2", "1", "0"]]})
    read.clear()
    cards, computed = run("2026-07-13")
    assert computed == read == ["2026-07-05"] and {r.plan for r in cards.where("day = '2026-07-05'").collect()} == {52.0}
    assert run("2026-07-13")[1] == []
    # a run that was lost has no mark: it is made again
    known = cache.day_fingerprints(spark, f"file://{raw}")
    os.remove(tmp_path / "kept" / "2026-07-07" / known["2026-07-07"] / "_SUCCESS")
    assert run("2026-07-13")[1] == ["2026-07-07"]
    gone = cache.DayCache(spark, kept).vacuum(known)
    assert len(gone) == 1 and gone[0].startswith("2026-07-05/") and run("2026-07-13")[1] == []
    assert cache.daily_scorecards(spark, f"file://{tmp_path}/none", "2026-07-13", kept) == (None, [])
    shutil.rmtree(raw / "2026-07-12")
    assert "2026-07-12" not in cache.day_fingerprints(spark, f"file://{raw}")


def test_mirror_copies_new_and_changed_files_once(spark, tmp_path):
    spark.dataSource.register(mirror.MirrorFolder)
    target = tmp_path / "mirror"
    target.mkdir()

    def put(rows, **options):
        df = spark.createDataFrame(rows, "path string, body string").repartition(3)
        df.write.format("mirror_folder").option("path", f"file://{target}").options(**options).mode("append").save()

    read = lambda: {str(p.relative_to(target)): p.read_text() for p in target.rglob("*") if p.is_file()}
    put([("2026-07-01.md", "bir"), ("chat/a.md", "é" * 10), ("chat/b.md", "")])
    assert read() == {"2026-07-01.md": "bir", "chat/a.md": "é" * 10, "chat/b.md": ""}
    for p in target.rglob("*.md"):
        os.utime(p, (1000, 1000))
    put([("2026-07-01.md", "bir"), ("chat/a.md", "changed"), ("new/c.md", "c")])
    assert read() == {"2026-07-01.md": "bir", "chat/a.md": "changed", "chat/b.md": "", "new/c.md": "c"}
    assert sorted(str(p.relative_to(target)) for p in target.rglob("*.md") if p.stat().st_mtime == 1000) == ["2026-07-01.md", "chat/b.md"]
    put([("chat/a.md", "seed"), ("d.md", "seed")], only="missing")
    assert read()["chat/a.md"] == "changed" and read()["d.md"] == "seed"
    with pytest.raises(Exception, match="no path below"):
        put([("e.md", "e"), ("../out.md", "x")])
    assert "e.md" not in read() and not (tmp_path / "out.md").exists()  # a job that fails changes nothing
    assert not [p for p in target.iterdir() if p.name.startswith(".staging")]
    binary = spark.createDataFrame([("x.bin", bytearray(b"\x00\xff"))], "path string, body binary")
    binary.write.format("mirror_folder").option("path", str(target)).mode("append").save()
    assert (target / "x.bin").read_bytes() == b"\x00\xff"


def test_paths_stay_below_the_folder():
    assert mirror.place("/a", "b/./c.md") == "/a/b/c.md"
    for bad in ("", ".", "..", "../x", "/x", "a/../../x"):
        with pytest.raises(ValueError):
            mirror.place("/a", bad)


def test_schedule(spark):
    at = datetime.datetime
    start = at(2026, 7, 1, 8, 0)
    jobs_ = [(j, start, d, e, g) for j, d, e, g in [("on_time", 540, None, 180), ("late", 540, None, 180), ("too_late", 540, None, 180), ("done", 540, None, 180), ("busy", 540, None, 180), ("new", 570, None, 180), ("every", None, 10, None), ("every_busy", None, 10, None), ("slept", 540, None, 5000)]]
    df = spark.createDataFrame(jobs_, "job string, since timestamp, daily_at int, every int, grace int")
    ran = [("on_time", at(2026, 7, 19, 9), True), ("late", at(2026, 7, 16, 9), True), ("done", at(2026, 7, 20, 9), True), ("busy", at(2026, 7, 19, 9), False), ("every", at(2026, 7, 20, 9, 20), True), ("every_busy", at(2026, 7, 20, 9, 20), False), ("slept", at(2026, 7, 17, 9), True), ("too_late", at(2026, 7, 18, 9), True)]
    runs = spark.createDataFrame([(j, d, d, d if ended else None) for j, d, ended in ran], "job string, due_at timestamp, started_at timestamp, ended_at timestamp")

    def due(now, names):
        got = jobs.schedule(df, runs, F.lit(now).cast("timestamp")).collect()
        return {r.job: (r.due_at, r.action, r.folded) for r in got if r.job in names}

    nine = at(2026, 7, 20, 9)
    got = due("2026-07-20 10:05:00", [j[0] for j in jobs_])
    assert got["on_time"] == (nine, "run", 0) and "done" not in got and got["busy"] == (nine, "busy", 0)
    assert got["late"] == (nine, "run", 3)  # of four due times the last, once
    assert got["every"] == (at(2026, 7, 20, 10), "run", 3) and got["every_busy"] == (at(2026, 7, 20, 10), "busy", 3)
    assert got["new"] == (at(2026, 7, 20, 9, 30), "run", 19)
    assert due("2026-07-20 12:30:00", ["too_late", "slept"]) == {"too_late": (nine, "missed", 1), "slept": (nine, "run", 2)}
    assert due("2026-07-20 08:00:00", ["too_late", "on_time"]) == {"too_late": (at(2026, 7, 19, 9), "missed", 0)}
    first = jobs.schedule(df.where("job = 'new'"), runs, F.lit("2026-07-01 08:30:00").cast("timestamp"))
    assert first.count() == 0 and jobs.schedule(df.where("false"), runs, F.current_timestamp()).count() == 0
