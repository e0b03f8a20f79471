"""Operators on small synthetic inputs with results worked out by hand."""

import datetime
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from gridlake.functions import dates, text
from gridlake.operators import audit, diff, grid, kb, present, receivables, routing, scorecard, sync
from gridlake.sources import readers, sinks, workbooks
from gridlake.streaming import jobs

D = datetime.date


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert column(spark, ["$1 600", "$1 600", "1 800,50", "", "—", "1,800", "-5"], text.money) == [1600, 1600, 1800.5, 0, 0, 1.8, -5]
    assert column(spark, ["Ketdi", "🚪 Ketdi", "Kutilmoqda", "To'lov qilindi ✅", "PAUZA", None], text.status) == ["churned", "churned", "pending", "paid", "paused", "pending"]
    assert column(spark, ["5 %", "1,5", "x", "NaN", "1.2.3"], text.number) == [5, 1.5, None, None, None]
    assert column(spark, [0, 25, 26, 701, 702], text.column_letters, "int") == ["A", "Z", "AA", "ZZ", "AAA"]
    assert column(spark, ["ab ", "a\r\nb \n\n\n\n\nc", "oʻzbek ‘x’"], text.normalise_document) == ["ab", "a\nb\n\n\nc", "o'zbek 'x'"]
    assert column(spark, ["Ａ  b C "], text.norm) == ["a b c"]
    assert column(spark, [1234.5, 2.5, 0.0], text.usd, "double") == ["$1 234", "$2", "$0"]
    assert column(spark, ["x ```json\n{\"title\": 1}\n```", "{\"a\": 1}", "no"], text.fenced_answer) == ['{"title": 1}', None, None]
    assert column(spark, ["# a **b**\n- `c` <d>"], text.markdown_to_html) == ["<b>a <b>b</b></b>\n• <code>c</code> &lt;d&gt;"]
    assert column(spark, ["t\nManba: a b.md, c.md\nManba: d.md, e.md"], lambda c: text.source_paths(c).getField("paths")) == [["a b.md", "c.md", "d.md"]]
    assert column(spark, ["a b/c.md"], text.url_path) == ["a%20b/c.md"]
    assert column(spark, ["https://tok@host/x", "y"], text.redact_tokens) == ["https://***@host/x", "y"]
    assert column(spark, ["muddatlar va IT-xizmat", "a b"], text.query_terms) == [["muddatlar", "xizmat"], ["a", "b"]]
    assert column(spark, ["d/my-file_x.md"], text.file_title) == ["my file x"]
    assert column(spark, ["x\n## T one \ny"], text.first_heading) == ["T one"]
    assert text.text_of_html("<p>a<script>x</script> b</p><style>c</style><i>d</i>") == "a\nb\nd"
    assert column(spark, [r"{\rtf1 \b hi\b0  \'e9there}"], text.rtf_text) == ["hi there"]


def test_due_dates(spark):
    today = F.lit("2026-07-20").cast("date")
    same = D(2026, 8, 5)
    values = ["05.08", "5.8", " 05.08 ", "05,08", "2026-08-05", "05.08.2025", "05/08/2025", "05.08.25", "45874", "45874.0", "31.02", "5", "soon", None]
    want = [same] * 5 + [D(2025, 8, 5)] * 5 + [None] * 4
    assert column(spark, values, lambda c: dates.due_date(c, today)) == want
    days = ["2026-07-19", "2026-07-25", "2026-07-26", None]
    assert column(spark, days, lambda c: dates.due_bucket(c.cast("date"), today)) == ["overdue", "soon", "future", "nodate"]
    assert column(spark, ["yanvar va mart", "mart", "may va kamay", "iyun aprel may", "dekabr fevral"], dates.months_in) == [[1, 2, 3], [3], [5], [6, 4, 5], [12, 1, 2]]
    tabs = ["undiruv sentabr", "undiruv sentyabr (2026)", "undiruv sentyabr(x)", "undiruv may", "undiruv sentyabrx"]
    assert column(spark, tabs, lambda c: dates.tab_matches_month(c, "undiruv", 9)) == [True, True, True, False, False]
    assert column(spark, ["2026-07-20"], lambda c: dates.human_date(c.cast("date"))) == ["20.07.2026 (Mon)"]


HEAD = ["Person", "Score", "Deadline", "Status", "Note"]
DAY1 = [HEAD, ["p1", "92", "2026-07-20", "open", "n1"], ["p2", "78", "2026-07-18", "open", "n2"], ["p3", "85", "2026-07-25", "open", "n3"], ["p4", "88", "2026-07-19", "done", "n4"]]
DAY2 = [HEAD, ["p1", "95", "2026-07-20", "open", "n1"], ["p2", "61", "2026-07-22", "late", "n2"], ["p4", "88", "2026-07-19", "done", "n4"], ["p5", "70", "2026-07-30", "new", "n5"]]


def grids(spark, *rows):
    return spark.createDataFrame([("d", "s", f"r{i}", g) for i, g in enumerate(rows)], "day string, sheet_id string, range string, grid array<array<string>>")


def test_grid_diff(spark):
    keyed = lambda g: grid.keyed_rows(grids(spark, g), F.lit(0))
    keys = ["sheet_id", "range", "key", "dup_no"]
    d = diff.grid_diff(keyed(DAY1), keyed(DAY2), keys)
    got = {r.key: (r.kind, [c.col_no for c in r.cells or []]) for r in d.collect()}
    assert got == {"p1": ("changed", [1]), "p2": ("changed", [1, 2, 3]), "p3": ("removed", []), "p4": ("unchanged", []), "p5": ("added", [])}
    stats = diff.counts(d, ["range"])
    assert stats.first()[1:] == (1, 1, 2, 1) and not diff.quiet(stats).first()[0]
    assert diff.quiet(diff.counts(diff.grid_diff(keyed(DAY2), keyed(DAY2), keys), ["range"])).first()[0]
    ragged = diff.grid_diff(keyed([["K", "V", "W"], ["k", "1"]]), keyed([["K", "V", "W"], ["k", "1", "x"]]), keys).first()
    assert [(c.col_no, c.old, c.new) for c in ragged.cells] == [(2, "", "x")]
    base = diff.baseline(keyed(DAY1), ["range"]).first()
    assert base.rows_now == 4 and len(base.sample) == 4


def test_grid_edges(spark):
    g = grids(spark, [[], ["url"], ["A", "B", "C"], ["1", "2", "3"]], [], [["K", ""], ["A"], ["A"], [" ", " "], ["", "v"], ["A"]])
    rows = g.select("range", grid.header_row(F.col("grid"))).collect()
    assert sorted(map(tuple, rows)) == [("r0", 2), ("r1", 0), ("r2", 0)]
    keyed = grid.keyed_rows(grids(spark, [["K", "V"], ["A"], ["A"], [" ", " "], ["", "v"], ["A"]]), F.lit(0)).orderBy("row_no").collect()
    assert [(r.key, r.dup_no, r.row_no) for r in keyed] == [("A", 1, 2), ("A", 2, 3), ("(blank key, row 5)", 1, 5), ("A", 3, 6)]
    head = grid.headers(grids(spark, [["Nomi", "Aktive Summary", "", "Summa"]]))
    assert [r.title for r in head.orderBy("col_no").collect()] == ["Nomi", "Aktive Summary", "C-column", "Summa"]
    assert grid.bind_substring(head, {"amount": ["summa"], "none": ["zz"]}).select("amount", "none").first() == (1, None)
    assert grid.bind_exact_then_substring(head, {"amount": ["summa"], "prepaid": ["aktive"], "x": ["zz"]}).select("amount", "prepaid", "x").first() == (3, 1, None)
    cells = grid.cells(grids(spark, [["a", "b"], ["c"]]))
    assert sorted((r.row_no, r.col_no, r.value) for r in cells.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    rows = spark.createDataFrame([("d", "s", "r", i, [v]) for i, v in enumerate(["a", "b", "narvon", "c"])], "day string, sheet_id string, range string, row_no int, row array<string>")
    assert grid.prefix_until(rows, grid.marker_row(F.col("row"))).count() == 2


def test_receivables(spark):
    rows = spark.createDataFrame(
        [("alpha", "o1", "churned", 0.0, 0.0, 0.0, 1800.0, False), ("beta", "o2", "pending", 1600.0, 0.0, 0.0, 1600.0, False), ("gamma", "o2", "pending", 1800.0, 0.0, 0.0, 1800.0, True), ("delta", "o1", "pending", 1266.0, 500.0, 0.0, None, True)],
        "project string, owner string, status string, outstanding double, collected double, prepaid double, lost double, status_blank boolean",
    )
    t = receivables.totals(rows).first()
    assert (t.agreed, t.collected, t.outstanding, t.gap, t.blank_status) == (5166, 500, 4666, 0, 2)
    c = receivables.churn_summary(rows).first()
    assert (c.n, c.lost, c.mismatch, c.names) == (1, 1800, 2, "alpha")
    now = spark.createDataFrame([("beta", "pending", 0.0, 1), ("beta", "paid", 0.0, 2), ("gamma", "pending", 0.0, 1)], "project string, status string, collected double, n int")
    assert {r.project: r.closed for r in receivables.carry_over(rows, now, "project", "n").collect()} == {"beta": True, "gamma": False, "delta": False}
    tabs = spark.createDataFrame([("x avgust",), ("x avgust(2026)",), ("x avgust(2025)",)], "title string")
    assert [r.title for r in receivables.month_tabs(tabs, 2026).collect()] == ["x avgust(2026)", "x avgust"]
    contacts = spark.createDataFrame([("o1", 7)], "slot_key string, slot int")
    assert {r.owner: r.found for r in receivables.to_contacts(rows.select("owner").distinct(), contacts, text.slot_key(F.col("owner"))).collect()} == {"o1": True, "o2": False}


def test_pay_forecast(spark):
    row = spark.range(1).select(scorecard.pay_forecast(F.lit(8), F.lit(80.0), F.lit(4.0))).first()
    assert row[0] == 10 * 150000 + 6 * 150000 + 5000000


def test_acks(spark):
    found = spark.createDataFrame([("k", "s1"), ("k", "s2"), ("j", "s1")], "key string, sheet string")
    acks = spark.createDataFrame([("k", "s1", "d1", "n", 1), ("k", "", "d2", "m", 2)], "key string, sheet string, ack_day string, note string, ack_no int")
    got = {(r.key, r.sheet): r.ack_day for r in audit.acknowledge(found, acks).collect()}
    assert got == {("k", "s1"): "d1", ("k", "s2"): "d2", ("j", "s1"): None}


def test_ingest(spark):
    docs = spark.createDataFrame([("v", "a", "text one", 1, 1), ("v", "b", "new text", 2, 1), ("v", "c", "same", 3, 1)], "source string, origin string, text string, seq int, n_chunks int")
    have = kb.identified(docs.withColumn("text", F.when(F.col("origin") == "b", "old text").otherwise(F.col("text"))).where("origin <> 'a'")).drop("seq").withColumn("archived", F.lit(True))
    got = kb.classify_ingest(kb.identified(docs), have)
    assert {r.origin: r.ingest for r in got.collect()} == {"a": "new", "b": "updated", "c": "unchanged"}
    after = {r.origin: (r.text, r.archived) for r in kb.merged(got, have).collect()}
    assert after == {"a": ("text one", False), "b": ("new text", False), "c": ("same", True)}
    gone = spark.createDataFrame([("c",)], "origin string")
    assert {r.origin for r in kb.archive(have.withColumn("archived", F.lit(False)), "v", gone).where("archived").collect()} == {"c"}


def test_chunks():
    body = "x" * 250
    assert kb.chunk_text(f"intro\n# A\n{body}\n## B\nshort\n# C\n{body}") == [("A", f"intro\n\n# A\n{body}"), ("A > B", f"## B\nshort\n\n# C\n{body}")]
    long = "\n\n".join(["p" * 1400] * 5)
    pieces = kb.split_large(long)
    assert len(pieces) == 4 and all(len(p) <= 3302 for p in pieces) and pieces[1].startswith("p" * 300)
    assert kb.sections("x\n# A #\ny\n### B\n## C ##\n# D\n#no") == [("", "x"), ("A", "# A #\ny"), ("A > B", "### B"), ("A > C", "## C ##"), ("D", "# D\n#no")]
    assert kb.split_large("y" * 7000)[0] == "y" * 3000
    assert kb.chunk_text("") == [] and len(kb.chunk_text("\n".join(f"# h{i}\n{body}" for i in range(2100)))) == 2100


def test_bm25_equals_sqlite(spark):
    import random

    rng = random.Random(4)
    words = ["muddat", "muddatlar", "shartnoma", "hisob", "oylik", "mijoz", "tolov"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 30))), " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, heading)")
    con.executemany("INSERT INTO t(rowid, text, heading) VALUES (?, ?, ?)", [(i + 1, t, h) for i, t, h in rows])
    want = {r[0] - 1: r[1] for r in con.execute("SELECT rowid, bm25(t, 1.0, 0.5) FROM t WHERE t MATCH 'muddat* OR tolov*'")}
    df = spark.createDataFrame(rows, "chunk_id int, text string, heading string")
    got = {r.chunk_id: r.score for r in kb.bm25(df, ["muddat", "tolov"], heading_col="heading").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_context(spark):
    ranked = spark.createDataFrame([(1, 500, "vault"), (2, 400, "vault"), (3, 200, "vault"), (4, 50, "chat"), (5, 10, "chat"), (6, 10, "chat")], "rank int, n_chars int, source string")
    assert sorted(r["rank"] for r in kb.pack_two_tiers(ranked, 1000, 20).collect()) == [1, 2, 4, 5]
    framed = kb.pack_two_tiers(ranked, 300, 20, start=10, frame=5).collect()
    assert [(r["rank"], r["take"], r["used"]) for r in framed] == [(1, 284, 10), (4, 50, 85), (5, 10, 100)]
    assert [r["rank"] for r in kb.top(ranked, 2).orderBy("rank").collect()] == [1, 2]
    named = ranked.withColumn("was", F.col("rank"))
    assert [r.was for r in kb.reranked(named, [5, 3, 5, 99, 0], 3).orderBy("rank").collect()] == [5, 3, 1]
    assert [r.was for r in kb.reranked(named, [5], 6).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]
    big = kb.pack_context(ranked, 300).collect()
    assert [(r["rank"], r["take"]) for r in big] == [(1, 300)]


def test_context_of_many(spark):
    import random

    from gridlake.plans import queries

    sf_dir = "/root/testdata/sf0.1"
    rows = sorted((r.n_chars, r.doc_id) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("n_chars", "doc_id").collect())
    want, used = [], 0
    for n, i in rows:
        used += n
        if used > 12000:
            break
        want.append((i, used, n))
    got = sorted(tuple(r) for r in queries.context_pack(spark, sf_dir).select("doc_id", "used", "take").collect())
    assert len(want) > 200 and got == sorted(want)
    rng = random.Random(5)
    for budget in (0, 1, 7, 40, 41, 10**6):
        sizes = [rng.choice([0, 1, 3, 3, 5, 9]) for _ in range(60)]
        df = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, n_chars int")
        order = sorted((n, i) for i, n in enumerate(sizes))
        fits = [i for k, (_, i) in enumerate(order) if sum(n for n, _ in order[: k + 1]) <= budget]
        assert [r.doc_id for r in kb.prefix_within(df, budget).collect()] == fits
    assert [r.doc_id for r in kb.prefix_within(df.where("n_chars > 3"), 2).collect()] == [next(i for n, i in order if n > 3)]


def test_tree(spark):
    patterns = ["odam/", "kunlik/shaxsiy/", "*.private.md", "!kunlik/shaxsiy/keep.md"]
    paths = ["a/odam/x.md", "kunlik/shaxsiy/note.md", "bilim/x.private.md", "bilim/a.md", "kunlik/shaxsiy/keep.md", ".git/x.md"]
    assert column(spark, paths, lambda c: sync.ignored(c, patterns)) == [True, True, True, False, False, True]
    today = F.lit("2026-07-20").cast("date")
    assert column(spark, ["chat/2026-07-01.md", "chat/2026-01-01.md", "chat/notes.md"], lambda c: sync.young(c, today)) == [True, False, True]


def test_present(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, None, 3.0, None, 4.0, 5.0])], "k string, i int, v double")
    assert sorted((r["first"], r["last"], r.points) for r in present.segments(df, ["k"], "i", "v").collect()) == [(0, 1, 2), (5, 6, 2)]
    runs = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([False, True, False, False])] + [("b", 0, False)], "k string, i int, ok boolean")
    assert {r.k: r.streak for r in present.fail_streak(runs, ["k"], "i", "ok").collect()} == {"a": 2, "b": 1}
    points = present.sparkline(spark.createDataFrame([("a", 0, 50.0), ("a", 1, 150.0)], "k string, i int, p double"), ["k"], "i", "p").orderBy("i").collect()
    assert [(p.x, p.y) for p in points] == [(0, 10), (100, 0)]
    assert present.extents(df, ["k"], "v").first()[1:] == pytest.approx((0.68, 5.32))


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    with pytest.raises(PermissionError):
        sinks.append_once(rows(("a", 1)), path, ["k"], [F.col("v")], sinks.SinkGuard("elsewhere"))
    for _ in range(2):
        sinks.append_once(rows(("a", 1), ("b", 2), ("b", 1)), path, ["k"], [F.col("v")], sinks.SinkGuard(path))
    sinks.append_once(rows((" a ", 9), ("c", 3)), path, ["k"], [F.col("v")])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 1), ("c", 3)]
    days = spark.createDataFrame([("2026-07-01", 1), ("2026-07-02", 2)], "day string, v int")
    sinks.write_days(days, f"{tmp_path}/d")
    sinks.write_days(days.where("v = 2").withColumn("v", F.lit(5)), f"{tmp_path}/d")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [1, 5]
    assert sinks.keep_days(spark, f"{tmp_path}/d", "2026-07-02") == ["2026-07-01"]
    sinks.append_once(rows(("a\u00a0", 5), ("\u00a0d", 1), ("d ", 2)), path, ["k"], [F.col("v")])
    assert sorted(r.k.strip() for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]
    os.makedirs(path + "-broken")
    with open(path + "-broken/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        sinks.append_once(rows(("a", 1)), path + "-broken", ["k"], [F.col("v")])
    assert os.path.exists(path + "-broken/part-0.parquet")
    assert sinks.pack_lines("a\n" + "b" * 9 + "\nc", 4) == ["a", "bbbb", "bbbb", "b\nc"]
    files = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, body string")
    assert [r.path for r in sinks.changed_files(files, files.where("path = 'x'")).collect()] == ["y"]


def test_snapshots_and_directory(spark, tmp_path):
    day = tmp_path / "2026-07-01"
    day.mkdir()
    doc = {"id": "s1", "name": "S", "ranges": {"T!A1:B2": {"actual_range": "x", "values": [["K", "V"], ["a", 1]]}}}
    (day / "a.json").write_text(json.dumps(doc))
    (day / "b.json").write_text("{broken")
    (day / "_meta.json").write_text("{}")
    docs, bad = readers.snapshots(spark, str(tmp_path), "2026-07-01")
    assert [r.file for r in bad.collect()] == ["b.json"]
    assert readers.grids(docs).first().grid == [["K", "V"], ["a", "1"]]
    books = tmp_path / "books"
    books.mkdir()
    (books / "one.json").write_text(json.dumps({"tabs": {"t": [["a", 1, None]], "hidden": [["x"]]}}))
    (books / "two.json").write_text("nope")
    spark.dataSource.register(workbooks.GridDirectory)
    got = spark.read.format("grid_directory").option("path", str(books)).option("excludedTabs", "hidden").load().orderBy("workbook").collect()
    assert [(r.workbook, r.tab, r.ok) for r in got] == [("one.json", "t", True), ("two.json", None, False)] and got[0].grid == [["a", "1", None]]


def test_extractors(tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    assert readers.extract_bytes("D.DOCX", (tmp_path / "d.docx").read_bytes()) == "hi\na | b"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>k</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>')
    assert readers.extract_bytes("x.xlsx", (tmp_path / "x.xlsx").read_bytes()) == "## S\nk, 5"
    assert readers.extract_bytes("x.txt", b"a\xff") == "a�"


def test_history_and_stream_state(spark, tmp_path):
    log = tmp_path / "h.jsonl"
    log.write_text("\n".join(['{"ts":"1","q":"a"}', "bad", '{"ts":"2","reset":true}', '{"ts":"3","q":"b"}', '{"ts":"4","q":"c"}']))
    assert [r.q for r in readers.since_reset(readers.history(spark, str(log))).collect()] == ["c", "b"]
    marks = spark.createDataFrame([(1, "start"), (1, "done"), (2, "start"), (3, "start"), (3, "start")], "update_id int, event string")
    assert {r.update_id: r.action for r in jobs.in_flight(marks).collect()} == {2: "retry", 3: "drop"}
    updates = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "update_id int, chat_id int")
    mine, others = jobs.owned(updates, 7)
    assert mine.count() == 1 and others.count() == 2
    assert jobs.backlog_skipped(updates, None).count() == 0 and jobs.backlog_skipped(updates, 1).count() == 2


def test_runs_of_blanks_take_linear_time(spark):
    import time

    from gridlake.functions.text import normalise_document, strip

    wide = " " * 400_000
    df = spark.createDataFrame([(f"{wide}a{wide}b{wide}\n{wide}c\u2028 ",)], "t string")
    began = time.perf_counter()
    row = df.select(strip(F.col("t")).alias("s"), normalise_document(F.col("t")).alias("n")).first()
    assert row.s == f"a{wide}b{wide}\n{wide}c" and row.n == f"a{wide}b\n{wide}c" and time.perf_counter() - began < 20


def test_speech_and_rtf(spark):
    from gridlake.functions.text import rtf_text, speech_summary

    talk = "One 3.5 percent rise. " + "word " * 30 + "```\ncode. here\n``` end"
    row = spark.createDataFrame([(talk, "{\\rtf1 first\\par second\\line third}")], "t string, r string").select(speech_summary(F.col("t"), 30).alias("s"), speech_summary(F.col("t")).alias("w"), rtf_text(F.col("r")).alias("r")).first()
    assert row.s == "One 3.5 percent rise." and "code" not in row.w and row.r == "first\nsecond\nthird"


def test_chunks_of_whole_documents(spark, small):
    """Every chunk lies in its text, but for joints; paths name headings of the text; none is over the limit."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_id = {}
    for r in kb.chunks(docs).orderBy("doc_id", "ord").collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id.keys() == {i for i, t in texts.items() if t.strip()}
    for i, found in by_id.items():
        assert [r.ord for r in found] == list(range(len(found))) and all(r.n_chars == len(r.text) <= 3302 for r in found)
        # without overlaps, the chunks hold all words of the text in order
        words, at = texts[i].split(), 0
        joined = found[0].text
        for r in found[1:]:
            # the tail of the chunk before is repeated where one section was split
            k = min(300, len(joined))
            joined += "\n\n" + (r.text[k + 2 :] if r.text.startswith(joined[-k:] + "\n\n") else r.text)
        assert "".join(joined.split()) == "".join(words) and at == 0


def test_text_of_pages_equals_a_plain_reading(spark, small):
    import re
    from html import unescape

    from gridlake.functions.text import html_text

    for r in spark.read.parquet(f"{small}/pages.parquet").limit(250).select("html", html_text("html").alias("t")).collect():
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", "", r.html)
        want = [unescape(x).strip() for x in re.split(r"(?s)<[!/?]?[a-zA-Z][^>]*>", bare)]
        assert "".join(r.t.split()) == "".join("".join(w.split()) for w in want)
