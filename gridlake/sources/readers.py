"""Sources: snapshot days, logs with resets, trees of files, extractors, and workbook files."""

from __future__ import annotations

import io
import json
import os
import re
import time
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.text import rtf_text, text_of_html

SNAPSHOT = "id string, name string, watch string, key_column string, fetched_at string, watch_ranges array<string>, tabs array<string>, excluded_tabs array<string>, ranges map<string,struct<actual_range:string,values:array<array<string>>>>"
SERVICE_FILES = ("_meta.json", "_diff.json", "_report.json", "_audit.json")
#: Characters of one extracted document.
MOST_CHARS = 4_000_000


def snapshots(spark: SparkSession, folder: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantined files) of a day; a file is known by the id inside it."""
    raw = spark.read.text(f"{folder}/{day}/*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = raw.where(~F.col("file").isin(*SERVICE_FILES)).withColumn("doc", F.from_json("value", SNAPSHOT, {"mode": "PERMISSIVE"}))
    good = F.col("doc.id").isNotNull()
    docs = parsed.where(good).select(F.lit(day).cast("date").alias("day"), F.col("doc.id").alias("sheet_id"), "doc.*")
    return docs, parsed.where(~good).select("file")


def grids(docs: DataFrame) -> DataFrame:
    """A row a range: day, sheet_id, ordinal (the range's place in the document), range, grid. Only watched ranges where the document names some."""
    rows = docs.select("day", "sheet_id", "watch_ranges", F.posexplode("ranges").alias("ordinal", "range", "r"))
    watched = F.col("watch_ranges").isNull() | F.array_contains("watch_ranges", F.col("range"))
    return rows.where(watched).select("day", "sheet_id", "ordinal", "range", F.col("r.values").alias("grid"))


def snapshot_days(spark: SparkSession, folder: str) -> DataFrame:
    """day of each subfolder named YYYY-MM-DD: one listing, no file is opened; none where the folder isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
    listed = spark.createDataFrame([(n,) for n in names], "name string").where(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return listed.select(F.try_to_timestamp("name", F.lit("yyyy-MM-dd")).cast("date").alias("day")).where("day IS NOT NULL")


def available_days(snapshot_days: DataFrame) -> DataFrame:
    return snapshot_days.select("day").distinct()


def previous_day(snapshot_days: DataFrame, today: Column) -> DataFrame:
    return snapshot_days.where(F.col("day") < today).agg(F.max("day").alias("day"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL log with their line order; lines that aren't JSON objects are dropped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    rec = F.from_json("value", "ts string, q string, a string, reset boolean")
    return lines.select("seq", rec.alias("r")).where("r IS NOT NULL AND (r.ts IS NOT NULL OR r.q IS NOT NULL)").select("seq", "r.*")


def since_reset(log: DataFrame, most: int = 10) -> DataFrame:
    """The last records with a question after the last reset."""
    last = log.agg(F.coalesce(F.max(F.when(F.col("reset"), F.col("seq"))), F.lit(-1)).alias("__last"))
    rest = log.join(F.broadcast(last), F.col("seq") > F.col("__last")).where("q IS NOT NULL").drop("__last")
    return rest.orderBy(F.desc("seq")).limit(most)


def tree(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """origin (path below folder), text, content_hash of each file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    below = F.regexp_replace(F.url_decode("_metadata.file_path"), rf"^.*{re.escape(folder.rstrip('/'))}/", "")
    return raw.select(below.alias("origin"), F.col("value").alias("text"), F.sha2("value", 256).alias("content_hash"))


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [text(p) for p in body.findall(f"{w}p")]
    for table in body.findall(f"{w}tbl"):
        lines += [" | ".join(text(c).strip() for c in row.findall(f"{w}tc")) for row in table.findall(f"{w}tr")]
    return "\n".join(x for x in lines if x.strip())


def _parts(z: zipfile.ZipFile) -> dict[str, str]:
    """The workbook's relations: id to the part's name in the archive; sheets may stand in any order there."""
    at = "xl/_rels/workbook.xml.rels"
    if at not in z.namelist():
        return {}
    rows = [(r.get("Id"), r.get("Target") or "") for r in ElementTree.fromstring(z.read(at))]
    return {k: t[1:] if t.startswith("/") else f"xl/{t}" for k, t in rows}


def _xlsx(data: bytes) -> str:
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")]
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    parts = _parts(z)
    out = []
    for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"), 1):
        out.append(f"## {sheet.get('name')}")
        for row in ElementTree.fromstring(z.read(parts.get(sheet.get(link), f"xl/worksheets/sheet{i}.xml"))).iter(f"{m}row"):
            cells = []
            for c in row.findall(f"{m}c"):
                v = c.find(f"{m}v")
                inline = "".join(t.text or "" for t in c.iter(f"{m}t"))
                cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else ""))
            if any(x.strip() for x in cells):
                out.append(", ".join(cells))
    return "\n".join(out)


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("PDF extraction needs the optional package pypdf") from e
    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  a broken page is an empty one
            pages.append("")
    return "\n\n".join(pages)


def extract_bytes(name: str, data: bytes, most: int = MOST_CHARS) -> str:
    """By the lower-case suffix; anything unknown is text. The first MOST_CHARS characters."""
    kind = os.path.splitext(name)[1].lower()
    plain = lambda: data.decode("utf-8", "replace")
    out = {".docx": lambda: _docx(data), ".xlsx": lambda: _xlsx(data), ".pdf": lambda: _pdf(data), ".html": lambda: text_of_html(plain()), ".htm": lambda: text_of_html(plain())}.get(kind, plain)()
    return out[:most]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType()), T.StructField("cut", T.BooleanType())]))
def _extract(names: pd.Series, data: pd.Series) -> pd.DataFrame:
    def one(name: str, content: bytes) -> tuple:
        try:
            text = extract_bytes(name, bytes(content), MOST_CHARS + 1)
            return text[:MOST_CHARS], None, len(text) > MOST_CHARS
        except Exception as e:  # noqa: BLE001  a broken file is told in its row
            return None, f"{type(e).__name__}: {e}", False

    return pd.DataFrame([one(n, d) for n, d in zip(names, data, strict=True)], columns=["text", "error", "cut"])


def extracted(spark: SparkSession, folder: str) -> DataFrame:
    """origin, text, error, cut of files of all supported kinds.

    A file that can't be read has an error and no text; the others go on. cut: it has more than MOST_CHARS
    characters, which is what text holds of it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = raw.select(F.col("path").alias("origin"), "content", _extract(F.col("path"), F.col("content")).alias("x"))
    rtf = F.lower("origin").endswith(".rtf")
    whole = rtf_text(F.decode("content", "UTF-8"))
    text = F.when(rtf, F.substring(whole, 1, MOST_CHARS)).otherwise(F.col("x.text"))
    return found.select("origin", text.alias("text"), "x.error", F.when(rtf, F.char_length(whole) > MOST_CHARS).otherwise(F.col("x.cut")).alias("cut"))


#: Answers of a remote source after which one more try makes sense.
TRANSIENT = (429, 500, 502, 503)


def retrying(call, attempts: int = 2, wait: float = 20.0, status=lambda e: getattr(e, "status", None), sleep=time.sleep):
    """call(), again after a pause where it failed with a transient status. Other failures go straight up."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception as e:
            if not left or status(e) not in TRANSIENT:
                raise
            sleep(wait)


def registry(spark: SparkSession, path: str, with_question_only: bool = False, placeholders: tuple[str, ...] = ("SHU_YERGA", "SHEET_ID")) -> DataFrame:
    """The configured sheets of a YAML or JSON file, in order: ordinal, sheet_id, name, is_scorecard, question_only, aliases.

    Entries without an id or with a placeholder for one are left out, and those for questions only unless asked for.
    A registry is written by hand and read on the driver.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML registry needs the optional package pyyaml; JSON needs none") from e
        config = yaml.safe_load(text)
    rows = []
    for i, s in enumerate((config or {}).get("sheets") or []):
        sheet_id = str(s.get("id") or "")
        if sheet_id and not any(p in sheet_id for p in placeholders) and (with_question_only or not s.get("qa_only")):
            rows.append((i, sheet_id, str(s.get("name", sheet_id)), bool(s.get("pm_kpi", True)), bool(s.get("qa_only", False)), [str(a) for a in s.get("aliases") or []]))
    return spark.createDataFrame(rows, "ordinal int, sheet_id string, name string, is_scorecard boolean, question_only boolean, aliases array<string>")


def run_errors(status: DataFrame) -> DataFrame:
    """One row of a scan's (workbook, ok, error) rows: n_ok, n_failed and failed, which is true where none worked."""
    per = status.groupBy("workbook").agg(F.min("ok").alias("ok"))
    return per.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), ((F.count(F.lit(1)) > 0) & (F.count_if("ok") == 0)).alias("failed"))


def workbooks(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (), most_rows: int = 1000, most_columns: int = 78) -> DataFrame:
    """workbook, tab, grid, excluded, ok, error of the JSON workbooks in a folder that Spark's readers can open.

    Excluded tabs keep their name but no cells. A file without tabs is one row with ok = false; others go on.
    """
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("workbook"), "value")
    tabs = F.from_json("value", "tabs map<string,array<array<string>>>")["tabs"]
    listed = text.select("workbook", tabs.alias("tabs")).select("workbook", F.col("tabs").isNotNull().alias("ok"), F.explode_outer("tabs").alias("tab", "cells"))
    out = F.col("tab").isin(*excluded) if excluded else F.lit(False)
    grid = F.when(~out, F.transform(F.slice("cells", 1, most_rows), lambda r: F.slice(r, 1, most_columns)))
    return listed.select("workbook", "tab", grid.alias("grid"), F.coalesce(out, F.lit(False)).alias("excluded"), "ok", F.when(~F.col("ok"), "no tabs").alias("error"))
