"""Grids: cells, headers found by their filling, columns bound by title, rows keyed and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.text import blank, column_letters, norm, strip

AT = ["day", "sheet_id", "range"]


def cells(grids: DataFrame, at: list[str] = AT) -> DataFrame:
    """A row a cell: 1-based row_no, 0-based col_no, value."""
    rows = grids.select(*at, F.posexplode("grid").alias("r", "row")).withColumn("row_no", F.col("r") + 1)
    return rows.select(*at, "row_no", F.posexplode("row").alias("col_no", "value"))


def header_row(grid: Column, within: int = 6) -> Column:
    """0-based row with most filled cells among the first ones; the first of equals; 0 of an empty grid."""
    filled = F.transform(F.slice(grid, 1, within), lambda row, i: F.struct(F.size(F.filter(row, lambda c: ~blank(c))).alias("n"), (-i).alias("i")))
    return F.coalesce(-F.array_max(filled)["i"], F.lit(0))


def column_label(title: Column, col_no: Column) -> Column:
    return F.when(blank(title), F.concat(column_letters(col_no), F.lit("-column"))).otherwise(strip(title))


def headers(grids: DataFrame, at: list[str] = AT) -> DataFrame:
    found = grids.withColumn("header_row", header_row(F.col("grid")))
    rows = found.select(*at, "header_row", F.posexplode(F.coalesce(F.get("grid", "header_row"), F.expr("cast(array() as array<string>)"))).alias("col_no", "raw"))
    return rows.select(*at, "header_row", "col_no", "raw", column_label(F.col("raw"), F.col("col_no")).alias("title"))


def bind_substring(head: DataFrame, needles: dict[str, list[str]], at: list[str] = AT) -> DataFrame:
    """For each name the first column whose title contains any needle; NULL without one."""
    title = norm(F.col("raw"))
    hit = lambda ns: F.exists(F.array(*map(F.lit, ns)), lambda n: F.contains(F.col("__t"), n))
    return head.withColumn("__t", title).groupBy(*at).agg(*(F.min(F.when(hit(ns), F.col("col_no"))).alias(name) for name, ns in needles.items()))


def bind_exact_then_substring(head: DataFrame, needles: dict[str, list[str]], at: list[str] = AT) -> DataFrame:
    """Needle by needle: an equal title first, then one that contains it."""
    df = head.withColumn("__t", norm(F.col("raw")))
    out = []
    for name, ns in needles.items():
        # an earlier needle's containment beats a later needle's equality
        rank = F.least(*(F.when(F.col("__t") == n, 2 * i).when(F.contains(F.col("__t"), F.lit(n)), 2 * i + 1) for i, n in enumerate(ns)), F.lit(None).cast("int"))
        out.append(F.min(F.when(rank.isNotNull(), F.struct(rank, F.col("col_no")))).getField("col_no").alias(name))
    return df.groupBy(*at).agg(*out)


def prefix_until(rows: DataFrame, stop: Column, at: list[str] = AT) -> DataFrame:
    """Rows before the first of each range where stop holds."""
    first = F.min(F.when(stop, F.col("row_no"))).over(Window.partitionBy(*at))
    return rows.withColumn("__stop", first).where(F.col("__stop").isNull() | (F.col("row_no") < F.col("__stop"))).drop("__stop")


#: Cells that end a score table.
MARKERS = ("kpi turi", "joriy kpi", "proekt manager", "kechikish kun", "kechga qolish", "o'rtacha ball", "meetinglar", "yangi mijozlar 1 hafta", "narvon", "shablon", "proekt", "limit")


def marker_row(row: Column) -> Column:
    """row holds normalised cells."""
    return (
        F.arrays_overlap(row, F.array(*map(F.lit, MARKERS)))
        | F.exists(row, lambda c: F.contains(c, F.lit("oyligi")))
        | (F.array_contains(row, "summa") & F.array_contains(row, "fix"))
        | (F.array_contains(row, "limit") & F.array_contains(row, "foiz"))
    )


def keyed_rows(grids: DataFrame, key_no: Column, at: list[str] = AT) -> DataFrame:
    """Data rows below the header with key and dup_no (1 for the first of a key); blank rows vanish.

    A blank key is named by its sheet row. (key, dup_no) is unique in a range, whatever keys look like.
    """
    df = grids.withColumn("__h", header_row(F.col("grid")))
    rows = df.select(*at, "__h", key_no.alias("__k"), F.posexplode("grid").alias("__r", "row")).where("__r > __h")
    rows = rows.where(F.exists("row", lambda c: ~blank(c))).withColumn("row_no", F.col("__r") + 1)
    key = strip(F.coalesce(F.get("row", "__k"), F.lit("")))
    rows = rows.withColumn("key", F.when(key == "", F.format_string("(blank key, row %d)", "row_no")).otherwise(key))
    return number_duplicates(rows, [*at, "key"], ["row_no"]).drop("__h", "__k", "__r")


def number_duplicates(df: DataFrame, keys: list[str], order: list[str], out: str = "dup_no") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
