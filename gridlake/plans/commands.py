"""The engine's commands end to end: daily diff and push of receivables; the store is in store.py.

Each takes and returns DataFrames; the day is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators import diff, grid, receivables
from gridlake.operators.tables import key_place
from gridlake.plans.store import Store

__all__ = ["Store", "by_urgency", "daily_diff", "push"]

AT = ["sheet_id", "range"]


def daily_diff(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cells, stats) of two days; now and before: sheet_id, range, grid, key_column.

    Both days use the key column found in today's header and find their header rows on their own. A range
    without a day before is a baseline: counted, no row kinds. A range that vanished is a row of stats with
    removed_range. Cells are labelled by today's header.
    """
    title = lambda df: F.get(df["grid"], grid.header_row(df["grid"]))
    new = now.withColumn("__titles", title(now)).withColumn("__key", key_place(F.col("__titles"), F.col("key_column").cast("string")))
    old = before.select(*AT, "grid", title(before).alias("__was"))
    shared = new.select(*AT, "__key", "__titles")
    a = grid.keyed_rows(old.join(shared.select(*AT, "__key"), AT), F.col("__key"), AT)
    every = grid.keyed_rows(new, F.col("__key"), AT)
    b = every.join(old.select(*AT), AT, "left_semi")
    rows = diff.grid_diff(a, b, [*AT, "key", "dup_no"])
    cells = rows.where("kind = 'changed'").join(shared.select(*AT, "__titles"), AT).select(*AT, "key", "dup_no", "__titles", F.explode("cells").alias("c"))
    label = grid.column_label(F.get("__titles", F.col("c.col_no")), F.col("c.col_no"))
    cells = cells.select(*AT, "key", "dup_no", "c.col_no", label.alias("column"), "c.old", "c.new")
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    moved = rows.groupBy(*AT).agg(F.count_if(F.col("kind") != "added").alias("rows_prev"), n("added"), n("removed"), n("changed"))
    have = every.groupBy(*AT).agg(F.count(F.lit(1)).alias("rows_now"))
    trimmed = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    sides = shared.select(*AT, "__titles", F.lit(True).alias("__now")).join(old.select(*AT, "__was", F.lit(True).alias("__then")), AT, "full_outer")
    both = F.col("__now").isNotNull() & F.col("__then").isNotNull()
    sides = sides.select(*AT, F.col("__then").isNull().alias("baseline"), F.col("__now").isNull().alias("removed_range"), (both & (trimmed(F.col("__titles")) != trimmed(F.col("__was")))).alias("header_changed"))
    stats = sides.join(moved, AT, "left").join(have, AT, "left").na.fill(0, ["rows_prev", "added", "removed", "changed", "rows_now"])
    return rows.drop("cells"), cells, stats


def nothing_happened(stats: DataFrame, fetch_errors: int = 0, missing_sheets: int = 0) -> DataFrame:
    """One row, quiet: no row, header, baseline or range change, no failed and no missing sheet."""
    odd = F.col("baseline") | F.col("removed_range") | F.col("header_changed") | (F.col("added") + F.col("removed") + F.col("changed") > 0)
    return stats.agg((F.count_if(odd) + fetch_errors + missing_sheets == 0).alias("quiet"))


def diff_documents(rows: DataFrame, cells: DataFrame, stats: DataFrame) -> DataFrame:
    """A JSON document a range: stats, and the rows that were added or removed and the cells that changed.

    A range holds at most 1000 rows of 78 cells, which bounds a document.
    """
    moved = rows.where("kind IN ('added', 'removed')").groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("kind", "key", "dup_no"))).alias("rows"))
    changed = cells.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("key", "dup_no", "col_no", "column", "old", "new"))).alias("cells"))
    doc = stats.join(moved, AT, "left").join(changed, AT, "left")
    return doc.select(*AT, F.to_json(F.struct(*doc.columns)).alias("value"))


def push(current: DataFrame, previous: DataFrame, contacts: DataFrame, today: Column, slot: Column, days: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, stats, closed) of a push; current and previous: receivable rows of two months.

    items: unpaid rows overdue, soon or undated, of this month and carried over, with the contact's slot;
    recipient false where the owner or their contact is unknown. closed: carried rows that this month shows
    as paid. slot: the key of an owner, as in contacts (slot_key, slot).
    """
    carried = receivables.carry_over(previous, current, "name_key", "row_no")
    rows = current.withColumn("carried", F.lit(False)).unionByName(carried.where("NOT closed").drop("closed").withColumn("carried", F.lit(True)))
    bucket = receivables.due_bucket(F.col("due"), today, days)
    due = rows.where(receivables.unpaid(F.col("status"), F.col("outstanding"))).withColumn("bucket", bucket).where("bucket <> 'future'")
    items = receivables.to_contacts(due, contacts, slot).withColumn("days_left", F.date_diff("due", today)).withColumn("recipient", F.col("found") & ~F.col("owner_missing")).drop("slot_key", "found")
    broken = lambda df: df.where("outstanding_raw <> '' AND NOT outstanding_raw RLIKE '[0-9]'").select(F.lit(1).alias("x"))
    bad = broken(current).union(broken(previous)).agg(F.count("x").alias("bad_sum"))
    stats = receivables.push_stats(rows, today, days).join(bad, F.lit(True))
    return items, stats, carried.where("closed").drop("closed")


def by_urgency(rows: DataFrame, today: Column) -> DataFrame:
    """Receivables in the dashboard's order, with label: overdue, pending, prepaid, paused, churned, paid; then due."""
    rank = F.array_position(F.array(*map(F.lit, receivables.LABELS)), F.col("label"))
    return rows.withColumn("label", receivables.urgency(today)).orderBy(rank, F.coalesce(F.col("due"), today), "row_no")
