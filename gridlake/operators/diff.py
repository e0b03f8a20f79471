"""Keyed snapshot diff: rows added, removed and changed, cells old to new, counts, missing and removed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on keys: keys, kind, old_<v> and new_<v>. Values are compared as they are, nulls alike."""
    a = old.select(*keys, F.struct(*values).alias("__old"))
    b = new.select(*keys, F.struct(*values).alias("__new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"__old.{v}").eqNullSafe(F.col(f"__new.{v}"))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    joined = a.join(b, keys, "full_outer").withColumn("kind", kind)
    return joined.select(*keys, "kind", *(F.col(f"__old.{v}").alias(f"old_{v}") for v in values), *(F.col(f"__new.{v}").alias(f"new_{v}") for v in values))


def grid_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The same for rows held as arrays of cells: shorter rows are padded with ''."""
    a, b = old.select(*keys, F.col("row").alias("__old")), new.select(*keys, F.col("row").alias("__new"))
    cell = F.zip_with("__old", "__new", lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("old"), F.coalesce(y, F.lit("")).alias("new")))
    moved = F.filter(F.transform(cell, lambda c, i: F.struct(i.alias("col_no"), c["old"].alias("old"), c["new"].alias("new"))), lambda c: c["old"] != c["new"])
    joined = a.join(b, keys, "full_outer").withColumn("cells", moved)
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size("cells") == 0, "unchanged").otherwise("changed")
    return joined.withColumn("kind", kind).drop("__old", "__new")


def cell_changes(diff: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row a changed cell: keys, column, old, new (as text)."""
    entry = lambda v: F.struct(F.lit(v).alias("column"), F.col(f"old_{v}").cast("string").alias("old"), F.col(f"new_{v}").cast("string").alias("new"))
    moved = F.filter(F.array(*map(entry, values)), lambda c: ~c["old"].eqNullSafe(c["new"]))
    return diff.where("kind = 'changed'").select(*keys, F.explode(moved).alias("c")).select(*keys, "c.*")


def change_label(columns: Column) -> Column:
    """The first changed column, and how many more there are: "score (+2)"."""
    more = F.size(columns) - 1
    return F.when(more > 0, F.concat(F.get(columns, F.lit(0)), F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(F.get(columns, F.lit(0)))


def counts(diff: DataFrame, by: list[Column | str]) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return diff.groupBy(*by).agg(*(n(k) for k in ("added", "removed", "changed", "unchanged")))


def only_in(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of left without a row in right: missing tables, removed ranges, names on one side."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def changed_groups(old: DataFrame, new: DataFrame, group: str, hashed: Column) -> DataFrame:
    """Groups present on both sides whose multisets of rows differ, told by count and sum of row hashes."""
    total = lambda df, n: df.groupBy(group).agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.sum(hashed).alias(f"{n}_sum"))
    return total(old, "old").join(total(new, "new"), group).where("old_rows <> new_rows OR old_sum <> new_sum").select(group, "old_rows", "new_rows")


def baseline(rows: DataFrame, at: list[str], order: str = "row_no", most: int = 5) -> DataFrame:
    """Without an earlier day: how many rows, and the first few."""
    top = F.row_number().over(Window.partitionBy(*at).orderBy(order)) <= most
    return rows.withColumn("__top", top).groupBy(*at).agg(F.count(F.lit(1)).alias("rows_now"), F.array_sort(F.collect_list(F.when(F.col("__top"), F.struct(order, "row")))).alias("sample"))


def first_n_with_rest(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """First rows of each section, and how many more there are."""
    w = Window.partitionBy(*by)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0))).where(F.col("rank") <= most)


def quiet(stats: DataFrame) -> DataFrame:
    """One row: whether nothing at all happened."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return stats.agg((total("added") + total("removed") + total("changed") == 0).alias("quiet"))


def totals(stats: DataFrame) -> DataFrame:
    """One row over all watched ranges: rows added, removed and changed, ranges whose header changed, sheets."""
    each = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return stats.agg(*map(each, ("added", "removed", "changed")), F.count_if("header_changed").alias("header_changed"), F.countDistinct("sheet_id").alias("sheets"))


def assembled(today: DataFrame, before: DataFrame, changes: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Today's stats of each sheet beside those of the day before (prev_...) and its change counts, in order of names."""
    others = [c for c in before.columns if c != key]
    old = before.select(key, *(F.col(c).alias(f"prev_{c}") for c in others))
    return today.join(old, key, "left").join(changes, key, "left").orderBy(key)
