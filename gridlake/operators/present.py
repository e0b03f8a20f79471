"""Shapes for answers: numeric columns, bar scales, trend segments, sparklines, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.text import blank

NUMERIC = r"^\s*[-+$]?\s*[0-9][0-9\s.,]*\s*[%$]?\s*$"


def numeric_columns(df: DataFrame, columns: list[str], share: float = 0.7) -> DataFrame:
    """A row a column: filled cells and whether at least a share of them look numeric. One pass."""
    n = lambda c: F.count_if(~blank(F.col(c)))
    hit = lambda c: F.count_if(~blank(F.col(c)) & F.col(c).rlike(NUMERIC))
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), n(c).alias("filled"), hit(c).alias("hits")) for c in columns)).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.column", "x.filled", (F.coalesce(F.try_divide(F.col("x.hits").cast("double"), F.col("x.filled").cast("double")), F.lit(0.0)) >= share).alias("is_numeric"))


def bar_scale(value: Column, top: Column, is_percent: Column) -> Column:
    """Width of a bar from 0 to 100: percents up to 100 against 100, all else against the largest."""
    scale = F.when(is_percent & (top <= 100), F.lit(100.0)).otherwise(top)
    return F.bround(F.least(F.greatest(F.coalesce(F.try_divide(value * 100, scale), F.lit(0.0)), F.lit(0.0)), F.lit(100.0)), 1)


def extents(df: DataFrame, by: list[str], value: str, pad: float = 0.08) -> DataFrame:
    low, high = F.min(value), F.max(value)
    return df.groupBy(*by).agg((F.when(low == high, low - 1).otherwise(low - (high - low) * pad)).alias("low"), (F.when(low == high, high + 1).otherwise(high + (high - low) * pad)).alias("high"))


def segments(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of values between nulls, of two points or more: segment, first, last, points."""
    breaks = F.sum(F.col(value).isNull().cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("segment", breaks).where(F.col(value).isNotNull())
    return runs.groupBy(*by, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("points")).where("points >= 2")


def sparkline(df: DataFrame, by: list[str], order: str, pct: str, width: float = 100, height: float = 20) -> DataFrame:
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(order)) - 1
    many = F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    level = F.least(F.greatest(F.col(pct), F.lit(0)), F.lit(100))
    return df.withColumn("x", F.bround(place * width / many, 1)).withColumn("y", F.bround(F.lit(height) - level * height / 100, 1))


def fail_streak(df: DataFrame, by: list[str], order: str, ok: str) -> DataFrame:
    """Failures since the last success."""
    last = df.groupBy(*by).agg(F.max(F.when(F.col(ok), F.col(order))).alias("__last"))
    return df.join(last, by).groupBy(*by).agg(F.count_if(~F.col(ok) & (F.col("__last").isNull() | (F.col(order) > F.col("__last")))).alias("streak"))


def pivot_trend(df: DataFrame, row: str, column: str, values: list[str], agg: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(agg)
