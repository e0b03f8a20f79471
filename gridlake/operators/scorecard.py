"""Scorecards: totals of plan and actual, deltas between snapshot days, trends, bands and a pay forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(c: Column) -> Column:
    """Amounts are summed as decimals, so a sum doesn't depend on the order of its terms."""
    return F.coalesce(c, F.lit(0)).cast("decimal(18,4)")


def scorecard(rows: DataFrame, by: list[str], plan: Column, actual: Column, delay: Column) -> DataFrame:
    """active rows (plan above 0), sums, pct = actual / plan * 100 and delay_pct = delay * 3.33 / active; 0 by 0 is 0."""
    sums = rows.groupBy(*by).agg(
        F.count_if(plan > 0).alias("active"),
        F.sum(exact(plan)).cast("double").alias("plan"),
        F.sum(exact(actual)).cast("double").alias("actual"),
        F.sum(exact(delay)).cast("double").alias("delay_days"),
    )
    pct = F.coalesce(F.try_divide(F.col("actual") * 100, F.col("plan")), F.lit(0.0))
    late = F.coalesce(F.try_divide(F.col("delay_days") * 3.33, F.col("active").cast("double")), F.lit(0.0))
    return sums.withColumn("pct", F.bround(pct, 1)).withColumn("delay_pct", F.bround(late, 2))


def first_range_only(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of several month tables of a sheet the first."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def delta(cards: DataFrame, by: list[str], order: str, value: str = "pct", out: str = "delta") -> DataFrame:
    """value minus that of the snapshot day before; null on the first."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return cards.withColumn(out, F.bround(F.col(value) - before, 1))


def last_days(cards: DataFrame, day: str = "day", most: int = 7) -> DataFrame:
    """Rows of the last few days that there are. The days are few, so they are found first and joined."""
    days = cards.select(day).distinct().orderBy(F.desc(day)).limit(most)
    return cards.join(days, day, "left_semi")


def band(pct: Column, cuts: tuple[int, ...] = (90, 80, 70)) -> Column:
    out = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(pct >= cut, i).otherwise(out)
    return out


def pay_forecast(active: Column, pct: Column, delay_pct: Column) -> Column:
    """Rate 100000 and 25000 a project from 6 to 16; points over 70 and under 10; 5000000 fixed."""
    rate = F.lit(100000) + (F.least(F.greatest(active, F.lit(6)), F.lit(16)) - 6) * 25000
    return F.greatest(F.lit(0.0), pct - 70) * rate + F.greatest(F.lit(0.0), 10 - delay_pct) * rate + 5000000


def unselected(rows: DataFrame, chosen: DataFrame, tab: str, plan: Column, actual: Column, delay: Column) -> DataFrame:
    """Totals of the tabs that weren't chosen, in place of their rows."""
    return scorecard(rows.join(chosen.select(tab).distinct(), tab, "left_anti"), [tab], plan, actual, delay)
