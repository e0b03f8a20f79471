"""Data-quality rules as a declarative list, and acknowledgements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.text import blank, has_nonzero, number, numeric_text, year_less_date


@dataclass(frozen=True)
class Rule:
    """holds: a boolean column of the row; detail: what to show."""

    key: str
    level: str
    holds: Column
    detail: Column


def findings(rows: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """A row a rule and row where it holds; one pass over the rows, whatever the number of rules."""
    entry = lambda r: F.when(F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.key).alias("key"), F.lit(r.level).alias("level"), r.detail.cast("string").alias("detail")))
    hits = F.filter(F.array(*map(entry, rules)), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(hits).alias("f")).select(*keep, "f.*")


def _given(bound: dict[str, bool | Column], name: str) -> Column:
    have = bound.get(name, False)
    return have if isinstance(have, Column) else F.lit(have)


def scorecard_rules(name: Column, filled: Column, owner: Column, rating: Column, contract: Column, ends: Column, score: Column, total: Column, bound: dict[str, bool | Column], most: float = 150) -> list[Rule]:
    """The rules of a main tab; bound says which columns the table (or the row's table) has.

    A row without a name is one finding and no other: filled in, but not a row of sums.
    """
    first = F.coalesce(F.nullif(number(score), F.lit(0.0)), number(total))
    rule = lambda key, level, column, holds, detail: Rule(key, level, ~blank(name) & _given(bound, column) & holds, detail)
    return [
        Rule("name_missing", "critical", blank(name) & (filled >= 2) & (first.isNull() | (first < most)), filled),
        rule("owner_missing", "critical", "owner", blank(owner), name),
        rule("rating_missing", "critical", "rating", blank(rating), name),
        rule("rating_not_numeric", "critical", "rating", ~blank(rating) & ~numeric_text(rating), rating),
        rule("contract_missing", "warning", "contract", blank(contract), name),
        rule("end_missing", "warning", "ends", blank(ends) & ~F.coalesce(F.lower(contract).contains("har oy"), F.lit(False)), name),
        rule("date_without_year", "warning", "ends", year_less_date(ends), ends),
        rule("total_zero", "critical", "score", ~blank(total) & ~has_nonzero(total) & has_nonzero(score), total),
    ]


def month_rules(name: Column, scores: dict[str, Column], bound: dict[str, bool | Column], most: float = 150) -> list[Rule]:
    """The rules of a month tab: scores without a name (unless a row of sums), scores that aren't numbers.

    An unnamed row shares its key with main tabs, so that one acknowledgement covers both.
    """
    values = [number(s) for s in scores.values()]
    top = F.greatest(*values) if len(values) > 1 else values[0]
    some = F.lit(False)
    for s in scores.values():
        some = some | F.coalesce(has_nonzero(s), F.lit(False))
    unnamed = Rule("name_missing", "critical", blank(name) & some & (top.isNull() | (top < most)), top)
    return [unnamed, *(Rule("score_not_numeric", "critical", ~blank(name) & _given(bound, k) & ~blank(s) & ~numeric_text(s), s) for k, s in scores.items())]


def missing_tabs(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(found.select(*on).distinct(), on, "left_anti")


def acknowledge(found: DataFrame, acks: DataFrame) -> DataFrame:
    """Add acked, ack_day and note. acks: key, sheet (null or '' for all), ack_day, note, ack_no; the first one wins.

    acks is a list that people keep; it is joined on its key, so its size is left to the planner.
    """
    a = acks.select(F.col("key"), F.nullif("sheet", F.lit("")).alias("__sheet"), "ack_day", "note", "ack_no")
    ranked = a.groupBy("key", "__sheet").agg(F.min(F.struct("ack_no", "ack_day", "note")).alias("__first"))
    own = ranked.where("__sheet IS NOT NULL").withColumnRenamed("__first", "__own").withColumnRenamed("__sheet", "sheet")
    every = ranked.where("__sheet IS NULL").select("key", F.col("__first").alias("__all"))
    df = found.join(own, ["key", "sheet"], "left").join(every, "key", "left")
    first = F.least("__own", "__all")
    return df.withColumn("__ack", first).withColumn("acked", F.col("__ack").isNotNull()).withColumn("ack_day", F.col("__ack.ack_day")).withColumn("note", F.col("__ack.note")).drop("__own", "__all", "__ack")


def ack_groups(acknowledged: DataFrame) -> DataFrame:
    """Per key of acknowledged findings: findings, distinct sheets, earliest day."""
    return acknowledged.where("acked").groupBy("key").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("sheet").alias("sheets"), F.min("ack_day").alias("ack_day"))


def critical_counts(found: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Fresh critical findings of each sheet; found: findings that no acknowledgement covers."""
    return found.where("level = 'critical'").groupBy(sheet).agg(F.count(F.lit(1)).alias("critical"))


def by_level(found: DataFrame, *then: str) -> DataFrame:
    """Findings in order: critical ones first, then as the columns say."""
    return found.orderBy(F.when(F.col("level") == "critical", 0).otherwise(1), *then)
