"""A tree of files against a table: ignore patterns, ages, what to ingest and what to archive."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names that are never read, whatever the patterns say.
ALWAYS = (".git", ".obsidian", ".trash", ".DS_Store")


def ignored(path: Column, patterns: list[str], always: tuple[str, ...] = ALWAYS) -> Column:
    """Whether the last matching pattern excludes a path; ! includes again, a/b is anchored, a bare name is any segment.

    * matches / too. Patterns become regular expressions on the driver.
    """
    # Java takes Python's translation without its (?s:...)\z dress
    regex = lambda p: "(?s)^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"
    out = F.lit(False)
    for raw in patterns:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        keep, p = line.startswith("!"), line.lstrip("!").rstrip("/")
        if "/" in p.strip("/"):
            p = p.strip("/")
            hit = (path == p) | path.startswith(p + "/") | path.rlike(regex(p)) | path.rlike(regex(p + "/*"))
        else:
            hit = F.exists(F.split(path, "/"), _rlike(regex(p.strip("/"))))
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, always))) | out


def _rlike(pattern: str):
    return lambda s: s.rlike(pattern)


def young(path: Column, today: Column, days: int = 90) -> Column:
    """Undated names stay; a name YYYY-MM-DD.md stays for some days."""
    day = F.try_to_timestamp(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.md$", 1), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.date_diff(today, day) <= days, F.lit(True))


def source_of(path: Column) -> Column:
    return F.when(path.startswith("chat/"), "chat").otherwise("vault")


def reconcile(tree: DataFrame, stored: DataFrame, on: list[str] = ["source", "origin"]) -> DataFrame:
    """Full outer join of files and active documents: action new, updated, unchanged or archive."""
    a = tree.select(*on, F.col("content_hash").alias("__file"))
    b = stored.select(*on, F.col("content_hash").alias("__doc"))
    action = F.when(F.col("__doc").isNull(), "new").when(F.col("__file").isNull(), "archive").when(F.col("__file") == F.col("__doc"), "unchanged").otherwise("updated")
    return a.join(b, on, "full_outer").select(*on, action.alias("action"))


def counters(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
