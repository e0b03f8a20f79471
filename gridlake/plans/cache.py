"""Results kept by day and by what the day's files are, so that a run computes only days that changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gridlake.operators.tables import month_scorecards
from gridlake.sources.readers import grids, snapshots


def day_fingerprints(spark: SparkSession, folder: str, most: int | None = None) -> dict[str, str]:
    """Of each subfolder YYYY-MM-DD (the last `most`) a digest of its files' names, sizes and times; no file is opened."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at(folder)) if s.isDirectory()) if fs.exists(at(folder)) else []
    days = [n for n in names if len(n) == 10 and n[4] == n[7] == "-" and n.replace("-", "").isdigit()]
    files = lambda day: sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at(f"{folder}/{day}")) if s.isFile())
    return {d: hashlib.sha256(repr(files(d)).encode()).hexdigest()[:16] for d in (days[-most:] if most else days)}


class DayCache:
    """Results below path/DAY/FINGERPRINT, each written once and complete when Spark has marked it so.

    A lost run leaves at most an unmarked folder, which the next one writes over. Days are few, so their
    folders are listed on the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at, at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def results(self, fingerprints: dict[str, str], compute: Callable[[str], DataFrame]) -> tuple[DataFrame | None, list[str]]:
        """(the results of all days, None without days; the days that were computed). compute gets a day that is new or changed."""
        at, fs = self._fs()
        folder = lambda day: f"{self.path}/{day}/{fingerprints[day]}"
        stale = [d for d in sorted(fingerprints) if not fs.exists(at(f"{folder(d)}/_SUCCESS"))]
        for day in stale:
            compute(day).coalesce(1).write.mode("overwrite").parquet(folder(day))  # a day's results are a row a sheet
        parts = [self.spark.read.parquet(folder(d)) for d in sorted(fingerprints)]
        return (reduce(DataFrame.unionByName, parts) if parts else None), stale

    def vacuum(self, fingerprints: dict[str, str]) -> list[str]:
        """Delete results of other days and of files as they were before."""
        at, fs = self._fs()
        gone = []
        for day in fs.listStatus(at(self.path)) if fs.exists(at(self.path)) else []:
            for kept in fs.listStatus(day.getPath()):
                if fingerprints.get(day.getPath().getName()) != kept.getPath().getName():
                    gone.append(f"{day.getPath().getName()}/{kept.getPath().getName()}")
                    fs.delete(kept.getPath(), True)
        return sorted(gone)


def daily_scorecards(spark: SparkSession, folder: str, today: str, path: str, most: int = 10) -> tuple[DataFrame | None, list[str]]:
    """(scorecards by day and sheet of the last days before today, the days that were read).

    A day and sheet whose plan sums up to 0 has none. Only days that are new or whose files changed are read.
    """
    known = {d: f for d, f in day_fingerprints(spark, folder).items() if d < today}
    last = {d: known[d] for d in sorted(known)[-most:]}

    def compute(day: str) -> DataFrame:
        docs, _ = snapshots(spark, folder, day)
        return month_scorecards(grids(docs)).where("plan <> 0")

    return DayCache(spark, path).results(last, compute)
