"""Structured Streaming forms of the incremental jobs. Sinks are keyed, so replays change nothing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def work_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gridlake-shared")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def single_run(spark: SparkSession, path: str) -> Iterator[bool]:
    """Whether this run holds the job's lock, a file that only one creates; a second run is told that it is busy.

    A run whose driver was lost leaves the file; its owner removes it.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.createNewFile(at)
    try:
        yield held
    finally:
        if held:
            fs.delete(at, False)


def daily_rollup(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Tumbling days by event type, for streams and tables alike."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_batches(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each micro-batch is a complete replacement of the rows with its keys, kept by batch number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch."""
    others = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def owned(updates: DataFrame, owner: int) -> tuple[DataFrame, DataFrame]:
    """(messages of the owner, the others for a log)."""
    mine = F.coalesce(F.col("chat_id") == owner, F.lit(False))
    return updates.where(mine), updates.where(~mine)


def in_flight(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Updates that began and didn't end: retried once, dropped when interrupted again."""
    state = attempts.groupBy("update_id").agg(F.count_if(F.col("event") == "start").alias("starts"), F.max((F.col("event") == "done").cast("int")).alias("done"))
    return state.where("done = 0").select("update_id", F.when(F.col("starts") < most, "retry").otherwise("drop").alias("action"))


def once_per_day(notices: DataFrame) -> DataFrame:
    """At most one notice a key and day."""
    return notices.dropDuplicates(["key", "day"])


def backlog_skipped(updates: DataFrame, offset: int | None) -> DataFrame:
    """Updates past the committed offset; without one nothing old is processed."""
    return updates.where(F.col("update_id") > offset) if offset is not None else updates.where("false")


def due_jobs(jobs: DataFrame, runs: DataFrame, today: Column, forced: Column | None = None) -> DataFrame:
    """Jobs (job) that no run (job, day) of today is known of; forced ones always."""
    done = runs.where(F.col("day") == today).select("job").distinct().withColumn("__done", F.lit(True))
    again = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    return jobs.join(done, "job", "left").where(F.col("__done").isNull() | again).drop("__done")


#: How late a daily job may still start, and how often the others run.
GRACE_HOURS, INTERVAL_MINUTES = 3, 10


def schedule(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """What to start now: job, due_at, action, folded.

    jobs: job, since (from when it counts), daily_at (minutes after midnight) or else every (minutes), grace
    (minutes it may start late; null: any). runs: job, due_at, started_at, ended_at, of which a lost run has no
    end. Times are in the session's zone. Of all due times since the last run only the latest counts; folded
    tells how many before it are left out. action: "run"; "missed" where the grace has passed, so the time is
    left out, too; "busy" while a run of the job goes on. Jobs with nothing due have no row.
    """
    stamp = lambda c: F.unix_timestamp(c)
    last = runs.groupBy("job").agg(F.max("due_at").alias("__last"), F.max(F.col("ended_at").isNull()).alias("__busy"))
    known = jobs.join(last, "job", "left").withColumn("__from", F.coalesce("__last", "since"))
    moment = F.date_trunc("day", now) + F.make_dt_interval(mins=F.col("daily_at"))
    daily = F.when(moment <= now, moment).otherwise(moment - F.expr("INTERVAL 1 DAY"))
    step = F.col("every") * 60
    elapsed = F.floor((stamp(now) - stamp("since")) / step) * step
    due = F.when(F.col("daily_at").isNotNull(), daily).otherwise(F.timestamp_seconds(stamp("since") + elapsed))
    timed = known.withColumn("due_at", due).where((F.col("due_at") > F.col("__from")) | (F.col("__last").isNull() & (F.col("due_at") >= F.col("since"))))
    clock = lambda c: F.date_format(c, "HH:mm:ss")
    counted = (clock("__from") < clock("due_at")) | (F.col("__last").isNull() & (clock("__from") == clock("due_at")))  # a due time on the first day
    days = F.date_diff("due_at", "__from") - F.when(counted, 0).otherwise(1)
    steps = F.floor((stamp("due_at") - stamp("__from")) / step) - F.when(F.col("__last").isNull(), 0).otherwise(1)
    folded = F.greatest(F.when(F.col("daily_at").isNotNull(), days).otherwise(steps), F.lit(0)).cast("long")
    late = F.col("grace").isNotNull() & (stamp(now) - stamp("due_at") > F.col("grace") * 60)
    action = F.when(F.coalesce("__busy", F.lit(False)), "busy").when(late, "missed").otherwise("run")
    return timed.select("job", "due_at", action.alias("action"), folded.alias("folded"))


def new_months(runs: DataFrame) -> DataFrame:
    """Runs (job, day, tab) with new_month: whether the job's run before had another tab; a first run has none before."""
    before = F.lag("tab").over(Window.partitionBy("job").orderBy("day"))
    return runs.withColumn("new_month", F.coalesce(before != F.col("tab"), F.lit(False)))


def fresh_entries(cache: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Cache entries (key, stored_at, value) no older than their time to live; of a key the last one."""
    kept = cache.where(F.col("stored_at") >= now - F.make_dt_interval(secs=F.lit(seconds)))
    others = [c for c in cache.columns if c != "key"]
    return kept.groupBy("key").agg(F.max_by(F.struct(*others), "stored_at").alias("x")).select("key", "x.*")
