"""Reads and writes of the store's tables: partitioned files, inserts of absent rows, upserts by the newest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .steps import Steps


def write_history(history: DataFrame, path: str) -> None:
    """By class and day of the anchor, so that windows read the days they need."""
    history.withColumn("anchor_date", F.to_date("anchor")).write.mode("append").partitionBy("class_key", "anchor_date").parquet(path)


def read_history(spark: SparkSession, path: str, lower, upper) -> DataFrame:
    """The window's rows; the filter on days prunes partitions."""
    days = F.col("anchor_date").between(F.lit(lower).cast("date"), F.lit(upper).cast("date"))
    return spark.read.parquet(path).where(days & (F.col("anchor") >= F.lit(lower)) & (F.col("anchor") < F.lit(upper)))


def write_heartbeats(beats: DataFrame, path: str) -> None:
    beats.withColumn("hour", F.date_trunc("HOUR", "sent_at")).write.mode("append").partitionBy("hour").parquet(path)


def absent(new: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows to insert: one for each new id that isn't there, the first by all columns."""
    first = Window.partitionBy(key).orderBy(*(c for c in new.columns if c != key))
    return new.join(there.select(key), key, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def conflicts(new: DataFrame, there: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, outcome): INSERTED, REPLAY of the same content, MISMATCH, or UNVERIFIABLE without a digest there."""
    held = there.select(key, F.col(digest).alias("_held"), F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there").isNull(), "INSERTED").when(F.col("_held").isNull(), "UNVERIFIABLE").when(F.col("_held") == F.col(digest), "REPLAY").otherwise("MISMATCH")
    return new.join(held, key, "left").select(key, outcome.alias("outcome"))


def upsert(there: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The table after writing new rows over old ones of the same keys."""
    return there.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def unsaved(configured: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Configured rows without a state row, one for each key."""
    return configured.join(states.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def delete(there: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return there.join(gone.select(*keys), list(keys), "left_anti")


def claimer_beats(tasks: DataFrame, worker: str, as_of: Column) -> DataFrame:
    """A heartbeat for each task the worker has claimed."""
    return tasks.where((F.col("status") == "CLAIMED") & (F.col("worker_id") == worker)).select("task_id", F.lit(worker).alias("sender_id"), F.lit("claimer").alias("role"), as_of.alias("sent_at"))


def write_snapshots(states: DataFrame, path: str) -> None:
    """Appends worker snapshots by day, which retention then drops whole."""
    states.withColumn("snapshot_date", F.to_date("snapshot_at")).write.mode("append").partitionBy("snapshot_date").parquet(path)


def locate(live: DataFrame, history: DataFrame, ids: DataFrame) -> DataFrame:
    """Where each of the ids (task_id) is: live first, and only those that aren't there in the archive."""
    asked = ids.select("task_id").distinct()
    now = asked.join(live.select("task_id"), "task_id", "left_semi")
    past = asked.join(now, "task_id", "left_anti").join(history.select("task_id"), "task_id", "left_semi")
    return now.select("task_id", F.lit("LIVE").alias("location")).unionByName(past.select("task_id", F.lit("HISTORY").alias("location")))


def staged_lookup(ids: DataFrame, live: DataFrame, history: DataFrame, floors: DataFrame) -> DataFrame:
    """ids: task_id, born_at (null where the id doesn't tell). Each id with its archive row's class and the stage that found it.

    LIVE first; then PRUNED: archived rows of classes whose floor (class_key, floor; null if not all leaves are verified)
    lies before the birth; then FALLBACK, for the ids that no stage has found, over the whole archive. stage is null for
    ids that are nowhere.
    """
    asked = ids.select("task_id", "born_at")
    now = asked.join(live.select("task_id"), "task_id", "left_semi").select("task_id", F.lit(None).cast("string").alias("class_key"), F.lit("LIVE").alias("stage"))
    rest = asked.join(live.select("task_id"), "task_id", "left_anti")
    known = history.select("task_id", "class_key")
    pruned = known.join(F.broadcast(floors.where("floor is not null")), "class_key").join(rest.where("born_at is not null"), "task_id").where("born_at >= floor").select("task_id", "class_key", F.lit("PRUNED").alias("stage"))
    left = rest.join(pruned.select("task_id"), "task_id", "left_anti")
    last = left.join(known, "task_id", "left").select("task_id", "class_key", F.when(F.col("class_key").isNotNull(), "FALLBACK").alias("stage"))
    return now.unionByName(pruned).unionByName(last)


def snapshots(states: DataFrame, worker: str, limit: int | None = None) -> DataFrame:
    """A worker's states, newest first."""
    out = states.where(F.col("worker_id") == worker).orderBy(F.desc("snapshot_at"), F.desc("snapshot_id"))
    return out if limit is None else out.limit(limit)


#: A birth time may be ahead of the store's clock by so many seconds.
CLOCK_S = 5


def archive_lookup(ids: DataFrame, live: DataFrame, archive: DataFrame, floor=None) -> DataFrame:
    """(task_id, class_key, stage) of ids (task_id, born_at; null where the id doesn't tell), reading few files of the archive.

    archive: what write_history() wrote, read again. LIVE first. PRUNED: a task ends after its birth, so of ids with a
    birth only days from the oldest birth on are read, a filter on partitions; births before `floor` have no row. Each id
    then looks at its own days. FALLBACK, for ids that no stage has found: births are only a hint, so the days before are
    read up to the newest birth left, and all days if an id has none; with nothing left, nothing is read. stage is null
    for ids that are nowhere. Each stage is a written table.
    """
    steps = Steps(ids.sparkSession)
    day = F.to_date(F.col("born_at") - F.make_dt_interval(secs=F.lit(CLOCK_S)))
    asked = steps.put(ids.select("task_id", "born_at", day.alias("day")).distinct())
    found = lambda rows, stage: rows.select("task_id", "class_key", F.lit(stage).alias("stage"))
    now = steps.put(asked.join(live.select("task_id"), "task_id", "left_semi").select("task_id", F.lit(None).cast("string").alias("class_key"), F.lit("LIVE").alias("stage")))
    rest = steps.put(asked.join(now, "task_id", "left_anti"))
    early = F.lit(False) if floor is None else F.coalesce(F.col("born_at") < F.lit(floor), F.lit(False))
    rows = archive.select("task_id", "class_key", "anchor_date")
    late = rest.where(F.col("day").isNotNull() & ~early)
    out, oldest = [now], late.agg(F.min("day")).first()[0]
    if oldest is not None:
        out.append(steps.put(found(rows.where(F.col("anchor_date") >= F.lit(oldest)).join(late, "task_id").where("anchor_date >= day"), "PRUNED")))
        rest = rest.join(out[-1], "task_id", "left_anti")
    left = steps.put(rest)
    bounds = left.where(~early).agg(F.max("day"), F.count_if(F.col("day").isNull()), F.count("*")).first()
    if bounds[2]:
        days = rows if bounds[1] else rows.where(F.col("anchor_date") < F.lit(bounds[0]))
        out.append(steps.put(found(days.join(left.where(~early), "task_id").where("day is null or anchor_date < day"), "FALLBACK")))
        left = left.join(out[-1], "task_id", "left_anti")
    out.append(left.select("task_id", F.lit(None).cast("string").alias("class_key"), F.lit(None).cast("string").alias("stage")))
    return reduce(DataFrame.unionByName, out)
