"""Predicates and projections over live tasks, history, schedules and workers. Every function takes as_of where the store would ask for the time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = ["task_id", "task_name", "queue_name", "status", "priority", "retry_count", "max_retries", "is_workflow_task", "error_code", "worker_id", "enqueued_at", "started_at", "completed_at", "failed_at", "created_at"]
HISTORY_SUMMARY = [*SUMMARY, "kind", "class_key", "terminal_at"]


def members(df: DataFrame, **wanted: list) -> DataFrame:
    """Keeps rows whose columns are in the lists; an empty list filters nothing."""
    for name, values in wanted.items():
        if values:
            df = df.where(F.col(name).isin(values))
    return df


def half_open(c: Column, lower, upper) -> Column:
    return (c >= F.lit(lower)) & (c < F.lit(upper))


def resolve_window(now: datetime, since: datetime | None = None, until: datetime | None = None) -> tuple[datetime, datetime]:
    """(lower, upper): a day up to now unless given. Empty windows and more than 30 days are refused."""
    upper = until or now
    lower = since or upper - timedelta(hours=24)
    if lower >= upper:
        raise ValueError("window must not be empty")
    if upper - lower > timedelta(days=30):
        raise ValueError("window must not exceed 30 days")
    return lower, upper


def check_page(limit: int, offset: int) -> None:
    if offset < 0 or not 1 <= limit <= 200 or offset + limit > 500:
        raise ValueError("page out of bounds: 1 <= limit <= 200, offset >= 0, offset + limit <= 500")


def window_of(since: Column, until: Column, now: Column) -> Column:
    """struct(lower, upper, fault) of a request, as resolve_window(): EMPTY or TOO_LONG, else null."""
    upper = F.coalesce(until, now)
    lower = F.coalesce(since, upper - F.make_dt_interval(hours=F.lit(24)))
    fault = F.when(lower >= upper, "EMPTY").when(upper - lower > F.make_dt_interval(F.lit(30)), "TOO_LONG")
    return F.struct(lower.alias("lower"), upper.alias("upper"), fault.alias("fault"))


def page_ok(limit: Column, offset: Column) -> Column:
    """Whether a page may be asked for, as check_page()."""
    return (offset >= 0) & limit.between(1, 200) & (offset + limit <= 500)


def _due(as_of: Column) -> Column:
    return (F.col("enqueued_at") <= as_of) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)) & (F.col("good_until").isNull() | (F.col("good_until") > as_of))


def claimable(as_of: Column) -> Column:
    return (F.col("status") == "PENDING") & _due(as_of)


def reclaimable(as_of: Column) -> Column:
    """Claimed with a lease that has run out. No lease never runs out here."""
    return (F.col("status") == "CLAIMED") & F.col("claim_expires_at").isNotNull() & (F.col("claim_expires_at") < as_of) & _due(as_of)


def in_flight(as_of: Column) -> Column:
    return (F.col("status") == "RUNNING") | ((F.col("status") == "CLAIMED") & (F.col("claim_expires_at").isNull() | (F.col("claim_expires_at") > as_of)))


def past_deadline(as_of: Column) -> Column:
    """The deadline itself is past."""
    return F.col("good_until").isNotNull() & (F.col("good_until") <= as_of)


def stale_claim(as_of: Column, age_s: int) -> Column:
    old = F.col("claim_expires_at").isNull() & (F.col("claimed_at") < as_of - F.make_dt_interval(secs=F.lit(age_s)))
    return (F.col("status") == "CLAIMED") & ((F.col("claim_expires_at") < as_of) | old)


def last_beats(beats: DataFrame, role: str = "runner") -> DataFrame:
    """The newest heartbeat of each task."""
    return beats.where(F.col("role") == role).groupBy("task_id").agg(F.max("sent_at").alias("last_beat"))


def stale_running(tasks: DataFrame, beats: DataFrame, as_of: Column, age_s: int = 300, grace_s: int = 60) -> DataFrame:
    """Running, without a sign of life for age_s, and not just finalizing."""
    seen = tasks.where("status = 'RUNNING'").join(last_beats(beats), "task_id", "left")
    quiet = F.coalesce("last_beat", "started_at") < as_of - F.make_dt_interval(secs=F.lit(age_s))
    return seen.where(quiet & (F.col("finalizing_at").isNull() | (F.col("finalizing_at") < as_of - F.make_dt_interval(secs=F.lit(grace_s)))))


def roots(workflows: DataFrame, name: str | None = None, status: str | None = None) -> DataFrame:
    out = workflows.where(F.col("parent_id").isNull())
    return members(out, name=[name] if name else [], status=[status] if status else [])


def due_schedules(schedules: DataFrame, names: list[str], as_of: Column) -> DataFrame:
    return members(schedules, schedule_name=names).where(F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= as_of))


def hide_payload(df: DataFrame, column: str, keep: bool) -> DataFrame:
    return df if keep else df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def stale_worker(as_of: Column, age_s: int = 120) -> Column:
    return F.col("snapshot_at") < as_of - F.make_dt_interval(secs=F.lit(age_s))
