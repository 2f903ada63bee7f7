"""Claim planning: which tasks a worker would get. It plans; it holds no locks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import capacity
from .filters import claimable, in_flight, reclaimable


@dataclass(frozen=True)
class Claim:
    worker: str
    queues: list[str]
    priority: dict[str, int] = field(default_factory=dict)
    most_running: dict[str, int] = field(default_factory=dict)
    hard_cap: bool = False
    processes: int = 4
    prefetch: int = 0
    max_per_worker: int = 0
    max_batch: int = 0
    cluster_cap: int | None = None
    lease_ms: int = 60_000


def order_queues(queues: list[str], priority: dict[str, int], most_running: dict[str, int]) -> list[str]:
    """Queues with a priority or cap, by priority (100 by default), in the given order among equals; all as given without priorities."""
    if not priority:
        return list(queues)
    return sorted((q for q in queues if q in priority or q in most_running), key=lambda q: priority.get(q, 100))


def queues_from_json(configs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, queue_name, queue_priority, cap) of each queue in a JSON array of objects {name, priority, cap}; priority is 100
    by default, cap null. Texts that aren't such arrays, and queues without a name, give no rows."""
    listed = F.from_json(F.col(text), "array<struct<name:string,priority:int,cap:int>>")
    rows = configs.select(key, F.explode(listed).alias("q")).where("q.name is not null")
    return rows.select(key, F.col("q.name").alias("queue_name"), F.coalesce("q.priority", F.lit(100)).alias("queue_priority"), F.col("q.cap").alias("cap"))


def ordered_queues(configs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, queue_name, place) from a JSON object {queues, priority, caps} of each row: queues with a priority or a cap, by
    priority (100 by default), in the given order among equals; all as given where no priorities are set."""
    c = F.from_json(F.col(text), "struct<queues:array<string>,priority:map<string,int>,caps:map<string,int>>")
    of = lambda m, q: F.try_element_at(F.coalesce(m, F.expr("cast(map() as map<string,int>)")), q)
    rows = configs.select(key, c.alias("c")).select(key, "c", F.posexplode("c.queues").alias("pos", "queue_name"))
    priority, cap = of(F.col("c.priority"), F.col("queue_name")), of(F.col("c.caps"), F.col("queue_name"))
    given = F.coalesce(F.size("c.priority"), F.lit(0)) <= 0
    kept = rows.where(given | priority.isNotNull() | cap.isNotNull()).select(key, "queue_name", "pos", F.when(given, 0).otherwise(F.coalesce(priority, F.lit(100))).alias("p"))
    return kept.select(key, "queue_name", F.row_number().over(Window.partitionBy(key).orderBy("p", "pos")).alias("place"))


def queue_table(df: DataFrame, c: Claim) -> DataFrame:
    """A row for each queue asked for: its priority, and its cap or null."""
    rows = [(q, c.priority.get(q, 100), c.most_running.get(q)) for q in c.queues]
    return df.sparkSession.createDataFrame(rows, "queue_name string, queue_priority int, cap int")


def accounting(tasks: DataFrame, c: Claim, as_of: Column) -> DataFrame:
    """One row: what the worker has claimed and runs, all in flight, and how many more it may have."""
    mine = F.col("worker_id") == c.worker
    flying = tasks.where(in_flight(as_of))
    out = flying.agg(F.count_if(mine & (F.col("status") == "CLAIMED")).alias("claimed"), F.count_if(mine & (F.col("status") == "RUNNING")).alias("running"), F.count_if(mine).alias("mine"), F.count("*").alias("everyone"))
    return out.withColumn("budget", capacity(hard_cap=c.hard_cap, processes=c.processes, prefetch=c.prefetch, max_per_worker=c.max_per_worker, cluster_cap=c.cluster_cap, claimed=F.col("claimed"), running=F.col("running"), mine=F.col("mine"), everyone=F.col("everyone")))


def queue_counts(tasks: DataFrame, c: Claim, as_of: Column) -> DataFrame:
    """What counts against a cap: running tasks, and with a hard cap claimed ones."""
    counted = tasks.where(in_flight(as_of) & (F.lit(c.hard_cap) | (F.col("status") == "RUNNING")))
    return counted.groupBy("queue_name").agg(F.count("*").alias("used"))


def candidates(tasks: DataFrame, c: Claim, as_of: Column) -> DataFrame:
    """task_id, queue_name, nth: the tasks to claim, in order of dispatch. Only the first of each queue are sorted together."""
    able = tasks.where(claimable(as_of) | reclaimable(as_of)).select("task_id", "queue_name", "priority", "enqueued_at")
    queues = queue_table(tasks, c).join(queue_counts(tasks, c, as_of), "queue_name", "left").crossJoin(accounting(tasks, c, as_of).select("budget"))
    batch = F.lit(c.max_batch).cast("long") if c.max_batch > 0 else F.col("budget")
    room = F.least("budget", batch, F.when(F.col("cap").isNotNull(), F.greatest(F.lit(0), F.col("cap") - F.coalesce("used", F.lit(0)))).otherwise(F.col("budget")))
    queues = queues.select("queue_name", "queue_priority", "budget", room.alias("room"))
    most = c.processes + c.prefetch + c.max_per_worker  # no queue gives more than this: it bounds the rows before the join
    own = Window.partitionBy("queue_name").orderBy("priority", "enqueued_at", "task_id")
    first = able.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= most)
    kept = first.join(F.broadcast(queues), "queue_name").where(F.col("rn") <= F.col("room"))
    every = Window.orderBy("queue_priority", "priority", "enqueued_at", "task_id")
    return kept.withColumn("nth", F.row_number().over(every)).where(F.col("nth") <= F.col("budget")).select("task_id", "queue_name", "nth")


def claim(tasks: DataFrame, c: Claim, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(all tasks after the claim, the claimed ones in order)"""
    got = candidates(tasks, c, as_of)
    hit = F.col("nth").isNotNull()
    new = tasks.join(got.select("task_id", "nth"), "task_id", "left").withColumns({
        "status": F.when(hit, "CLAIMED").otherwise(F.col("status")), "worker_id": F.when(hit, c.worker).otherwise(F.col("worker_id")), "claimed_at": F.when(hit, as_of).otherwise(F.col("claimed_at")),
        "claim_expires_at": F.when(hit, as_of + F.make_dt_interval(secs=F.lit(c.lease_ms / 1000))).otherwise(F.col("claim_expires_at")),
        "finalizing_at": F.when(hit, F.lit(None)).otherwise(F.col("finalizing_at"))}).drop("nth")
    return new, got


def best_places(ranked: DataFrame) -> DataFrame:
    """ranked: task_id, rn, where a task may be named by several arms. Each once, at its best place."""
    return ranked.groupBy("task_id").agg(F.min("rn").alias("rn"))


def dispatch_order(ranked: DataFrame) -> DataFrame:
    """ranked: task_id, rn, where a task may be named by several arms. Each once, at its best place, in that order."""
    return best_places(ranked).orderBy("rn", "task_id")
