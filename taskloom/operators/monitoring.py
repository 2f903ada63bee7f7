"""Counts, facets, breakdowns and pages over live and archived tasks. The time window holds for history only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import error_category, in_categories
from ..functions.vocab import ERROR_FAMILIES, TASK_STATUSES
from ..sources.steps import Steps
from .filters import half_open

SHARED = ["task_id", "task_name", "queue_name", "status", "priority", "retry_count", "worker_id", "error_code", "enqueued_at", "started_at", "completed_at", "failed_at"]


def lifecycle(live: DataFrame, history: DataFrame, lower, upper) -> DataFrame:
    """Live rows, and those archived in the window."""
    past = history.where(half_open(F.col("anchor"), lower, upper))
    return live.select(*SHARED, F.lit("live").alias("arm")).unionByName(past.select(*SHARED, F.lit("history").alias("arm")))


def task_stats(rows: DataFrame) -> DataFrame:
    """A count for each of the seven states, in their order."""
    spark = rows.sparkSession
    every = spark.createDataFrame(list(enumerate(TASK_STATUSES)), "nth int, status string")
    return every.join(rows.groupBy("status").count(), "status", "left").orderBy("nth").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def breakdown(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """Per group the states' counts, total and retried, largest first; the TOTAL row and group_count cover all groups."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in TASK_STATUSES]
    groups = rows.groupBy(F.coalesce(by, F.lit("unknown")).alias("grp")).agg(*counts, F.count("*").alias("total"), F.count_if(F.col("retry_count") > 0).alias("retried"))
    groups = Steps(rows.sparkSession).put(groups)  # the rows are read once; both what follows comes from their groups
    summed = [F.sum(c).alias(c) for c in groups.columns[1:]]
    total = groups.agg(F.lit("TOTAL").alias("grp"), *summed, F.count("*").alias("group_count"))
    top = groups.orderBy(F.desc("total"), F.asc("grp")).limit(limit)
    return top.withColumn("group_count", F.lit(None).cast("long")).unionByName(total)


def facet(rows: DataFrame, column: str, cap: int) -> DataFrame:
    """Values with counts, most first. Nulls go, and empty error codes."""
    kept = rows.where(F.col(column).isNotNull())
    if column == "error_code":
        kept = kept.where("error_code <> ''")
    return kept.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(cap)


def facets(rows: DataFrame, categories: list[str] = (), columns: tuple[str, ...] = ("task_name", "queue_name", "worker_id", "error_code"), cap: int = 50, error_cap: int = 30) -> DataFrame:
    """(facet, value, n), in one pass over the rows. The categories limit the error codes shown; the totals by category ignore them and the caps."""
    shown = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") & (in_categories(F.col(c), categories) if categories else F.lit(True)) if c == "error_code" else F.lit(True))
    pairs = [F.struct(F.lit(c).alias("facet"), F.when(shown(c), F.col(c).cast("string")).alias("value")) for c in columns]
    pairs.append(F.struct(F.lit("category").alias("facet"), error_category(F.col("error_code")).alias("value")))
    counted = rows.select(F.explode(F.array(*pairs)).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    most = F.when(F.col("facet") == "error_code", error_cap).when(F.col("facet") != "category", cap)
    nth = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    # one number bounds all facets (there are few categories): each task sends no more than so many rows of a facet
    first = counted.withColumn("nth", nth).where(F.col("nth") <= max(cap, error_cap, len(ERROR_FAMILIES) + 1))
    return first.where(most.isNull() | (F.col("nth") <= most)).select("facet", "value", "n")


def sort_key(field: str) -> Column:
    """A field, or one of the derived durations."""
    ended = F.coalesce("completed_at", "failed_at")
    return {"queue_s": F.col("started_at") - F.col("enqueued_at"), "exec_s": ended - F.col("started_at")}.get(field, F.col(field))


def page(rows: DataFrame, field: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """Sorted once over both arms; nulls are last either way, and the id breaks ties."""
    key = sort_key(field)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return rows.orderBy(order, "task_id").offset(offset).limit(limit)


def after(rows: DataFrame, cursor: tuple, upper: tuple, limit: int, keys: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """A keyset page: rows after the cursor and up to the bound that the cycle began with."""
    kinds = [rows.schema[k].dataType for k in keys]
    bound = lambda x: F.struct(*(F.lit(v).cast(t).alias(k) for v, k, t in zip(x, keys, kinds)))
    now = F.struct(*keys)
    return rows.where((now > bound(cursor)) & (now <= bound(upper))).orderBy(*keys).limit(limit)


def next_cursor(page_rows: list, limit: int, upper: tuple, keys: tuple[str, str] = ("created_at", "id")) -> tuple | None:
    """Where the next page begins; None (from the start, with a new bound) after a short page or one that met the bound."""
    if len(page_rows) < limit:
        return None
    last = tuple(page_rows[-1][k] for k in keys)
    return None if last >= upper else last


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def top_per_key(rows: DataFrame, key: str, limit: Column, *order) -> DataFrame:
    """The first rows of each key, as many as `limit` says."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit)


def places(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `nth`, their place from 1 in an order without ties, over all of them.

    Rows are dealt out by ranges of the order, sorted in each and numbered where they lie; the number of rows of each
    range is all that comes together. The ranges are a written table, so a lost task can't shift them.
    """
    steps = Steps(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the range in its upper bits and the place in the lower 33
    numbered = dealt.select("*", F.monotonically_increasing_id().alias("_at")).select("*", F.call_function("shiftright", F.col("_at"), F.lit(33)).cast("int").alias("_range"))
    written = steps.put(numbered)
    sizes = sorted((r["_range"], r["count"]) for r in written.groupBy("_range").count().collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    first = rows.sparkSession.createDataFrame(offsets, "_range int, _before long")
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    return written.join(F.broadcast(first), "_range").select(*rows.columns, (own + F.col("_before") + 1).alias("nth"))


def schedules_in_order(schedules: DataFrame) -> DataFrame:
    """All schedules by next run, nulls last, then id, with their place: within the hour of the next run (without one,
    within 10,000 ids) plus what comes before it. Only the counts of those ranges meet in one task."""
    hour = F.date_trunc("HOUR", "next_run_at").cast("timestamp_ntz")
    rows = schedules.select("schedule_id", "next_run_at", hour.alias("hour"), F.when(hour.isNull(), F.floor(F.col("schedule_id") / 10_000)).otherwise(0).alias("part"))
    ranges = [F.col("hour").asc_nulls_last(), "part"]
    before = rows.groupBy("hour", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = before.select(F.col("hour").alias("h"), F.col("part").alias("p"), "before")
    order = [F.col("next_run_at").asc_nulls_last(), "schedule_id"]
    placed = rows.withColumn("own", F.row_number().over(Window.partitionBy("hour", "part").orderBy(*order)))
    out = placed.join(first, F.col("hour").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p")))
    return out.select("schedule_id", "next_run_at", (F.col("own") + F.col("before")).cast("long").alias("nth")).orderBy(*order)
