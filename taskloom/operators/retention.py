"""Partitions of the archive and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired_leaves(leaves: DataFrame, classes: DataFrame, as_of: Column) -> DataFrame:
    """Leaves whose upper bound plus the class's duration has passed; `forever` has none."""
    kept = leaves.join(F.broadcast(classes), "class_key").where(F.col("keep_days").isNotNull())
    return kept.where(F.col("upper_anchor") + F.make_dt_interval(F.col("keep_days")) <= as_of).select("leaf_name", "class_key", "lower_anchor").orderBy("lower_anchor", "leaf_name")


#: Leaves of more days than these, open-ended ones above all, are compared by class alone.
LONGEST = 400


def in_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with the leaf that holds them: a range join made an equality on class and day, then checked. Leaves stand under
    each of their days; the few that are longer than LONGEST are compared with all rows of their class."""
    bounds = leaves.select("class_key", "leaf_name", "lower_anchor", "upper_anchor", "min_birth_at").where(F.col("lower_anchor") < F.col("upper_anchor"))
    short = F.col("upper_anchor") <= F.col("lower_anchor") + F.make_dt_interval(F.lit(LONGEST))
    days = F.sequence(F.date_trunc("DAY", "lower_anchor").cast("timestamp_ntz"), F.date_trunc("DAY", F.col("upper_anchor") - F.expr("interval 1 microsecond")).cast("timestamp_ntz"), F.expr("interval 1 day"))
    daily = bounds.where(short).withColumn("day", F.explode(days))
    by_day = rows.withColumn("day", F.date_trunc("DAY", "anchor").cast("timestamp_ntz")).join(F.broadcast(daily), ["class_key", "day"]).drop("day")
    joined = by_day.unionByName(rows.join(F.broadcast(bounds.where(~short)), "class_key"))
    return joined.where((F.col("anchor") >= F.col("lower_anchor")) & (F.col("anchor") < F.col("upper_anchor")))


def blockers(outbox: DataFrame, leaves: DataFrame) -> DataFrame:
    """How many pending outbox rows hold on to each leaf."""
    rows = outbox.select("task_id", F.col("history_class").alias("class_key"), F.col("history_anchor").alias("anchor"))
    return leaves.select("leaf_name").join(in_leaf(rows, leaves).groupBy("leaf_name").agg(F.count("*").alias("n")), "leaf_name", "left").select("leaf_name", F.coalesce("n", F.lit(0)).alias("blockers"))


def empty_leaves(leaves: DataFrame, history: DataFrame, as_of: Column, limit: int = 32) -> DataFrame:
    """Closed leaves of `forever` that hold nothing."""
    full = in_leaf(history.select("class_key", "anchor"), leaves).select("leaf_name").distinct()
    return leaves.where((F.col("class_key") == "forever") & (F.col("upper_anchor") <= as_of)).join(full, "leaf_name", "left_anti").select("leaf_name", "lower_anchor").orderBy("lower_anchor", "leaf_name").limit(limit)


def expected_leaves(classes: DataFrame, first: Column, days: int) -> DataFrame:
    """A leaf per class and day of the horizon."""
    day = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    return classes.select("class_key").distinct().select("class_key", day.alias("d")).select("class_key", F.concat_ws("_", F.lit("hist"), "class_key", F.col("d").cast("string")).alias("leaf_name"), (first + F.make_dt_interval(F.col("d"))).alias("lower_anchor"))


def coverage_faults(expected: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf_name, fault): MISSING, BOUND_MISMATCH, UNVERIFIED or OK."""
    actual = leaves.select("leaf_name", F.col("lower_anchor").alias("actual"), "verified")
    fault = F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") != F.col("lower_anchor"), "BOUND_MISMATCH").when(~F.col("verified"), "UNVERIFIED").otherwise("OK")
    return expected.join(actual, "leaf_name", "left").select("leaf_name", fault.alias("fault"))


#: A finite class needs so many whole leaves to come; `forever` must reach so many days on.
FLOOR = 2
#: The class that is never deleted.
FOREVER = "forever"


def leaf_faults(leaves: DataFrame) -> DataFrame:
    """(class_key, leaf_name, fault) of leaves whose relation isn't what the catalog says, by the first rule that holds."""
    fault = (F.when(~F.col("relation_exists"), "NO_RELATION").when(F.col("detach_pending").isNull(), "NOT_A_PARTITION").when(F.col("detach_pending"), "DETACH_AWAITING_FINALIZE")
             .when(~F.col("actual_bound").eqNullSafe(F.col("cataloged_bound")) | ~F.col("id_index_exists"), "BOUND_OR_INDEX"))
    return leaves.select("class_key", "leaf_name", fault.alias("fault")).where("fault is not null")


def health(leaves: DataFrame, classes: DataFrame, blocked: DataFrame, as_of: Column) -> DataFrame:
    """Per class with a duration, and `forever`, over its sound leaves: how many are attached, covered until, whole future
    ones, those that block, and those that can go; how many leaves have a fault, and whether coverage is below the floor.
    Other classes without a duration have no coverage to speak of, and no row."""
    faults = leaf_faults(leaves)
    classes = classes.where(F.col("keep_days").isNotNull() | (F.col("class_key") == FOREVER))
    sound = leaves.join(faults.select("leaf_name"), "leaf_name", "left_anti").join(blocked, "leaf_name")
    rows = classes.select("class_key", "keep_days").join(sound, "class_key", "left")
    old = F.col("keep_days").isNotNull() & (F.col("upper_anchor") + F.make_dt_interval(F.col("keep_days")) <= as_of)
    out = rows.groupBy("class_key", "keep_days").agg(
        F.count("leaf_name").alias("attached"), F.max("upper_anchor").alias("covered_until"), F.count_if(F.col("lower_anchor") >= as_of).alias("future"),
        F.count_if(F.col("blockers") > 0).alias("blocked"), F.count_if((F.col("blockers") == 0) & old).alias("detachable"))
    bad = faults.groupBy("class_key").agg(F.count("*").alias("faults"))
    short = F.when(F.col("keep_days").isNotNull(), F.col("future") < FLOOR).otherwise(F.coalesce(F.col("covered_until") < as_of + F.make_dt_interval(F.lit(FLOOR)), F.lit(True)))
    return out.join(bad, "class_key", "left").select("class_key", "attached", "covered_until", "future", "blocked", "detachable", F.coalesce("faults", F.lit(0)).alias("faults"), short.alias("below_floor"))


def health_faults(asked: DataFrame, leaves: DataFrame, classes: DataFrame, blocked: DataFrame, as_of: Column) -> DataFrame:
    """(class_key, leaf_name, fault) of the classes in asked (class_key): CLASS_ABSENT from the catalog, what is wrong with
    each leaf (see leaf_faults), and COVERAGE_BELOW_FLOOR; leaf_name is null where the class as a whole is meant."""
    asked = asked.select("class_key").distinct()
    found = health(leaves, classes.join(asked, "class_key", "left_semi"), blocked, as_of)
    whole = lambda rows, fault: rows.select("class_key", F.lit(None).cast("string").alias("leaf_name"), F.lit(fault).alias("fault"))
    absent = asked.join(classes, "class_key", "left_anti")
    bad = leaf_faults(leaves).join(found.select("class_key"), "class_key", "left_semi")
    return whole(absent, "CLASS_ABSENT").unionByName(bad).unionByName(whole(found.where("below_floor"), "COVERAGE_BELOW_FLOOR"))


def birth_floor(leaves: DataFrame) -> DataFrame:
    """Per class the earliest birth, if all leaves are verified."""
    return leaves.groupBy("class_key").agg(F.when(F.bool_and("verified"), F.min("min_birth_at")).alias("floor"))


def probe_order(leaves: DataFrame) -> DataFrame:
    """Leaves in the order in which lookups go through them, from 0."""
    return leaves.select("class_key", "leaf_name", (F.row_number().over(Window.partitionBy("class_key").orderBy("lower_anchor", "leaf_name")) - 1).alias("position"))


def deletable(workflows: DataFrame, nodes: DataFrame, live: DataFrame, as_of: Column, keep_hours: int) -> DataFrame:
    """Workflows whose end (or else last change, or start) is older than `keep_hours`, and of which no task is live."""
    there = [F.col(c) for c in ("completed_at", "updated_at", "created_at") if c in workflows.columns]
    old = workflows.where(F.coalesce(*there) < as_of - F.make_dt_interval(hours=F.lit(keep_hours)))
    running = live.where("status in ('PENDING', 'CLAIMED', 'RUNNING')").select("task_id")
    busy = nodes.join(running, "task_id", "left_semi").select(F.col("workflow_id").alias("id")).distinct()
    return old.join(busy, "id", "left_anti")


def within_budget(workflows: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """Ended runs in order of id, as many as their nodes fit in the budget; the first always. A pass looks at no more runs
    than the budget has nodes, so that is what is summed in order; the rest is for the next pass."""
    ended = workflows.where("status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED')").select("id").orderBy("id").limit(max(budget, 1))
    sizes = nodes.select(F.col("workflow_id").alias("id")).join(F.broadcast(ended), "id", "left_semi").groupBy("id").agg(F.count("*").alias("node_count"))
    rows = ended.join(sizes, "id", "left").select("id", F.coalesce("node_count", F.lit(0)).alias("node_count"))
    order = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"running": F.sum("node_count").over(order), "nth": F.row_number().over(Window.orderBy("id"))}).where((F.col("running") <= budget) | (F.col("nth") == 1)).select("id", "node_count", "running")


def rewrite_plan(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per leaf: rows, rows with a payload, their bytes, distinct ids."""
    return in_leaf(rows, leaves).groupBy("leaf_name").agg(F.count("*").alias("n"), F.count_if(F.col("error_code").isNotNull()).alias("with_payload"), F.coalesce(F.sum(F.octet_length("error_code")), F.lit(0)).alias("payload_bytes"), F.count_distinct("task_id").alias("ids"))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, kind): rows that are in one only, or differ."""
    left, right = (x.select(key, F.struct(*(c for c in x.columns if c != key)).alias(n)) for x, n in ((a, "l"), (b, "r")))
    kind = F.when(F.col("l").isNull(), "ADDED").when(F.col("r").isNull(), "MISSING").otherwise("CHANGED")
    return left.join(right, key, "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select(key, kind.alias("kind"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).unionAll(b.exceptAll(a)).isEmpty()


def transcode_batch(rows: DataFrame, after, size: int, recode: Column, key: str = "task_id") -> DataFrame:
    """One batch of a copy in order of key: the next `size` rows after the cursor (None: from the start), with the payload
    in the new form and the digests of both."""
    left = rows if after is None else rows.where(F.col(key) > F.lit(after))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return left.orderBy(key).limit(size).select(key, F.col("payload").alias("source"), recode.alias("payload"), digest(F.col("payload")).alias("source_digest"), digest(recode).alias("digest"))


def verify_copy(source: DataFrame, copy: DataFrame, back: Column, key: str = "task_id") -> DataFrame:
    """(key, fault) of a batch against its source: MISSING, EXTRA, DIGEST where the copy isn't what its digest says, and
    CHANGED where it doesn't turn back (`back`, over payload) into what was copied."""
    was = source.select(key, F.col("payload").alias("was"), F.lit(True).alias("there"))
    now = copy.select(key, "payload", "digest", back.alias("back"), F.lit(True).alias("copied"))
    fault = (F.when(F.col("copied").isNull(), "MISSING").when(F.col("there").isNull(), "EXTRA").when(~F.sha2(F.col("payload").cast("binary"), 256).eqNullSafe(F.col("digest")), "DIGEST")
             .when(~F.col("back").eqNullSafe(F.col("was")), "CHANGED"))
    return was.join(now, key, "full_outer").select(key, fault.alias("fault")).where("fault is not null")
