"""Workflow graphs: dependencies, joins of nodes, completion, results, trees, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import NODE_TERMINAL
from ..sources.steps import Steps
from .joins import spread


def dependency_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node with dependencies: how many there are, completed, failed, skipped."""
    status = nodes.select("workflow_id", F.col("task_index").cast("long").alias("dep"), F.col("status").alias("dep_status"))
    links = edges.select("workflow_id", "task_index", F.col("dep").cast("long").alias("dep"))
    joined = spread(links, "workflow_id", "dep").join(spread(status, "workflow_id", "dep"), ["workflow_id", "dep"], "left").select("workflow_id", "task_index", "dep_status")
    return spread(joined, "workflow_id", "task_index").groupBy("workflow_id", "task_index").agg(F.count("*").alias("deps"), *(F.count_if(F.col("dep_status") == s).alias(s.lower()) for s in NODE_TERMINAL))


def shared_tasks(nodes: DataFrame) -> DataFrame:
    """(task_id, n): tasks that nodes of several workflows name, and of how many. Nodes without a task are dealt out by workflow."""
    part = F.when(F.col("task_id").isNull(), F.xxhash64("workflow_id"))
    counts = spread(nodes.select("task_id", "workflow_id", part.alias("part")), "task_id", "part").groupBy("task_id", "part").agg(F.count_distinct("workflow_id").alias("n"))
    return counts.where("n > 1 or task_id is null").groupBy("task_id").agg(F.sum("n").alias("n")).where("n > 1")


def join_action() -> Column:
    """READY, SKIP or WAIT from the counts of a node; an unknown way of joining acts as `all`."""
    ended = F.col("completed") + F.col("failed") + F.col("skipped")
    least = F.coalesce("min_success", F.lit(1))
    every = F.when(ended < F.col("deps"), "WAIT").when((F.col("failed") + F.col("skipped") > 0) & ~F.col("allow_failed_deps"), "SKIP").otherwise("READY")
    some = F.when(F.col("completed") > 0, "READY").when(ended == F.col("deps"), "SKIP").otherwise("WAIT")
    quorum = F.when(F.col("completed") >= least, "READY").when(F.col("completed") + F.col("deps") - ended < least, "SKIP").otherwise("WAIT")
    return F.when(F.col("join_type") == "any", some).when(F.col("join_type") == "quorum", quorum).otherwise(every)


def evaluate_joins(nodes: DataFrame, edges: DataFrame, workflows: DataFrame) -> DataFrame:
    """(workflow_id, task_index, action) of pending nodes with dependencies in running workflows."""
    running = workflows.where("status = 'RUNNING'").select(F.col("id").alias("workflow_id"))
    pending = nodes.where("status = 'PENDING'").join(running, "workflow_id", "left_semi")
    return pending.join(dependency_counts(nodes, edges), ["workflow_id", "task_index"]).select("workflow_id", "task_index", join_action().alias("action"))


def skip_cascade(nodes: DataFrame, edges: DataFrame, workflows: DataFrame) -> DataFrame:
    """Nodes after skipping all that can't run, level by level, until a level skips none.

    Dependencies are counted once, of pending nodes in running workflows alone; each level adds what the level before
    has skipped to the counts of the nodes that depend on it, and judges only these again. What a level finds is a
    written table; at the end only the lists of skipped nodes stay.
    """
    steps, keys = Steps(nodes.sparkSession), ["workflow_id", "task_index"]
    running = workflows.where("status = 'RUNNING'").select(F.col("id").alias("workflow_id"))
    pending = steps.put(nodes.where("status = 'PENDING'").join(running, "workflow_id", "left_semi").select(*keys, "join_type", "min_success", "allow_failed_deps"))
    links = steps.put(edges.select(*keys, F.col("dep").cast("long").alias("dep")).join(pending.select(*keys), keys, "left_semi"))
    state = steps.put(pending.join(dependency_counts(nodes, links), keys))
    listed = lambda rows: rows.where(join_action() == "SKIP").select(*keys)
    new = steps.put(listed(state))
    skipped, touched = [], []
    while not new.isEmpty():
        skipped.append(steps.tables[-1])
        hit = links.join(new.select("workflow_id", F.col("task_index").cast("long").alias("dep")), ["workflow_id", "dep"]).groupBy(*keys).agg(F.count("*").alias("more"))
        touched.append(steps.write(hit))
        more = steps.read(*touched, like=hit).join(steps.read(touched[-1], like=hit).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("more").alias("more"))
        again = state.join(more, keys).withColumn("skipped", F.col("skipped") + F.col("more"))
        new = steps.put(listed(again).join(steps.read(*skipped, like=new), keys, "left_anti"))
    steps.keep(*skipped)
    if not skipped:
        return nodes
    skip = steps.read(*skipped, like=new).withColumn("skip", F.lit(True))
    return nodes.join(skip, keys, "left").withColumn("status", F.when(F.col("skip"), "SKIPPED").otherwise(F.col("status"))).select(*nodes.columns)


def unfinished(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("status").isin(NODE_TERMINAL))


def finished_workflows(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Running workflows with nodes that have all ended."""
    running = workflows.where("status = 'RUNNING'")
    some = running.join(nodes.select(F.col("workflow_id").alias("id")), "id", "left_semi")
    return some.join(unfinished(nodes).select(F.col("workflow_id").alias("id")), "id", "left_anti")


def empty_workflows(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    return workflows.where("status = 'RUNNING'").join(nodes.select(F.col("workflow_id").alias("id")), "id", "left_anti")


def ready_by_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes none of whose dependencies is still to end."""
    open_deps = unfinished(nodes).select("workflow_id", F.col("task_index").cast("long").alias("dep"))
    blocked = edges.withColumn("dep", F.col("dep").cast("long")).join(open_deps, ["workflow_id", "dep"], "left_semi").select("workflow_id", "task_index")
    return nodes.where("status = 'PENDING'").join(blocked, ["workflow_id", "task_index"], "left_anti")


def dependents(edges: DataFrame, done: list[int]) -> DataFrame:
    """Nodes that depend on any of the indexes."""
    lists = edges.groupBy("workflow_id", "task_index").agg(F.collect_list(F.col("dep").cast("long")).alias("deps"))
    return lists.where(F.arrays_overlap("deps", F.array(*(F.lit(d).cast("long") for d in done)))).select("workflow_id", "task_index")


def terminal_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    used = edges.select("workflow_id", F.col("dep").cast("int").alias("task_index"))
    return nodes.join(used, ["workflow_id", "task_index"], "left_anti")


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    there = nodes.select("workflow_id", F.col("task_index").cast("long").alias("dep"))
    return edges.withColumn("dep", F.col("dep").cast("long")).join(there, ["workflow_id", "dep"], "left_semi").select("workflow_id", "task_index", "dep")


def child_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("workflow_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in NODE_TERMINAL))


def success(nodes: DataFrame, cases: dict[str, list[int]] | None = None) -> DataFrame:
    """(workflow_id, succeeded, met_case). Without cases no node may have failed; with cases the nodes of one must all be completed, and other failures don't matter."""
    if not cases:
        return nodes.groupBy("workflow_id").agg((F.count_if(F.col("status") == "FAILED") == 0).alias("succeeded"), F.lit(None).cast("string").alias("met_case"))
    met = [(name, F.count_if((F.col("status") == "COMPLETED") & F.col("task_index").isin(need)) == len(need)) for name, need in cases.items()]
    out = nodes.groupBy("workflow_id").agg(*(c.alias(f"case_{i}") for i, (_, c) in enumerate(met)))
    first = F.coalesce(*(F.when(F.col(f"case_{i}"), F.lit(name)) for i, (name, _) in enumerate(met)))
    return out.select("workflow_id", first.isNotNull().alias("succeeded"), first.alias("met_case"))


def final_result(workflows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, result): the chosen node's, or else the last nodes' results by node id, as JSON."""
    chosen = workflows.where("output_index is not null").select(F.col("id").alias("workflow_id"), F.col("output_index").cast("int").alias("task_index")).join(nodes, ["workflow_id", "task_index"]).select("workflow_id", "result")
    rest = workflows.where("output_index is null").select(F.col("id").alias("workflow_id"))
    last = terminal_nodes(nodes, edges).join(rest, "workflow_id", "left_semi").groupBy("workflow_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "result")))).alias("m"))
    return chosen.unionByName(last.select("workflow_id", F.to_json("m", {"ignoreNullFields": "false"}).alias("result")))


def first_failed(nodes: DataFrame, only: list[int] = ()) -> DataFrame:
    failed = nodes.where("status = 'FAILED'")
    if only:
        failed = failed.where(F.col("task_index").isin(list(only)))
    return failed.groupBy("workflow_id").agg(F.min("task_index").alias("task_index"))


def _doubled(first: DataFrame, parents: DataFrame, down: bool) -> DataFrame:
    """(start, id, level) of all that is above, or below, each of the rows in `first` (start, id). parents: id, up.

    Path doubling: step k joins what is known, which is all within 2^k levels, with the links over exactly 2^k levels,
    so a chain of n takes log2(n) steps. Links shrink to the runs that have so many above them. A row is known once, at
    its least level, so circles end. Each step is a written table; those of the links are dropped.
    """
    spark = first.sparkSession
    steps, k = Steps(spark), 0
    start = first.distinct().withColumn("level", F.lit(0).cast("long"))
    known = [steps.write(start)]
    links = steps.put(parents.where("id is not null and up is not null").distinct())
    a, b = ("up", "id") if down else ("id", "up")
    while True:
        found = steps.read(*known, like=start)
        step = found.join(links.select(F.col(a).alias("id"), F.col(b).alias("to")), "id").select("start", F.col("to").alias("id"), (F.col("level") + (1 << k)).alias("level"))
        at = steps.write(step.groupBy("start", "id").agg(F.min("level").alias("level")).join(found.select("start", "id"), ["start", "id"], "left_anti"))
        if steps.read(at, like=start).isEmpty():
            steps.keep(*known)
            return found
        known.append(at)
        links = steps.put(links.join(links.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
        k += 1


def descend(workflows: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, level) of each of the runs in roots (id) and all below it."""
    parents = workflows.select("id", F.col("parent_id").alias("up"))
    return _doubled(roots.select(F.col("id").alias("start"), "id"), parents, True).withColumnRenamed("start", "root")


def ascend(workflows: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, id, level) of each of the runs in leaves (id) and all above it."""
    parents = workflows.select("id", F.col("parent_id").alias("up"))
    found = _doubled(leaves.select(F.col("id").alias("start"), "id"), parents, False)
    return found.join(workflows.select("id"), "id", "left_semi").select(F.col("start").alias("leaf"), "id", "level")


def descendants(workflows: DataFrame, root: int) -> DataFrame:
    """(id, level) of a run and all below it."""
    return descend(workflows, workflows.where(F.col("id") == root)).select("id", "level")


def ancestors(workflows: DataFrame, leaf: int) -> DataFrame:
    """(id, level) of a run and all above it."""
    return ascend(workflows, workflows.where(F.col("id") == leaf)).select("id", "level")


def refused_starts(starts: DataFrame, workflows: DataFrame) -> DataFrame:
    """starts: start, parent_id, name, definition_key. Those that would close a circle, with the nearest run on the way up
    that is the same definition: of the same key where both have one, else of the same name."""
    chain = ascend(workflows, starts.select(F.col("parent_id").alias("id"))).withColumnRenamed("leaf", "parent_id")
    named = workflows.select("id", F.col("name").alias("above"), F.col("definition_key").alias("key_above"))
    both = F.col("definition_key").isNotNull() & F.col("key_above").isNotNull()
    same = F.when(both, F.col("definition_key") == F.col("key_above")).otherwise(F.col("name") == F.col("above"))
    met = starts.join(chain, "parent_id").join(named, "id").where(same)
    return met.groupBy("start").agg(F.min(F.struct("level", "id")).alias("m")).select("start", F.col("m.id").alias("ancestor"))


def failure_policy(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, status, error) of running workflows with a failed node, and of what their policy changes. `pause` pauses the
    run with the error and all running ones below it; any other policy keeps it running with the first error by index."""
    failed = nodes.where("status = 'FAILED'").groupBy(F.col("workflow_id").alias("id")).agg(F.min_by("error", "task_index").alias("error"))
    hit = workflows.where("status = 'RUNNING'").join(failed, "id").select("id", F.when(F.col("on_error") == "pause", "PAUSED").otherwise("RUNNING").alias("status"), "error")
    below = descend(workflows, hit.where("status = 'PAUSED'")).where("level > 0").select("id").distinct()
    paused = workflows.where("status = 'RUNNING'").select("id").join(below, "id", "left_semi").select("id", F.lit("PAUSED").alias("status"), F.lit(None).cast("string").alias("error"))
    return hit.unionByName(paused).groupBy("id").agg(F.min("status").alias("status"), F.max("error").alias("error"))
