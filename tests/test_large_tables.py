"""Steps that many rows must not meet in, on small tables."""

import pytest
from pyspark.sql import functions as F

from taskloom.functions import patterns as N
from taskloom.operators import dag as J
from taskloom.operators import specs as G
from taskloom.operators import transitions as K
from taskloom.operators.joins import left_by_key
from taskloom.plans import catalog
from taskloom.sources import fixtures
from taskloom.sources.steps import Steps


@pytest.fixture
def shuffled(spark):
    """Plain shuffles: no broadcasts, and partitions as they are."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def most_in_a_task(df):
    return max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def test_left_by_key_spreads_nulls(shuffled):
    rows = shuffled.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"))
    table = shuffled.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = left_by_key(rows, table, "k", "id")
    assert got.columns == ["id", "k", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table, "k", "left").select("id", "k", "v").collect()), key=str)
    assert most_in_a_task(got) < 1000


def test_start_spreads_claims(shuffled):
    claims = shuffled.range(2000).select(F.col("id").alias("task_id"), F.lit("w").alias("by"), F.lit(None).cast("timestamp_ntz").alias("at"))
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    tasks = shuffled.range(1000).select(F.col("id").alias("task_id"), F.when(F.col("id") % 2 == 0, "CLAIMED").otherwise("RUNNING").alias("status"), F.lit("w").alias("worker_id"), at.alias("claimed_at"), F.lit(None).cast("timestamp_ntz").alias("claim_expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("good_until"), F.when(F.col("id") % 4 == 0, F.col("id") % 3).alias("workflow_id"))
    workflows = shuffled.createDataFrame([(0, "PAUSED"), (1, "RUNNING")], "id long, status string")
    got = K.start(claims, tasks, workflows, at)
    want = lambda i: "TASK_ABSENT" if i >= 1000 else "LOST_CLAIM" if i % 2 else "WORKFLOW_STOPPED" if i % 4 == 0 and i % 3 == 0 else "RUNNING"
    assert {r.task_id: r.outcome for r in got.collect()} == {i: want(i) for i in range(2000)}
    assert most_in_a_task(got) < 1000


def test_run_detail_spreads_nodes_without_children(shuffled, sf_dir):
    plan = catalog.QUERIES["j15_run_detail"](shuffled, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sub_workflow_id" not in plan


def test_outbox_verdicts_spread_tasks_without_rows(shuffled, sf_dir):
    plan = catalog.QUERIES["j16_outbox_verdicts"](shuffled, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(workflow_id" not in plan and "hashpartitioning(node_key" not in plan


def test_cascade_reads_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    # each of 20 runs: a failed node, and a chain of six behind it; in odd ones the fourth doesn't mind failures
    nodes = spark.range(140).select((F.col("id") / 7).cast("long").alias("workflow_id"), (F.col("id") % 7).cast("int").alias("task_index")).select(
        "*", F.when(F.col("task_index") == 0, "FAILED").otherwise("PENDING").alias("status"), F.lit("all").alias("join_type"), F.lit(None).cast("int").alias("min_success"), ((F.col("task_index") == 4) & (F.col("workflow_id") % 2 == 1)).alias("allow_failed_deps"))
    edges = nodes.where("task_index > 0").select("workflow_id", "task_index", (F.col("task_index") - 1).cast("long").alias("dep"))
    workflows = spark.range(20).select("id", F.when(F.col("id") < 18, "RUNNING").otherwise("PAUSED").alias("status"))
    got = J.skip_cascade(nodes, edges.mapInArrow(counted, edges.schema), workflows).collect()
    want = lambda w, i: "FAILED" if i == 0 else "SKIPPED" if w < 18 and i < (4 if w % 2 else 7) else "PENDING"
    assert {(r.workflow_id, r.task_index): r.status for r in got} == {(w, i): want(w, i) for w in range(20) for i in range(7)}
    assert seen.value <= 120 * 2


def test_definitions_in_order_are_not_peeled(spark, monkeypatch):
    sizes = []
    put = Steps.put
    monkeypatch.setattr(Steps, "put", lambda self, df: (sizes.append(df.count()), put(self, df))[1])
    nodes = spark.range(60).select((F.col("id") / 6).cast("long").alias("workflow_id"), (F.col("id") % 6).cast("int").alias("task_index"))
    down = nodes.where("task_index > 0").select("workflow_id", "task_index", (F.col("task_index") - 1).cast("long").alias("dep"))
    # 3 goes up and down without a circle, 4 has one, 5 depends on itself
    odd = spark.createDataFrame([(3, 4, 5), (4, 0, 5), (5, 2, 2)], "workflow_id long, task_index int, dep long")
    edges = down.where("workflow_id <> 3 or task_index <> 5").unionByName(odd)
    assert sorted(r.workflow_id for r in G.circles(nodes, edges).collect()) == [4, 5]
    assert sizes[0] == 17


def test_schedules_of_one_file_are_dealt_out(spark, sf_dir):
    rows = fixtures.read(spark, sf_dir, "patterns").coalesce(1)
    assert N.compiled(rows).rdd.getNumPartitions() > 1


def test_terminal_nodes_without_grouping(spark):
    nodes = spark.range(5).select(F.lit(1).cast("long").alias("workflow_id"), F.col("id").cast("int").alias("task_index"))
    edges = spark.createDataFrame([(1, 0), (1, 0), (1, 3)], "workflow_id long, dep long")
    got = J.terminal_nodes(nodes, edges)
    assert sorted(r.task_index for r in got.collect()) == [1, 2, 4]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dependency_counts_are_not_merged(spark):
    nodes = spark.range(4000).select((F.col("id") / 4).cast("long").alias("workflow_id"), (F.col("id") % 4).cast("int").alias("task_index"), F.when(F.col("id") % 3 == 0, "FAILED").otherwise("COMPLETED").alias("status"))
    edges = nodes.where("task_index > 0").select("workflow_id", "task_index", (F.col("task_index") - 1).alias("dep"))
    counts = J.dependency_counts(nodes, edges)
    got = {(r.workflow_id, r.task_index): (r.deps, r.completed, r.failed, r.skipped) for r in counts.collect()}
    assert got == {(i // 4, i % 4): (1, (i - 1) % 3 > 0, (i - 1) % 3 == 0, 0) for i in range(4000) if i % 4}
    assert most_in_a_task(counts) < 1500
    pending = nodes.withColumn("status", F.lit("PENDING")).select("*", F.lit("all").alias("join_type"), F.lit(None).cast("int").alias("min_success"), F.lit(False).alias("allow_failed_deps"))
    running = spark.range(1000).select("id", F.lit("RUNNING").alias("status"))
    assert most_in_a_task(J.evaluate_joins(pending, edges, running)) < 1500


def test_shared_tasks_are_not_merged(spark):
    # tasks 0 to 9 in two or three runs, the others in one; many nodes without a task, in 50 runs
    rows = [(w, w % 100 + 10) for w in range(100)] + [(w, k) for k in range(10) for w in range(2 + k % 2)] * 2 + [(w % 50, None) for w in range(1000)] + [(None, 10), (None, 11)]
    nodes = spark.createDataFrame(rows, "workflow_id long, task_id long")
    got = J.shared_tasks(nodes)
    assert {r.task_id: r.n for r in got.collect()} == {None: 50} | {k: 2 + k % 2 for k in range(10)}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
