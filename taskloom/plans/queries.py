"""Queries over the projected lifecycle tables, one or more for each operator, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import schedules as H
from ..functions.vocab import ERROR_FAMILIES, NODE_MOVES, TASK_MOVES, TASK_STATUSES, WORKFLOW_MOVES
from ..operators import claim as C
from ..operators import dag as J
from ..operators import filters as B
from ..operators import monitoring as M
from ..operators import retention as L
from ..operators import transitions as K
from ..sources import store as A
from ..sources.fixtures import AS_OF, duckdb_prelude, read
from ..streaming import events as I

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
NOW = datetime.fromisoformat(AS_OF)
#: The window of the reports.
LOWER, UPPER = NOW - timedelta(days=20), NOW
CLAIM = C.Claim("worker-7", ["default", "high", "low"], {"high": 1, "default": 10}, {"low": 40, "default": 60}, hard_cap=True, processes=50, cluster_cap=1200)
SOFT = C.Claim("worker-3", ["low", "default"], {"low": 5}, {"low": 70}, processes=20, prefetch=10, max_batch=12)
CASES = {"head": [0, 1], "tail": [2]}
CODES = {k: ", ".join(f"'{c}'" for c in v) for k, v in ERROR_FAMILIES.items()}
CATEGORY = "case when nullif(trim(error_code), '') is null then null " + " ".join(f"when trim(error_code) in ({v}) then '{k}'" for k, v in CODES.items()) + " else 'DOMAIN' end"
RANGE = f"anchor >= timestamp '{LOWER}' and anchor < timestamp '{UPPER}'"
LIFE = f"(select task_id, task_name, queue_name, status, priority, retry_count, worker_id, error_code, enqueued_at, started_at, completed_at, failed_at, 'live' as arm from live union all select task_id, task_name, queue_name, status, priority, retry_count, worker_id, error_code, enqueued_at, started_at, completed_at, failed_at, 'history' from history where {RANGE})"
DUE = "enqueued_at <= :now and (next_retry_at is null or next_retry_at <= :now) and (good_until is null or good_until > :now)"
COUNTS = ", ".join(f"count(*) filter (status = '{s}') as {s.lower()}" for s in TASK_STATUSES)
SUMS = ", ".join(f"sum({s.lower()})::bigint" for s in TASK_STATUSES)
DEPS = "select e.workflow_id, e.task_index, count(*) as deps, count(*) filter (d.status = 'COMPLETED') as completed, count(*) filter (d.status = 'FAILED') as failed, count(*) filter (d.status = 'SKIPPED') as skipped from edges e left join nodes d on d.workflow_id = e.workflow_id and d.task_index = e.dep group by all"
ACTION = """case join_type
    when 'any' then case when completed > 0 then 'READY' when completed + failed + skipped = deps then 'SKIP' else 'WAIT' end
    when 'quorum' then case when completed >= coalesce(min_success, 1) then 'READY' when deps - failed - skipped < coalesce(min_success, 1) then 'SKIP' else 'WAIT' end
    else case when completed + failed + skipped < deps then 'WAIT' when failed + skipped > 0 and not allow_failed_deps then 'SKIP' else 'READY' end end"""
OPEN = "status not in ('COMPLETED', 'FAILED', 'SKIPPED')"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def query(sql: str | None = None):
    """Registers a function of (table by name) under its own name; :now in the SQL is the time of the report."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = duckdb_prelude() + sql.replace(":now", f"timestamp '{AS_OF}'")
        return f

    return put


def life(t) -> DataFrame:
    return M.lifecycle(t("live"), t("history"), LOWER, UPPER)


# ---- A: scans and writes


@query("select task_id, status, queue_name, enqueued_at from live")
def a1_live_scan(t):
    return t("live").select("task_id", "status", "queue_name", "enqueued_at")


@query(f"select task_id, class_key, anchor from history where {RANGE}")
def a2_history_scan(t):
    return t("history").where(B.half_open(F.col("anchor"), LOWER, UPPER)).select("task_id", "class_key", "anchor")


@query(f"select task_id, status, arm from {LIFE}")
def a3_unified_scan(t):
    return life(t).select("task_id", "status", "arm")


@query("select workflow_id, task_index, n.status as node_status, w.status as workflow_status from nodes n join workflows w on w.id = n.workflow_id")
def a4_workflow_scan(t):
    return t("nodes").select("workflow_id", "task_index", F.col("status").alias("node_status")).join(t("workflows").select(F.col("id").alias("workflow_id"), F.col("status").alias("workflow_status")), "workflow_id")


@query("select snapshot_id, snapshot_at, cpu_percent from worker_states where worker_id = 'worker-7' order by snapshot_at desc, snapshot_id desc limit 5")
def a5_worker_snapshots(t):
    return A.snapshots(t("worker_states"), "worker-7", 5).select("snapshot_id", "snapshot_at", "cpu_percent")


@query("select role, date_trunc('hour', sent_at) as beat_hour, count(*) as n from heartbeats group by all")
def a6_heartbeats_by_hour(t):
    return t("heartbeats").groupBy("role", F.date_trunc("HOUR", "sent_at").cast("timestamp_ntz").alias("beat_hour")).agg(F.count("*").alias("n"))


@query("select schedule_id, next_run_at, row_number() over (order by next_run_at asc nulls last, schedule_id) as nth from schedules")
def a7_schedules_in_order(t):
    return M.schedules_in_order(t("schedules"))


@query("select task_id, case when status in ('PENDING', 'CLAIMED', 'RUNNING') then 'LIVE' else 'HISTORY' end as location from tasks")
def a8_locate(t):
    return A.locate(t("live"), t("history"), t("events").select(F.col("event_id").alias("task_id")))


@query("select leaf_name, c.class_key, keep_days from leaves l join classes c using (class_key)")
def a9_leaf_catalog(t):
    return t("leaves").join(t("classes"), "class_key").select("leaf_name", "class_key", "keep_days")


@query("select * from (values ('default', 10, 60), ('high', 1, null), ('low', 100, 40)) v(queue_name, queue_priority, cap)")
def a10_queue_parameters(t):
    return C.queue_table(t("live"), CLAIM)


@query("select task_id, 'new' as state from (select event_id as task_id from events) where task_id not in (select task_id from live)")
def a12_enqueue_absent(t):
    return A.absent(t("events").select(F.col("event_id").alias("task_id"), F.lit("new").alias("state")), t("live"), "task_id")


@query("""select n.task_id, case when o.task_id is null then 'INSERTED' when o.digest is null then 'UNVERIFIABLE' when o.digest = n.digest then 'REPLAY' else 'MISMATCH' end as outcome
    from (select event_id as task_id, sha256(event_type) as digest from events) n
    left join (select task_id, case when task_id % 3 = 0 then sha256(task_name) when task_id % 3 = 1 then sha256('x') end as digest from live) o using (task_id)""")
def a13_enqueue_conflicts(t):
    old = t("live").select("task_id", F.expr("case when task_id % 3 = 0 then sha2(task_name, 256) when task_id % 3 = 1 then sha2('x', 256) end").alias("digest"))
    return A.conflicts(t("events").select(F.col("event_id").alias("task_id"), F.sha2("event_type", 256).alias("digest")), old, "task_id", "digest")


@query("select task_id, attempt, case when attempt = 1 then true else ok end as ok from attempts")
def a14_attempt_upsert(t):
    old = t("attempts").select("task_id", "attempt", "ok")
    return A.upsert(old, old.where("attempt = 1").withColumn("ok", F.lit(True)), "task_id", "attempt")


@query("select schedule_name, case when schedule_id % 4 = 0 then run_count + 1 else run_count end as run_count from schedules where schedule_id % 9 <> 0")
def a15_schedule_upsert(t):
    old = t("schedules").select("schedule_id", "schedule_name", "run_count")
    new = A.upsert(old, old.where("schedule_id % 4 = 0").withColumn("run_count", F.col("run_count") + 1), "schedule_id", "schedule_name")
    return A.delete(new, old.where("schedule_id % 9 = 0"), "schedule_id").select("schedule_name", "run_count")


@query("select task_id, worker_id as sender_id, 'claimer' as role, :now as sent_at from tasks where status = 'CLAIMED' and worker_id = 'worker-7'")
def a16_claimer_beats(t):
    return A.claimer_beats(t("live"), "worker-7", now())


# ---- B: filters and projections


@query("select task_id, task_name, queue_name, status, priority, retry_count, max_retries, is_workflow_task, error_code, worker_id, enqueued_at, started_at, completed_at, failed_at, created_at from live")
def b1_live_summary(t):
    return t("live").select(*B.SUMMARY)


@query("select task_id, task_name, queue_name, status, priority, retry_count, max_retries, is_workflow_task, error_code, worker_id, enqueued_at, started_at, completed_at, failed_at, created_at, kind, class_key, terminal_at from history")
def b2_history_summary(t):
    return t("history").select(*B.HISTORY_SUMMARY)


@query("select task_id, status, queue_name from tasks where status in ('FAILED', 'RUNNING') and queue_name in ('high', 'low')")
def b3_member_filter(t):
    return B.members(t("tasks"), status=["FAILED", "RUNNING"], queue_name=["high", "low"], task_name=[]).select("task_id", "status", "queue_name")


@query(f"select task_id, error_code from tasks where error_code in ({CODES['OUTCOME']}) or (error_code is not null and error_code <> '' and error_code not in ({', '.join(CODES.values())}))")
def b4_category_filter(t):
    return t("tasks").where(S.in_categories(F.col("error_code"), ["OUTCOME", "DOMAIN"])).select("task_id", "error_code")


@query("select task_id, retry_count from history where retry_count > 0")
def b5_retried_only(t):
    return t("history").where("retry_count > 0").select("task_id", "retry_count")


@query(f"select task_id, anchor from history where {RANGE}")
def b6_half_open_window(t):
    return t("history").where(B.half_open(F.col("anchor"), LOWER, UPPER)).select("task_id", "anchor")


@query(f"select task_id from tasks where status = 'PENDING' and {DUE}")
def b9_claimable(t):
    return t("live").where(B.claimable(now())).select("task_id")


@query(f"select task_id from tasks where status = 'CLAIMED' and claim_expires_at < :now and {DUE}")
def b10_reclaimable(t):
    return t("live").where(B.reclaimable(now())).select("task_id")


@query("select task_id, status from tasks where status = 'RUNNING' or (status = 'CLAIMED' and (claim_expires_at is null or claim_expires_at > :now))")
def b11_in_flight(t):
    return t("live").where(B.in_flight(now())).select("task_id", "status")


@query("select task_id, good_until from live where good_until <= :now")
def b12_past_deadline(t):
    return t("live").where(B.past_deadline(now())).select("task_id", "good_until")


@query("""select t.task_id, h.last_beat from tasks t left join (select task_id, max(sent_at) as last_beat from heartbeats where role = 'runner' group by 1) h using (task_id)
    where status = 'RUNNING' and coalesce(last_beat, started_at) < :now - interval 300 second and (finalizing_at is null or finalizing_at < :now - interval 60 second)""")
def b13_stale_running(t):
    return B.stale_running(t("live"), t("heartbeats"), now()).select("task_id", "last_beat")


@query("select task_id from tasks where status = 'CLAIMED' and (claim_expires_at < :now or (claim_expires_at is null and claimed_at < :now - interval 600 second))")
def b14_stale_claimed(t):
    return t("live").where(B.stale_claim(now(), 600)).select("task_id")


@query("select id, name from workflows where parent_id is null and name = 'flow-3' and status = 'RUNNING'")
def b15_root_workflows(t):
    return B.roots(t("workflows"), "flow-3", "RUNNING").select("id", "name")


@query("select task_id, case when status = 'COMPLETED' then terminal_at end as done_at, case when status <> 'COMPLETED' then terminal_at end as fail_at from history")
def b16_terminal_pivot(t):
    done = F.col("status") == "COMPLETED"
    return t("history").select("task_id", F.when(done, F.col("terminal_at")).alias("done_at"), F.when(~done, F.col("terminal_at")).alias("fail_at"))


@query("select node_key, result as shown, case when task_index % 2 = 0 then result end as every_other from nodes")
def b17_hidden_payload(t):
    shown = B.hide_payload(t("nodes"), "result", True).select("node_key", F.col("result").alias("shown"))
    halves = [B.hide_payload(t("nodes").where(f"task_index % 2 = {k}"), "result", k == 0).select("node_key", F.col("result").alias("every_other")) for k in (0, 1)]
    return shown.join(halves[0].unionByName(halves[1]), "node_key")


@query("select schedule_name, next_run_at from schedules where next_run_at <= :now and schedule_name in ('s1', 's2', 's3', 's11', 's50', 's51')")
def b18_due_schedules(t):
    return B.due_schedules(t("schedules"), ["s1", "s2", "s3", "s11", "s50", "s51"], now()).select("schedule_name", "next_run_at")


@query("select t.task_id from tasks t join workflows w on w.id = t.workflow_id where t.status = 'CLAIMED' and w.status in ('PAUSED', 'CANCELLED')")
def b19_not_runnable(t):
    stopped = t("workflows").where(F.col("status").isin("PAUSED", "CANCELLED")).select(F.col("id").alias("workflow_id"))
    return t("live").where("status = 'CLAIMED'").join(stopped, "workflow_id").select("task_id")


@query("select worker_id, arg_max(snapshot_at, (snapshot_at, snapshot_id)) as seen, epoch(:now) - epoch(max(snapshot_at)) > 120 as stale from worker_states group by 1")
def b20_stale_workers(t):
    return M.latest(t("worker_states"), "worker_id", "snapshot_at", "snapshot_id").select("worker_id", F.col("snapshot_at").alias("seen"), B.stale_worker(now()).alias("stale"))


# ---- C: joins


@query("select n.node_key from nodes n join workflows w on w.id = n.workflow_id where n.status = 'READY' and w.status = 'RUNNING'")
def c1_nodes_of_running(t):
    running = t("workflows").where("status = 'RUNNING'").select(F.col("id").alias("workflow_id"))
    return t("nodes").where("status = 'READY'").join(running, "workflow_id").select("node_key")


@query("select n.node_key, p.status as parent_status, c.status as child_status from nodes n join workflows p on p.id = n.workflow_id join workflows c on c.id = n.sub_workflow_id where p.status = 'RUNNING' and c.status = 'COMPLETED'")
def c2_parent_and_child(t):
    w = t("workflows")
    parent = w.where("status = 'RUNNING'").select(F.col("id").alias("workflow_id"), F.col("status").alias("parent_status"))
    child = w.where("status = 'COMPLETED'").select(F.col("id").alias("sub_workflow_id"), F.col("status").alias("child_status"))
    return t("nodes").join(parent, "workflow_id").join(child, "sub_workflow_id").select("node_key", "parent_status", "child_status")


@query("select distinct n.workflow_id from live t join nodes n on n.task_id = t.task_id")
def c3_workflows_with_live_tasks(t):
    return t("nodes").join(t("live").select("task_id"), "task_id", "left_semi").select("workflow_id").distinct()


@query("select t.task_id, n.workflow_id from live t left join nodes n on n.task_id = t.task_id")
def c4_optional_workflow(t):
    return t("live").select("task_id").join(t("nodes").select("task_id", "workflow_id"), "task_id", "left")


@query(f"select id from workflows w where status = 'RUNNING' and exists (select 1 from nodes n where n.workflow_id = w.id) and not exists (select 1 from nodes n where n.workflow_id = w.id and {OPEN})")
def c5_finished_workflows(t):
    return J.finished_workflows(t("workflows"), t("nodes")).select("id")


@query("select id from workflows w where status = 'RUNNING' and not exists (select 1 from nodes n where n.workflow_id = w.id)")
def c6_empty_workflows(t):
    return J.empty_workflows(t("workflows"), t("nodes")).select("id")


@query("select id from workflows w where exists (select 1 from nodes n where n.workflow_id = w.id and n.status = 'FAILED')")
def c7_with_failed_node(t):
    return t("workflows").join(t("nodes").where("status = 'FAILED'").select(F.col("workflow_id").alias("id")), "id", "left_semi").select("id")


@query("select t.task_id, max(sent_at) as last_beat from tasks t left join heartbeats h on h.task_id = t.task_id and role = 'runner' where status = 'RUNNING' group by 1")
def c8_last_heartbeat(t):
    return t("live").where("status = 'RUNNING'").select("task_id").join(B.last_beats(t("heartbeats")), "task_id", "left")


@query(f"select node_key from nodes n where status = 'PENDING' and not exists (select 1 from edges e join nodes d on d.workflow_id = e.workflow_id and d.task_index = e.dep where e.workflow_id = n.workflow_id and e.task_index = n.task_index and d.{OPEN})")
def c9_unblocked_nodes(t):
    return J.ready_by_dependencies(t("nodes"), t("edges")).select("node_key")


@query("select distinct workflow_id, task_index from edges where dep in (0, 2)")
def c10_dependents(t):
    return J.dependents(t("edges"), [0, 2])


@query(f"select task_id, queue_name, row_number() over (partition by queue_name order by priority, enqueued_at, task_id) as nth from live where status = 'PENDING' and {DUE} qualify nth <= case queue_name when 'high' then 7 else 4 end")
def c11_top_per_queue(t):
    able = t("live").where(B.claimable(now())).select("task_id", "queue_name", "priority", "enqueued_at")
    # the largest limit first, so that Spark keeps only so many rows of each queue before the shuffle
    most = M.top_per_key(able, "queue_name", F.lit(7), "priority", "enqueued_at", "task_id")
    return most.where(F.col("nth") <= F.when(F.col("queue_name") == "high", 7).otherwise(4)).select("task_id", "queue_name", F.col("nth").cast("long").alias("nth"))


@query("select workflow_id, task_index, status from nodes join (values (32, 0), (33, 1), (34, 0), (66, 2)) v(w, i) on w = workflow_id and i = task_index")
def c12_paired_lookup(t):
    pairs = t("nodes").sparkSession.range(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, (32, 33, 34, 66))).alias("w"), F.array(*map(F.lit, (0, 1, 0, 2))).alias("i"))).alias("p")).select(F.col("p.w").cast("long").alias("workflow_id"), F.col("p.i").alias("task_index"))
    return t("nodes").join(F.broadcast(pairs), ["workflow_id", "task_index"]).select("workflow_id", "task_index", "status")


@query("select * from (with recursive tree as (select id, 0 as level from workflows where id = 4 union all select c.id, t.level + 1 from workflows c join tree t on c.parent_id = t.id) select id, level from tree)")
def c13_descendants(t):
    return J.descendants(t("workflows"), 4)


@query("select * from (with recursive up as (select id, parent_id, 0 as level from workflows where id = 1444 union all select p.id, p.parent_id, u.level + 1 from workflows p join up u on p.id = u.parent_id) select id, level from up)")
def c14_ancestors(t):
    return J.ancestors(t("workflows"), 1444)


@query("select worker_id, snapshot_id, cpu_percent from worker_states qualify row_number() over (partition by worker_id order by snapshot_at desc, snapshot_id desc) = 1")
def c15_newest_snapshots(t):
    return M.latest(t("worker_states"), "worker_id", "snapshot_at", "snapshot_id").select("worker_id", "snapshot_id", "cpu_percent")


@query("select leaf_name, count(o.task_id) as blockers from leaves l left join outbox o on o.history_class = l.class_key and history_anchor >= lower_anchor and history_anchor < upper_anchor group by 1")
def c16_leaf_blockers(t):
    return L.blockers(t("outbox"), t("leaves"))


@query("select class_key, 'hist_' || class_key || '_' || d as leaf_name, timestamp '2024-01-01' + interval 1 day * d::int as lower_anchor from classes, range(0, 25) r(d)")
def c17_expected_leaves(t):
    return L.expected_leaves(t("classes"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 25)


@query("select 'hist_' || c.class_key || '_' || d as leaf_name, case when l.leaf_name is null then 'MISSING' when not verified then 'UNVERIFIED' else 'OK' end as fault from classes c, range(0, 27) r(d) left join leaves l on l.leaf_name = 'hist_' || c.class_key || '_' || d")
def c18_coverage_faults(t):
    return L.coverage_faults(L.expected_leaves(t("classes"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 27), t("leaves"))


@query("select id, created_at from workflows where (created_at > timestamp '1995-03-01' or (created_at = timestamp '1995-03-01' and id > 100)) and (created_at < timestamp '1998-01-01' or (created_at = timestamp '1998-01-01' and id <= 0)) order by created_at, id limit 100")
def c19_keyset_page(t):
    return M.after(t("workflows"), (datetime(1995, 3, 1), 100), (datetime(1998, 1, 1), 0), 100).select("id", "created_at")


@query("select n.node_key, total, s.failed from nodes n left join (select workflow_id, count(*) as total, count(*) filter (status = 'FAILED') as failed from nodes group by 1) s on s.workflow_id = n.sub_workflow_id where n.sub_workflow_id is not null")
def c20_child_counts(t):
    children = J.child_summary(t("nodes")).select(F.col("workflow_id").alias("sub_workflow_id"), "total", "failed")
    return t("nodes").where("sub_workflow_id is not null").select("node_key", "sub_workflow_id").join(children, "sub_workflow_id", "left").select("node_key", "total", "failed")


@query("select e.workflow_id, e.task_index, e.dep from edges e where exists (select 1 from nodes n where n.workflow_id = e.workflow_id and n.task_index = e.dep)")
def c21_edges(t):
    return J.valid_edges(t("nodes"), t("edges"))


@query(f"select task_name, sum(n)::bigint as n from (select task_name, count(*) as n from live group by 1 union all select task_name, count(*) from history where {RANGE} group by 1) group by 1")
def c22_merged_groups(t):
    return life(t).groupBy("task_name").agg(F.count("*").alias("n"))


@query("select p_brand, sum(l_quantity)::decimal(18, 2) as sold from lineitem join part on p_partkey = l_partkey group by 1")
def c23_products_and_lines(t):
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("decimal(12,2)").alias("quantity"))
    return lines.join(t("part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sum("quantity").cast("decimal(18,2)").alias("sold"))


@query("select task_id from live t where is_workflow_task and status in ('PENDING', 'CLAIMED') and not exists (select 1 from nodes n where n.task_id = t.task_id and n.status in ('READY', 'ENQUEUED', 'RUNNING'))")
def c24_orphans(t):
    return K.orphans(t("live"), t("nodes")).select("task_id")


@query("select task_id from tasks t where status = 'RUNNING' and not exists (select 1 from heartbeats h where h.task_id = t.task_id and role = 'runner' and sent_at > :now - interval 10 day)")
def c25_no_fresh_beat(t):
    fresh = t("heartbeats").where((F.col("role") == "runner") & (F.col("sent_at") > now() - F.make_dt_interval(F.lit(10))))
    return t("live").where("status = 'RUNNING'").join(fresh.select("task_id"), "task_id", "left_anti").select("task_id")


@query("""select coalesce(a.task_id, b.task_id) as task_id, case when a.task_id is null then 'ADDED' when b.task_id is null then 'MISSING' else 'CHANGED' end as kind
    from (select task_id, status, queue_name from history where task_id % 7 <> 0) a full join (select task_id, case when task_id % 11 = 0 then 'X' else status end as status, queue_name from history where task_id % 5 <> 0) b using (task_id)
    where a.task_id is null or b.task_id is null or a.status <> b.status""")
def c26_full_outer_differences(t):
    rows = t("history").select("task_id", "status", "queue_name")
    return L.differences(rows.where("task_id % 7 <> 0"), rows.where("task_id % 5 <> 0").withColumn("status", F.when(F.col("task_id") % 11 == 0, "X").otherwise(F.col("status"))), "task_id")


# ---- D: aggregates


@query(f"select s as status, count(task_id) as n from (values {', '.join(f'({chr(39)}{s}{chr(39)})' for s in TASK_STATUSES)}) v(s) left join {LIFE} l on l.status = s group by 1")
def d1_task_stats(t):
    return M.task_stats(life(t))


def _breakdown_sql(by: str, limit: int) -> str:
    return f"""select * from (
        with g as (select coalesce({by}, 'unknown') as grp, {COUNTS}, count(*) as total, count(*) filter (retry_count > 0) as retried from {LIFE} l group by 1)
        select *, cast(null as bigint) as group_count from (select * from g order by total desc, grp limit {limit})
        union all select 'TOTAL', {SUMS}, sum(total)::bigint, sum(retried)::bigint, count(*) from g)"""


@query(_breakdown_sql("worker_id", 20))
def d2_task_breakdown(t):
    return M.breakdown(life(t), "worker_id", 20)


@query(_breakdown_sql("task_name", 3))
def d2_breakdown_by_name(t):
    return M.breakdown(life(t), "task_name", 3)


@query(f"select worker_id as value, count(*) as n from {LIFE} l where worker_id is not null group by 1 order by 2 desc, 1 limit 50")
def d3_facet_counts(t):
    return M.facet(life(t), "worker_id", 50)


@query(f"""select * from (
    (select 'task_name' as facet, task_name as value, count(*) as n from {LIFE} l group by 2 order by n desc, value limit 50) union all
    (select 'queue_name', queue_name as value, count(*) as n from {LIFE} l group by 2 order by n desc, value limit 50) union all
    (select 'worker_id', worker_id as value, count(*) as n from {LIFE} l where worker_id is not null group by 2 order by n desc, value limit 50) union all
    (select 'error_code', error_code as value, count(*) as n from {LIFE} l where error_code in ({CODES['OPERATIONAL']}) group by 2 order by n desc, value limit 30) union all
    (select 'category', {CATEGORY} as value, count(*) as n from {LIFE} l where {CATEGORY} is not null group by 2))""")
def d4_task_facets(t):
    return M.facets(life(t), ["OPERATIONAL"])


@query("""select * from (
    (select 'status' as facet, status as value, count(*) as n from history group by 2) union all (select 'kind', kind, count(*) from history group by 2) union all
    (select 'class_key', class_key, count(*) from history group by 2) union all (select 'queue_name', queue_name, count(*) from history group by 2) union all
    (select 'task_name', task_name, count(*) from history group by 2) union all (select 'error_code', error_code, count(*) from history where error_code <> '' group by 2) union all
    (select 'worker_id', worker_id as value, count(*) as n from history where worker_id is not null group by 2 order by n desc, value limit 50))""")
def d5_history_facets(t):
    columns = ("status", "kind", "class_key", "queue_name", "task_name", "error_code", "worker_id")
    return M.facets(t("history"), (), columns).where("facet <> 'category'")


@query(f"select status, kind, count(*) as n from history where {RANGE} group by all")
def d6_status_and_kind(t):
    return t("history").where(B.half_open(F.col("anchor"), LOWER, UPPER)).groupBy("status", "kind").agg(F.count("*").alias("n")).orderBy("status", "kind")


@query("select status, count(*) as n from history where queue_name = 'high' group by 1")
def d7_scoped_counts(t):
    return B.members(t("history"), queue_name=["high"]).groupBy("status").agg(F.count("*").alias("n"))


@query("select task_name, count(*) as n, count(*) filter (retry_count > 0) as retried from history group by 1")
def d8_filtered_count(t):
    return t("history").groupBy("task_name").agg(F.count("*").alias("n"), F.count_if(F.col("retry_count") > 0).alias("retried"))


@query(f"select count(*) as n from {LIFE} l where status in ('FAILED', 'PENDING')")
def d9_exact_count(t):
    return B.members(life(t), status=["FAILED", "PENDING"]).agg(F.count("*").alias("n"))


@query(f"select count(*) as n from {LIFE} l")
def d10_total(t):
    return life(t).agg(F.count("*").alias("n"))


@query("select exists (select 1 from history where status = 'EXPIRED') as there")
def d11_any_row(t):
    return t("history").where("status = 'EXPIRED'").select(F.lit(1).alias("one")).limit(1).agg((F.count("*") > 0).alias("there"))


FLYING = "select * from tasks where status = 'RUNNING' or (status = 'CLAIMED' and (claim_expires_at is null or claim_expires_at > :now))"
ACCOUNT = f"select count(*) filter (worker_id = 'worker-7' and status = 'CLAIMED') as claimed, count(*) filter (worker_id = 'worker-7' and status = 'RUNNING') as running, count(*) filter (worker_id = 'worker-7') as mine, count(*) as everyone from ({FLYING})"
BUDGET = "greatest(0, least(greatest(50 - mine, 0), 50 - claimed, greatest(0, 1200 - everyone)))::bigint"


@query(f"select *, {BUDGET} as budget from ({ACCOUNT})")
def d12_capacity_accounting(t):
    return C.accounting(t("live"), CLAIM, now())


@query("select queue_name, count(*) as used from tasks where status = 'RUNNING' and queue_name in ('low', 'default') group by 1")
def d13_queue_running(t):
    return B.members(t("live").where("status = 'RUNNING'"), queue_name=["low", "default"]).groupBy("queue_name").agg(F.count("*").alias("used"))


@query(DEPS)
def d14_dependency_histogram(t):
    return J.dependency_counts(t("nodes"), t("edges"))


@query("select workflow_id, string_agg(task_id::varchar, ',' order by completed_at, task_id) as ids from nodes where status = 'COMPLETED' group by 1")
def d15_ordered_ids(t):
    done = t("nodes").where("status = 'COMPLETED'").groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("completed_at", "task_id"))).alias("l"))
    return done.select("workflow_id", F.array_join(F.transform("l", lambda x: x["task_id"].cast("string")), ",").alias("ids"))


@query("select task_id, '[' || string_agg('[' || attempt || ',' || ok || ']', ',' order by attempt) || ']' as snapshot from attempts group by 1")
def d16_attempt_snapshot(t):
    rows = t("attempts").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "ok"))).alias("l"))
    return rows.select("task_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["attempt"].cast("string"), F.lit(","), x["ok"].cast("string"), F.lit("]"))), ","), F.lit("]")).alias("snapshot"))


@query("select distinct name from workflows")
def d17_distinct_names(t):
    return t("workflows").select("name").distinct().orderBy("name")


@query("select task_id, count(distinct workflow_id) as n from nodes group by 1 having n > 1")
def d18_shared_tasks(t):
    return J.shared_tasks(t("nodes"))


@query("select workflow_id, count(*) as total, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'SKIPPED') as skipped from nodes group by 1")
def d19_child_summary(t):
    return J.child_summary(t("nodes"))


@query("""select class_key, count(*) as attached, max(upper_anchor) as covered_until, count(*) filter (lower_anchor >= timestamp '2024-01-22') as future, count(*) filter (b.n > 0) as blocked,
    count(*) filter (b.n = 0 and keep_days is not null and upper_anchor + interval 1 day * keep_days <= timestamp '2024-01-22') as detachable
    from leaves l join classes c using (class_key) join (select leaf_name, count(o.task_id) as n from leaves l left join outbox o on o.history_class = l.class_key and history_anchor >= lower_anchor and history_anchor < upper_anchor group by 1) b using (leaf_name)
    where relation_exists and not detach_pending and actual_bound = cataloged_bound and id_index_exists group by 1""")
def d20_coverage_health(t):
    report = L.health(t("leaves"), t("classes"), L.blockers(t("outbox"), t("leaves")), F.lit("2024-01-22 00:00:00").cast("timestamp_ntz"))
    return report.select("class_key", "attached", "covered_until", "future", "blocked", "detachable")


@query("select o_orderstatus, count(*) as n, coalesce(sum(o_totalprice::decimal(15, 2)), 0)::decimal(18, 2) as total from orders group by 1")
def d21_sales_totals(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(15,2)")), F.lit(0)).cast("decimal(18,2)").alias("total"))


@query("select count(*) as n, min(o_orderdate) as oldest from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1996-01-01'")
def d22_abandoned_orders(t):
    return t("orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"))


@query("select count(*) filter (o_orderstatus = 'F') as captured, count(*) filter (o_orderstatus <> 'F') as authorized, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) as without_lines from orders")
def d23_reconciliation(t):
    o = t("orders")
    bare = o.join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count("*").alias("without_lines"))
    return o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("captured"), F.count_if(F.col("o_orderstatus") != "F").alias("authorized")).crossJoin(bare)


@query("select class_key, case when bool_and(verified) then min(min_birth_at) end as floor from leaves group by 1")
def d26_birth_floor(t):
    return L.birth_floor(t("leaves"))


@query("select class_key, coalesce(bool_and(verified), true) as conform from leaves group by 1")
def d27_conformity(t):
    return t("leaves").groupBy("class_key").agg(F.coalesce(F.bool_and("verified"), F.lit(True)).alias("conform"))


IN_LEAF = "history h join leaves l on l.class_key = h.class_key and h.anchor >= lower_anchor and h.anchor < upper_anchor"


@query(f"select leaf_name, count(*) as n, count(error_code) as with_payload, coalesce(sum(strlen(error_code)), 0)::bigint as payload_bytes, count(distinct task_id) as ids from {IN_LEAF} group by 1")
def d28_rewrite_plan(t):
    return L.rewrite_plan(t("history"), t("leaves"))


@query("select max(attempt_count) + 1 as next_batch, sum(attempt_count)::bigint as moved from outbox")
def d29_next_batch(t):
    return t("outbox").agg((F.max("attempt_count") + 1).alias("next_batch"), F.sum("attempt_count").alias("moved"))


@query("select workflow_id, count(task_id % 10) <> count(distinct task_id % 3) as repeated from nodes group by 1")
def d30_duplicates_in_list(t):
    lists = t("nodes").groupBy("workflow_id").agg(F.collect_list(F.col("task_id") % 3).alias("l"))
    return lists.select("workflow_id", (F.size("l") != F.size(F.array_distinct("l"))).alias("repeated"))
