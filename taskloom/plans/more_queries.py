"""Queries, continued: windows, order, sets, scalars, schedules, streams, graphs, state changes, partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import attempts as P
from ..functions import canonical as Q
from ..functions import envelopes as E
from ..functions import patterns as N
from ..operators import specs as G
from ..operators.joins import left_by_key
from ..sources.steps import Steps
from .queries import ACTION, BUDGET, ACCOUNT, CASES, CATEGORY, CLAIM, DEPS, DUE, FLYING, IN_LEAF, LIFE, LOWER, NODE_MOVES, OPEN, RANGE, SOFT, TASK_MOVES, WORKFLOW_MOVES, A, B, C, H, I, J, K, L, M, S, life, now, query

# ---- E, F: windows, order, first rows


def _claim_sql(budget: str, source: str, queues: str, hard: bool, batch: str) -> str:
    used = FLYING if hard else "select * from tasks where status = 'RUNNING'"
    return f"""select * from (
        with q as (select * from (values {queues}) v(queue_name, qp, cap)), b as (select {budget} as budget from ({source})),
        used as (select queue_name, count(*) as used from ({used}) f group by 1),
        room as (select q.*, least(budget, {batch}, case when cap is null then budget else greatest(0, cap - coalesce(used, 0)) end) as room, budget from q left join used using (queue_name) cross join b),
        able as (select * from tasks where (status = 'PENDING' or (status = 'CLAIMED' and claim_expires_at < :now)) and {DUE}),
        ranked as (select task_id, queue_name, qp, priority, enqueued_at, budget, room from able join room using (queue_name) qualify row_number() over (partition by queue_name order by priority, enqueued_at, task_id) <= room)
        select task_id, queue_name, row_number() over (order by qp, priority, enqueued_at, task_id) as nth from ranked qualify nth <= max(budget) over ())"""


HARD_SQL = _claim_sql(BUDGET, ACCOUNT, "('default', 10, 60), ('high', 1, null), ('low', 100, 40)", True, "budget")
MINE = ACCOUNT.replace("worker-7", "worker-3")
SOFT_SQL = _claim_sql("greatest(0, least(greatest(30 - running - claimed, 0), 30 - claimed))::bigint", MINE, "('default', 100, null), ('low', 5, 70)", False, "12")


@query(HARD_SQL)
def k1_claim_plan(t):
    return C.candidates(t("live"), CLAIM, now())


@query(SOFT_SQL)
def k1_claim_plan_soft(t):
    return C.candidates(t("live"), SOFT, now())


@query(f"select status, count(*) as n, count(*) filter (worker_id = 'worker-7') as mine from (select case when c.task_id is not null then 'CLAIMED' else status end as status, case when c.task_id is not null then 'worker-7' else worker_id end as worker_id from live left join ({HARD_SQL}) c using (task_id)) group by 1")
def k1_state_after_claim(t):
    new, _ = C.claim(t("live"), CLAIM, now())
    return new.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("worker_id") == "worker-7").alias("mine"))


@query("select task_id, queue_name, nth from (select task_id, queue_name, row_number() over (partition by queue_name order by priority, enqueued_at, task_id) as nth from live) where nth <= 9")
def e1_first_per_queue(t):
    return M.top_per_key(t("live").select("task_id", "queue_name", "priority", "enqueued_at"), "queue_name", F.lit(9), "priority", "enqueued_at", "task_id").select("task_id", "queue_name", F.col("nth").cast("long").alias("nth"))


@query("select task_id, row_number() over (order by priority, enqueued_at, task_id) as nth from live qualify nth <= 100")
def e2_first_of_all(t):
    first = t("live").orderBy("priority", "enqueued_at", "task_id").limit(100)
    return first.select("task_id", F.row_number().over(Window.orderBy("priority", "enqueued_at", "task_id")).cast("long").alias("nth"))


BUDGETED = """select id, node_count, running from (select id, node_count, sum(node_count) over (order by id)::bigint as running, row_number() over (order by id) as nth
    from (select w.id, count(n.node_key) as node_count from workflows w left join nodes n on n.workflow_id = w.id where w.status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED') group by 1 order by 1 limit 500)) where running <= 500 or nth = 1"""
DELETABLE = BUDGETED.replace("group by 1", "and coalesce(w.completed_at, w.updated_at, w.created_at) < :now - interval 720 hour and not exists (select 1 from live t join nodes x on x.task_id = t.task_id where x.workflow_id = w.id and t.status in ('CLAIMED', 'PENDING', 'RUNNING')) group by 1")


@query(BUDGETED)
def e3_running_budget(t):
    return L.within_budget(t("workflows"), t("nodes"), 500)


@query(BUDGETED.replace("running <= 500", "running <= 0").replace("limit 500", "limit 1"))
def e4_first_always(t):
    return L.within_budget(t("workflows"), t("nodes"), 0)


@query("select class_key, leaf_name, row_number() over (partition by class_key order by lower_anchor, leaf_name) - 1 as position from leaves")
def e6_probe_positions(t):
    return L.probe_order(t("leaves"))


def _page(name: str, field: str, sql: str, descending: bool, offset: int):
    def run(t):
        return M.page(life(t), field, descending, offset, 25).select("task_id", "status", "arm")

    run.__name__ = name
    query(f"select task_id, status, arm from {LIFE} l order by {sql} {'desc' if descending else 'asc'} nulls last, task_id limit 25 offset {offset}")(run)


for _name, _field, _sql in (
    ("enqueued_at", "enqueued_at", "enqueued_at"), ("started_at", "started_at", "started_at"), ("completed_at", "completed_at", "completed_at"), ("failed_at", "failed_at", "failed_at"), ("priority", "priority", "priority"), ("retry_count", "retry_count", "retry_count"),
    ("status", "status", "status"), ("task_name", "task_name", "task_name"), ("queue_name", "queue_name", "queue_name"), ("queue_s", "queue_s", "started_at - enqueued_at"), ("exec_s", "exec_s", "coalesce(completed_at, failed_at) - started_at"),
):
    _page(f"f1_page_by_{_name}", _field, _sql, False, 0)
    _page(f"f1_page_by_{_name}_desc", _field, _sql, True, 50)


@query("select task_id, epoch(started_at - enqueued_at)::bigint as queue_s, epoch(coalesce(completed_at, failed_at) - started_at)::bigint as exec_s from history")
def f2_durations(t):
    return t("history").select("task_id", S.elapsed_s(F.col("enqueued_at"), F.col("started_at")).alias("queue_s"), S.elapsed_s(F.col("started_at"), F.coalesce("completed_at", "failed_at")).alias("exec_s"))


@query(f"select task_id, status, arm from {LIFE} l order by enqueued_at desc nulls last, task_id limit 40 offset 160")
def f3_merged_page(t):
    B.check_page(40, 160)
    return M.page(life(t), "enqueued_at", True, 160, 40).select("task_id", "status", "arm")


@query(f"select task_id, status, arm from {LIFE} l order by completed_at asc nulls last, task_id limit 25 offset 400")
def f4_nulls_last(t):
    return M.page(life(t), "completed_at", False, 400, 25).select("task_id", "status", "arm")


@query("select id from workflows where id > 700 and id <= 1400 order by id limit 64")
def f5_cycle_page(t):
    rows = t("workflows").withColumn("zero", F.lit(0))
    return M.after(rows, (0, 700), (0, 1400), 64, ("zero", "id")).select("id")


@query(f"select queue_name, least(20, case queue_name when 'low' then greatest(0, 40 - count(*)) else 20 end, 15)::bigint as room from ({FLYING}) group by 1")
def f6_dynamic_limit(t):
    used = t("live").where(B.in_flight(now())).groupBy("queue_name").agg(F.count("*").alias("used"))
    return used.select("queue_name", F.least(F.lit(20), F.when(F.col("queue_name") == "low", F.greatest(F.lit(0), 40 - F.col("used"))).otherwise(20), F.lit(15)).cast("long").alias("room"))


@query("select workflow_id, min(task_index) as task_index from nodes where status = 'FAILED' and task_index in (0, 1, 2) group by 1")
def f7_first_failed(t):
    return J.first_failed(t("nodes"), [0, 1, 2])


@query("select user_id, arg_max(event_type, event_id) as last_type from events group by 1")
def f8_latest_per_key(t):
    return M.latest(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", F.col("event_type").alias("last_type"))


@query("select task_id, attempt from attempts where task_id in (select min(task_id) from attempts where attempt = 3) order by attempt desc")
def f9_attempts_newest_first(t):
    first = t("attempts").where("attempt = 3").agg(F.min("task_id").alias("task_id"))
    return t("attempts").join(F.broadcast(first), "task_id").select("task_id", "attempt").orderBy(F.desc("attempt"))


@query("select task_id, created_at from outbox where created_at <= :now - interval 10 day and attempt_count < 4 order by created_at, task_id limit 50")
def f10_outbox_oldest(t):
    return t("outbox").where((F.col("created_at") <= now() - F.make_dt_interval(F.lit(10))) & (F.col("attempt_count") < 4)).orderBy("created_at", "task_id").limit(50).select("task_id", "created_at")


@query("select task_id from tasks where status = 'CLAIMED' order by priority, enqueued_at, task_id limit 30")
def f11_buffered_claims(t):
    return t("live").where("status = 'CLAIMED'").orderBy("priority", "enqueued_at", "task_id").limit(30).select("task_id")


@query("select id, created_at from workflows where status = 'PAUSED' and created_at < timestamp '1998-01-01' order by created_at, id limit 20")
def f13_paused_expiry(t):
    return t("workflows").where((F.col("status") == "PAUSED") & (F.col("created_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))).orderBy("created_at", "id").limit(20).select("id", "created_at")


# ---- G: sets


@query(f"select task_id, 'pending' as arm from tasks where status = 'PENDING' and {DUE} union all select task_id, 'expired' from tasks where status = 'CLAIMED' and claim_expires_at < :now and {DUE}")
def g1_eligibility_arms(t):
    live = t("live")
    return live.where(B.claimable(now())).select("task_id", F.lit("pending").alias("arm")).unionByName(live.where(B.reclaimable(now())).select("task_id", F.lit("expired").alias("arm")))


@query("select class_key from history union select class_key from classes union select 'audit'")
def g2_distinct_classes(t):
    fixed = t("classes").sparkSession.createDataFrame([("audit",)], "class_key string")
    return t("history").select("class_key").union(t("classes").select("class_key")).union(fixed).distinct()


@query("select node_key from nodes n where not exists (select 1 from edges e where e.workflow_id = n.workflow_id and e.dep = n.task_index)")
def g3_terminal_nodes(t):
    return J.terminal_nodes(t("nodes"), t("edges")).select("node_key")


@query("select schedule_name from schedules where schedule_id % 3 = 0 and schedule_id not in (select schedule_id from schedules where schedule_id % 2 = 0)")
def g4_unsaved_schedules(t):
    s = t("schedules")
    return A.unsaved(s.where("schedule_id % 3 = 0"), s.where("schedule_id % 2 = 0"), "schedule_id").select("schedule_name")


@query("select leaf_name from (select 'hist_' || class_key || '_' || d as leaf_name from classes, range(0, 26) r(d)) where leaf_name not in (select leaf_name from leaves where verified)")
def g5_unpublished_leaves(t):
    want = L.expected_leaves(t("classes"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 26)
    return want.join(t("leaves").where("verified").select("leaf_name"), "leaf_name", "left_anti").select("leaf_name")


@query("select * from ((select task_id, status from history where task_id % 2 = 0 except select task_id, status from history where task_id % 3 = 0) union all (select task_id, status from history where task_id % 3 = 0 except select task_id, status from history where task_id % 2 = 0))")
def g7_symmetric_difference(t):
    a, b = (t("history").where(f"task_id % {n} = 0").select("task_id", "status") for n in (2, 3))
    return a.subtract(b).unionAll(b.subtract(a))


# ---- H: scalars

LABELS = "concat(case event_id % 4 when 0 then ' ' when 1 then chr(9) when 2 then '' else ' x' end, case when event_id % 3 = 0 then event_type else '' end, ' ')"


@query(f"select event_id, nullif(regexp_replace({LABELS}, '^\\s+|\\s+$', '', 'g'), '') as label from events")
def h1_normalized_text(t):
    return t("events").select("event_id", S.normalize_text(F.expr(LABELS)).alias("label"))


@query(f"select task_id, {CATEGORY} as category from history")
def h2_error_category(t):
    return t("history").select("task_id", S.error_category(F.col("error_code")).alias("category"))


@query("select leaf_name, regexp_matches(leaf_name, '^[a-z_][a-z0-9_]*$') and strlen(leaf_name) <= 16 as ok from leaves")
def h3_identifier(t):
    return t("leaves").select("leaf_name", S.identifier_ok(F.col("leaf_name"), 16).alias("ok"))


@query("select event_id, 'beats_' || strftime(ts, '%Y_%m_%d_%H') as hourly, 'hist_' || strftime(ts, '%Y_%m_%d') as daily from events")
def h4_partition_names(t):
    return t("events").select("event_id", S.partition_name(F.lit("beats"), F.col("ts"), True).alias("hourly"), S.partition_name(F.lit("hist"), F.col("ts")).alias("daily"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_exists(props, '$.k') as has, array_to_string(json_keys(props), ',') as keys from events")
def h5_json_access(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has"), F.array_join(F.json_object_keys("props"), ",").alias("keys"))


#: What a node has stored: JSON of several shapes, text that isn't JSON, and nothing.
STORED = """case task_index % 5 when 0 then concat('{"ok":{"l":[1,{"a":"}{"}],"n":', node_key, ',"z":null}}') when 1 then concat('"text ', node_id, '"') when 2 then cast(node_key as varchar(20)) when 3 then concat('r', node_key) end"""
DEP_ERROR = "case when stored is not null then case when task_index % 5 = 3 then 'RESULT_DESERIALIZATION_ERROR' end when status in ('COMPLETED', 'FAILED') then 'RESULT_NOT_AVAILABLE' else 'UPSTREAM_SKIPPED' end"
KWARGS = '{"x":1,"o":{"k":[1,2],"b":"{}"},"f":true}'


def _stored(t):
    return t("nodes").select("node_key", "workflow_id", "node_id", "status", "task_index", F.expr(STORED.replace("varchar(20)", "string")).alias("stored"))


@query(f"select node_key, {DEP_ERROR} as code from (select *, {STORED} as stored from nodes)")
def h6_dependency_errors(t):
    return _stored(t).select("node_key", S.dependency_error(F.col("status"), F.col("stored")).alias("code"))


@query(f"""select node_key, '{{"dep":' || case when code is null then stored else '{{"err":{{"error_code":"' || code || '"}}}}' end || ',"f":true,"o":{{"b":"{{}}","k":[1,2]}},"x":1}}' as merged
    from (select *, {DEP_ERROR} as code from (select *, {STORED} as stored from nodes))""")
def h7_merged_kwargs(t):
    return _stored(t).select("node_key", S.merge_results(F.lit(KWARGS), "dep", F.col("status"), F.col("stored")).alias("merged"))


@query(f"select workflow_id, string_agg(node_id || '=' || coalesce(code, stored), ';' order by node_id) as context from (select *, {DEP_ERROR} as code from (select *, {STORED} as stored from nodes)) group by 1")
def h8_context(t):
    value = F.coalesce(S.dependency_error(F.col("status"), F.col("stored")), "stored")
    rows = _stored(t).groupBy("workflow_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", value.alias("v"))))).alias("m"))
    return rows.select("workflow_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("context"))


OPTIONS = "case task_id % 3 when 0 then '{\"auto_retry_for\": [\"TASK_ERROR\", \"CARD_DECLINED\"]}' when 1 then '{\"retry_policy\": {\"max_retries\": 5, \"auto_retry_for\": [\"WORKER_CRASHED\"]}}' else '{}' end"


@query("""select task_id, max_retries > 0 and retry_count < max_retries and (good_until is null or :now < good_until)
        and coalesce(case task_id % 3 when 0 then error_code in ('TASK_ERROR', 'CARD_DECLINED') when 1 then error_code = 'WORKER_CRASHED' else false end, false) as again,
        case task_id % 3 when 1 then 5 else 0 end as most from history""")
def h9_retry_policy(t):
    options = F.expr(OPTIONS)
    return t("history").select("task_id", S.retry_eligible(F.col("retry_count"), F.col("max_retries"), options, F.col("error_code"), F.col("good_until"), now()).alias("again"), S.max_retries(options).alias("most"))


@query("select event_id, case event_id % 3 when 0 then 'ValueError' when 1 then 'KeyError' else 'Boom' end as exception from events")
def h10_exception_type(t):
    error = F.expr("case event_id % 3 when 0 then '{\"exception\": {\"type\": \"ValueError\"}}' when 1 then '{\"exception\": {\"exception_type\": \"KeyError\"}}' else '{\"exception\": \"Boom\"}' end")
    return t("events").select("event_id", S.exception_type(error).alias("exception"))


@query("select task_id, sha256(task_name || ':' || queue_name) as digest from history")
def h13_payload_digest(t):
    return t("history").select("task_id", F.sha2(F.concat_ws(":", "task_name", "queue_name"), 256).alias("digest"))


@query("""select event_id, sha256('\\x00\\x00\\x00\\x06'::blob || 'key.v1'::blob || unhex(lpad(hex(strlen(event_type)), 8, '0')) || event_type::blob || unhex(lpad(hex(strlen(event_id::varchar)), 8, '0')) || event_id::varchar::blob) as digest from events""")
def h14_framed_digest(t):
    return t("events").select("event_id", S.framed_digest("key.v1", F.col("event_type"), F.col("event_id").cast("string")).alias("digest"))


#: Commands of a table; some have faults, some texts need escapes.
COMMAND_NAME = "case when event_id % 31 = 0 then '' when event_id % 5 = 0 then concat(event_type, chr(34), chr(92), chr(10), chr(1), chr(233)) else event_type end"
COMMAND_SQL = "select *, " + COMMAND_NAME + """ as name, (event_id % 103)::int as prio, case when event_id % 4 = 0 then '{"a":true}' end as kw, case when event_id % 3 = 0 then ts end as until, case when event_id % 6 = 0 then event_id % 17 - 1 end as delay,
    case when event_id % 10 = 3 then 'r' || event_id end as rerun, case when event_id % 20 = 3 then 'r0' end as root from events"""
JSON_TEXT = "'\"' || replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(1), chr(92) || 'u0001') || '\"'"


def _command_columns(t):
    cols = {"name": COMMAND_NAME, "prio": "cast(event_id % 103 as int)", "kw": """case when event_id % 4 = 0 then '{"a":true}' end""", "until": "case when event_id % 3 = 0 then ts end", "delay": "case when event_id % 6 = 0 then event_id % 17 - 1 end",
            "rerun": "case when event_id % 10 = 3 then concat('r', event_id) end", "root": "case when event_id % 20 = 3 then 'r0' end"}
    rows = t("events").withColumns({k: F.expr(v) for k, v in cols.items()})
    return rows, {"task_name": F.col("name"), "queue_name": F.lit("default"), "priority": F.col("prio"), "kwargs": F.col("kw"), "good_until": F.col("until"), "delay_s": F.col("delay"), "class_key": F.lit("short"), "retain_input": F.lit(True), "rerun_of": F.col("rerun"), "rerun_root": F.col("root")}


@query(f"""select event_id, case when name = '' then 'EMPTY_TASK_NAME' when prio not between 1 and 100 then 'INVALID_PRIORITY' when delay < 0 then 'INVALID_DELAY' when (rerun is null) <> (root is null) then 'INCOMPLETE_LINEAGE' end as fault,
    case when fault is null then sha256('[1,' || {JSON_TEXT.format('name')} || ',"default",' || prio || ',null,' || coalesce({JSON_TEXT.format('kw')}, 'null') || ',' || coalesce('"' || strftime(until, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"', 'null') || ',' || coalesce(delay::varchar, 'null') || ',null,"short",true,'
        || coalesce('"' || rerun || '"', 'null') || ',' || coalesce('"' || root || '"', 'null') || ']') end as digest from ({COMMAND_SQL})""")
def h15_command_fingerprints(t):
    rows, columns = _command_columns(t)
    return rows.select("event_id", Q.command_fault(**columns).alias("fault"), Q.command_fingerprint(**columns).alias("digest"))


#: Fixed value of the tests: a namespace of slots.
SLOTS = "3c01f3f5-afd6-4363-b726-a5dab51a81c7"
SLOT_NAME = "schedule_name || ':' || strftime(next_run_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


@query(f"""select schedule_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', instr('0123456789abcdef', substr(h, 17, 1)) % 4 + case when instr('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 then 4 else 0 end, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as slot_id
    from (select schedule_id, sha1(unhex('{SLOTS.replace("-", "")}') || ({SLOT_NAME})::blob) as h from schedules where next_run_at is not null)""")
def h16_slot_ids(t):
    import uuid

    return t("schedules").where("next_run_at is not null").select("schedule_id", Q.slot_uuid(uuid.UUID(SLOTS), F.col("schedule_name"), F.col("next_run_at")).alias("slot_id"))


#: Texts of configurations, the same ones said differently, and some that aren't JSON.
CONFIG = """case event_id % 5 when 0 then concat('{{"b": 1.50, "a": [1, ', event_id % 7, '], "n": {{"z": null, "y": "', event_type, '"}}}}') when 1 then concat('{{"n":{{"y":"', event_type, '","z":null}},"a":[1,', event_id % 7, '],"b":1.5}}')
    when 2 then concat('{{"a": NaN, "b": "', event_type, '"}}') when 3 then concat('{{"a": "NaN", "b": [-Infinity, ', event_id, ']}}') else concat('{{"a": ', event_id) end""".replace("{{", "{").replace("}}", "}")


@query(f"select event_id, case when event_id % 5 in (2, 3) then 'NON_FINITE' when event_id % 5 = 4 then 'NOT_JSON' end as fault from events")
def h19_strict_json(t):
    return t("events").select("event_id", Q.strict_fault(F.expr(CONFIG)).alias("fault"))


@query("""select event_id, case when event_id % 5 < 2 then sha256('{"a":[1,' || event_id % 7 || '],"b":1.5,"n":{"y":"' || event_type || '","z":null}}') end as digest from events""")
def h20_config_digests(t):
    return t("events").select("event_id", Q.config_digest(F.expr(CONFIG)).alias("digest"))


@query("""select event_id, case when event_id % 3 <> 0 then date_trunc('milliseconds', ts) end as born from events""")
def h17_uuid7_birth(t):
    head = F.lower(F.lpad(F.hex(F.unix_millis(F.col("ts").cast("timestamp"))), 12, "0"))
    made = F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.when(F.col("event_id") % 3 == 0, "-4000-8000-000000000000").otherwise("-7000-8000-000000000000"))
    return t("events").select("event_id", S.uuid7_birth(made).cast("timestamp_ntz").alias("born"))


@query("select workflow_id, list_contains(l, 1) as has_one, len(l) as n, list_has_any(l, [0, 3]) as any_of from (select workflow_id, array_agg(task_index) as l from nodes group by 1)")
def h18_array_predicates(t):
    lists = t("nodes").groupBy("workflow_id").agg(F.collect_list("task_index").alias("l"))
    return lists.select("workflow_id", F.array_contains("l", 1).alias("has_one"), F.size("l").cast("long").alias("n"), F.arrays_overlap("l", F.array(F.lit(0), F.lit(3))).alias("any_of"))


@query("select task_id, case when started_at is not null then trunc(epoch(started_at) - epoch(enqueued_at))::bigint end as waited from tasks")
def h30_elapsed(t):
    return t("tasks").select("task_id", S.elapsed_s(F.col("enqueued_at"), F.col("started_at")).alias("waited"))


@query("select task_id, case when completed_at is not null then trunc(epoch(completed_at) - epoch(enqueued_at))::bigint when status = 'RUNNING' then trunc(epoch(:now) - epoch(enqueued_at))::bigint end as span from tasks")
def h31_span(t):
    return t("tasks").select("task_id", S.span_s(F.col("enqueued_at"), F.col("completed_at"), F.col("status") == "RUNNING", now()).alias("span"))


@query("""select task_id, trunc(case when coalesce(started_at, completed_at, failed_at) is not null then epoch(coalesce(started_at, completed_at, failed_at)) - epoch(enqueued_at) when status in ('PENDING', 'CLAIMED') then epoch(:now) - epoch(enqueued_at) end)::bigint as queue_s,
    trunc(case when coalesce(completed_at, failed_at) is not null then epoch(coalesce(completed_at, failed_at)) - epoch(started_at) when status = 'RUNNING' then epoch(:now) - epoch(started_at) end)::bigint as exec_s from tasks""")
def h32_queue_and_exec(t):
    return t("tasks").select("task_id", S.queue_s(now()).alias("queue_s"), S.exec_s(now()).alias("exec_s"))


@query("select node_key, case when status = 'RUNNING' then trunc(epoch(:now) - epoch(started_at))::bigint when completed_at is not null then trunc(epoch(completed_at) - epoch(started_at))::bigint end as exec_s from nodes")
def h33_node_exec(t):
    return t("nodes").select("node_key", S.node_exec_s(now()).alias("exec_s"))


@query("select event_id, date_trunc('day', ts)::timestamp as day, date_trunc('hour', ts)::timestamp + interval 1 hour as next_hour from events")
def h34_truncated_times(t):
    return t("events").select("event_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day"), (F.date_trunc("HOUR", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(1))).alias("next_hour"))


@query("select event_id, ts + interval 1 day + interval 2 hour + interval 3 minute as next_run from events")
def h35_next_interval(t):
    return t("events").select("event_id", H.interval_column(F.col("ts"), days=1, hours=2, minutes=3).alias("next_run"))


@query("select event_id, case when date_trunc('hour', ts)::timestamp + interval 17 minute > ts then date_trunc('hour', ts)::timestamp + interval 17 minute else date_trunc('hour', ts)::timestamp + interval 77 minute end as next_run from events")
def h36_next_hourly(t):
    return t("events").select("event_id", H.hourly_column(F.col("ts"), 17).alias("next_run"))


@query("select event_id, case when date_trunc('day', ts)::timestamp + interval 510 minute > ts then date_trunc('day', ts)::timestamp + interval 510 minute else date_trunc('day', ts)::timestamp + interval 1950 minute end as next_run from events")
def h37_next_daily(t):
    return t("events").select("event_id", H.daily_column(F.col("ts"), 8, 30).alias("next_run"))


@query("select event_id, min(r) as next_run from (select event_id, ts, date_trunc('day', ts)::timestamp + interval 1 day * d::int + interval 9 hour as r from events, range(0, 8) x(d)) where r > ts and isodow(r) in (1, 3) group by 1")
def h38_next_weekly(t):
    return t("events").select("event_id", H.daily_column(F.col("ts"), 9, 0, [0, 2]).alias("next_run"))


@query("""select event_id, min(r) as next_run from (select event_id, ts, m + interval 1 day * (least(31, day(last_day(m))) - 1)::int + interval 6 hour as r from (select event_id, ts, date_trunc('month', ts)::timestamp + interval 1 month * d::int as m from events, range(0, 2) x(d))) where r > ts group by 1""")
def h39_next_monthly(t):
    return t("events").select("event_id", H.monthly_column(F.col("ts"), 31, 6, 0).alias("next_run"))


#: New York around both clock changes of 2024, at which local times are skipped and repeated; its offsets from UTC.
ZONE = "America/New_York"
SHIFTED = "ts + interval 1 day * (case when event_id % 2 = 0 then 60 + event_id % 12 else 295 + event_id % 16 end)::int"
LOCAL = "u - interval 1 hour * (case when u >= timestamp '2024-03-10 07:00' and u < timestamp '2024-11-03 06:00' then 4 else 5 end)"
INSTANT = "case when l >= timestamp '2024-03-10 02:00' and l < timestamp '2024-03-10 03:00' then null else l + interval 1 hour * (case when l >= timestamp '2024-03-10 03:00' and l < timestamp '2024-11-03 02:00' then 4 else 5 end) end"


def _zone_sql(candidates: str, steps: int, where: str = "true") -> str:
    """The first candidate l (from b, the local time, and step d) whose instant is after u."""
    return f"""select event_id, min(x) as next_run from (select event_id, u, {INSTANT} as x from (select event_id, u, {candidates} as l from (select *, {LOCAL} as b from (select event_id, {SHIFTED} as u from events)), range(0, {steps}) r(d)) where {where}) where x > u group by 1"""


def _shifted(t):
    days = F.expr("case when event_id % 2 = 0 then 60 + event_id % 12 else 295 + event_id % 16 end").cast("int")
    return t("events").select("event_id", (F.col("ts") + F.make_dt_interval(days)).alias("u"))


@query(_zone_sql("date_trunc('hour', b)::timestamp + interval 1 hour * d::int + interval 17 minute", 6))
def h36_hourly_in_zone(t):
    return _shifted(t).select("event_id", H.hourly_column(F.col("u"), 17, zone=ZONE).alias("next_run"))


@query(_zone_sql("date_trunc('day', b)::timestamp + interval 1 day * d::int + interval 150 minute", 4))
def h37_daily_in_zone(t):
    return _shifted(t).select("event_id", H.daily_column(F.col("u"), 2, 30, zone=ZONE).alias("next_run"))


@query(_zone_sql("date_trunc('day', b)::timestamp + interval 1 day * d::int + interval 150 minute", 22, "isodow(l) = 7"))
def h38_weekly_in_zone(t):
    return _shifted(t).select("event_id", H.daily_column(F.col("u"), 2, 30, [6], zone=ZONE).alias("next_run"))


@query(_zone_sql("(date_trunc('month', b)::timestamp + interval 1 month * d::int) + interval 9 day + interval 150 minute", 5))
def h39_monthly_in_zone(t):
    return _shifted(t).select("event_id", H.monthly_column(F.col("u"), 10, 2, 30, zone=ZONE).alias("next_run"))


CRON = H.Cron(frozenset({0, 30}), frozenset({1, 2, 14}), frozenset({2, 3, 11}), frozenset({3, 10, 29}), frozenset({6}))


@query(_zone_sql("date_trunc('day', b)::timestamp + interval 1 day * (d // 6)::int + interval 1 hour * (case (d % 6) // 2 when 0 then 1 when 1 then 2 else 14 end)::int + interval 30 minute * (d % 2)::int", 6 * 230, "month(l) in (2, 3, 11) and (day(l) in (3, 10, 29) or isodow(l) = 7)"))
def h40_next_cron(t):
    return _shifted(t).select("event_id", H.cron_column(F.col("u"), CRON, zone=ZONE).alias("next_run"))


@query("select event_id, month(ts) in (2, 3, 11) and (day(ts) in (3, 10, 29) or isodow(ts) = 7) as either, day(ts) in (5, 12) and isodow(ts) = 5 as both from events")
def h41_cron_days(t):
    both = H.Cron(frozenset({0}), frozenset({0}), month_days=frozenset({5, 12}), week_days=frozenset({4}), both=True)
    return t("events").select("event_id", H.cron_day(F.col("ts"), CRON).alias("either"), H.cron_day(F.col("ts"), both).alias("both"))


# A table of schedules, each with its own pattern and zone. What the terms of the fixture stand for is spelled out here.
PATTERN_SQL = """
    c as (
        select *, case kind when 'hourly' then coalesce(second, '0')::int when 'cron' then 0 when 'interval' then 0 else case at_time when '01:15:30' then 30 when '23:59:59' then 59 else 0 end end as s,
               case when kind = 'hourly' then [minute::int] when kind = 'cron' then case minute when '0,30' then [0, 30] when '*/20' then [0, 20, 40] when '5-55/25' then [5, 30, 55] when '*' then range(0, 60) else [minute::int] end
                    else [case at_time when '02:30:00' then 30 when '01:15:30' then 15 else 59 end] end as ms,
               case when kind = 'hourly' then range(0, 24) when kind = 'cron' then case hour when '2' then [2] when '1-3' then [1, 2, 3] when '*/6' then [0, 6, 12, 18] when '*' then range(0, 24) else [0, 12, 23] end
                    else [case at_time when '02:30:00' then 2 when '01:15:30' then 1 else 23 end] end as hs,
               case when kind <> 'cron' or month = '*' then range(1, 13) when month = 'feb' then [2] when month = 'Mar,nov' then [3, 11] when month = '3-11/4' then [3, 7, 11] else [2, 3, 4] end as mons,
               case month_day when '29' then [29] when '3,10' then [3, 10] when '*/10' then [1, 11, 21, 31] when '30-31' then [30, 31] else range(1, 8) end as mds,
               case week_day when 'sun' then [7] when 'sat,sun' then [6, 7] when 'sun,mon,sun' then [7, 1] else range(1, 6) end as wds,
               case when kind <> 'interval' then 0 else coalesce(every_days, 0) * 86400 + coalesce(every_minutes, 0) * 60 + every_seconds end as step,
               case when zone = 'Mars/Olympus' then 'zone UNKNOWN'
                    when kind = 'interval' then case when every_seconds < 1 then 'every_seconds RANGE' when every_days < 1 then 'every_days RANGE' end
                    when kind = 'hourly' then case when second = '60' then 'second RANGE' when minute = '75' then 'minute RANGE' end
                    when kind <> 'cron' and at_time = '25:00:00' then 'at_time SYNTAX'
                    when kind = 'monthly' then case when month_day = '0' then 'month_day RANGE' end
                    when kind = 'weekly' then case when week_day = 'sun,mon,sun' then 'week_day DUPLICATE' end
                    when kind = 'cron' then case when minute = '75' then 'minute RANGE' when month = 'nov-mar' then 'month ORDER' when month = 'feb' and month_day = '30-31' and day_mode in ('month', 'both') then 'NEVER' end end as fault
        from patterns)"""
SPRING = "(make_date(year({0}), 3, 8) + ((7 - isodow(make_date(year({0}), 3, 8))) % 7)::int)"
AUTUMN = "(make_date(year({0}), 11, 1) + ((7 - isodow(make_date(year({0}), 11, 1))) % 7)::int)"


def _patterns_sql(back: bool) -> str:
    """By brute force: the first matching days, all their times of day, the moments of these, the first or last that fits."""
    u = "at_time_utc"
    local = f"case zone when 'UTC' then {u} when 'Asia/Kolkata' then {u} + interval 330 minute else {u} - interval 1 hour * (case when {u} >= {SPRING.format(u)} + interval 7 hour and {u} < {AUTUMN.format(u)} + interval 6 hour then 4 else 5 end) end"
    instant = f"case zone when 'UTC' then l when 'Asia/Kolkata' then l - interval 330 minute else case when l >= {SPRING.format('l')} + interval 2 hour and l < {SPRING.format('l')} + interval 3 hour then null else l + interval 1 hour * (case when l >= {SPRING.format('l')} + interval 3 hour and l < {AUTUMN.format('l')} + interval 2 hour then 4 else 5 end) end end"
    day = "date_trunc('day', b)::timestamp " + ("- interval 1 day * (n - 1)::int" if back else "+ interval 1 day * n::int")
    month_day, week_day = "list_contains(mds, day(d))", "list_contains(wds, isodow(d))"
    fits = f"list_contains(mons, month(d)) and case when kind in ('hourly', 'daily') or (kind = 'cron' and day_mode = 'any') then true when kind = 'monthly' then day(d) = least(month_day::int, day(last_day(d))) when kind = 'weekly' or day_mode = 'week' then {week_day} when day_mode = 'month' then {month_day} when day_mode = 'either' then {month_day} or {week_day} else {month_day} and {week_day} end"
    best = "max(x)" if back else "min(x)"
    found = f"""with {PATTERN_SQL},
        b as (select *, {local} as b from c where fault is null and kind <> 'interval'),
        days as (select * from (select *, {day} as d from b, range(0, 3400) r(n)) where {fits} qualify row_number() over (partition by schedule_id order by n) <= 4),
        hm as (select schedule_id, zone, {u}, d, s, h, unnest(ms) as m from (select *, unnest(hs) as h from days)),
        x as (select schedule_id, {u} as u, {instant} as x from (select *, d + interval 1 hour * h::int + interval 1 minute * m::int + interval 1 second * s::int as l from hm)),
        best as (select schedule_id, {best} as x from x where {'x <= u' if back else 'x > u'} group by 1)"""
    if back:
        first = f"{u} - interval 1 day * (schedule_id % 900)::int"
        return f"select * from ({found} select c.schedule_id, case when fault is not null then null when kind = 'interval' then {first} + interval 1 second * ((schedule_id % 900) * 86400 // step * step)::int else greatest({first}, coalesce(x, {first})) end as latest_slot from c left join best using (schedule_id))"
    return f"select * from ({found} select c.schedule_id, fault, case when fault is null and kind = 'interval' then {u} + interval 1 second * step::int else x end as next_run from c left join best using (schedule_id))"


@query(_patterns_sql(False))
def h40_next_run_by_row(t):
    return N.with_next_run(N.compiled(t("patterns")), "at_time_utc").select("schedule_id", "fault", "next_run")


@query(_patterns_sql(True))
def h46_latest_slot(t):
    behind = t("patterns").withColumn("first_due", F.col("at_time_utc") - F.make_dt_interval(F.expr("cast(schedule_id % 900 as int)")))
    return N.with_latest_slot(N.compiled(behind), "first_due", "at_time_utc").select("schedule_id", "latest_slot")


@query("""select schedule_id, list_sum(list_transform(case month when '*' then range(1, 13) when 'feb' then [2] when 'Mar,nov' then [3, 11] when '3-11/4' then [3, 7, 11] when 'nov-mar' then [] else [2, 3, 4] end, lambda m: (1 << m)::bigint))::bigint as months,
    case when month = 'nov-mar' then 'ORDER' end as fault from patterns""")
def h42_terms(t):
    return t("patterns").select("schedule_id", N.term(F.col("month"), 1, 12, N.MONTHS).alias("x")).select("schedule_id", F.nullif(F.col("x.mask"), F.lit(0)).alias("months"), "x.fault")


@query(f"select * from (with {PATTERN_SQL} select coalesce(fault, 'OK') as fault, count(*) as n from c group by 1)")
def h43_schedule_faults(t):
    return N.compiled(t("patterns")).groupBy(F.coalesce("fault", F.lit("OK")).alias("fault")).agg(F.count("*").alias("n"))


@query("select schedule_id, next_run_at is null or next_run_at <= :now as due from schedules")
def h45_should_run(t):
    return t("schedules").select("schedule_id", H.should_run(F.col("next_run_at"), now()).alias("due"))


@query("select schedule_id, next_run_at + interval 1 minute * (5 * i)::int as slot from schedules, range(0, 4) r(i) where next_run_at + interval 1 minute * (5 * i)::int <= :now")
def h47_missed_slots(t):
    due = t("schedules").where("next_run_at is not null")
    return due.select("schedule_id", F.explode(H.missed_slots(F.col("next_run_at"), now(), 300, 4)).alias("slot"))


@query("""select task_id, case when queue_name = 'high' then least(5.0 * pow(2, retry_count), 30) else case least(retry_count + 1, 3) when 1 then 5.0 when 2 then 20.0 else 60.0 end end::double as delay from history""")
def h48_retry_delay(t):
    exponential = F.col("queue_name") == "high"
    steps = F.array(F.lit(5), F.lit(20), F.lit(60))
    return t("history").select("task_id", S.retry_delay(F.col("retry_count") + 1, steps, exponential, F.when(exponential, 30).otherwise(0)).alias("delay"))


@query("select event_id, greatest(100.0, least(30000.0, 50.0 * pow(2, event_id % 12)))::double as delay_ms from events")
def h49_reconnect_delay(t):
    return t("events").select("event_id", S.reconnect_delay_ms(F.col("event_id") % 12 + 1, 50, 30_000).alias("delay_ms"))


@query(f"select {BUDGET} as budget from ({ACCOUNT})")
def h50_capacity(t):
    return C.accounting(t("live"), CLAIM, now()).select("budget")


# ---- I: the batch side of streams


@query("""select topic, n > 100 as overflow, case when n > 100 then '' else ids end as ids from (
    select topic, count(*) as n, string_agg(user_id::varchar, ',' order by seq) as ids from (select case when event_id % 40 = 0 then 'workers' when event_id % 2 = 0 then 'tasks' else 'workflows' end as topic, user_id, min(event_id) as seq from events where event_id % 2 = 0 or user_id % 3 = 0 group by all) group by 1)""")
def i1_coalesced_ids(t):
    channel = F.when(F.col("event_id") % 40 == 0, "worker_changes").when(F.col("event_id") % 2 == 0, "task_changes").otherwise("workflow_changes")
    events = t("events").where("event_id % 2 = 0 or user_id % 3 = 0")
    out = I.coalesce(events.select(channel.alias("channel"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq")))
    return out.select("topic", "overflow", F.array_join("ids", ",").alias("ids"))


@query("""select '{"topic":"' || topic || '","ids":[' || case when n > 100 then '' else ids end || ']}' as frame from (select topic, count(*) as n, string_agg('"' || user_id || '"', ',' order by seq) as ids
    from (select case when event_id % 2 = 0 then 'tasks' else 'workers' end as topic, user_id, min(event_id) as seq from events where event_id % 2 = 0 or user_id % 3 = 0 group by all) group by 1)""")
def a19_frames(t):
    events = t("events").where("event_id % 2 = 0 or user_id % 3 = 0")
    made = [I.notifications(events.where(f"event_id % 2 = {k}"), channel, "user_id", "event_id") for k, channel in enumerate(("task_changes", "worker_changes"))]
    return I.frames(I.coalesce(made[0].unionByName(made[1])))


@query("select 'task_changes' as channel, task_id::varchar as id, task_id as seq from live union all select 'workflow_changes', id::varchar, id from workflows where status = 'PAUSED'")
def a11_notifications(t):
    return I.notifications(t("live"), "task_changes", "task_id").unionByName(I.notifications(t("workflows").where("status = 'PAUSED'"), "workflow_changes", "id"))


@query("""select task_id, row_number() over (order by rn) as nth from (select task_id, min(rn) as rn from (
    select task_id, row_number() over (order by priority, enqueued_at, task_id) * 2 as rn from live where status = 'PENDING' union all select task_id, row_number() over (order by enqueued_at, task_id) * 2 + 1 from live where status = 'PENDING' and queue_name = 'high') group by 1)""")
def d24_dispatch_order(t):
    waiting = t("live").where("status = 'PENDING'")
    arm = lambda rows, shift, *order: M.places(rows.select("task_id", *(c for c in order if c != "task_id")), *order).select("task_id", (F.col("nth") * 2 + shift).alias("rn"))
    arms = arm(waiting, 0, "priority", "enqueued_at", "task_id").unionByName(arm(waiting.where("queue_name = 'high'"), 1, "enqueued_at", "task_id"))
    return M.places(C.best_places(arms), "rn", "task_id").select("task_id", "nth")


@query("select date_trunc('day', ts)::timestamp as bucket, count(*) as n from events group by 1")
def i3_daily_buckets(t):
    return t("events").groupBy(F.window(F.col("ts"), "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "n")


@query("select id, created_at from workflows where (created_at > timestamp '1995-03-01' or (created_at = timestamp '1995-03-01' and id > 0)) and (created_at < timestamp '1997-06-30' or (created_at = timestamp '1997-06-30' and id <= 4000)) order by created_at, id limit 300")
def i4_cycle_bound(t):
    """A page of a cycle that keeps the bound it began with, whatever comes in meanwhile."""
    begun, bound = (datetime(1995, 3, 1), 0), (datetime(1997, 6, 30), 4000)
    return M.after(t("workflows"), begun, bound, 300).select("id", "created_at")


@query("select task_id from live where good_until <= :now and started_at is null")
def i5_late_tasks(t):
    return I.late(t("live"), now())[1].select("task_id")


@query("select task_id, 'LIVE' as location from live union all select task_id, 'HISTORY' from history")
def i6_two_pass_lookup(t):
    return A.locate(t("live"), t("history"), t("events").select(F.col("event_id").alias("task_id")))


STALE = "select t.* from tasks t left join (select task_id, max(sent_at) as last_beat from heartbeats where role = 'runner' group by 1) h using (task_id) where status = 'RUNNING' and coalesce(last_beat, started_at) < :now - interval 300 second and (finalizing_at is null or finalizing_at < :now - interval 60 second)"


@query(f"select task_id, case when retry_count < max_retries then 'PENDING' else 'FAILED' end as status, case when retry_count >= max_retries then 'WORKER_CRASHED' end as error_code from ({STALE})")
def i7_liveness_timeout(t):
    return K.fail_stale(t("live"), t("heartbeats"), now())


@query("select task_id, claim_expires_at + interval 60 second as renewed from tasks where status = 'CLAIMED' and claim_expires_at > :now")
def i8_lease_renewal(t):
    return t("live").where((F.col("status") == "CLAIMED") & (F.col("claim_expires_at") > now())).select("task_id", (F.col("claim_expires_at") + F.make_dt_interval(secs=F.lit(60))).alias("renewed"))


@query("""select r.key_id, case when h.key_id is null then 'APPLIED' when h.fingerprint = r.fingerprint then 'REPLAY' else 'CONFLICT' end as outcome
    from (select user_id as key_id, min(event_id) % 9 as fingerprint from events group by 1) r left join (select * from reservations where disposition = 'LIVE' or expires_at > timestamp '2024-01-04') h using (key_id)""")
def i9_reservations(t):
    asked = t("events").groupBy(F.col("user_id").alias("key_id")).agg((F.min("event_id") % 9).alias("fingerprint"))
    return K.reserve(asked, t("reservations"), F.lit("2024-01-04 00:00:00").cast("timestamp_ntz"))


@query("select key_id, expires_at from reservations where disposition = 'TERMINAL' and expires_at <= :now order by expires_at, key_id limit 25")
def i10_expired_reservations(t):
    return K.expired_reservations(t("reservations"), now(), 25).select("key_id", "expires_at")


@query("select task_id, next_retry_at from tasks where status = 'PENDING' and next_retry_at <= :now")
def i11_due_retries(t):
    return t("live").where((F.col("status") == "PENDING") & (F.col("next_retry_at") <= now())).select("task_id", "next_retry_at")


def _moves(moves: dict, a: str, b: str) -> str:
    return " or ".join(f"({a} = '{k}' and {b} in ({', '.join(repr(x) for x in v)}))" for k, v in moves.items())


def _replay_sql(key: str, seq: str, expr: str, table: str, moves: dict) -> str:
    return f"select k, arg_max(s, q) as status, count(*) filter (p is not null and not ({_moves(moves, 'p', 's')})) as illegal from (select *, lag(s) over (partition by k order by q) as p from (select {key} as k, {seq} as q, {expr} as s from {table})) group by 1"


TASK_STEP = "case (user_id + event_id) % 4 when 0 then 'PENDING' when 1 then 'CLAIMED' when 2 then 'RUNNING' else 'COMPLETED' end"
FLOW_STEP = "case o_orderkey % 3 when 0 then 'RUNNING' when 1 then 'PAUSED' else 'COMPLETED' end"


@query(_replay_sql("user_id", "event_id", TASK_STEP, "events", TASK_MOVES))
def i12_task_states(t):
    return K.replay(t("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("q"), F.expr(TASK_STEP).alias("s")), TASK_MOVES, "k", "q", "s")


@query(_replay_sql("o_custkey", "o_orderkey", FLOW_STEP, "orders", WORKFLOW_MOVES))
def i13_workflow_states(t):
    return K.replay(t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("q"), F.expr(FLOW_STEP).alias("s")), WORKFLOW_MOVES, "k", "q", "s")


@query(_replay_sql("workflow_id", "task_index", "status", "nodes", NODE_MOVES))
def i14_node_states(t):
    return K.replay(t("nodes").select(F.col("workflow_id").alias("k"), F.col("task_index").alias("q"), F.col("status").alias("s")), NODE_MOVES, "k", "q", "s")


@query("select 'task_changes' as channel, task_id::varchar as id from history where status = 'FAILED'")
def i16_notifications(t):
    return I.notifications(t("history").where("status = 'FAILED'"), "task_changes", "task_id").select("channel", "id")


# ---- J: graphs

JOINS = f"select n.workflow_id, n.task_index, {ACTION} as action from nodes n join workflows w on w.id = n.workflow_id and w.status = 'RUNNING' join ({DEPS}) d on d.workflow_id = n.workflow_id and d.task_index = n.task_index where n.status = 'PENDING'"


@query(JOINS)
def j1_join_evaluation(t):
    return J.evaluate_joins(t("nodes"), t("edges"), t("workflows"))


def _cascade_sql(levels: int) -> str:
    """The cascade level by level; a workflow of the fixture has at most seven nodes."""
    steps = ["s0 as (select * from nodes)"]
    for k in range(1, levels + 1):
        deps = DEPS.replace("nodes d", f"s{k - 1} d")
        skip = f"select n.workflow_id, n.task_index from s{k - 1} n join workflows w on w.id = n.workflow_id and w.status = 'RUNNING' join ({deps}) d on d.workflow_id = n.workflow_id and d.task_index = n.task_index where n.status = 'PENDING' and {ACTION} = 'SKIP'"
        steps.append(f"s{k} as (select n.* replace (case when x.workflow_id is not null then 'SKIPPED' else n.status end as status) from s{k - 1} n left join ({skip}) x on x.workflow_id = n.workflow_id and x.task_index = n.task_index)")
    return f"select * from (with {', '.join(steps)} select workflow_id, task_index, status from s{levels})"


@query(_cascade_sql(7))
def j2_skip_cascade(t):
    return J.skip_cascade(t("nodes"), t("edges"), t("workflows")).select("workflow_id", "task_index", "status")


@query(f"select w.id, count(*) filter (n.{OPEN}) as open_nodes from workflows w join nodes n on n.workflow_id = w.id where w.status = 'RUNNING' group by 1 having open_nodes = 0")
def j3_completion(t):
    done = J.finished_workflows(t("workflows"), t("nodes"))
    return done.select("id", F.lit(0).cast("long").alias("open_nodes"))


@query("select workflow_id, count(*) filter (status = 'FAILED') = 0 as succeeded from nodes group by 1")
def j4_default_success(t):
    return J.success(t("nodes")).select("workflow_id", "succeeded")


@query("""select workflow_id, h or x as succeeded, case when h then 'head' when x then 'tail' end as met_case from (
    select workflow_id, count(*) filter (status = 'COMPLETED' and task_index in (0, 1)) = 2 as h, count(*) filter (status = 'COMPLETED' and task_index = 2) = 1 as x from nodes group by 1)""")
def j5_success_cases(t):
    return J.success(t("nodes"), CASES)


@query("""select * from (select w.id as workflow_id, n.result from workflows w join nodes n on n.workflow_id = w.id and n.task_index = 0 where output_index is not null union all
    select n.workflow_id, '{' || string_agg('"' || node_id || '":' || coalesce('"' || result || '"', 'null'), ',' order by node_id) || '}' from nodes n join workflows w on w.id = n.workflow_id and output_index is null
    where not exists (select 1 from edges e where e.workflow_id = n.workflow_id and e.dep = n.task_index) group by 1)""")
def j6_final_result(t):
    return J.final_result(t("workflows"), t("nodes"), t("edges"))


@query("select workflow_id, arg_min(node_id, task_index) as node_id from nodes where status = 'FAILED' group by 1")
def j7_failure_error(t):
    first = J.first_failed(t("nodes"))
    return t("nodes").join(first, ["workflow_id", "task_index"]).select("workflow_id", "node_id")


@query("""select * from (with recursive bad as (select w.id, w.on_error, (select arg_min(n.error, n.task_index) from nodes n where n.workflow_id = w.id and n.status = 'FAILED') as error from workflows w where w.status = 'RUNNING'
        and exists (select 1 from nodes n where n.workflow_id = w.id and n.status = 'FAILED')),
    tree as (select id from bad where on_error = 'pause' union select c.id from workflows c join tree t on c.parent_id = t.id)
    select w.id, case when t.id is not null then 'PAUSED' else 'RUNNING' end as status, b.error from workflows w left join bad b using (id) left join tree t using (id) where w.status = 'RUNNING' and (b.id is not null or t.id is not null))""")
def j8_failure_policy(t):
    return J.failure_policy(t("workflows"), t("nodes"))


@query("select n.node_key, case when s.failed > 0 then 'FAILED' else 'COMPLETED' end as status, s.total from nodes n join workflows w on w.id = n.sub_workflow_id and w.status = 'COMPLETED' join (select workflow_id, count(*) as total, count(*) filter (status = 'FAILED') as failed from nodes group by 1) s on s.workflow_id = w.id")
def j9_child_completion(t):
    done = t("workflows").where("status = 'COMPLETED'").select(F.col("id").alias("sub_workflow_id"))
    children = J.child_summary(t("nodes")).select(F.col("workflow_id").alias("sub_workflow_id"), "total", "failed")
    return t("nodes").join(done, "sub_workflow_id").join(children, "sub_workflow_id").select("node_key", F.when(F.col("failed") > 0, "FAILED").otherwise("COMPLETED").alias("status"), "total")


@query("""select * from (
    with recursive w as (select id, name, case when id % 50 = 17 then 42 else output_index end as output_index from workflows where id % 50 < 40 union all select -1, '', null),
    n as (select * from plan_nodes where workflow_id in (select id from w)), e as (select distinct * from plan_edges where workflow_id in (select id from w)),
    size as (select workflow_id, count(*) as n from n group by 1), deps as (select workflow_id, task_index, count(*) as deps from e group by 1, 2),
    link as (select e.* from e join n t on t.workflow_id = e.workflow_id and t.task_index = e.dep),
    reach as (select workflow_id, task_index as a, dep as b from link union select r.workflow_id, r.a, l.dep from reach r join link l on l.workflow_id = r.workflow_id and l.task_index = r.b),
    counted as (select n.*, coalesce(deps, 0) as deps from n left join deps using (workflow_id, task_index))
    select id as workflow_id, null::bigint as task_index, 'NAME' as fault from w where name = ''
    union all select id, null, 'EMPTY' from w where id not in (select workflow_id from n)
    union all select workflow_id, null, 'NO_ROOT' from counted group by workflow_id having min(deps) > 0
    union all select id, null, 'OUTPUT' from w left join size on workflow_id = id where output_index >= coalesce(n, 0)
    union all select distinct workflow_id, null::bigint, 'CIRCLE' from reach where a = b
    union all select workflow_id, task_index, 'ID_INVALID' from n where not regexp_full_match(node_id, '[A-Za-z0-9_:.-]{1,128}')
    union all select workflow_id, task_index, 'ID_TWICE' from n where node_id = 'same' and task_index > 0
    union all select workflow_id, task_index, 'JOIN' from n where join_type = 'most'
    union all select workflow_id, task_index, 'QUORUM' from counted where case when join_type = 'quorum' then min_success is null or min_success not between 1 and deps else min_success is not null end
    union all select e.workflow_id, task_index, 'RANGE' from e join size using (workflow_id) where dep not between 0 and n - 1
    union all select workflow_id, task_index, 'SELF' from e where dep = task_index)""")
def j10_spec_faults(t):
    spark = t("workflows").sparkSession
    flows = t("workflows").where("id % 50 < 40").select("id", "name", F.when(F.col("id") % 50 == 17, 42).otherwise(F.col("output_index")).alias("output_index"))
    return G.spec_faults(flows.unionByName(spark.range(1).select((-F.col("id") - 1).alias("id"), F.lit("").alias("name"), F.lit(None).cast("int").alias("output_index"))), t("plan_nodes"), t("plan_edges"))


@query("""select * from (with recursive up as (select id as start, parent_id as at, name, definition_key as k, 1 as level from workflows where parent_id is not null
        union all select u.start, w.parent_id, u.name, u.k, u.level + 1 from up u join workflows w on w.id = u.at where w.parent_id is not null)
    select start, arg_min(w.id, level) as ancestor from up u join workflows w on w.id = u.at where case when u.k is not null and w.definition_key is not null then u.k = w.definition_key else u.name = w.name end group by 1)""")
def j11_cycle_refusal(t):
    starts = t("workflows").where("parent_id is not null").select(F.col("id").alias("start"), "parent_id", "name", "definition_key")
    return J.refused_starts(starts, t("workflows"))


@query("select * from (with recursive tree as (select id, 0 as level from workflows where id = 4 union all select c.id, t.level + 1 from workflows c join tree t on c.parent_id = t.id) select w.id, case when t.id is not null and status = 'RUNNING' then 'PAUSED' else status end as status, case when t.id is null then 'UNTOUCHED' when status = 'RUNNING' then 'APPLIED' else 'REFUSED' end as outcome from workflows w left join tree t using (id))")
def j12_pause_tree(t):
    return K.move_tree(t("workflows"), J.descendants(t("workflows"), 4), "PAUSED", ["RUNNING"])


@query(f"select n.workflow_id, n.task_index, {ACTION} as action from nodes n join workflows w on w.id = n.workflow_id and w.status = 'PAUSED' join ({DEPS}) d on d.workflow_id = n.workflow_id and d.task_index = n.task_index where n.status = 'PENDING'")
def j13_resume(t):
    resumed = t("workflows").where("status = 'PAUSED'").withColumn("status", F.lit("RUNNING"))
    return J.evaluate_joins(t("nodes"), t("edges"), resumed)


@query(f"""select 'unblocked' as kase, count(*) as n from nodes n join workflows w on w.id = n.workflow_id and w.status = 'RUNNING' where n.status = 'PENDING' and not exists (select 1 from edges e join nodes d on d.workflow_id = e.workflow_id and d.task_index = e.dep where e.workflow_id = n.workflow_id and e.task_index = n.task_index and d.{OPEN})
    union all select 'ready', count(*) from nodes n join workflows w on w.id = n.workflow_id and w.status = 'RUNNING' where n.status = 'READY'
    union all select 'child done', count(*) from nodes n join workflows w on w.id = n.workflow_id and w.status = 'RUNNING' join workflows c on c.id = n.sub_workflow_id and c.status = 'COMPLETED' where n.{OPEN}
    union all select 'finished', count(*) from workflows w where status = 'RUNNING' and exists (select 1 from nodes n where n.workflow_id = w.id) and not exists (select 1 from nodes n where n.workflow_id = w.id and {OPEN})
    union all select 'empty', count(*) from workflows w where status = 'RUNNING' and not exists (select 1 from nodes n where n.workflow_id = w.id)""")
def j14_recovery_cases(t):
    n, e, w = t("nodes"), t("edges"), t("workflows")
    running = w.where("status = 'RUNNING'").select(F.col("id").alias("workflow_id"))
    done = w.where("status = 'COMPLETED'").select(F.col("id").alias("sub_workflow_id"))
    cases = {
        "unblocked": J.ready_by_dependencies(n, e).join(running, "workflow_id", "left_semi"), "ready": n.where("status = 'READY'").join(running, "workflow_id", "left_semi"),
        "child done": J.unfinished(n).join(running, "workflow_id", "left_semi").join(done, "sub_workflow_id", "left_semi"), "finished": J.finished_workflows(w, n), "empty": J.empty_workflows(w, n),
    }
    out = None
    for name, rows in cases.items():
        one = rows.agg(F.lit(name).alias("kase"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select n.workflow_id, n.task_index, n.status, (select string_agg(dep::varchar, ',' order by dep) from edges e where e.workflow_id = n.workflow_id and e.task_index = n.task_index) as deps, s.total as child_total from nodes n left join (select workflow_id, count(*) as total from nodes group by 1) s on s.workflow_id = n.sub_workflow_id")
def j15_run_detail(t):
    nodes = t("nodes")
    deps = t("edges").groupBy("workflow_id", "task_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("dep").cast("long"))), lambda x: x.cast("string")), ",").alias("deps"))
    children = J.child_summary(t("nodes")).select(F.col("workflow_id").alias("sub_workflow_id"), F.col("total").alias("child_total"))
    rows = nodes.join(deps, ["workflow_id", "task_index"], "left").select("workflow_id", "task_index", "status", "deps", "sub_workflow_id")
    return left_by_key(rows, children, "sub_workflow_id", "workflow_id", "task_index").select("workflow_id", "task_index", "status", "deps", "child_total")


OUTBOX = """select a.task_id, case when o.task_id is null then case when l.s in ('COMPLETED', 'FAILED', 'SKIPPED') then 'ALREADY_APPLIED' else 'PENDING_ABSENT' end
    when w.id is null or n.node_key is null then 'SOURCE_STATE_CONFLICT' when w.status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED') then 'SUPERSEDED_BY_WORKFLOW_TERMINAL' when h.task_id is null then 'SOURCE_ABSENT'
    when o.version <> 1 then 'SOURCE_VERSION_CONFLICT' when o.digest <> 'd' || h.task_id then 'SOURCE_DIGEST_MISMATCH' when n.status in ('COMPLETED', 'FAILED', 'SKIPPED') then 'ALREADY_APPLIED' else 'APPLIED_TO_NODE' end as verdict
    from (select task_id from tasks) a left join outbox o using (task_id) left join workflows w on w.id = o.workflow_id left join nodes n on n.node_key = o.node_key
    left join (select task_id, arg_min(status, node_key) as s from nodes group by 1) l on l.task_id = a.task_id left join (select task_id from history where task_id % 31 <> 0) h on h.task_id = a.task_id"""


@query(OUTBOX)
def j16_outbox_verdicts(t):
    return K.outbox_verdicts(t("tasks").select("task_id"), t("outbox"), t("workflows"), t("nodes"), t("history").where("task_id % 31 <> 0"))


@query("select task_id, attempt_count >= 4 as quarantined from outbox")
def j17_quarantine(t):
    left, gone = K.quarantine(t("outbox"), 4)
    return left.select("task_id", F.lit(False).alias("quarantined")).unionByName(gone.select("task_id", F.lit(True).alias("quarantined")))


# ---- K: state changes

ENDED = "case when h.task_id is null then 'TASK_ABSENT' when h.kind = '{kind}' then 'ALREADY_APPLIED' else 'SOURCE_STATE_CONFLICT' end"


def _end_sql(kind: str, source: str, to: str) -> str:
    return f"""select c.task_id, case when l.task_id is not null then case when l.status in ({source}) and l.worker_id is not distinct from c.by then 'APPLIED' when l.worker_id is distinct from c.by then 'LOST_CLAIM' else 'SOURCE_STATE_CONFLICT' end else {ENDED.format(kind=kind)} end as outcome,
        case when l.status in ({source}) and l.worker_id is not distinct from c.by then '{to}' end as status
        from (select event_id as task_id, 'worker-' || (user_id + (event_id % 5 = 0)::int) as by from events) c left join live l using (task_id) left join history h using (task_id)"""


def _commands(t):
    return t("events").select(F.col("event_id").alias("task_id"), F.concat(F.lit("worker-"), F.col("user_id") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).alias("by"))


@query("""select c.task_id, case when t.task_id is null then 'TASK_ABSENT' when t.status <> 'CLAIMED' or t.worker_id is distinct from c.by or (c.at is not null and t.claimed_at is distinct from c.at) then 'LOST_CLAIM' when t.claim_expires_at <= :now then 'LEASE_EXPIRED'
    when t.good_until <= :now then 'EXPIRED' when w.status in ('PAUSED', 'CANCELLED') then 'WORKFLOW_STOPPED' else 'RUNNING' end as outcome
    from (select event_id as task_id, 'worker-' || user_id as by, case when event_id % 4 <> 0 then ts + interval 1 second * (user_id + (event_id % 3 = 0)::int) end as at from events) c left join live t using (task_id) left join workflows w on w.id = t.workflow_id""")
def k2_start(t):
    claims = t("events").select(F.col("event_id").alias("task_id"), F.concat(F.lit("worker-"), F.col("user_id").cast("string")).alias("by"), F.expr("case when event_id % 4 <> 0 then ts + interval '1' second * (user_id + cast(event_id % 3 = 0 as int)) end").alias("at"))
    return K.start(claims, t("live"), t("workflows"), now())


@query(_end_sql("COMPLETE_LOCKED", "'RUNNING'", "COMPLETED"))
def k3_complete(t):
    return K.end(_commands(t), t("live"), t("history"), to="COMPLETED", kind="COMPLETE_LOCKED", source=["RUNNING"], as_of=now()).select("task_id", "outcome", "status")


@query(_end_sql("FAIL_RUNNING", "'RUNNING'", "FAILED"))
def k4_fail(t):
    return K.end(_commands(t), t("live"), t("history"), to="FAILED", kind="FAIL_RUNNING", source=["RUNNING"], as_of=now()).select("task_id", "outcome", "status")


@query(f"select count(*) as n, count(*) filter (retry_count >= max_retries) as failed from ({STALE})")
def k5_fail_stale(t):
    return K.fail_stale(t("live"), t("heartbeats"), now()).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query("select task_id, 'EXPIRED' as status, 'EXPIRE_CLAIMED' as kind from tasks where status = 'CLAIMED' and good_until <= :now")
def k6_expire_claimed(t):
    return K.expire_claimed(t("live"), now())


@query("select task_id, 'EXPIRED' as status, 'EXPIRE_PENDING' as kind from tasks where status = 'PENDING' and good_until <= :now order by good_until, task_id limit 500")
def k7_expire_pending(t):
    return K.expire_pending(t("live"), now(), 500)


@query(_end_sql("CANCEL_ADMIN", "'PENDING', 'CLAIMED'", "CANCELLED"))
def k8_cancel(t):
    return K.end(_commands(t), t("live"), t("history"), to="CANCELLED", kind="CANCEL_ADMIN", source=["PENDING", "CLAIMED"], as_of=now()).select("task_id", "outcome", "status")


@query("select task_id from live t where is_workflow_task and status in ('PENDING', 'CLAIMED') and task_id > 2000 and not exists (select 1 from nodes n where n.task_id = t.task_id and n.status in ('READY', 'ENQUEUED', 'RUNNING')) order by task_id limit 100")
def k9_cancel_orphans(t):
    return K.orphans(t("live"), t("nodes")).where("task_id > 2000").orderBy("task_id").limit(100).select("task_id")


@query("select t.task_id from tasks t join workflows w on w.id = t.workflow_id and w.status = 'PAUSED' where t.status = 'CLAIMED'")
def k10_abandon_paused(t):
    return K.stopped_claims(t("live"), t("workflows"), "PAUSED").select("task_id")


@query("select t.task_id from tasks t join workflows w on w.id = t.workflow_id and w.status = 'CANCELLED' where t.status = 'CLAIMED'")
def k11_cancel_of_stopped(t):
    return K.stopped_claims(t("live"), t("workflows"), "CANCELLED").select("task_id")


#: A text as a JSON string, and a row of attempts by position.
QUOTED = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
SNAPSHOT = "'[' || coalesce(string_agg('[' || attempt || ',\"' || outcome || '\",' || will_retry::varchar || ',' || epoch_us(started_at) || ',' || epoch_us(finished_at) || ',' || coalesce('\"' || error_code || '\"', 'null') || ',' || coalesce(" + QUOTED.format("error_message") + ", 'null') || ',null,\"' || worker_id || '\",\"host\",' || worker_pid || ',null]', ',' order by attempt), '') || ']'"


@query(f"""select t.task_id, t.task_name, t.queue_name, t.priority, 'COMPLETED' as status, 'COMPLETE_LOCKED' as kind, :now as terminal_at, :now as anchor, t.enqueued_at, t.started_at, t.created_at, t.retry_count, t.max_retries, t.worker_id, t.workflow_id,
        'done ' || t.task_id as result, null::varchar as error_code, null::varchar as failed_reason, sha256('done ' || t.task_id) as result_digest, coalesce(a.s, '[]') as attempts, sha256(coalesce(a.s, '[]')) as attempts_digest, true as deferred
    from tasks t left join (select task_id, {SNAPSHOT} as s from attempts group by 1) a using (task_id) where t.status = 'RUNNING'""")
def k12_move_to_history(t):
    ended = K.end(t("live").select("task_id", F.col("worker_id").alias("by")), t("live"), t("history"), to="COMPLETED", kind="COMPLETE_LOCKED", source=["RUNNING"], as_of=now())
    results = t("live").select("task_id", F.concat(F.lit("done "), "task_id").alias("result"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("failed_reason"))
    return K.to_history(ended, t("live"), t("attempts"), results)


@query(f"""select t.task_id, t.task_name, t.queue_name, t.priority, fingerprint_version, fingerprint, case t.status when 'RUNNING' then 'FAILED' else 'CANCELLED' end as status, case t.status when 'RUNNING' then 'FAIL_RUNNING' else 'CANCEL_ADMIN' end as kind, :now as terminal_at, :now as anchor, i.class_key, i.sent_at, t.enqueued_at, t.claimed_at, t.started_at, t.created_at, t.good_until,
        case when result is not null then 1 end as result_version, case when result is not null then 'json-utf8' end as result_codec, case when result is not null then 'application/json' end as result_content_type, case when t.status = 'RUNNING' then result end as result_payload, case when t.status <> 'RUNNING' then result end as prior_payload, sha256(result) as result_digest,
        i.error_code, i.failed_reason, t.retry_count, t.max_retries, t.worker_id, worker_hostname, worker_pid, worker_process_name, input_digest, rerun_of, rerun_root, t.workflow_id, t.is_workflow_task, 1 as row_version, 1 as attempts_version, 'json-utf8' as attempts_codec, 'application/json' as attempts_content_type, coalesce(a.s, '[]') as attempts, sha256(coalesce(a.s, '[]')) as attempts_digest,
        case when t.is_workflow_task then 'NEVER_ELIGIBLE' when not retain_input then 'DECLINED_BY_POLICY' when prepared is not null then 'INLINE' end as rerun_disposition, case when rerun_disposition = 'INLINE' then 1 end as rerun_version, case when rerun_disposition = 'INLINE' then 'json-utf8' end as rerun_codec, case when rerun_disposition = 'INLINE' then 'application/json' end as rerun_content_type,
        case when rerun_disposition = 'INLINE' then prepared_digest end as rerun_digest, case when rerun_disposition = 'INLINE' then prepared end as rerun_input, t.status = 'RUNNING' and t.is_workflow_task as deferred
    from tasks t join inputs i using (task_id) left join (select task_id, {SNAPSHOT} as s from attempts group by 1) a using (task_id) where t.status in ('RUNNING', 'CLAIMED')""")
def k12_archive_rows(t):
    """Running tasks fail, claimed ones are cancelled by an administrator; all columns of their archive rows."""
    asked = lambda status: t("live").where(F.col("status") == status).select("task_id", F.col("worker_id").alias("by"))
    failed = K.end(asked("RUNNING"), t("live"), t("history"), to="FAILED", kind="FAIL_RUNNING", source=["RUNNING"], as_of=now())
    gone = K.end(asked("CLAIMED"), t("live"), t("history"), to="CANCELLED", kind="CANCEL_ADMIN", source=["CLAIMED"], as_of=now())
    return K.archive_rows(failed.unionByName(gone), t("live"), t("attempts"), t("inputs"))


@query(f"select task_id, {SNAPSHOT} as snapshot from attempts group by 1")
def h11_snapshots(t):
    return t("attempts").groupBy("task_id").agg(P.encode(F.collect_list(F.struct(*P.FIELDS))).alias("snapshot"))


@query(f"""select a.task_id, case when a.task_id % 10 = 1 then 'DIGEST_MISMATCH' when a.task_id % 10 = 2 then 'NOT_JSON' when a.task_id % 10 = 3 then 'FIELD_COUNT' when a.task_id % 10 = 4 then 'NOT_CONTIGUOUS' when a.task_id % 10 = 5 then 'MISSING' end as fault,
    case when a.task_id % 10 not in (1, 2, 3, 4, 5) then string_agg(coalesce(error_message, '-'), ';' order by attempt) end as messages from attempts a group by 1""")
def h12_decoded_snapshots(t):
    made = h11_snapshots(t)
    last = F.col("task_id") % 10
    text = (F.when(last == 2, F.concat(F.lit("x"), "snapshot")).when(last == 3, F.replace("snapshot", F.lit(",null]"), F.lit("]"))).when(last == 4, F.replace("snapshot", F.lit("[[1,"), F.lit("[[7,")))
            .when(last == 5, F.lit(None)).otherwise(F.col("snapshot")))
    rows = made.select("task_id", text.alias("text"), F.when(last == 1, "0").alias("digest"))
    rows = rows.withColumn("fault", P.fault(F.col("text"), F.col("digest")))
    messages = F.array_join(F.transform(P.decode(F.col("text")), lambda a: F.coalesce(a["error_message"], F.lit("-"))), ";")
    return rows.select("task_id", "fault", F.when(F.col("fault").isNull(), messages).alias("messages"))


@query("select c.task_id, case when l.task_id is not null then case when l.worker_id is distinct from c.by then 'LOST_CLAIM' else 'SOURCE_STATE_CONFLICT' end when h.task_id is null then 'TASK_ABSENT' when h.kind in ('FAIL_RUNNING', 'FAIL_STALE') then 'ALREADY_APPLIED' else 'SOURCE_STATE_CONFLICT' end as outcome from (select event_id * 2 as task_id, 'worker-1' as by from events) c left join live l using (task_id) left join history h using (task_id)")
def k13_miss(t):
    asked = t("events").select((F.col("event_id") * 2).alias("task_id"), F.lit("worker-1").alias("by"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return K.miss(asked, t("live"), t("history"), ["FAIL_RUNNING", "FAIL_STALE"])


@query("select task_id, 'PENDING' as status, retry_count + 1 as retry_count, :now + interval 90 second as next_retry_at from tasks where status = 'RUNNING' and retry_count < max_retries and (good_until is null or :now + interval 90 second < good_until)")
def k14_requeue(t):
    return K.requeue(t("live"), F.lit(90), now())


@query("select task_id, 'PENDING' as status, cast(null as varchar) as worker_id from tasks where status = 'CLAIMED' and (claim_expires_at < :now or (claim_expires_at is null and claimed_at < :now - interval 3600 second))")
def k15_requeue_stale(t):
    return K.requeue_stale_claims(t("live"), now(), 3600)


@query(f"select id, status from workflows where id not in (select id from ({DELETABLE}))")
def k16_retention_delete(t):
    old = L.deletable(t("workflows"), t("nodes"), t("live"), now(), 24 * 30)
    return A.delete(t("workflows").select("id", "status"), L.within_budget(old, t("nodes"), 500), "id")


@query("select snapshot_id from worker_states where snapshot_at < :now - interval 20 day order by snapshot_id limit 1000")
def k17_old_snapshots(t):
    return t("worker_states").where(F.col("snapshot_at") < now() - F.make_dt_interval(F.lit(20))).orderBy("snapshot_id").limit(1000).select("snapshot_id")


@query("select task_id as rerun_of, kind as rerun_of_kind, queue_name, 'PENDING' as status from history where task_id in (100, 200, 300, 400, 555)")
def k18_rerun(t):
    return K.rerun(t("history"), [100, 200, 300, 400, 555], now()).select("rerun_of", "rerun_of_kind", "queue_name", "status")


RERUN_NAMES = "t::varchar || ':2024-01-31T00:00:00.000000'"


@query(f"""select t as rerun_of, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || case when substr(h, 17, 1) in ('0', '4', '8', 'c') then '8' when substr(h, 17, 1) in ('1', '5', '9', 'd') then '9' when substr(h, 17, 1) in ('2', '6', 'a', 'e') then 'a' else 'b' end || substr(h, 18, 3) || '-' || substr(h, 21, 12) as task_id
    from (select t, sha1(unhex('{K.RERUNS.hex}') || ({RERUN_NAMES})::blob) as h from (select task_id as t from history where task_id in (100, 200, 300, 400, 555)))""")
def k18_rerun_ids(t):
    return K.rerun(t("history"), [100, 200, 300, 400, 555], now()).select("rerun_of", "task_id")


#: Configurations of workers as JSON, made from nations.
QUEUES_JSON = """case when n_nationkey % 8 = 7 then 'none' else concat('[{"name":"', n_name, '","priority":', n_nationkey % 9, ',"cap":', n_regionkey + 1, '},{"name":"high"},{"cap":3},{"name":"low","cap":', n_nationkey, '}]') end"""
ORDER_JSON = """concat('{"queues":["low","', n_name, '","high","bulk"],"priority":{', case when n_nationkey % 3 = 0 then '' else concat('"high":', n_nationkey % 5, ',"', n_name, '":', n_regionkey) end, '},"caps":{"bulk":', n_nationkey, '}}')"""


@query("""select n_nationkey as worker, n_name as queue_name, n_nationkey % 9 as queue_priority, n_regionkey + 1 as cap from nation where n_nationkey % 8 <> 7 union all select n_nationkey, 'high', 100, null from nation where n_nationkey % 8 <> 7
    union all select n_nationkey, 'low', 100, n_nationkey from nation where n_nationkey % 8 <> 7""")
def a10_queues_from_json(t):
    return C.queues_from_json(t("nation").select(F.col("n_nationkey").alias("worker"), F.expr(QUEUES_JSON).alias("config")), "worker", "config")


@query("""select worker, queue_name, row_number() over (partition by worker order by p, pos) as place from (
    select n_nationkey as worker, unnest(['low', n_name, 'high', 'bulk']) as queue_name, unnest([1, 2, 3, 4]) as pos, unnest(case when n_nationkey % 3 = 0 then [0, 0, 0, 0] else [null, n_regionkey, n_nationkey % 5, 100] end) as p from nation) where p is not null""")
def f12_queue_order(t):
    return C.ordered_queues(t("nation").select(F.col("n_nationkey").alias("worker"), F.expr(ORDER_JSON).alias("config")), "worker", "config")


SINCE, UNTIL = "case when event_id % 3 = 0 then ts - interval '1' hour * cast(event_id % 800 as int) end", "case when event_id % 4 <> 0 then ts + interval '1' day * cast(event_id % 5 - 1 as int) end"


@query(f"""select event_id, lower, upper, case when lower >= upper then 'EMPTY' when upper - lower > interval 30 day then 'TOO_LONG' end as fault from (select event_id, coalesce(since, coalesce(until, :now) - interval 24 hour) as lower, coalesce(until, :now) as upper from (select event_id, {SINCE} as since, {UNTIL} as until from events))""")
def b7_windows(t):
    return t("events").select("event_id", B.window_of(F.expr(SINCE), F.expr(UNTIL), now()).alias("w")).select("event_id", "w.*")


@query("select event_id, event_id % 210 between 1 and 200 and event_id % 450 - 1 >= 0 and event_id % 450 - 1 + event_id % 210 <= 500 as ok from events")
def b8_pages(t):
    return t("events").select("event_id", B.page_ok(F.col("event_id") % 210, F.col("event_id") % 450 - 1).alias("ok"))


@query("""select event_id, case when m > 0 then case when m // 86400000000 = 0 then '' when m // 86400000000 = 1 then '1 day, ' else m // 86400000000 || ' days, ' end || (m // 3600000000) % 24 || ':' || lpad(((m // 60000000) % 60)::varchar, 2, '0') || ':' || lpad(((m // 1000000) % 60)::varchar, 2, '0')
    || case when m % 1000000 = 0 then '' else '.' || lpad((m % 1000000)::varchar, 6, '0') end end as text from (select event_id, case when event_id % 9 = 0 then event_id * 1000000 else event_id * 61234567 end - 90000000 as m from events)""")
def h51_durations(t):
    micros = F.when(F.col("event_id") % 9 == 0, F.col("event_id") * 1_000_000).otherwise(F.col("event_id") * 61_234_567) - 90_000_000
    return t("events").select("event_id", S.duration_text(micros).alias("text"))


@query("""select * from (with p as (select c_custkey as workflow_id, (c_custkey % 4)::int as w from customer),
    parts as (select workflow_id, w, 0 as task_index, 'split' as node_id from p union all select workflow_id, w, 1 + n::int, 'load-' || n from p, range(0, 3) r(n) where n < w union all select workflow_id, w, 1 + w + n::int, 'check-' || n from p, range(0, 3) r(n) where n < w union all select workflow_id, w, 1 + 2 * w, 'merge' from p)
    select workflow_id, task_index, node_id, case when node_id like 'load%' then [0] when node_id like 'check%' then [task_index - w] when node_id = 'merge' then range(1 + w, 1 + 2 * w) || [0] else [] end::varchar as deps from parts)""")
def m4_built_workflows(t):
    parts = [G.Part("split"), G.Part("load", ("split",), "w"), G.Part("check", ("load",), "w", each=True), G.Part("merge", ("check", "split"))]
    nodes, edges = G.from_parameters(t("customer").select(F.col("c_custkey").alias("workflow_id"), (F.col("c_custkey") % 4).alias("w")), parts)
    listed = edges.groupBy("workflow_id", "task_index").agg(F.collect_list("dep").alias("deps"))
    order = F.array_sort(F.coalesce("deps", F.expr("cast(array() as array<int>)")))
    last = F.concat(F.filter(order, lambda d: d != 0), F.filter(order, lambda d: d == 0))
    return nodes.join(listed, ["workflow_id", "task_index"], "left").select("workflow_id", "task_index", "node_id", F.concat(F.lit("["), F.array_join(last.cast("array<string>"), ", "), F.lit("]")).alias("deps"))


@query("select event_id * 3 as task_id, case when t.status is null then 'NOT_FOUND' when t.status in ('PENDING', 'CLAIMED') then 'CANCELLED' when t.status = 'RUNNING' then 'REFUSED_RUNNING' else 'REFUSED_TERMINAL' end as outcome from events left join tasks t on t.task_id = event_id * 3")
def k19_cancel_action(t):
    return K.cancel_task(t("events").select((F.col("event_id") * 3).alias("task_id")), t("tasks"))


# ---- L: partitions


@query("select leaf_name, l.class_key, lower_anchor from leaves l join classes c using (class_key) where keep_days is not null and upper_anchor + interval 1 day * keep_days <= :now")
def l1_expired_leaves(t):
    return L.expired_leaves(t("leaves"), t("classes"), now())


@query(f"select leaf_name, lower_anchor from leaves where class_key = 'forever' and upper_anchor <= :now and leaf_name not in (select leaf_name from {IN_LEAF.replace('history h', '(select * from history where day(anchor) <> 9) h')}) order by 2, 1 limit 32")
def l2_empty_leaves(t):
    return L.empty_leaves(t("leaves"), t("history").where("day(anchor) <> 9"), now())


@query("select fault, count(*) as n from (select case when l.leaf_name is null then 'MISSING' when not verified then 'UNVERIFIED' else 'OK' end as fault from classes c, range(0, 30) r(d) left join leaves l on l.leaf_name = 'hist_' || c.class_key || '_' || d) group by 1")
def l3_coverage(t):
    want = L.expected_leaves(t("classes"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 30)
    return L.coverage_faults(want, t("leaves")).groupBy("fault").agg(F.count("*").alias("n"))


LEAF_FAULT = "case when not relation_exists then 'NO_RELATION' when detach_pending is null then 'NOT_A_PARTITION' when detach_pending then 'DETACH_AWAITING_FINALIZE' when actual_bound is distinct from cataloged_bound or not id_index_exists then 'BOUND_OR_INDEX' end"


@query(f"select class_key, leaf_name, {LEAF_FAULT} as fault from leaves where {LEAF_FAULT} is not null")
def l4_leaf_faults(t):
    return L.leaf_faults(t("leaves"))


@query(f"""select *, case when class_key = 'forever' then coalesce(covered_until < timestamp '2024-01-20' + interval 2 day, true) else future < 2 end as below_floor from (
    select c.class_key, count(l.leaf_name) as attached, max(l.upper_anchor) as covered_until, count(*) filter (l.lower_anchor >= timestamp '2024-01-20') as future, count(*) filter (blockers > 0) as blocked,
        count(*) filter (blockers = 0 and keep_days is not null and l.upper_anchor + interval 1 day * keep_days <= timestamp '2024-01-20') as detachable, (select count(*) from leaves f where f.class_key = c.class_key and {LEAF_FAULT} is not null) as faults
    from classes c left join (select *, (select count(*) from outbox o where o.history_class = leaves.class_key and o.history_anchor >= lower_anchor and o.history_anchor < upper_anchor) as blockers from leaves where {LEAF_FAULT} is null) l using (class_key) group by c.class_key, keep_days)""")
def l4_partition_health(t):
    return L.health(t("leaves"), t("classes"), L.blockers(t("outbox"), t("leaves")), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(f"""select * from (with cl as (select * from classes union all select 'legal', null), asked as (select unnest(['short', 'forever', 'legal', 'ghost']) as class_key),
    kept as (select cl.* from cl join asked using (class_key) where keep_days is not null or class_key = 'forever'),
    cover as (select k.class_key, keep_days, count(*) filter (lower_anchor >= timestamp '2024-01-26') as future, max(upper_anchor) as until from kept k left join (select * from leaves where {LEAF_FAULT} is null) l using (class_key) group by all)
    select class_key, null as leaf_name, 'CLASS_ABSENT' as fault from asked where class_key not in (select class_key from cl)
    union all select class_key, leaf_name, {LEAF_FAULT} from leaves join kept using (class_key) where {LEAF_FAULT} is not null
    union all select class_key, null, 'COVERAGE_BELOW_FLOOR' from cover where case when keep_days is not null then future < 2 else coalesce(until < timestamp '2024-01-26' + interval 2 day, true) end)""")
def l4_health_faults(t):
    spark = t("leaves").sparkSession
    classes = t("classes").unionByName(spark.range(1).select(F.lit("legal").alias("class_key"), F.lit(None).cast("int").alias("keep_days")))
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, ("short", "forever", "legal", "ghost")))).alias("class_key"))
    return L.health_faults(asked, t("leaves"), classes, L.blockers(t("outbox"), t("leaves")), F.lit("2024-01-26 00:00:00").cast("timestamp_ntz"))


@query("""select e.event_id as task_id, case when l.task_id is not null then 'LIVE' when h.task_id is null then null when e.event_id % 3 <> 0 and h.enqueued_at >= (select case when bool_and(verified) then min(min_birth_at) end from leaves f where f.class_key = h.class_key and f.leaf_name not like '%\\_5') then 'PRUNED' else 'FALLBACK' end as stage
    from events e left join live l on l.task_id = e.event_id left join (select * from history where task_id % 5 <> 0) h on h.task_id = e.event_id""".replace("bool_and(verified)", "bool_and(verified or class_key = 'short')"))
def l5_staged_lookup(t):
    asked = t("events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("born_at"))
    leaves = t("leaves").where("leaf_name not like '%\\_5'").withColumn("verified", F.expr("verified or class_key = 'short'"))
    return A.staged_lookup(asked, t("live"), t("history").where("task_id % 5 <> 0"), L.birth_floor(leaves)).select("task_id", "stage")


BORN = "case when event_id % 3 <> 0 then ts + interval 1 day * (case when event_id % 7 = 0 then 3 else 0 end)::int end"


@query(f"""select task_id, class_key, stage from (select e.event_id as task_id, case when l.task_id is null then h.class_key end as class_key, {BORN} as born,
        case when l.task_id is not null then 'LIVE' when h.task_id is null or born < timestamp '2024-01-03' then null when born is not null and date_trunc('day', anchor) >= date_trunc('day', born - interval 5 second) then 'PRUNED' else 'FALLBACK' end as stage
    from events e left join live l on l.task_id = e.event_id left join (select * from history where task_id % 5 <> 0) h on h.task_id = e.event_id) where true""".replace("select task_id, class_key, stage", "select task_id, case when stage <> 'LIVE' then class_key end as class_key, stage"))
def l5_archive_lookup(t):
    spark = t("events").sparkSession
    at = f"{Steps(spark).top}/archive"
    A.write_history(t("history").where("task_id % 5 <> 0").select("task_id", "class_key", "anchor").repartition("class_key", F.to_date("anchor")), at)
    born = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.make_dt_interval(F.when(F.col("event_id") % 7 == 0, 3).otherwise(0)))
    return A.archive_lookup(t("events").select(F.col("event_id").alias("task_id"), born.alias("born_at")), t("live"), spark.read.parquet(at), datetime(2024, 1, 3))


@query(f"select h.task_id, leaf_name from {IN_LEAF} where h.enqueued_at >= min_birth_at")
def l5_pruned_lookup(t):
    return L.in_leaf(t("history"), t("leaves")).where("enqueued_at >= min_birth_at").select("task_id", "leaf_name")


PAYLOAD = "concat(task_name, '/', queue_name)"


@query(f"""select * from (with with_batch as (select task_id, {PAYLOAD} as source, upper({PAYLOAD}) as payload from history where task_id > 50 order by task_id limit 400)
    select task_id, payload, sha256(source) as source_digest, sha256(payload) as digest from with_batch)""")
def l6_transcode_batch(t):
    rows = t("history").select("task_id", F.expr(PAYLOAD).alias("payload"))
    return L.transcode_batch(rows, 50, 400, F.upper("payload")).select("task_id", "payload", "source_digest", "digest")


@query(f"""select task_id, case when task_id % 7 = 1 then 'MISSING' when task_id % 7 = 2 then 'DIGEST' when task_id % 7 = 3 then 'CHANGED' end as fault from (select task_id from history where task_id > 50 order by task_id limit 400) where task_id % 7 in (1, 2, 3)
    union all select -1, 'EXTRA'""")
def l6_copy_faults(t):
    source = t("history").select("task_id", F.expr(PAYLOAD).alias("payload"))
    copy = L.transcode_batch(source, 50, 400, F.upper("payload"))
    batch = copy.select("task_id", F.col("source").alias("payload"))
    spoilt = F.when(F.col("task_id") % 7 == 3, "?").otherwise(F.col("payload"))
    digest = F.when(F.col("task_id") % 7 == 2, "?").otherwise(F.sha2(spoilt.cast("binary"), 256))
    bad = copy.where("task_id % 7 <> 1").select("task_id", spoilt.alias("payload"), digest.alias("digest"))
    bad = bad.unionByName(bad.limit(1).select(F.lit(-1).cast("long").alias("task_id"), "payload", "digest"))
    return L.verify_copy(batch, bad, F.lower("payload"))


@query("select task_id, 'result-' || task_id as payload, case when status = 'CANCELLED' then 'ADMINISTRATIVE_PRIOR' else 'CANONICAL' end as source from history union all select -task_id, null, 'NONE' from history where task_id % 100 = 0")
def l8_result_select(t):
    """What is read of an archived task: its result, or what it had put out before an administrator cancelled it."""
    rows = t("history").select("task_id", E.of_ended(F.concat(F.lit("result-"), F.col("task_id").cast("string")), F.col("status") == "CANCELLED").alias("e"))
    rows = rows.unionByName(rows.where("task_id % 100 = 0").select((-F.col("task_id")).alias("task_id"), F.struct(*(F.lit(None).cast("binary").alias(c) for c in ("canonical", "prior", "digest"))).alias("e")))
    return rows.select("task_id", E.selected(F.col("e.canonical"), F.col("e.prior")).alias("s")).select("task_id", F.col("s.payload").cast("string").alias("payload"), "s.source")


@query("""select task_id, case task_id % 8 when 1 then 'UNKNOWN_VERSION' when 2 then 'UNKNOWN_CODEC' when 3 then 'UNKNOWN_CONTENT_TYPE' when 4 then 'DIGEST_MISMATCH' when 5 then 'CORRUPT' end as fault,
    case when task_id % 8 in (0, 7) then '{"task":' || task_id || '}' end as result from history""")
def l8_envelopes(t):
    """Envelopes of results, some of them spoilt after they were written; a text that isn't JSON gets none."""
    n = F.col("task_id") % 8
    text = F.when(n != 6, F.concat(F.lit('{"task":'), F.col("task_id").cast("string"), F.lit("}"))).otherwise("{")
    e, bad = F.col("e"), F.lit("{").cast("binary")
    rows = t("history").select("task_id", E.encode(text).alias("e"))
    spoilt = (F.when(n == 1, e.withField("version", F.lit(2).cast("smallint"))).when(n == 2, e.withField("codec", F.lit("row-v1"))).when(n == 3, e.withField("content_type", F.lit("text/plain")))
              .when(n == 4, e.withField("digest", F.lit("?").cast("binary"))).when(n == 5, e.withField("payload", bad).withField("digest", F.unhex(F.sha2(bad, 256)))).otherwise(e))
    return rows.select("task_id", spoilt.alias("e")).select("task_id", E.fault(F.col("e")).alias("fault"), E.decode(F.col("e")).alias("result"))
