"""The lifecycle tables that the queries run on, projected from the star schema. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

#: {name} is a table or another projection, <k> the number in an event's properties, <as_of> the time of the report.
PROJECTIONS = {
    "numbered": "select event_id, ts, user_id, event_type, value, <k> as k from {events}",
    "tasks": """
        select event_id as task_id, event_type as task_name, case event_id % 3 when 0 then 'default' when 1 then 'high' else 'low' end as queue_name,
               cast(1 + event_id % 100 as int) as priority, status, k % 4 as retry_count, 3 as max_retries,
               case when status <> 'PENDING' then concat('worker-', user_id) end as worker_id, ts as enqueued_at, ts as created_at,
               case when status not in ('PENDING', 'CLAIMED', 'EXPIRED') then ts + interval '1' second * user_id end as started_at,
               case when status in ('CLAIMED', 'RUNNING') then ts + interval '1' second * user_id end as claimed_at,
               case when status = 'CLAIMED' and event_id % 5 <> 0 then <as_of> + interval '1' minute * (case when event_id % 2 = 0 then 5 else -5 end) end as claim_expires_at,
               case when status = 'PENDING' and event_id % 11 = 0 then <as_of> + interval '1' hour * (case when event_id % 2 = 0 then 1 else -1 end) end as next_retry_at,
               case when event_id % 13 = 0 then ts + interval '1' day * 20 end as good_until,
               case when status = 'RUNNING' and event_id % 17 = 0 then <as_of> - interval '1' second * 5 end as finalizing_at,
               event_id % 2 = 0 as is_workflow_task, case when event_id % 2 = 0 then event_id % 500 end as workflow_id,
               case when status = 'COMPLETED' then ts + interval '1' second * (600 + k) end as completed_at,
               case when status in ('FAILED', 'CANCELLED', 'EXPIRED') then ts + interval '1' second * (600 + k) end as failed_at,
               case when status = 'FAILED' then case event_id % 4 when 0 then 'TASK_ERROR' when 1 then 'WORKER_CRASHED' when 2 then 'CARD_DECLINED' else '' end
                    when status = 'CANCELLED' then 'TASK_CANCELLED' when status = 'EXPIRED' then 'TASK_EXPIRED' end as error_code, k
        from (select *, case when k < 10 then 'PENDING' when k < 15 then 'CLAIMED' when k < 20 then 'RUNNING' when k < 80 then 'COMPLETED' when k < 90 then 'FAILED' when k < 95 then 'CANCELLED' else 'EXPIRED' end as status from {numbered}) s""",
    "live": "select * from {tasks} where status in ('PENDING', 'CLAIMED', 'RUNNING')",
    "history": """
        select *, coalesce(completed_at, failed_at) as terminal_at, coalesce(completed_at, failed_at) as anchor,
               case status when 'COMPLETED' then case when task_id % 2 = 0 then 'COMPLETE_LOCKED' else 'COMPLETE_FUSED' end when 'FAILED' then case when task_id % 5 = 0 then 'FAIL_STALE' else 'FAIL_RUNNING' end when 'CANCELLED' then 'CANCEL_ADMIN' else 'EXPIRE_PENDING' end as kind,
               case task_id % 4 when 0 then 'forever' when 1 then 'short' else 'standard' end as class_key
        from {tasks} where status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED')""",
    "attempts": """
        select task_id, cast(a as int) as attempt, task_id % 3 = a as ok, case when task_id % 3 = a then 'COMPLETED' else 'FAILED' end as outcome, a < h.retry_count as will_retry, h.started_at, h.started_at + interval '1' minute * cast(a as int) as finished_at,
               case when task_id % 3 <> a then 'TASK_ERROR' end as error_code, case when task_id % 3 <> a then concat('bad ', chr(123), '"v": ', task_id, chr(125), ' body', chr(125)) end as error_message, cast(null as varchar(9)) as failed_reason, worker_id, 'host' as worker_hostname, cast(task_id % 1000 as int) as worker_pid, cast(null as varchar(9)) as worker_process_name
        from {tasks} h join (values (1), (2), (3)) v(a) on v.a <= h.retry_count where h.started_at is not null""",
    "inputs": """
        select task_id, case task_id % 4 when 0 then 'forever' when 1 then 'short' else 'standard' end as class_key, enqueued_at - interval '1' second * cast(task_id % 5 as int) as sent_at, claimed_at, good_until,
               case when task_id % 6 <> 0 then concat('fp', task_id) end as fingerprint, case when task_id % 6 <> 0 then 1 end as fingerprint_version, concat('in', task_id) as input_digest,
               case when task_id % 10 = 3 then task_id - 1 end as rerun_of, case when task_id % 10 = 3 then task_id - 2 end as rerun_root, task_id % 3 = 0 as retain_input,
               case when task_id % 7 <> 0 then concat('[', task_id, ']') end as prepared, case when task_id % 7 <> 0 then concat('d', task_id) end as prepared_digest, case when task_id % 8 <> 0 then concat(chr(123), '"v":', task_id, chr(125)) end as result,
               case when status <> 'RUNNING' then 'TASK_CANCELLED' end as error_code, case when task_id % 9 = 0 then 'why' end as failed_reason, concat('host-', task_id % 3) as worker_hostname, cast(task_id % 1000 as int) as worker_pid, cast(null as varchar(9)) as worker_process_name
        from {tasks}""",
    "heartbeats": "select task_id, 'runner' as role, started_at + interval '1' second * (30 * (task_id % 20)) as sent_at from {tasks} where status = 'RUNNING' and task_id % 7 <> 0 union all select task_id, 'claimer', claimed_at from {tasks} where status = 'CLAIMED'",
    "worker_states": "select concat('worker-', user_id) as worker_id, ts as snapshot_at, event_id as snapshot_id, value as cpu_percent, event_id % 5 as tasks_running from {events}",
    "workflows": """
        select o_orderkey as id, concat('flow-', o_orderkey % 7) as name, case when o_orderstatus = 'O' then 'RUNNING' when o_orderstatus = 'P' then 'PAUSED' when o_orderkey % 7 = 3 then 'CANCELLED' else 'COMPLETED' end as status,
               case when o_orderkey % 5 <> 1 then concat('key-', o_orderkey % 11) end as definition_key,
               case when o_orderstatus = 'F' and o_orderkey % 5 < 2 then <as_of> - interval '1' day * (o_orderkey % 60) end as completed_at,
               case when o_orderkey % 3 = 0 then <as_of> - interval '1' day * (o_orderkey % 70) end as updated_at,
               case when o_orderkey > 0 and o_orderkey % 4 = 0 then cast(floor(o_orderkey / 10) as bigint) end as parent_id, o_orderdate as created_at,
               case when o_orderkey % 6 = 0 then 'pause' else 'fail' end as on_error, case when o_orderkey % 9 = 0 then 0 end as output_index from {orders}""",
    "nodes": """
        select l_orderkey as workflow_id, cast(i as int) as task_index, concat('n', i) as node_id, l_orderkey * 100 + i as node_key,
               case when m <= 3 then 'COMPLETED' when m = 4 then 'FAILED' when m = 5 then 'SKIPPED' when m = 6 then 'RUNNING' when m = 7 then 'READY' else 'PENDING' end as status,
               case l_returnflag when 'A' then 'all' when 'N' then 'any' else 'quorum' end as join_type, case when l_returnflag = 'R' then 1 end as min_success,
               l_linestatus = 'O' as allow_failed_deps, case when i > 0 then cast(floor((i - 1) / 2) as bigint) end as dep_a, case when i > 1 and i % 3 = 0 then i - 1 end as dep_b,
               l_shipdate as started_at, case when m <= 5 then l_shipdate + interval '1' second * (10 * l_linenumber) end as completed_at,
               case when m <= 3 then concat('r', l_partkey) end as result, case when m = 4 then concat(chr(123), '"error_code":"E', i, '"', chr(125)) end as error, l_orderkey * 10 + i as task_id, case when l_partkey % 10 = 0 then l_orderkey + 1 end as sub_workflow_id
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, (l_partkey + l_linenumber) % 10 as m from {lineitem}) s""",
    "edges": "select workflow_id, task_index, dep_a as dep from {nodes} where dep_a is not null union all select workflow_id, task_index, dep_b from {nodes} where dep_b is not null",
    "plan_nodes": """
        select workflow_id, task_index, case when workflow_id % 50 = 9 then 'same' when workflow_id % 50 = 11 and task_index = 0 then 'bad id!' else node_id end as node_id,
               case when workflow_id % 50 = 19 then 'most' else join_type end as join_type, case when workflow_id % 50 = 13 then 9 else min_success end as min_success from {nodes}""",
    "plan_edges": """
        select workflow_id, cast(task_index as bigint) as task_index, dep from {edges} union all select workflow_id, 0, cast(max(task_index) as bigint) from {nodes} where workflow_id % 50 = 3 group by workflow_id
        union all select workflow_id, task_index, 99 from {nodes} where workflow_id % 50 = 7 and task_index = 1 union all select workflow_id, task_index, task_index from {nodes} where workflow_id % 50 = 15 and task_index = 2
        union all select workflow_id, 1, 2 from {nodes} where workflow_id % 50 = 21 and task_index = 2 union all select workflow_id, 2, 1 from {nodes} where workflow_id % 50 = 21 and task_index = 2""",
    "schedules": "select c_custkey as schedule_id, concat('s', c_custkey) as schedule_name, case when c_custkey % 10 <> 0 then <as_of> + interval '1' minute * (c_custkey % 97 - 48) end as next_run_at, <as_of> - interval '1' day * (c_custkey % 5) as last_run_at, c_custkey % 12 as run_count from {customer}",
    "patterns": """
        select k as schedule_id, case k % 9 when 0 then 'interval' when 1 then 'hourly' when 2 then 'daily' when 3 then 'weekly' when 4 then 'monthly' else 'cron' end as kind,
               case when k % 47 = 0 then 'Mars/Olympus' when k % 5 = 0 then 'UTC' when k % 5 = 1 then 'Asia/Kolkata' else 'America/New_York' end as zone,
               case when k % 2 = 0 then cast(k % 40 as int) end as every_days, cast(null as int) as every_hours, case when k % 3 = 0 then 90 end as every_minutes, cast(k % 50 as int) as every_seconds,
               case when k % 59 = 1 then '60' when k % 2 = 0 then cast(k % 60 as varchar(9)) end as second,
               case when k % 61 = 0 then '75' when k % 9 = 1 then cast(k % 60 as varchar(9)) when k % 7 = 0 then '0,30' when k % 7 = 1 then '*/20' when k % 7 = 2 then '5-55/25' when k % 7 = 3 then '*' else '30' end as minute,
               case when k % 11 < 4 then '2' when k % 11 < 6 then '1-3' when k % 11 < 8 then '*/6' when k % 11 = 8 then '*' else '0,12,23' end as hour,
               case when k % 53 = 0 then 'nov-mar' when k % 13 < 4 then '*' when k % 13 < 6 then 'feb' when k % 13 < 8 then 'Mar,nov' when k % 13 < 10 then '3-11/4' else 'feb-apr' end as month,
               case when k % 9 = 4 then cast(k % 32 as varchar(9)) when k % 17 < 4 then '29' when k % 17 < 8 then '3,10' when k % 17 < 12 then '*/10' when k % 17 = 12 then '30-31' else '1-7' end as month_day,
               case when k % 67 = 3 then 'sun,mon,sun' when k % 10 < 4 then 'sun' when k % 10 < 7 then 'mon,tue,wed,thu,fri' else 'sat,sun' end as week_day,
               case when k % 71 = 2 then '25:00:00' when k % 4 < 2 then '02:30:00' when k % 4 = 2 then '01:15:30' else '23:59:59' end as at_time,
               case k % 6 when 0 then 'any' when 1 then 'month' when 2 then 'week' when 3 then 'either' else 'both' end as day_mode,
               case when k % 4 = 0 then <as_of> + interval '1' day * cast(k % 600 as int) when k % 4 = 1 then timestamp '2024-03-09 12:00:00' + interval '1' minute * cast(k * 37 % 2000 as int) else timestamp '2024-11-02 20:00:00' + interval '1' minute * cast(k * 41 % 1500 as int) end as at_time_utc
        from (select c_custkey as k from {customer}) c""",
    "classes": "select * from (values ('short', 5), ('standard', 15), ('forever', null)) v(class_key, keep_days)",
    "leaves": """
        select class_key, concat('hist_', class_key, '_', cast(d as int)) as leaf_name, timestamp '2024-01-01 00:00:00' + interval '1' day * cast(d as int) as lower_anchor, timestamp '2024-01-01 00:00:00' + interval '1' day * (cast(d as int) + 1) as upper_anchor,
               d % 6 <> 5 as verified, d % 11 <> 10 as relation_exists, case when d % 13 <> 12 then d % 17 = 16 end as detach_pending, d % 19 <> 18 as id_index_exists,
               concat('day ', cast(d as int)) as cataloged_bound, concat('day ', cast(d + (case when d % 23 = 7 then 1 else 0 end) as int)) as actual_bound, timestamp '2024-01-01 00:00:00' + interval '1' day * (cast(d as int) - 1) as min_birth_at
        from (select distinct class_key from {classes}) c cross join (select n_nationkey as d from {nation}) n where not (class_key = 'short' and d = 20)""",
    "reservations": "select user_id as key_id, case when event_id % 2 = 0 then 'LIVE' else 'TERMINAL' end as disposition, event_id % 10 as fingerprint, event_id as task_id, case when event_id % 2 = 1 then ts + interval '1' day * 2 end as expires_at from (select *, row_number() over (partition by user_id order by event_id) as r from {events}) s where r = 1",
    "outbox": """
        select h.task_id, h.task_id as workflow_id, case when h.task_id % 19 = 0 then -1 else h.task_id * 100 end as node_key, h.class_key as history_class, h.anchor as history_anchor, cast(1 + (case when h.task_id % 23 = 0 then 1 else 0 end) as int) as version,
               case when h.task_id % 29 = 0 then 'bad' else concat('d', h.task_id) end as digest, h.task_id % 6 as attempt_count, h.enqueued_at as created_at
        from {history} h where h.task_id % 3 = 0""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a projection of tables."""
    if name not in PROJECTIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = PROJECTIONS[name].replace("<k>", "cast(get_json_object(props, '$.k') as int)").replace("<as_of>", f"timestamp_ntz '{AS_OF}'").replace("timestamp '2024", "timestamp_ntz '2024")
    used = [n for n in (*PROJECTIONS, "events", "orders", "lineitem", "customer", "nation") if f"{{{n}}}" in text]
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in used})


def duckdb_prelude() -> str:
    """WITH clauses for the same projections in DuckDB."""
    parts = []
    for name, text in PROJECTIONS.items():
        text = text.replace("<k>", "cast(json_extract_string(props, '$.k') as int)").replace("<as_of>", f"timestamp '{AS_OF}'")
        for n in (*PROJECTIONS, "events", "orders", "lineitem", "customer", "nation"):
            text = text.replace(f"{{{n}}}", n)
        parts.append(f"{name} as ({text})")
    return "with " + ",\n".join(parts) + "\n"
