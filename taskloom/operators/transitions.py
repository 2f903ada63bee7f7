"""State changes as projections: (rows, command, as_of) to rows with an outcome. Nothing is updated in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attempts, canonical, envelopes
from ..functions.vocab import ANY_STATUS_KIND, DEFERRED_KINDS, STATUS_OF_KIND, TASK_TERMINAL
from .filters import past_deadline, stale_claim, stale_running
from .joins import left_by_key


def start(claims: DataFrame, tasks: DataFrame, workflows: DataFrame, as_of: Column) -> DataFrame:
    """claims: task_id, by, at. outcome RUNNING if the claim still holds (a null `at` accepts any time of claim), in time,
    and the workflow isn't paused or cancelled."""
    held = tasks.select("task_id", "status", "worker_id", "claimed_at", "claim_expires_at", "good_until", "workflow_id")
    rows = claims.join(held, "task_id", "left")
    lost = (F.col("status") != "CLAIMED") | ~F.col("worker_id").eqNullSafe(F.col("by")) | (F.col("at").isNotNull() & ~F.col("claimed_at").eqNullSafe(F.col("at")))
    so_far = (F.when(F.col("status").isNull(), "TASK_ABSENT").when(lost, "LOST_CLAIM").when(F.col("claim_expires_at") <= as_of, "LEASE_EXPIRED")
              .when(past_deadline(as_of), "EXPIRED"))
    # only a claim that nothing else ends asks for its workflow; the others are dealt out by task
    asks = F.when(F.col("so_far").isNull(), F.col("workflow_id"))
    stopped = workflows.where(F.col("status").isin("PAUSED", "CANCELLED")).select(F.col("id").alias("asked"), F.lit(True).alias("stopped"))
    rows = left_by_key(rows.select("task_id", so_far.alias("so_far"), "workflow_id").select("task_id", "so_far", asks.alias("asked")), stopped, "asked", "task_id")
    outcome = F.coalesce("so_far", F.when(F.col("stopped"), "WORKFLOW_STOPPED").otherwise("RUNNING"))
    return rows.select("task_id", outcome.alias("outcome"))


def miss(commands: DataFrame, live: DataFrame, history: DataFrame, equivalent: list[str]) -> DataFrame:
    """commands: task_id, by, at. Why a command found nothing to do."""
    now = live.select("task_id", F.col("status").alias("live_status"), "worker_id", "claimed_at")
    past = history.select("task_id", "kind")
    rows = commands.join(now, "task_id", "left").join(past, "task_id", "left")
    lost = F.col("by").isNotNull() & (~F.col("worker_id").eqNullSafe(F.col("by")) | (F.col("at").isNotNull() & ~F.col("claimed_at").eqNullSafe(F.col("at"))))
    outcome = (F.when(F.col("live_status").isNotNull(), F.when(lost, "LOST_CLAIM").otherwise("SOURCE_STATE_CONFLICT"))
               .when(F.col("kind").isNull(), "TASK_ABSENT").when(F.col("kind").isin(equivalent), "ALREADY_APPLIED").otherwise("SOURCE_STATE_CONFLICT"))
    return rows.select("task_id", outcome.alias("outcome"))


def end(commands: DataFrame, live: DataFrame, history: DataFrame, *, to: str, kind: str, source: list[str], as_of: Column) -> DataFrame:
    """commands: task_id, by. Tasks in a source state that the worker holds end as `to`; the others say why not."""
    if kind != ANY_STATUS_KIND and kind not in STATUS_OF_KIND:
        raise ValueError(f"{kind} is no way to end")
    if to not in TASK_TERMINAL or STATUS_OF_KIND.get(kind, to) != to:
        raise ValueError(f"{kind} doesn't end as {to}")
    missed = miss(commands.withColumn("at", F.lit(None).cast("timestamp_ntz")), live, history, [kind])
    hit = commands.join(live, "task_id").where(F.col("status").isin(source) & (F.col("by").isNull() | F.col("worker_id").eqNullSafe(F.col("by")))).select("task_id", F.lit(to).alias("status"), F.lit(kind).alias("kind"), as_of.alias("terminal_at"))
    return missed.join(hit, "task_id", "left").select("task_id", F.when(F.col("status").isNotNull(), "APPLIED").otherwise(F.col("outcome")).alias("outcome"), "status", "kind", "terminal_at")


def to_history(ended: DataFrame, live: DataFrame, tries: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Archive rows of tasks that ended: what the live row says, the state and way in which it ended, the anchor of its
    retention, its attempts as a snapshot with digest, and whether the workflow's part follows later.

    results: task_id, result, error_code, failed_reason of tasks that ended with one.
    """
    made = tries.groupBy("task_id").agg(F.collect_list(F.struct(*attempts.FIELDS)).alias("tries"))
    done = ended.where("outcome = 'APPLIED'").select("task_id", F.col("status").alias("ended"), "kind", "terminal_at")
    rows = live.drop("error_code").join(done, "task_id").join(made, "task_id", "left")
    given = ["result", "error_code", "failed_reason"]
    rows = rows.join(results.select("task_id", *given), "task_id", "left") if results is not None else rows.withColumns({c: F.lit(None).cast("string") for c in given})
    snapshot = attempts.encode(F.col("tries"))
    return rows.select(
        "task_id", "task_name", "queue_name", "priority", F.col("ended").alias("status"), "kind", "terminal_at", F.col("terminal_at").alias("anchor"),
        "enqueued_at", "started_at", "created_at", "retry_count", "max_retries", "worker_id", "workflow_id", *given,
        F.sha2(F.col("result").cast("binary"), 256).alias("result_digest"), snapshot.alias("attempts"), F.sha2(snapshot.cast("binary"), 256).alias("attempts_digest"),
        F.col("kind").isin(DEFERRED_KINDS).alias("deferred"))


#: Kinds by which an administrator ends a task: its output so far is kept apart from a canonical result.
ADMINISTRATIVE = ["CANCEL_ADMIN"]
#: Columns of `inputs` that archive_rows() takes; missing ones are null.
INPUTS = {
    "class_key": "string", "sent_at": "timestamp_ntz", "claimed_at": "timestamp_ntz", "good_until": "timestamp_ntz", "fingerprint": "string", "fingerprint_version": "smallint", "input_digest": "string", "rerun_of": "long", "rerun_root": "long",
    "retain_input": "boolean", "prepared": "string", "prepared_digest": "string", "result": "string", "error_code": "string", "failed_reason": "string", "worker_hostname": "string", "worker_pid": "int", "worker_process_name": "string",
}


def archive_rows(ended: DataFrame, live: DataFrame, tries: DataFrame, inputs: DataFrame) -> DataFrame:
    """The whole archive row of each task that ended, with the class that says which partition it goes to.

    inputs: task_id and INPUTS, what the store knows of a task beside the live row. The result is an envelope of version
    1; an administrator's cancellation keeps the output as prior_payload. The input for a rerun is carried as it was
    prepared, inline, if the task may be rerun at all (no workflow task, not completed) and its sender wanted it kept.
    """
    known = inputs.select("task_id", *(F.col(c).cast(k).alias(f"in_{c}") if c in inputs.columns else F.lit(None).cast(k).alias(f"in_{c}") for c, k in INPUTS.items()))
    made = tries.groupBy("task_id").agg(F.collect_list(F.struct(*attempts.FIELDS)).alias("tries"))
    done = ended.where("outcome = 'APPLIED'").select("task_id", F.col("status").alias("ended"), "kind", "terminal_at")
    rows = live.join(done, "task_id").join(known, "task_id", "left").join(made, "task_id", "left")
    i = lambda c: F.col(f"in_{c}")
    own = lambda c: F.coalesce(F.col(c), i(c)) if c in live.columns else i(c)
    result = envelopes.of_ended(i("result"), F.col("kind").isin(ADMINISTRATIVE))
    there = i("result").isNotNull()
    snapshot = attempts.encode(F.col("tries"))
    never = F.col("is_workflow_task") | (F.col("ended") == "COMPLETED")
    disposition = F.when(never, "NEVER_ELIGIBLE").when(~F.coalesce(i("retain_input"), F.lit(False)), "DECLINED_BY_POLICY").when(i("prepared").isNotNull(), "INLINE")
    inline = F.coalesce(disposition == "INLINE", F.lit(False))
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select(
        "task_id", "task_name", "queue_name", "priority", i("fingerprint_version").alias("fingerprint_version"), i("fingerprint").alias("fingerprint"), F.col("ended").alias("status"), "kind", "terminal_at", F.col("terminal_at").alias("anchor"), i("class_key").alias("class_key"),
        i("sent_at").alias("sent_at"), "enqueued_at", own("claimed_at").alias("claimed_at"), "started_at", "created_at", own("good_until").alias("good_until"),
        F.when(there, envelopes.VERSION).cast("smallint").alias("result_version"), F.when(there, envelopes.CODEC).alias("result_codec"), F.when(there, envelopes.CONTENT_TYPE).alias("result_content_type"),
        result["canonical"].cast("string").alias("result_payload"), result["prior"].cast("string").alias("prior_payload"), hexed(result["digest"]).alias("result_digest"), i("error_code").alias("error_code"), i("failed_reason").alias("failed_reason"),
        "retry_count", "max_retries", "worker_id", *(i(c).alias(c) for c in ("worker_hostname", "worker_pid", "worker_process_name", "input_digest", "rerun_of", "rerun_root")), "workflow_id", "is_workflow_task",
        F.lit(1).cast("smallint").alias("row_version"), F.lit(1).cast("smallint").alias("attempts_version"), F.lit(envelopes.CODEC).alias("attempts_codec"), F.lit(envelopes.CONTENT_TYPE).alias("attempts_content_type"), snapshot.alias("attempts"), F.sha2(snapshot.cast("binary"), 256).alias("attempts_digest"),
        disposition.alias("rerun_disposition"), F.when(inline, 1).cast("smallint").alias("rerun_version"), F.when(inline, envelopes.CODEC).alias("rerun_codec"), F.when(inline, envelopes.CONTENT_TYPE).alias("rerun_content_type"),
        F.when(inline, i("prepared_digest")).alias("rerun_digest"), F.when(inline, i("prepared")).alias("rerun_input"), (F.col("kind").isin(DEFERRED_KINDS) & F.col("is_workflow_task")).alias("deferred"))


def expire_pending(tasks: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The oldest deadlines first."""
    return tasks.where((F.col("status") == "PENDING") & past_deadline(as_of)).orderBy("good_until", "task_id").limit(limit).select("task_id", F.lit("EXPIRED").alias("status"), F.lit("EXPIRE_PENDING").alias("kind"))


def expire_claimed(tasks: DataFrame, as_of: Column) -> DataFrame:
    return tasks.where((F.col("status") == "CLAIMED") & past_deadline(as_of)).select("task_id", F.lit("EXPIRED").alias("status"), F.lit("EXPIRE_CLAIMED").alias("kind"))


def fail_stale(tasks: DataFrame, beats: DataFrame, as_of: Column, age_s: int = 300) -> DataFrame:
    """Running tasks without a sign of life: those with retries left wait again, the others fail."""
    again = F.col("retry_count") < F.col("max_retries")
    return stale_running(tasks, beats, as_of, age_s).select("task_id", F.when(again, "PENDING").otherwise("FAILED").alias("status"), F.when(again, F.lit(None)).otherwise("WORKER_CRASHED").alias("error_code"))


def requeue(tasks: DataFrame, delay_s: Column, as_of: Column) -> DataFrame:
    """Running tasks that failed with retries left, if the next try falls before the deadline."""
    at = as_of + F.make_dt_interval(secs=delay_s)
    fits = (F.col("retry_count") < F.col("max_retries")) & (F.col("good_until").isNull() | (at < F.col("good_until")))
    return tasks.where((F.col("status") == "RUNNING") & fits).select("task_id", F.lit("PENDING").alias("status"), (F.col("retry_count") + 1).alias("retry_count"), at.alias("next_retry_at"))


def requeue_stale_claims(tasks: DataFrame, as_of: Column, age_s: int) -> DataFrame:
    return tasks.where(stale_claim(as_of, age_s)).select("task_id", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("worker_id"))


def orphans(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Waiting workflow tasks that no runnable node points to."""
    runnable = nodes.where(F.col("status").isin("READY", "ENQUEUED", "RUNNING")).select("task_id")
    return tasks.where("is_workflow_task and status in ('PENDING', 'CLAIMED')").join(runnable, "task_id", "left_anti")


def stopped_claims(tasks: DataFrame, workflows: DataFrame, to: str) -> DataFrame:
    """Claimed tasks whose workflow is paused (abandoned) or cancelled."""
    of = workflows.where(F.col("status") == to).select(F.col("id").alias("workflow_id"))
    return tasks.where("status = 'CLAIMED'").join(of, "workflow_id", "left_semi")


def move_tree(workflows: DataFrame, tree: DataFrame, to: str, source: list[str]) -> DataFrame:
    """Pause, resume, cancel or expire a run and all below it: those in a source state change."""
    hit = F.col("level").isNotNull() & F.col("status").isin(source)
    return workflows.join(tree, "id", "left").select("id", F.when(hit, to).otherwise(F.col("status")).alias("status"), F.when(F.col("level").isNull(), "UNTOUCHED").when(hit, "APPLIED").otherwise("REFUSED").alias("outcome"))


def replay(events: DataFrame, moves: dict[str, list[str]], key: str, seq: str, status: str) -> DataFrame:
    """Per key the last state of an event log, and how many of its steps aren't legal moves."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(seq))
    legal = F.lit(False)
    for a, to in moves.items():
        legal = legal | ((F.col("_before") == a) & F.col(status).isin(to))
    steps = events.withColumn("_before", before)
    return steps.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.count_if(F.col("_before").isNotNull() & ~legal).alias("illegal"))


def reserve(requests: DataFrame, reservations: DataFrame, as_of: Column) -> DataFrame:
    """requests: key_id, fingerprint. APPLIED for a free key; REPLAY or CONFLICT with a live one, or one that hasn't run out."""
    held = reservations.where((F.col("disposition") == "LIVE") | (F.col("expires_at") > as_of)).select("key_id", F.col("fingerprint").alias("held"), F.col("task_id").alias("holder"))
    rows = requests.join(held, "key_id", "left")
    return rows.select("key_id", F.when(F.col("holder").isNull(), "APPLIED").when(F.col("held") == F.col("fingerprint"), "REPLAY").otherwise("CONFLICT").alias("outcome"))


def expired_reservations(reservations: DataFrame, as_of: Column, limit: int) -> DataFrame:
    return reservations.where((F.col("disposition") == "TERMINAL") & (F.col("expires_at") <= as_of)).orderBy("expires_at", "key_id").limit(limit)


def outbox_verdicts(asked: DataFrame, outbox: DataFrame, workflows: DataFrame, nodes: DataFrame, history: DataFrame) -> DataFrame:
    """asked: task_id. What consuming each pending row would do, by the first rule that holds."""
    o = outbox.select("task_id", "workflow_id", "node_key", "version", "digest", F.lit(True).alias("pending"))
    w = workflows.select(F.col("id").alias("workflow_id"), F.col("status").alias("wf_status"))
    n = nodes.select("node_key", F.col("status").alias("node_status"))
    linked = nodes.groupBy("task_id").agg(F.min_by("status", "node_key").alias("linked_status"))
    h = history.select("task_id", F.lit(1).alias("source_version"), F.concat(F.lit("d"), F.col("task_id")).alias("source_digest"))
    rows = left_by_key(asked.join(o, "task_id", "left"), w, "workflow_id", "task_id")
    rows = left_by_key(rows, n, "node_key", "task_id").join(linked, "task_id", "left").join(h, "task_id", "left")
    ended = ["COMPLETED", "FAILED", "SKIPPED"]
    verdict = (F.when(F.col("pending").isNull(), F.when(F.col("linked_status").isin(ended), "ALREADY_APPLIED").otherwise("PENDING_ABSENT"))
               .when(F.col("wf_status").isNull() | F.col("node_status").isNull(), "SOURCE_STATE_CONFLICT")
               .when(F.col("wf_status").isin(TASK_TERMINAL), "SUPERSEDED_BY_WORKFLOW_TERMINAL").when(F.col("source_version").isNull(), "SOURCE_ABSENT")
               .when(F.col("source_version") != F.col("version"), "SOURCE_VERSION_CONFLICT").when(F.col("source_digest") != F.col("digest"), "SOURCE_DIGEST_MISMATCH")
               .when(F.col("node_status").isin(ended), "ALREADY_APPLIED").otherwise("APPLIED_TO_NODE"))
    return rows.select("task_id", verdict.alias("verdict"))


def quarantine(outbox: DataFrame, most_attempts: int) -> tuple[DataFrame, DataFrame]:
    """(still pending, quarantined)"""
    over = F.col("attempt_count") >= most_attempts
    return outbox.where(~over), outbox.where(over)


#: Namespace of the ids of reruns.
RERUNS = uuid.uuid5(uuid.NAMESPACE_OID, "reruns")


def rerun(history: DataFrame, ids: list, as_of: Column) -> DataFrame:
    """A new pending request for each archived task, with its lineage. Its id follows from the task and the time of the
    command: the same command twice makes the same request."""
    rows = history.where(F.col("task_id").isin(ids))
    name = F.concat_ws(":", F.col("task_id").cast("string"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return rows.select(canonical.uuid5(RERUNS, name).alias("task_id"), "task_name", "queue_name", "priority", F.lit("PENDING").alias("status"), as_of.alias("enqueued_at"), F.col("task_id").alias("rerun_of"), F.col("kind").alias("rerun_of_kind"))


def cancel_task(commands: DataFrame, tasks: DataFrame) -> DataFrame:
    """commands: task_id. Waiting tasks are cancelled; running ones and ended ones are refused."""
    rows = commands.join(tasks.select("task_id", "status"), "task_id", "left")
    return rows.select("task_id", F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status").isin("PENDING", "CLAIMED"), "CANCELLED").when(F.col("status") == "RUNNING", "REFUSED_RUNNING").otherwise("REFUSED_TERMINAL").alias("outcome"))


