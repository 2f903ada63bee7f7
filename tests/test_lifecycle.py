"""Metamorphic checks, plans, driver-side helpers, streams."""

import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from taskloom.functions import scalars as S
from taskloom.functions import schedules as H
from taskloom.operators import claim as C
from taskloom.operators import dag as J
from taskloom.operators import filters as B
from taskloom.operators import monitoring as M
from taskloom.operators import retention as L
from taskloom.plans import queries as Q
from taskloom.sources import store as A
from taskloom.sources.fixtures import read
from taskloom.streaming import events as I

NOW = datetime(2024, 1, 31)


def table(spark, sf_dir):
    return lambda name: read(spark, sf_dir, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window():
    assert B.resolve_window(NOW) == (NOW - timedelta(days=1), NOW)
    assert B.resolve_window(NOW, NOW - timedelta(days=30)) == (NOW - timedelta(days=30), NOW)
    for since in (NOW, NOW - timedelta(days=30, seconds=1)):
        with pytest.raises(ValueError):
            B.resolve_window(NOW, since)


def test_page_bounds():
    B.check_page(200, 300)
    for limit, offset in ((200, 301), (0, 0), (201, 0), (1, -1)):
        with pytest.raises(ValueError):
            B.check_page(limit, offset)


def test_totals_agree(spark, sf_dir):
    t = table(spark, sf_dir)
    life = Q.life(t)
    total = M.breakdown(life, "task_name", 2).where("grp = 'TOTAL'").first()
    stats = {r.status: r.n for r in M.task_stats(life).collect()}
    assert list(stats) == ["PENDING", "CLAIMED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "EXPIRED"] and sum(stats.values()) == total.total and total.group_count == 5
    whole = [r.task_id for r in life.orderBy(F.col("completed_at").desc_nulls_last(), "task_id").collect()]
    assert [r.task_id for r in M.page(life, "completed_at", True, 30, 20).collect()] == whole[30:50]


def test_breakdown_of_seeded_groups(spark):
    """Counts are merged before the cap."""
    rows = [(i, f"n{i % 50}", "PENDING", 0) for i in range(100)] + [(200, "shared", "CLAIMED", 0), (201, "shared", "COMPLETED", 1), (202, "shared", "COMPLETED", 0)] + [(300 + i, f"f{i}", "FAILED", 0) for i in range(35)]
    df = spark.createDataFrame(rows, "task_id int, task_name string, status string, retry_count int")
    got = M.breakdown(df, "task_name", 1).collect()
    assert (got[0].grp, got[0].total, got[0].retried) == ("shared", 3, 1) and (got[1].total, got[1].group_count) == (138, 86)
    assert M.facet(df, "task_name", 50).count() == 50


def test_claim_keeps_caps(spark, sf_dir):
    t = table(spark, sf_dir)
    for c in (Q.CLAIM, Q.SOFT):
        got = C.candidates(t("live"), c, Q.now()).collect()
        assert [r.nth for r in got] == sorted(r.nth for r in got) and len(got) <= C.accounting(t("live"), c, Q.now()).first().budget
        used = {r.queue_name: r.used for r in C.queue_counts(t("live"), c, Q.now()).collect()}
        for q, cap in c.most_running.items():
            assert sum(r.queue_name == q for r in got) <= max(0, cap - used.get(q, 0))


def test_queue_order():
    assert C.order_queues(["a", "b"], {}, {"b": 1}) == ["a", "b"]
    assert C.order_queues(["a", "b", "c", "d"], {"c": 1, "a": 5}, {"b": 2}) == ["c", "a", "b"]


def test_skip_cascade_is_idempotent(spark, sf_dir):
    t = table(spark, sf_dir)
    once = J.skip_cascade(t("nodes"), t("edges"), t("workflows"))
    twice = J.skip_cascade(once, t("edges"), t("workflows"))
    assert L.same_rows(once.select("node_key", "status"), twice.select("node_key", "status"))
    assert J.evaluate_joins(once, t("edges"), t("workflows")).where("action = 'SKIP'").isEmpty()


def test_plans(spark, sf_dir, tmp_path):
    t = table(spark, sf_dir)
    assert "WindowGroupLimit" in plan(M.top_per_key(t("live"), "queue_name", F.lit(5), "priority", "task_id"))
    assert "TakeOrderedAndProject" in plan(M.page(Q.life(t), "enqueued_at", True, 0, 25))
    leaves = spark.createDataFrame(t("leaves").collect(), t("leaves").schema)
    for df in (J.ready_by_dependencies(t("nodes"), t("edges")), L.in_leaf(t("history"), leaves)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    A.write_history(t("history"), str(tmp_path / "h"))
    pruned = A.read_history(spark, str(tmp_path / "h"), datetime(2024, 1, 10), datetime(2024, 1, 12))
    assert "anchor_date" in plan(pruned).split("PartitionFilters")[1].split("]")[0]
    want = t("history").where(B.half_open(F.col("anchor"), datetime(2024, 1, 10), datetime(2024, 1, 12)))
    assert pruned.count() == want.count() > 0
    A.write_heartbeats(t("heartbeats"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == t("heartbeats").count()


def test_cursor():
    rows = [{"created_at": 1, "id": i} for i in range(3)]
    assert M.next_cursor(rows, 3, (9, 9)) == (1, 2) and M.next_cursor(rows, 4, (9, 9)) is None and M.next_cursor(rows, 3, (1, 2)) is None


def test_digest_vector(spark):
    """A published vector: the framed digest of two texts under a domain."""
    got = spark.range(1).select(S.framed_digest("key.v1", F.lit("tasks.add"), F.lit("invoice:42")).alias("d")).first().d
    import hashlib

    framed = b"".join(len(x).to_bytes(4, "big") + x for x in (b"key.v1", b"tasks.add", b"invoice:42"))
    assert got == hashlib.sha256(framed).hexdigest()


def test_scalars_on_the_driver():
    assert S.slot_id(uuid.NAMESPACE_URL, "s", "x") == S.slot_id(uuid.NAMESPACE_URL, "s", "x") != S.slot_id(uuid.NAMESPACE_URL, "s", "y")
    assert S.config_hash({"b": 1, "a": 2}) == S.config_hash({"a": 2, "b": 1}) and len(S.fingerprint("a", 1, None)) == 64
    with pytest.raises(ValueError):
        S.strict_json({"a": [float("nan")]})
    assert S.timedelta_text(timedelta(days=1, seconds=61)) == "1 day, 0:01:01"
    with pytest.raises(ValueError):
        S.timedelta_text(timedelta(0))


def test_elapsed_truncates(spark):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1, 999_000)
    r = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz").select(S.elapsed_s(F.col("a"), F.col("b")).alias("x"), S.elapsed_s(F.col("b"), F.col("a")).alias("y")).first()
    assert (r.x, r.y) == (1, -1)


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def cron(minutes="*", hours="*", months="*", month_days=None, week_days=None, both=False):
    part = lambda x, a, b: None if x is None else frozenset(H.expand(x, a, b))
    return H.Cron(part(minutes, 0, 59), part(hours, 0, 23), part(months, 1, 12), part(month_days, 1, 31), part(week_days, 0, 6), both)


def test_schedules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(H.monthly_column(at("2025-02-01 00:00:00"), 31, 0, 0)) == datetime(2025, 2, 28)
    assert one(H.daily_column(at("2025-01-06 12:00:00"), 9, 0, [2])) == datetime(2025, 1, 8, 9)
    assert one(H.hourly_column(at("2025-01-06 12:17:00"), 17)) == datetime(2025, 1, 6, 13, 17)
    assert one(H.interval_column(at("2025-01-06 12:17:00"))) is None
    assert H.latest_slot(datetime(2025, 1, 1), datetime(2025, 1, 1, 1, 7), timedelta(minutes=5)) == datetime(2025, 1, 1, 1, 5)


def test_cron():
    assert cron("*/15", "9-17/4").next(utc(2025, 1, 1, 9, 45)) == utc(2025, 1, 1, 13, 0)
    assert cron("0", "0", month_days="13", week_days="4").next(utc(2025, 6, 1)) == utc(2025, 6, 6)
    assert cron("0", "0", month_days="13", week_days="4", both=True).next(utc(2025, 1, 1)) == utc(2025, 6, 13)
    assert cron("0", "0", "2", "29").next(utc(2025, 1, 1)) == utc(2028, 2, 29)
    assert H.expand("MON-FRI", 0, 6, ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")) == {0, 1, 2, 3, 4}
    for bad in ("61", "5-2", "*/99"):
        with pytest.raises(ValueError):
            H.expand(bad, 0, 59)
    with pytest.raises(ValueError):
        cron("0", "0", "2,4", "31")
    assert H.slots(cron("30", "1"), utc(2025, 1, 1), 2) == [utc(2025, 1, 1, 1, 30), utc(2025, 1, 2, 1, 30)]


def test_clock_changes():
    skipped, repeated = cron("30", "2"), cron("30", "1")
    assert skipped.next(utc(2025, 3, 9, 6, 0), "America/New_York") == utc(2025, 3, 10, 6, 30)
    assert repeated.next(utc(2025, 11, 2, 0, 0), "America/New_York") == utc(2025, 11, 2, 5, 30)
    assert repeated.next(utc(2025, 11, 2, 5, 30), "America/New_York") == utc(2025, 11, 3, 6, 30)


def test_schedule_settings():
    H.Schedule("s", "daily", {"hour": 3})
    for bad in (("", "daily", {}), ("s", "yearly", {}), ("s", "hourly", {"minute": 60})):
        with pytest.raises(ValueError):
            H.Schedule(*bad)


def test_coalesced_stream(spark, tmp_path):
    rows = [("task_changes", str((30 - i) % 7), i) for i in range(30)] + [("workflow_changes", str(i), i) for i in range(150)] + [("unknown", "1", 1)]
    spark.createDataFrame(rows, "channel string, id string, seq long").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    q = I.debounced(I.notification_stream(spark, str(tmp_path / "in")), lambda df, epoch: seen.extend(df.collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    by = {r.topic: r for r in seen}
    assert by["tasks"].ids == ["2", "1", "0", "6", "5", "4", "3"] and by["workflows"].overflow and by["workflows"].ids == [] and set(by) == {"tasks", "workflows"}
    assert I.frames(spark.createDataFrame([("tasks", ["1"])], "topic string, ids array<string>")).first().frame == '{"topic":"tasks","ids":["1"]}'


def test_reserved_stream(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", "x", at(0)), ("a", "x", at(5)), ("a", "y", at(6)), ("a", "y", at(30)), ("b", "z", at(1))]
    spark.createDataFrame(rows, "key string, fingerprint string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, fingerprint string, at timestamp").parquet(str(tmp_path / "in"))
    q = I.reserved(stream, 20).writeStream.format("memory").queryName("reserved").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.outcome) for r in spark.table("reserved").collect())
    assert got == sorted([("a", "APPLIED"), ("a", "REPLAY"), ("a", "CONFLICT"), ("a", "APPLIED"), ("b", "APPLIED")])


def test_watermarked_streams(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2)] + [("b", datetime(2024, 1, 1, 0, 1))]
    spark.createDataFrame(rows, "key string, sent_at timestamp").withColumn("role", F.lit("runner")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, sent_at timestamp, role string").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("firsts", I.first_of_key(stream(), "key", "sent_at", "10 minutes"), "append", 2), ("hours", I.hourly(stream()), "complete", 1)):
        df.writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == n


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, digest string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "id int, digest string")
    assert sorted((r.id, r.digest) for r in A.absent(new, old, "id").collect()) == [(3, "c")]
    assert {(r.id, r.outcome) for r in A.conflicts(new, old, "id", "digest").collect()} == {(1, "REPLAY"), (2, "UNVERIFIABLE"), (3, "INSERTED")}
    assert L.same_rows(old, old) and not L.same_rows(old, new)


def test_leaves_of_many_days(spark):
    """A leaf holds the rows of all its days, an open-ended one too."""
    at = lambda *a: datetime(2024, *a)
    leaves = spark.createDataFrame([("forever", "open", at(1, 1, 6), datetime(9999, 1, 1), at(1, 1)), ("forever", "old", datetime(2023, 12, 1), at(1, 1, 6), at(1, 1)), ("short", "week", at(1, 1, 12), at(1, 8), at(1, 1)), ("short", "next", at(1, 8), at(1, 9), at(1, 1))], "class_key string, leaf_name string, lower_anchor timestamp_ntz, upper_anchor timestamp_ntz, min_birth_at timestamp_ntz")
    rows = [(1, "forever", at(1, 1, 7)), (2, "forever", at(5, 3)), (3, "forever", datetime(2031, 1, 1)), (4, "forever", at(1, 1, 5)), (5, "short", at(1, 7, 23)), (6, "short", at(1, 8)), (7, "short", at(1, 1, 11)), (8, "short", at(1, 9)), (9, "short", None)]
    df = spark.createDataFrame(rows, "task_id int, class_key string, anchor timestamp_ntz")
    assert sorted((r.task_id, r.leaf_name) for r in L.in_leaf(df, leaves).collect()) == [(1, "open"), (2, "open"), (3, "open"), (4, "old"), (5, "week"), (6, "next")]
    outbox = df.select("task_id", F.col("class_key").alias("history_class"), F.col("anchor").alias("history_anchor"))
    assert {r.leaf_name: r.blockers for r in L.blockers(outbox, leaves).collect()} == {"open": 3, "old": 1, "week": 1, "next": 1}
    assert L.empty_leaves(leaves, df.where("task_id = 4"), F.lit(at(2, 1)).cast("timestamp_ntz")).isEmpty()


def test_retention_guards(spark):
    """Fresh workflows and ones with live tasks stay, and take nothing of the budget."""
    old, fresh = datetime(2023, 1, 1), datetime(2024, 1, 30)
    rows = [(1, "COMPLETED", old, None, old), (2, "COMPLETED", None, fresh, old), (3, "FAILED", old, fresh, fresh), (4, "COMPLETED", fresh, old, old), (5, "COMPLETED", None, None, old), (6, "RUNNING", None, None, old)]
    workflows = spark.createDataFrame(rows, "id int, status string, completed_at timestamp_ntz, updated_at timestamp_ntz, created_at timestamp_ntz")
    nodes = spark.createDataFrame([(1, 10), (1, 11), (3, 30), (4, 40), (5, 50), (5, None)], "workflow_id int, task_id int")
    live = spark.createDataFrame([(11, "CLAIMED"), (50, "COMPLETED"), (99, "RUNNING")], "task_id int, status string")
    got = L.within_budget(L.deletable(workflows, nodes, live, F.lit(NOW).cast("timestamp_ntz"), 24), nodes, 3)
    assert sorted((r.id, r.node_count, r.running) for r in got.collect()) == [(3, 1, 1), (5, 2, 3)]


def test_all_schedules_in_order(spark):
    """None is left out, those without a next run among them."""
    rows = [(i, NOW + timedelta(minutes=i * 37 % 300) if i % 3 else None) for i in range(25_000)]
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or NOW, r[0]))
    got = M.schedules_in_order(spark.createDataFrame(rows, "schedule_id long, next_run_at timestamp_ntz")).collect()
    assert [(r.schedule_id, r.next_run_at, r.nth) for r in got] == [(*r, n) for n, r in enumerate(want, 1)]
    assert Q.QUERIES["a7_schedules_in_order"](spark, "/root/testdata/sf0.01").count() == 1500


def test_closure_by_doubling(spark):
    """A chain of 1,000 runs takes at most 12 steps, each a written table; circles end, and each run has its least level."""
    from taskloom.sources.steps import Steps

    written = []
    real = Steps.write
    Steps.write = lambda self, df: written.append(1) or real(self, df)
    try:
        chain = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
        up = J.ancestors(chain, 999)
    finally:
        Steps.write = real
    assert len(written) <= 2 * 12 + 1
    assert sorted((r.id, r.level) for r in up.collect()) == [(i, 999 - i) for i in range(1000)]
    down = J.descend(chain, spark.createDataFrame([(10,), (990,), (990,)], "id long")).collect()
    assert sorted((r.root, r.id, r.level) for r in down) == [(10, i, i - 10) for i in range(10, 1000)] + [(990, i, i - 990) for i in range(990, 1000)]
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(7, 3), (8, 7), (9, None), (None, None)], "id long, parent_id long")
    assert sorted((r.id, r.level) for r in J.ancestors(ring, 8).collect()) == sorted([(8, 0), (7, 1)] + [((3 + i) % 7, 2 + i) for i in range(7)])
    assert sorted((r.id, r.level) for r in J.descendants(ring, 3).collect()) == sorted([((3 - i) % 7, i) for i in range(7)] + [(7, 1), (8, 2)])
