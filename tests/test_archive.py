"""Archive lookups, envelopes, digests and ids, places: vectors from Python's own libraries, plans, odd rows."""

import hashlib
import json
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from taskloom.functions import canonical as Q
from taskloom.functions import envelopes as E
from taskloom.functions.vocab import STATUS_OF_KIND, TASK_TERMINAL, TERMINAL_KINDS
from taskloom.operators import monitoring as M
from taskloom.operators import retention as L
from taskloom.operators import transitions as K
from taskloom.sources import store as A

DAY = datetime(2024, 1, 1)


def archive(spark, path, days=30):
    rows = spark.range(days * 4).select(F.col("id").alias("task_id"), F.lit("short").alias("class_key"), (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.expr("cast(id div 4 as int)"), F.lit(12))).alias("anchor"))
    A.write_history(rows.repartition("anchor"), path)
    return spark.read.parquet(path)


def files_read(df):
    """Files that the scans of a plan have read."""
    df.collect()
    leaves, n = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        if (m := leaves.apply(i).metrics().get("numFiles")).isDefined():
            n += m.get().value()
    return n


def test_pruned_lookups_read_few_files(spark, tmp_path, monkeypatch):
    rows = archive(spark, str(tmp_path / "a"))
    read = []
    real = A.Steps.put

    def put(self, df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            if "anchor_date" in df._jdf.queryExecution().optimizedPlan().toString():
                read.append(files_read(df))
            return real(self, df)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    monkeypatch.setattr(A.Steps, "put", put)
    live = spark.createDataFrame([(1000,)], "task_id long")
    ids = spark.createDataFrame([(100, DAY + timedelta(days=24)), (110, DAY + timedelta(days=26)), (1000, None)], "task_id long, born_at timestamp_ntz")
    got = {r.task_id: (r.class_key, r.stage) for r in A.archive_lookup(ids, live, rows).collect()}
    assert got == {100: ("short", "PRUNED"), 110: ("short", "PRUNED"), 1000: (None, "LIVE")}
    pruned = max(read)
    assert 0 < pruned <= 3 * 8 and len([n for n in read if n]) == 1  # six of thirty days, and no fallback
    whole = files_read(rows)
    assert pruned < whole / 3
    # a birth that is ahead of the row's day falls back to the days before, and ids without one to all
    read.clear()
    ids = spark.createDataFrame([(8, DAY + timedelta(days=5)), (9, None), (5000, DAY), (5001, None), (100, DAY + timedelta(days=24))], "task_id long, born_at timestamp_ntz")
    got = {r.task_id: r.stage for r in A.archive_lookup(ids, live, rows).collect()}
    assert got == {8: "FALLBACK", 9: "FALLBACK", 5000: None, 5001: None, 100: "PRUNED"}
    got = {r.task_id: r.stage for r in A.archive_lookup(ids, live, rows, DAY + timedelta(days=1)).collect()}
    assert got == {8: "FALLBACK", 9: "FALLBACK", 5000: None, 5001: None, 100: "PRUNED"}
    assert A.archive_lookup(ids.limit(0), live, rows).count() == 0


def test_snapshots_read_back(spark, tmp_path):
    at = str(tmp_path / "s")
    day = lambda n: spark.createDataFrame([(f"w{i}", DAY + timedelta(days=n, hours=i), 100 * n + i, 0.5) for i in range(3)], "worker_id string, snapshot_at timestamp_ntz, snapshot_id long, cpu_percent double")
    A.write_snapshots(day(0), at)
    A.write_snapshots(day(1), at)
    got = A.snapshots(spark.read.parquet(at), "w1").collect()
    assert [(r.snapshot_id, r.snapshot_date) for r in got] == [(101, date(2024, 1, 2)), (1, date(2024, 1, 1))] and A.snapshots(spark.read.parquet(at), "w1", 1).first().snapshot_id == 101


TEXTS = ["plain", 'q"uote \\ back', "line\nfeed\ttab\r\b\f", "\x00\x01\x1f\x7f", "é漢😀", "", None]


def test_json_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", Q.json_string(F.col("t")).alias("j")).collect():
        assert r.j == json.dumps(r.t, ensure_ascii=False)


def test_fingerprints(spark):
    at = datetime(2026, 8, 7, 12)
    columns = {"task_name": F.col("t"), "queue_name": F.lit("default"), "priority": F.lit(50), "args": F.lit("[1,2]"), "kwargs": F.lit('{"a":true}'), "good_until": F.lit(at).cast("timestamp_ntz"), "delay_s": F.lit(0), "options": F.lit("{}"), "class_key": F.lit("finite"), "retain_input": F.lit(True)}
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", Q.command_fingerprint(**columns).alias("d"), Q.command_fault(**columns).alias("f")).collect():
        want = json.dumps([1, r.t, "default", 50, "[1,2]", '{"a":true}', "2026-08-07T12:00:00.000000+00:00", 0, "{}", "finite", True, None, None], separators=(",", ":"), ensure_ascii=False)
        assert (r.d, r.f) == ((hashlib.sha256(want.encode()).hexdigest(), None) if r.t else (None, "EMPTY_TASK_NAME"))
    faults = lambda **k: df.limit(1).select(Q.command_fault(**(columns | k)).alias("f")).first().f
    assert faults(priority=F.lit(101)) == "INVALID_PRIORITY" and faults(delay_s=F.lit(-1)) == "INVALID_DELAY" and faults(class_key=F.lit("")) == "EMPTY_CLASS" and faults(rerun_of=F.lit("x")) == "INCOMPLETE_LINEAGE"


def test_canonical_json(spark):
    texts = ['{"b":1.50,"a":{"z":[1,2,{"y":null,"x":1e2}]}}', ' { "a" : {"z": [1, 2.0, {"x": 100.0e0, "y": null}]} , "b": 1.5 } ', '{"a":NaN}', '{"a":"NaN"}', '["\\"", -Infinity]', "{", None, "3"]
    got = [(r.c, r.f) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(Q.canonical_json(F.col("t")).alias("c"), Q.strict_fault(F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] == ('{"a":{"z":[1,2,{"x":100.0,"y":null}]},"b":1.5}', None)
    assert got[2:] == [(None, "NON_FINITE"), ('{"a":"NaN"}', None), (None, "NON_FINITE"), (None, "NOT_JSON"), (None, None), ("3", None)]


def test_uuids(spark):
    names = [f"name {i} é" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for space in (uuid.NAMESPACE_DNS, uuid.UUID(int=7)):
        assert all(r.u == str(uuid.uuid5(space, r.n)) for r in df.select("n", Q.uuid5(space, F.col("n")).alias("u")).collect())
    r = df.limit(1).select(Q.slot_uuid(uuid.NAMESPACE_URL, F.lit("nightly"), F.lit(datetime(2024, 5, 6, 7, 8, 9, 12)).cast("timestamp_ntz")).alias("u")).first()
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "nightly:2024-05-06T07:08:09.000012+00:00"))


def test_envelopes(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[]",), ("{",), (None,)], "t string").withColumn("e", E.encode(F.col("t")))
    assert [(r.t, r.d, r.f) for r in df.select("t", E.decode(F.col("e")).alias("d"), E.fault(F.col("e")).alias("f")).collect()] == [('{"a": 1}', '{"a": 1}', None), ("[]", "[]", None), ("{", None, None), (None, None, None)]
    bad = df.limit(1).withColumn("p", F.lit(bytes([0xFF, 0x7B])).cast("binary")).withColumn("e", F.col("e").withField("payload", F.col("p")).withField("digest", F.unhex(F.sha2("p", 256))))
    assert bad.select(E.fault(F.col("e")).alias("f")).first().f == "CORRUPT"
    b = lambda x: F.lit(x).cast("binary")
    s = df.limit(1).select(E.selected(b(b"c"), b(None)).alias("c"), E.selected(b(None), b(b"p")).alias("p"), E.selected(b(None), b(None)).alias("n"), E.selected(b(b"c"), b(b"p")).alias("both")).first()
    assert [tuple(x) for x in s] == [(b"c", "CANONICAL", None), (b"p", "ADMINISTRATIVE_PRIOR", None), (None, "NONE", None), (None, None, "CANONICAL_AND_PRIOR")]


def test_ways_to_end(spark):
    assert set(STATUS_OF_KIND) | {"LEGACY_TERMINAL"} == set(TERMINAL_KINDS) and set(STATUS_OF_KIND.values()) <= set(TASK_TERMINAL)
    nothing = spark.createDataFrame([], "task_id long, by string")
    for kind, to in (("WORKFLOW_CANCEL_CLAIM", "FAILED"), ("NO_SUCH", "FAILED"), ("LEGACY_TERMINAL", "RUNNING")):
        with pytest.raises(ValueError):
            K.end(nothing, nothing, nothing, to=to, kind=kind, source=["RUNNING"], as_of=F.lit(DAY))


def test_archive_rows_without_inputs(spark):
    live = spark.createDataFrame([(1, "t", "q", 5, 0, 3, "w", None, True, DAY, DAY, DAY)], "task_id long, task_name string, queue_name string, priority int, retry_count int, max_retries int, worker_id string, workflow_id long, is_workflow_task boolean, enqueued_at timestamp_ntz, started_at timestamp_ntz, created_at timestamp_ntz")
    ended = spark.createDataFrame([(1, "APPLIED", "FAILED", "FAIL_RUNNING", DAY), (2, "TASK_ABSENT", None, None, None)], "task_id long, outcome string, status string, kind string, terminal_at timestamp_ntz")
    tries = spark.createDataFrame([], "task_id long, " + ", ".join(f"{n} {'timestamp_ntz' if n.endswith('_at') else k}" for n, k in K.attempts.FIELDS.items()))
    [r] = K.archive_rows(ended, live, tries, spark.createDataFrame([], "task_id long")).collect()
    assert (r.status, r.class_key, r.result_version, r.result_digest, r.rerun_disposition, r.attempts, r.deferred) == ("FAILED", None, None, None, "NEVER_ELIGIBLE", "[]", True)


def test_places(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 101).alias("a"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 3).alias("b"))
    order = [F.col("b").desc_nulls_last(), F.col("a"), F.col("id")]
    got = M.places(rows, *order)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows.collect(), key=lambda r: (r.b is None, -(r.b or 0), r.a, r.id))
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.nth)] == [r.id for r in want] and sorted(r.nth for r in got.collect()) == list(range(1, 5001))
    assert M.places(rows.limit(0), *order).count() == 0


def test_health_of_classes(spark):
    leaves = spark.createDataFrame([("forever", "f", DAY, datetime(9999, 1, 1), True, False, True, "b", "b"), ("legal", "l", DAY, DAY, False, False, True, "b", "b"), ("short", "s", DAY, DAY + timedelta(days=1), True, True, True, "b", "b")], "class_key string, leaf_name string, lower_anchor timestamp_ntz, upper_anchor timestamp_ntz, relation_exists boolean, detach_pending boolean, id_index_exists boolean, cataloged_bound string, actual_bound string")
    classes = spark.createDataFrame([("forever", None), ("legal", None), ("short", 5)], "class_key string, keep_days int")
    asked = spark.createDataFrame([("forever",), ("legal",), ("short",), ("ghost",), ("ghost",)], "class_key string")
    blocked = leaves.select("leaf_name", F.lit(0).alias("blockers"))
    got = sorted((r.class_key, r.leaf_name or "", r.fault) for r in L.health_faults(asked, leaves, classes, blocked, F.lit(DAY).cast("timestamp_ntz")).collect())
    assert got == [("ghost", "", "CLASS_ABSENT"), ("short", "", "COVERAGE_BELOW_FLOOR"), ("short", "s", "DETACH_AWAITING_FINALIZE")]
