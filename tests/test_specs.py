"""Definitions of workflows, and snapshots of attempts."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from taskloom.functions import attempts as A
from taskloom.operators import specs as S
from taskloom.operators.specs import Node, Spec, as_rows, built, problems


def test_good_definition(spark):
    spec = Spec("w", (Node("a", "x"), Node("b", "y", (0,), {"v": 0}), Node("c", None, (0, 1), join="quorum", min_success=1)), output=2, cases={"ok": (0, 1)})
    assert problems(spec) == [] and as_rows(spec, spark.range(1)).count() == 3
    assert built(lambda n: Spec(n, (Node("a"),)), n="w").name == "w"


@pytest.mark.parametrize("spec,word", [
    (Spec("", (Node("a"),)), "name"), (Spec("w", ()), "no node"), (Spec("w", (Node("a", "x"), Node("b", "x"))), "twice"), (Spec("w", (Node("a"), Node("b", None, (5,)))), "isn't there"),
    (Spec("w", (Node("a"), Node("b", None, (1,)))), "itself"), (Spec("w", (Node("a"), Node("b", None, (2,)), Node("c", None, (1,)))), "circle"), (Spec("w", (Node("a"), Node("b", None, (), {"v": 0}))), "doesn't depend"),
    (Spec("w", (Node("a", join="quorum", min_success=1),)), "quorum"), (Spec("w", (Node("a", min_success=1),)), "quorum"), (Spec("w", (Node("a"),), output=4), "output"), (Spec("w", (Node("a"),), cases={"c": ()}), "case c"), (Spec("w", (Node("a", None, (0,)),)), "begin"),
])
def test_bad_definitions(spec, word):
    assert any(word in p for p in problems(spec))
    with pytest.raises(ValueError):
        built(lambda: spec)


def test_snapshots(spark):
    at = datetime(2024, 1, 1)
    row = lambda n: (n, "FAILED", n < 2, at, at, "E\"x", None, None, "w", None, 7, None)
    kind = "array<struct<attempt:int,outcome:string,will_retry:boolean,started_at:timestamp,finished_at:timestamp,error_code:string,error_message:string,failed_reason:string,worker_id:string,worker_hostname:string,worker_pid:int,worker_process_name:string>>"
    text = spark.createDataFrame([([row(2), row(1)],)], f"a {kind}").select(A.encode(F.col("a")).alias("t")).first().t
    assert text.startswith('[[1,"FAILED",true,1704067200000000,')
    rows = [(text, None), (text, "0"), ("[[1]]", None), ("{", None), (None, None), ("[]", None), (text, hashlib.sha256(text.encode()).hexdigest()), (text.replace("[[1", "[[3"), None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, d string").coalesce(1).select(A.fault(F.col("t"), F.col("d"))).collect()]
    assert got == [None, "DIGEST_MISMATCH", "FIELD_COUNT", "NOT_JSON", "MISSING", None, None, "NOT_CONTIGUOUS"]


def test_table_agrees_with_the_driver(spark):
    """Random definitions: circles and missing roots of the table are those of each definition by itself."""
    import random

    r = random.Random(4)
    flows, nodes, edges, want = [], [], [], set()
    for w in range(60):
        n = r.randint(1, 7)
        deps = [sorted({r.randint(0, n) for _ in range(r.choice([0, 0, 1, 1, 2]))}) for _ in range(n)]
        spec = S.Spec("flow", tuple(S.Node("task", f"n{i}", tuple(d)) for i, d in enumerate(deps)))
        flows.append((w, "flow", None))
        nodes += [(w, i, f"n{i}", "all", None) for i in range(n)]
        edges += [(w, i, d) for i, ds in enumerate(deps) for d in ds]
        want |= {(w, "CIRCLE")} if S.circle(spec) else set()
        want |= {(w, "NO_ROOT")} if all(deps) else set()
        want |= {(w, f) for i, ds in enumerate(deps) for d in ds for f in (["SELF"] if d == i else []) + (["RANGE"] if d >= n else [])}
    found = S.spec_faults(spark.createDataFrame(flows, "id long, name string, output_index int"), spark.createDataFrame(nodes, "workflow_id long, task_index int, node_id string, join_type string, min_success int"), spark.createDataFrame(edges, "workflow_id long, task_index int, dep long"))
    assert {(f.workflow_id, f.fault) for f in found.collect()} == want


def test_peeling_of_chains(spark):
    """A chain is peeled from both ends, two nodes at each, and a circle behind it stays."""
    rounds = []
    real = S.Steps.write
    S.Steps.write = lambda self, df: rounds.append(1) or real(self, df)
    try:
        nodes = spark.range(60).select((F.col("id") % 2).alias("workflow_id"), (F.col("id") / 2).cast("int").alias("task_index"))
        chain = nodes.where("task_index > 0").withColumn("dep", F.col("task_index") - 1)
        back = spark.createDataFrame([(1, 27, 29), (1, 27, 29)], "workflow_id long, task_index int, dep int")
        assert [r.workflow_id for r in S.circles(nodes, chain.unionByName(back)).collect()] == [1]
    finally:
        S.Steps.write = real
    assert len(rounds) <= 17
