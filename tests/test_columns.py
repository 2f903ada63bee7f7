"""Queues, windows, durations and built definitions in columns, against the driver's own rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from taskloom.functions import scalars as S
from taskloom.operators import claim as C
from taskloom.operators import filters as B
from taskloom.operators import specs as G

NOW = datetime(2024, 1, 31)


def test_queue_order(spark):
    import json

    cases = [(["b", "a", "c"], {"a": 1}, {"c": 5}), (["b", "a"], {}, {}), (["b", "a"], {}, {"a": 1}), (["x", "y", "z"], {"x": 100, "z": 100}, {"y": 1}), ([], {"a": 1}, {})]
    texts = [json.dumps({"queues": q, "priority": p, "caps": c}) for q, p, c in cases] + ["{", None, "{}", '{"queues":["q"]}']
    got = C.ordered_queues(spark.createDataFrame(list(enumerate(texts)), "w int, t string"), "w", "t").collect()
    by = {i: [r.queue_name for r in sorted((r for r in got if r.w == i), key=lambda r: r.place)] for i in range(len(texts))}
    assert [by[i] for i in range(len(cases))] == [C.order_queues(*c) for c in cases] and [by[i] for i in range(5, 9)] == [[], [], [], ["q"]]


def test_queues_from_json(spark):
    df = spark.createDataFrame([(1, '[{"name":"a"},{"priority":3},{"name":"b","priority":2,"cap":0}]'), (2, "nope"), (3, None), (4, "[]")], "w int, t string")
    assert sorted(tuple(r) for r in C.queues_from_json(df, "w", "t").collect()) == [(1, "a", 100, None), (1, "b", 2, 0)]


def test_windows_and_pages(spark):
    r = random.Random(1)
    some = lambda: r.choice([None, NOW - timedelta(hours=r.randint(-10, 1000))])
    rows = [(some(), some(), r.randint(-1, 210), r.randint(-1, 510)) for _ in range(200)]
    df = spark.createDataFrame(rows, "since timestamp_ntz, until timestamp_ntz, size int, skip int")
    for x in df.select("*", B.window_of(F.col("since"), F.col("until"), F.lit(NOW).cast("timestamp_ntz")).alias("w"), B.page_ok(F.col("size"), F.col("skip")).alias("ok")).collect():
        try:
            assert (x.w.lower, x.w.upper) == B.resolve_window(NOW, x.since, x.until) and x.w.fault is None
        except ValueError as e:
            assert x.w.fault == ("EMPTY" if "empty" in str(e) else "TOO_LONG")
        if x.ok:
            B.check_page(x["size"], x.skip)
        else:
            with pytest.raises(ValueError):
                B.check_page(x["size"], x.skip)


def test_durations(spark):
    micros = [1, 999_999, 1_000_000, 59_999_999, 3_600_000_000, 86_399_999_999, 86_400_000_000, 172_800_000_001, 10**15, 0, -5, None]
    got = spark.createDataFrame([(m,) for m in micros], "m long").select("m", S.duration_text(F.col("m")).alias("t")).collect()
    assert all(r.t == (str(timedelta(microseconds=r.m)) if r.m and r.m > 0 else None) for r in got)


def test_built_definitions(spark):
    parts = [G.Part("a", times="n"), G.Part("b", ("a",)), G.Part("c", ("a", "b"), "m", each=False), G.Part("d", ("c",), "m", each=True)]
    nodes, edges = G.from_parameters(spark.createDataFrame([(1, 2, 2), (2, 0, 1), (3, None, -4)], "workflow_id int, n int, m int"), parts)
    assert sorted((r.workflow_id, r.task_index, r.node_id) for r in nodes.collect()) == [(1, 0, "a-0"), (1, 1, "a-1"), (1, 2, "b"), (1, 3, "c-0"), (1, 4, "c-1"), (1, 5, "d-0"), (1, 6, "d-1"), (2, 0, "b"), (2, 1, "c-0"), (2, 2, "d-0"), (3, 0, "b")]
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2, 0), (1, 2, 1), (1, 3, 0), (1, 3, 1), (1, 3, 2), (1, 4, 0), (1, 4, 1), (1, 4, 2), (1, 5, 3), (1, 6, 4), (2, 1, 0), (2, 2, 1)]
    with pytest.raises(ValueError):
        G.from_parameters(nodes, [G.Part("a", ("b",))])


def test_stale_worker_by_fractions_of_a_second(spark):
    ages = [(1, 119.0), (2, 120.0), (3, 120.000001), (4, 120.9), (5, 121.0)]
    rows = spark.createDataFrame([(k, NOW - timedelta(seconds=age)) for k, age in ages], "k int, snapshot_at timestamp_ntz")
    got = {r.k: r.stale for r in rows.select("k", B.stale_worker(F.lit(NOW).cast("timestamp_ntz")).alias("stale")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_merged_results_by_either_way(spark):
    kwargs = ['{"x":1,"a":1.50,"o":{"k":[1,2],"b":"{}"}}', ' { "z": 1e2 }', '{"dep":1,"e":2}', '{"o":{"dep":3},"a":0}', '{"a\\u0062":1}', "{}", "{ }", None, "null", '{"\u00e9":1,"b":2}', '{"a":"x","d":"y\\"z"}', '{"dep ":0,"de":0}']
    results = ['{"z":null,"a":[1,1.0,1e2,-0.0]}', "null", "12", '"t"', "bad", None, '1, "q":2', '""']
    rows = [(k, r, s) for k in kwargs for r in results for s in ("COMPLETED", "SKIPPED")]
    df = spark.createDataFrame(rows, "k string, r string, s string")
    got = df.select("k", "r", "s", S.merge_results(F.col("k"), "dep", F.col("s"), F.col("r")).alias("m")).collect()
    # a name with a hyphen goes by maps alone; "d-p" and "dep" sort alike among these keys
    maps = df.select(S.merge_results(F.replace("k", F.lit('"dep"'), F.lit('"d-p"')), "d-p", F.col("s"), F.col("r")).alias("m")).collect()
    want = [m.m.replace('"d-p"', '"dep"') for m in maps]
    for a, b in zip(got, want):
        if '"de"' not in (a.k or "") and a.k != '{"o":{"dep":3},"a":0}':
            assert a.m == b, a
    assert {a.m for a in got if a.k == '{"dep":1,"e":2}' and a.r == "12"} == {'{"dep":12,"e":2}'}
    assert {a.m for a in got if a.k == '{"o":{"dep":3},"a":0}' and a.r == "12"} == {'{"a":0,"dep":12,"o":{"dep":3}}'}
    assert {a.m for a in got if a.k == '{"dep ":0,"de":0}' and a.r == "null"} == {'{"de":0,"dep":null,"dep ":0}'}
    plans = df.select(S.merge_results(F.lit('{"x":1}'), "dep", F.col("s"), F.col("r")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plans
