"""Streams with timers over files in several batches, against the rules in plain Python."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest

from taskloom.streaming import timed as T
from taskloom.streaming.events import notification_stream


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in T.PROVIDER}
    for k, v in T.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


START = datetime(2024, 1, 1)
SCHEMA = "key string, fingerprint string, at timestamp, ending boolean"


def rule(batches, window):
    """Of each key: rows of a batch by time, requests first; held until the end and for a window after it."""
    held, out = {}, []
    for batch in batches:
        for key, fingerprint, s, ending in sorted(batch, key=lambda r: (r[2], r[3])):
            if key in held and held[key][1] is not None and held[key][1] <= s:
                del held[key]
            if ending:
                if key in held and held[key][1] is None:
                    held[key][1] = s + window
            elif key not in held:
                held[key] = [fingerprint, None]
                out.append((key, s, "APPLIED"))
            else:
                out.append((key, s, "REPLAY" if fingerprint == held[key][0] else "CONFLICT"))
    return sorted(out)


def test_reservations(rocks, tmp_path):
    r = random.Random(2)
    batches = [[("a", "x", 0, False), ("a", "x", 5, False), ("a", "y", 6, False), ("b", None, 1, True)], [("a", None, 40, True), ("a", "y", 50, False), ("a", None, 55, True)], [("a", "y", 61, False), ("a", "y", 61, False)], [("a", None, 70, True), ("a", "z", 89, False), ("a", "z", 90, False)]]
    for n, batch in enumerate(batches):
        batch += [(r.choice("cdef"), r.choice("xy"), 25 * n + r.randint(0, 24), r.random() < 0.3) for _ in range(25)]
    seen = {}
    for batch in batches:  # no two rows of a key at one moment, whose order would be open
        batch[:] = [row for row in batch if seen.setdefault((row[0], row[2], row[3]), row) is row or row[0] in "ab"]
    for n, batch in enumerate(batches):
        rows = [(k, f, START + timedelta(seconds=s), e) for k, f, s, e in batch]
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = T.reservations(stream.where("not ending").select("key", "fingerprint", "at"), stream.where("ending").select("key", "at"), 20, "10 minutes")
    q = out.writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = sorted((x.key, int(x.at_ms / 1000 - START.timestamp()), x.outcome) for x in rocks.table("held").collect())
    assert got == rule(batches, 20) and {x[2] for x in got} == {"APPLIED", "REPLAY", "CONFLICT"}


def test_state_goes_with_the_watermark(rocks, tmp_path):
    """After the window the key's timer clears its state: a later query over the checkpoint finds no row of it."""
    def put(rows):
        rocks.createDataFrame([(k, f, START + timedelta(seconds=s), e) for k, f, s, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = T.reservations(stream.where("not ending").select("key", "fingerprint", "at"), stream.where("ending").select("key", "at"), 20, "5 seconds")
        assert out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(240)

    put([("a", "x", 0, False), ("a", None, 10, True), ("b", "x", 0, False)])
    run()
    put([("c", "x", 500, False)])
    run()
    put([("c", "x", 501, False)])
    run()
    left = rocks.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c")).select("key.key").collect()
    assert sorted(r.key for r in left) == ["b", "c"]


def test_debounce(rocks, tmp_path):
    """Topics open their own windows; a repeated id counts once, and a topic over the limit is told without ids."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        (tmp_path / name).write_text("".join(json.dumps({"channel": c, "id": i, "seq": n}) + "\n" for c, i, n in rows))
        (tmp_path / name).rename(folder / name)

    put("1.json", [("task_changes", str(i % 3), i) for i in range(9)] + [("workflow_changes", str(i), i) for i in range(30)] + [("other", "1", 1)])
    q = T.debounced_topics(notification_stream(rocks, str(folder)), 250, 20).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for n in (2, 5):
            for _ in range(240):
                if rocks.table("frames").count() >= n:
                    break
                time.sleep(0.25)
            if n == 2:
                put("2.json", [("task_changes", "7", 10), ("worker_changes", "w", 11), ("workflow_changes", "9", 12)])
    finally:
        q.stop()
    got = sorted((r.topic, r.ids, r.overflow) for r in rocks.table("frames").collect())
    assert got == [("tasks", ["0", "1", "2"], False), ("tasks", ["7"], False), ("workers", ["w"], False), ("workflows", [], True), ("workflows", ["9"], False)]
