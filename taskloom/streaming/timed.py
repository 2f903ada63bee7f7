"""Streams with state and timers by key: reservations whose window begins when the holder ends, and a debounce that a
topic's first event opens. They need the RocksDB state store (see PROVIDER)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import MOST_IDS, TOPICS

#: Settings that a session needs for these streams.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Reservations(StatefulProcessor):
    """One key: who holds it (fingerprint), and until when after the holder's end; -1 while it is still to end."""

    def __init__(self, window_s: int):
        self.window_ms = window_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "fingerprint string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], self.held.get() if self.held.exists() else None
        before = held and held[1]
        every = pd.concat(rows).sort_values(["at_ms", "ending"], kind="stable")
        for ending, fingerprint, at in zip(every["ending"], every["fingerprint"], every["at_ms"]):
            if held and 0 <= held[1] <= at:
                held = None  # the window had passed by then, whether or not its timer has fired
            if ending:
                if held and held[1] < 0:
                    held = (held[0], int(at) + self.window_ms)
            elif held is None:
                held = (fingerprint, -1)
                out.append((key[0], int(at), "APPLIED"))
            else:
                out.append((key[0], int(at), "REPLAY" if fingerprint == held[0] else "CONFLICT"))
        if before is not None and before >= 0 and (held is None or held[1] != before):
            self.handle.deleteTimer(before)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            if held[1] >= 0 and held[1] != before:
                self.handle.registerTimer(held[1])
        yield pd.DataFrame(out, columns=["key", "at_ms", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        if held and 0 <= held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        yield pd.DataFrame([], columns=["key", "at_ms", "outcome"])

    def close(self) -> None:
        pass


def reservations(requests: DataFrame, endings: DataFrame, window_s: int, lateness: str = "1 minute") -> DataFrame:
    """requests: key, fingerprint, at; endings: key, at, when the holder of a key has ended. (key, at_ms, outcome) of each
    request: APPLIED, or REPLAY or CONFLICT with the one that holds the key.

    A key is held until its holder ends and for window_s after that; then its state goes, when the watermark passes. An
    ending without a holder, or a second one, changes nothing. Rows of one trigger are taken in order of time, requests
    before endings of the same moment; rows later than `lateness` are dropped as Spark drops them.
    """
    both = requests.select("key", "fingerprint", "at", F.lit(False).alias("ending")).unionByName(endings.select("key", F.lit(None).cast("string").alias("fingerprint"), "at", F.lit(True).alias("ending")))
    timed = both.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", lateness)
    return timed.groupBy("key").transformWithStateInPandas(Reservations(window_s), "key string, at_ms long, outcome string", "append", "EventTime")


class Debounce(StatefulProcessor):
    """One topic: the ids since its window was opened, in order of arrival."""

    def __init__(self, wait_ms: int, most: int):
        self.wait_ms, self.most = wait_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "place int")
        self.n = handle.getValueState("n", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0] if self.n.exists() else 0
        if not n:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        for id_ in pd.concat(rows).sort_values("seq", kind="stable")["id"]:
            if n > self.most:
                break  # it is known to be too many: nothing more has to be kept
            if not self.ids.containsKey((id_,)):
                self.ids.updateValue((id_,), (n,))
                n += 1
        self.n.update((n,))
        yield pd.DataFrame([], columns=["topic", "ids", "overflow"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0] if self.n.exists() else 0
        ids = [k[0] for k, _ in sorted(self.ids.iterator(), key=lambda kv: kv[1][0])] if n <= self.most else []
        self.ids.clear()
        self.n.clear()
        yield pd.DataFrame([(key[0], ids, n > self.most)] if n else [], columns=["topic", "ids", "overflow"])

    def close(self) -> None:
        pass


def debounced_topics(events: DataFrame, wait_ms: int = 250, most: int = MOST_IDS) -> DataFrame:
    """events: channel, id, seq. (topic, ids, overflow): a topic's first event opens a window of wait_ms by the clock; what
    comes until it closes is one frame, distinct ids in order of arrival, none if there are more than `most`. The next
    event opens the next window. Topics don't wait for each other."""
    topic = F.create_map(*(F.lit(x) for kv in TOPICS.items() for x in kv))[F.col("channel")]
    named = events.select(topic.alias("topic"), "id", "seq").where("topic is not null")
    return named.groupBy("topic").transformWithStateInPandas(Debounce(wait_ms, most), "topic string, ids array<string>, overflow boolean", "append", "ProcessingTime")
