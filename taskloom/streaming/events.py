"""Streams of change notifications: coalesced ids per topic, first-come windows, deduplication by key, liveness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Channel -> topic of a frame.
TOPICS = {"task_changes": "tasks", "workflow_changes": "workflows", "worker_changes": "workers"}
MOST_IDS = 100


def notifications(changes: DataFrame, channel: str, id_col: str, seq_col: str | None = None) -> DataFrame:
    """(channel, id, seq) of rows that changed; seq is their order of arrival, the id itself where none is named."""
    return changes.select(F.lit(channel).alias("channel"), F.col(id_col).cast("string").alias("id"), F.col(seq_col or id_col).cast("long").alias("seq"))


def notification_stream(spark: SparkSession, path: str) -> DataFrame:
    """The notifications that are written to a folder as JSON lines, as they come."""
    return spark.readStream.schema("channel string, id string, seq long").json(path)


def coalesce(events: DataFrame) -> DataFrame:
    """topic, ids: the distinct ids of a batch in order of arrival (seq); none if there are more than MOST_IDS (all is to be read anew)."""
    topic = F.create_map(*(F.lit(x) for kv in TOPICS.items() for x in kv))[F.col("channel")]
    distinct = events.select(topic.alias("topic"), "id", "seq").where("topic is not null").groupBy("topic", "id").agg(F.min("seq").alias("seq"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"])
    # a counted topic is listed only if it stays small, so no list grows with the stream
    small = distinct.groupBy("topic").agg(F.count("*").alias("n"))
    listed = distinct.join(small.where(F.col("n") <= MOST_IDS), "topic", "left_semi").groupBy("topic").agg(ids.alias("ids"))
    return small.join(listed, "topic", "left").select("topic", F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("ids"), (F.col("n") > MOST_IDS).alias("overflow"))


def frames(coalesced: DataFrame) -> DataFrame:
    return coalesced.select(F.to_json(F.struct("topic", "ids")).alias("frame"))


def debounced(events: DataFrame, sink, checkpoint: str, every: str = "250 milliseconds", once: bool = False):
    """Starts a query that hands each trigger's coalesced ids to `sink(df, epoch)`."""
    writer = events.writeStream.foreachBatch(lambda df, epoch: sink(coalesce(df), epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def first_of_key(events: DataFrame, key: str, at: str, window: str) -> DataFrame:
    """One event of each key within the window; replays go."""
    return events.withWatermark(at, window).dropDuplicatesWithinWatermark([key])


def reserved(requests: DataFrame, window_s: int, lateness: str = "1 minute") -> DataFrame:
    """requests: key, fingerprint, at. outcome of each: APPLIED, or REPLAY or CONFLICT with the one that holds the key for
    window_s. A key's state goes when the watermark passes the end of its window."""

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, until = state.get if state.exists else (None, None)
        rows = pd.concat(batches).sort_values("at", kind="stable")
        out = []
        for fingerprint, t in zip(rows["fingerprint"], rows["at"].astype("datetime64[s]").astype("int64")):
            if held is None or t >= until:
                held, until = fingerprint, int(t) + window_s
                out.append("APPLIED")
            else:
                out.append("REPLAY" if fingerprint == held else "CONFLICT")
        state.update((held, until))
        state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "outcome": out})

    timed = requests.withWatermark("at", lateness)
    return timed.groupBy("key").applyInPandasWithState(decide, "key string, outcome string", "fingerprint string, until long", "append", GroupStateTimeout.EventTimeTimeout)


def late(tasks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(in time, expired before they began)"""
    gone = F.col("good_until").isNotNull() & (F.col("good_until") <= as_of) & F.col("started_at").isNull()
    return tasks.where(~gone), tasks.where(gone)


def hourly(beats: DataFrame) -> DataFrame:
    """Heartbeats by task and hour of event time, with late ones up to ten minutes."""
    return beats.withWatermark("sent_at", "10 minutes").groupBy(F.window("sent_at", "1 hour"), "role").agg(F.count("*").alias("n"))
