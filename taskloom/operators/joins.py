"""Joins whose rows would else meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_by_key(rows: DataFrame, table: DataFrame, key: str, *spread: str) -> DataFrame:
    """rows left-joined with a table by `key`, of whole numbers. Rows with a null key find nothing; they are dealt out by the
    columns `spread`, where a plain join would send all of them to one task."""
    there = table.withColumnRenamed(key, "_key")
    at = F.coalesce(F.col(key), F.xxhash64(*spread))
    return rows.join(there, (at == F.col("_key")) & F.col(key).isNotNull(), "left").drop("_key")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys over as many tasks as shuffles have partitions. Adaptive execution merges other shuffles' parts up
    to a number of bytes, which for narrow rows is millions of rows in each sort and hash table of a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
