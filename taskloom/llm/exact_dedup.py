"""Exact dedup by content-defined chunk recipes.

Each text (A-Z lower-cased) is cut where a rolling hash of its last bytes says so. Only digests of the chunks
move between machines: distinct (64-bit digest, SHA-256) pairs become verified identifiers, a text becomes its
ordered list of identifiers, and texts with equal lists are equal. Long documents themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_NP, ROW, U, boxed, join_by_key, materialize, mix, slices, utf8, with_row

#: The rolling hash sees this many bytes.
REACH = 16
LEAST, MOST, MEAN_BITS = 512, 16384, 11
GEAR = mix(np.arange(256, dtype=U)).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks. A cut depends on the REACH bytes before it, at least LEAST bytes after the last cut; MOST bytes at most."""
    gear, roll = GEAR[data], np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(min(REACH, len(data))):
            roll[j:] += gear[: len(data) - j] << np.uint32(j)
    marks = np.flatnonzero((roll >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    out, at = [], np.searchsorted(marks, offsets)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        ends, last = [], a
        for m in [*marks[at[k] : at[k + 1]].tolist(), b]:
            while m - last > MOST:
                ends.append(last := last + MOST)
            if m - last >= LEAST or m == b and m > last:
                ends.append(last := m)
        out.append(ends)
    return out


def recipes(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    keep = (1 << digest_bits) - 1
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        raw = memoryview((data := LOWER_NP[data]).tobytes())
        shas, chunks = [], []
        for a, b, ends in zip(offsets.tolist(), offsets[1:].tolist(), cuts(data, offsets)):
            shas.append(hashlib.sha256(raw[a:b]).hexdigest())
            own = []
            for e in ends:
                x = xxhash.xxh3_64_intdigest(raw[a:e]) & keep
                own.append({"digest": x - (1 << 64) if x >> 63 else x, "sha": hashlib.sha256(raw[a:e]).digest()})
                a = e
            chunks.append(own)
        kind = pa.list_(pa.struct([("digest", pa.int64()), ("sha", pa.binary())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(chunks, kind)], [ROW, "id", "text_sha256", "chunks"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all empty texts are equal.
    Of equal texts the row with the largest id stays (null ids come before all others); if rows repeat that id,
    one of them stays. No rows give no rows. Columns beside id and text are ignored. Very long texts are cut as all
    others, and never shuffled. digest_bits below 64 forces digest collisions, which verification resolves.
    """
    rows = with_row(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).select(ROW, "id", "text")
    return _classes(rows, docs.schema[id_col].dataType.simpleString(), digest_bits).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. See exact_dedup()."""
    rows = materialize(boxed(docs), "rows")
    judged = _classes(rows.select(ROW, F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text")), docs.schema[id_col].dataType.simpleString(), 64)
    return rows.join(judged.where(~F.col("kept")).select(ROW), ROW, "left_anti").select("doc.*")


def _classes(rows: DataFrame, kind: str, digest_bits: int) -> DataFrame:
    made = rows.mapInArrow(lambda b: recipes(b, digest_bits), f"{ROW} long, id {kind}, text_sha256 string, chunks array<struct<digest:long,sha:binary>>")
    made = materialize(made, "recipes")
    parts = made.select(ROW, F.posexplode("chunks").alias("pos", "chunk")).select(ROW, "pos", "chunk.digest", "chunk.sha")
    same = Window.partitionBy("digest").orderBy("sha")
    known = parts.select("digest", "sha").distinct().withColumn("nth", F.row_number().over(same))
    named = join_by_key(parts, known, ["digest", "sha"]).select(ROW, F.struct("pos", "digest", "nth").alias("chunk"))
    # an ordered list of identifiers by its digest, as it may be long
    lists = named.groupBy(ROW).agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    recipe = F.sha2(F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", F.hex(c["digest"]), c["nth"])), ",").cast("binary"), 256)
    listed = made.select(ROW, "id", "text_sha256").join(lists.select(ROW, recipe.alias("recipe")), ROW, "left")
    listed = materialize(listed.withColumn("recipe", F.coalesce("recipe", F.lit(""))), "lists")
    groups = listed.groupBy("recipe").agg(F.max(F.struct("id", ROW)).alias("last"), F.count("*").alias("group_size"))
    judged = join_by_key(listed, groups, ["recipe"])
    return judged.select(ROW, "id", F.col("last.id").alias("keep_id"), "group_size", (F.col(ROW) == F.col(f"last.{ROW}")).alias("kept"), "text_sha256")
