"""Substring dedup by seed and extend.

Winnowing picks anchors, k-word runs of which every window of `length` words holds one, the same in every document.
Anchors that documents share are seeds. A seed whose surroundings, as far as a window can reach, are those of an
earlier document is extended both ways over all of them at once; other shared seeds are extended a window at a time, as
far both ways as an earlier document has the same. Extensions that meet or overlap are joined to maximal repeats, which
are at least `length` words long, and their words go. A passage that m documents share takes m rows, not m².
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import likely
from .common import U, join_by_key, materialize, mix, slices, utf8, word_hashes, words

LENGTH, ANCHOR = 50, 16
LAST = (1 << 63) - 1


class Runs:
    """Hashes of any run of consecutive words, from sums of powers."""

    def __init__(self, h: np.ndarray, seed: int):
        n = len(h)
        base = U(0x9E3779B97F4A7C15 + 2 * seed) | U(1)
        inverse = U(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate(([U(1)], np.full(n, base, U))))
            self.back = np.cumprod(np.concatenate(([U(1)], np.full(n, inverse, U))))
            self.sums = np.concatenate(([U(0)], np.cumsum(h * powers[:n], dtype=U)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.back[a] ^ (b - a).astype(U) * U(0xD6E8FEB86659FD93))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(at: np.ndarray, runs: Runs, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among all words) of the winnowed k-word runs of texts with at least `length` words; equal least ones are all picked."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    total, span = len(text), length - k + 1
    if total < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(total - k + 1)
    value = runs.of(start, start + k)
    inside = (text[start] == text[start + k - 1]) & (n[text[start]] >= length)
    value[~inside] = U(0xFFFFFFFFFFFFFFFF)
    low = sliding_least(value, span)
    # a run is picked if it is the least of some window that holds it
    edge = np.zeros(span - 1, U)
    high = ~sliding_least(~np.concatenate((edge, low, edge)), span)
    picked = np.flatnonzero(inside & (value == high))
    return text[picked], picked


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, n_repeats (maximal repeated runs that went), and with_text the kept words joined by one space.

    A word goes if a window of `length` words over it also starts in a row with a smaller id; texts are judged as they
    came. Null texts have no words, and shorter texts lose none. Very long texts are judged whole. Null ids count as
    larger than all others. Rows that repeat an id don't count against each other. No rows give no rows. Other columns
    are ignored. Windows are compared by two 64-bit hashes of their words.
    """
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    base = docs.select(F.col(f"`{id_col}`").alias("doc"), number.alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("fp"), F.col(f"`{text_col}`").alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("anchor", pa.int64()), ("around", pa.int64())]))
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, ends, at = words(data, offsets)
            one, two = (Runs(word_hashes(data, starts, ends, s), s) for s in (11, 12))
            text, place = anchors(at, one, length, k)
            lo, hi = np.maximum(place - (length - k), at[text]), np.minimum(place + length, at[text + 1])
            with np.errstate(over="ignore"):
                around = mix(two.of(lo, hi) ^ (place - lo).astype(U))
            flat = pa.StructArray.from_arrays([pa.array((place - at[text]).astype(np.int32)), pa.array(one.of(place, place + k).view(np.int64)), pa.array(around.view(np.int64))], fields=list(kind.value_type))
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(at))).astype(np.int32)), flat)
            n = np.diff(at)
            raw = data.tobytes()
            cut = offsets.tolist()
            whole = [b" ".join(raw[a:b].split()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("id"), batch.column("fp"), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in whole], pa.string()), found], ["doc", "id", "fp", "n_words", "whole", "seeds"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = materialize(base.mapInArrow(seeds, f"doc {kind}, id long, fp long, n_words long, whole string, seeds array<struct<pos:int,anchor:long,around:long>>"), "seeds")
    every = made.select("id", "fp", F.explode("seeds").alias("s")).select("id", "fp", "s.pos", "s.anchor", "s.around")
    shared = every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.min("around") == F.max("around")).alias("alike")).where("low < high")
    near = materialize(join_by_key(every, shared.select("anchor", "alike"), ["anchor"]), "shared")
    first = near.groupBy("anchor", "around").agg(F.min("id").alias("low"))
    placed = join_by_key(near, first, ["anchor", "around"])
    reach = length - k
    whole = placed.where("low < id").select("id", "fp", (F.col("pos") - reach).alias("a"), F.col("pos").alias("b"))
    some = placed.where("low = id and not alike").groupBy("id", "fp").agg(F.collect_set("pos").alias("at"))
    bodies = materialize(likely(base.where(F.col("text").isNotNull()).select("id", "fp", "text"), near.select("id"), "id").distinct(), "bodies")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, ends, at = words(data, offsets)
            one, two = (Runs(word_hashes(data, starts, ends, s), s) for s in (21, 22))
            seeds = batch.column("at")
            pos = seeds.flatten().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), seeds.value_lengths().to_numpy())
            begins = np.zeros(len(starts) + 1, np.int32)  # +1 where a run of windows begins, -1 after its end
            lo, hi = at[text] + np.maximum(pos - reach, 0), at[text] + np.minimum(pos, np.diff(at)[text] - length)
            np.add.at(begins, lo, 1)
            np.add.at(begins, hi + 1, -1)
            w = np.flatnonzero(np.cumsum(begins)[:-1] > 0)
            of = np.searchsorted(at, w, side="right") - 1
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(one.of(w, w + length).view(np.int64)), pa.array(two.of(w, w + length).view(np.int64)), batch.column("id").take(take), batch.column("fp").take(take), pa.array((w - at[of]).astype(np.int32))], ["x", "y", "id", "fp", "a"])

    wins = materialize(bodies.join(some, ["id", "fp"]).mapInArrow(extend, "x long, y long, id long, fp long, a int"), "windows")
    early = wins.groupBy("x", "y").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    more = join_by_key(wins, early, ["x", "y"]).where("low < id").select("id", "fp", "a", F.col("a").alias("b"))
    spans = whole.unionByName(more).groupBy("id", "fp").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            raw, cut = data.tobytes(), offsets.tolist()
            gone, shas, kept, repeats = [], [], [], []
            for i in range(batch.num_rows):
                own = raw[cut[i] : cut[i + 1]].split()
                s = batch.column("spans")[i].values
                a, b = (s.field(c).to_numpy().astype(np.int64) for c in ("a", "b"))
                a, b = np.maximum(a, 0), np.minimum(b, len(own) - length)
                turn = np.zeros(len(own) + 1, np.int64)
                np.add.at(turn, a, 1)
                np.add.at(turn, b + length, -1)
                drop = np.cumsum(turn)[:-1] > 0
                gone.append(int(drop.sum()))
                repeats.append(int((np.diff(drop.astype(np.int8), prepend=0) == 1).sum()))
                left = b" ".join(w for w, d in zip(own, drop.tolist()) if not d)
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(gone, pa.int64()), pa.array(repeats, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], ["id", "fp", "n_removed", "n_repeats", "left", "kept"])

    cut = bodies.join(spans, ["id", "fp"]).mapInArrow(remove, "id long, fp long, n_removed long, n_repeats long, left string, kept string")
    out = made.select("doc", "id", "fp", "n_words", "whole").join(cut, ["id", "fp"], "left")
    text = []
    if with_text:
        plain = F.array_join(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
        out = out.join(base.select("id", "fp", "text").distinct(), ["id", "fp"])
        text = [F.coalesce("kept", plain, F.lit("")).alias("kept")]
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("left", "whole").alias("kept_sha256"), F.coalesce("n_repeats", F.lit(0).cast("long")).alias("n_repeats"), *text)
