"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all have the same length and a larger inner product is a smaller distance. Each
row is stored under the key (nearest pivot, distance to it), in cells of bounded size: intervals of that key. A query's
distance to a pivot bounds its distance to all rows of a cell, so cells lie in annuli around the query. Scans widen over
them, nearest first, until the bound of what is left shows that no row there can be among those asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, bucketed, materialize, scratch, with_row

#: Rows of the sample that pivots are fitted on (those with the least hashes), pivots at most, rings of a pivot at most.
SAMPLE, PIVOTS, RINGS = 4096, 32, 64
#: Bytes of vectors in a cell (a ring with more is dealt out to several), and of the queries that scan the cells at a time.
CELL_BYTES, WAVE_BYTES = 4 << 20, 32 << 20
#: Cells of the first scan of a query; each further one takes four times as many.
FIRST = 4
SCALE = 256


@dataclass(frozen=True)
class Rule:
    """Positives and negatives of each, and the least share of the positive's score in hundredths."""

    positives: int = 5
    negatives: int = 5
    share: int = 80


def _ints(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit integers from a column of their bytes, shorter ones with zeros at the end."""
    sizes = np.array([len(b) // 8 for b in column.to_pylist()], np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(column.to_pylist()), "<i8")
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, in the narrowest kind of number that holds every partial sum."""
    d = min(a.shape[1], b.shape[1])  # what is beyond is zero on one side
    a, b = a[:, :d], b[:, :d]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1)
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    raise ValueError("an inner product may not fit a 64-bit integer")


def _quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 x) of each component as bytes, zeros at the end left out, and the squared length."""
    for batch in batches:
        v = batch.column("v")
        n, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
        x = np.floor(flat * SCALE)
        if len(x) and np.abs(x).max() >= 2.0**62:
            raise ValueError("a component does not fit a 64-bit integer")
        x = x.astype("<i8")
        ends = np.cumsum(n)
        rows = [x[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        rows = [r[: int(np.flatnonzero(r)[-1]) + 1] if r.any() else r[:0] for r in rows]
        norm = np.array([float((r.astype(float) ** 2).sum()) for r in rows])
        yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(norm, pa.float64())], [ROW, "id", "label", "vec", "norm"])


def pivots(vectors: np.ndarray, k: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Centres of vectors, fitted by a few rounds of k-means from rows far from each other."""
    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    far, chosen = np.full(len(vectors), np.inf), [0]
    while len(chosen) < min(k, len(vectors)):
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    centres = vectors[chosen].copy()
    for _ in range(rounds):
        near = _distances(vectors, centres).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = vectors[near == j].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T), 0))


@dataclass(frozen=True)
class Space:
    """The augmented space: pivots, the squared length of all rows in it, and the cells by ring."""

    centres: np.ndarray
    length: float
    pivot: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    #: First cell of each ring, and one past its last.
    cell: np.ndarray | None = None
    past: np.ndarray | None = None

    def augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        wide = np.zeros((len(v), self.centres.shape[1] - 1))
        wide[:, : v.shape[1]] = v[:, : wide.shape[1]]
        return np.concatenate((wide, np.sqrt(np.maximum(self.length - (v**2).sum(1), 0))[:, None]), 1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that any row of a ring can score with each query; rounding makes them no tighter."""
        q = q.astype(float)
        own = (q**2).sum(1)
        flat = np.zeros((len(q), self.centres.shape[1]))
        flat[:, : q.shape[1]] = q[:, : flat.shape[1] - 1]
        d = _distances(flat, self.centres)[:, self.pivot]
        slack = 1e-6 * (1 + np.sqrt(own + self.length))[:, None]
        near = np.maximum(np.maximum(d - self.high, self.low - d) - slack, 0)
        far = d + self.high + slack
        top, low = ((own[:, None] + self.length - x**2) / 2 for x in (near, far))
        return top + 1, low - 1


def build_index(rows: DataFrame, sample: int = SAMPLE, n_pivots: int = PIVOTS, rings: int = RINGS, cell_bytes: int = CELL_BYTES) -> tuple[DataFrame, Space]:
    """Every row with its key: cell, dist, id, label, vec, _row, as a table in buckets of cells; and the space.

    rows: _row, id, label, vec, norm. Pivots are fitted on the `sample` rows with the least hashes of their vectors;
    they and the rings (n_pivots x rings at most) are all that comes to the driver.
    """
    spark = rows.sparkSession
    length = rows.agg(F.max("norm")).first()[0] or 0.0
    picked = _ints(rows.select("vec").orderBy(F.xxhash64("vec")).limit(sample).toArrow().column("vec"))
    wide = rows.agg(F.max(F.length("vec"))).first()[0] or 0
    cell = max(cell_bytes // max(wide, 1), 1)
    picked = np.pad(picked, ((0, 0), (0, wide // 8 - picked.shape[1])))
    blank = Space(np.zeros((1, wide // 8 + 1)), length)
    space = Space(pivots(blank.augmented(picked), n_pivots), length)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(space.augmented(_ints(batch.column("vec"))), space.centres)
            near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (ROW, "id", "label", "vec")), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near], pa.float64())], [ROW, "id", "label", "vec", "pivot", "dist"])

    placed = materialize(rows.mapInArrow(keyed, f"{ROW} long, id long, label long, vec binary, pivot int, dist double"), "keyed")
    cuts = placed.groupBy("pivot").agg(F.percentile_approx("dist", F.array(*(F.lit(i / rings) for i in range(1, rings))), F.lit(10 * rings)).alias("cuts"), F.count("*").alias("n"))
    # no more rings than cells are needed for the rows of a pivot
    fewer = F.expr(f"array_distinct(filter(cuts, (c, i) -> (i + 1) % greatest(1, cast({rings} * {cell} / n as int)) = 0))")
    ringed = placed.join(F.broadcast(cuts.select("pivot", fewer.alias("cuts"))), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    found = sorted(map(tuple, ringed.groupBy("pivot", "ring").agg(F.min("dist"), F.max("dist"), F.count("*")).collect()))
    n = np.array([-(-f[4] // cell) for f in found], np.int64)
    past = np.cumsum(n)
    space = Space(space.centres, length, np.array([f[0] for f in found], np.int64), np.array([f[2] for f in found]), np.array([f[3] for f in found]), past - n, past)
    of = spark.createDataFrame([(f[0], f[1], int(a), int(k)) for f, a, k in zip(found, space.cell, n)], "pivot int, ring int, first long, cells long")
    celled = ringed.join(F.broadcast(of), ["pivot", "ring"]).withColumn("cell", F.col("first") + F.pmod(F.xxhash64(ROW), F.col("cells")))
    return bucketed(celled.select("cell", "dist", ROW, "id", "label", "vec"), "cell", "distance_keys"), space


def _best(score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score descending, then by id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over = np.flatnonzero(score >= least)
        return over[np.lexsort((id_[over], -score[over]))[:k]]
    return np.lexsort((id_, -score))


NO_LEAST, NO_MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query long, slot int, score long, id long, row long"


def search(queries: DataFrame, index: DataFrame, space: Space, k: int, same: bool, first: int = FIRST, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(query, slot, score, id, row): of each slot of a query, the first k rows by score, then id and row, with floor <= score <= cap.

    queries: query, label, vec and slots, an array of (slot, floor, cap). same: rows of the query's label, else of others.
    So many queries go at a time as a task can hold, should all of them scan one cell.
    """
    queries = materialize(queries, "asked")
    waves = -(-(queries.agg(F.sum(F.length("vec") + 64)).first()[0] or 1) // wave_bytes)
    found = [_widen(queries.where(F.pmod(F.xxhash64("query"), F.lit(waves)) == w), index, space, k, same, first) for w in range(waves)]
    return reduce(DataFrame.unionByName, found)


def _widen(queries: DataFrame, index: DataFrame, space: Space, k: int, same: bool, first: int) -> DataFrame:
    """See search()."""
    spark = queries.sparkSession
    empty = spark.createDataFrame([], FOUND)

    def plan(step: int):
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                top, low = space.bounds(_ints(batch.column("vec")))
                seen, todo = batch.column("seen").to_numpy(), []
                again = []
                for i, slots in enumerate(batch.column("slots").to_pylist()):
                    least, most = min(s["floor"] for s in slots), max(s["cap"] for s in slots)
                    order = np.argsort(-top[i], kind="stable")
                    left = order[seen[i] :]
                    cut = int(np.searchsorted(-top[i][left], -least, side="right"))  # beyond it, all score less
                    now = left[: min(step, cut)]
                    again.append(seen[i] + len(now) if len(now) < cut else len(order))
                    now = now[(low[i][now] <= most) | (most == NO_MOST)]
                    todo.append([c for r in now.tolist() for c in range(space.cell[r], space.past[r])])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "label", "vec", "slots")), pa.array(np.array(again), pa.int32()), pa.array(todo, pa.list_(pa.int64()))], ["query", "label", "vec", "slots", "seen", "cells"])

        return cells

    def scan(_, asked: pa.Table, there: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if asked.num_rows and there.num_rows:
            q, x = _ints(asked.column("vec").combine_chunks()), _ints(there.column("vec").combine_chunks())
            ids, rows, labels = (there.column(c).to_numpy() for c in ("id", ROW, "label"))
            by = np.lexsort((rows, ids))
            x, ids, rows, labels = x[by], ids[by], rows[by], labels[by]
            own = asked.column("label").to_numpy()
            queries, slots = asked.column("query").to_numpy(), asked.column("slots").to_pylist()
            for a in range(0, len(q), 256):
                score = _product(q[a : a + 256], x)
                for i in range(len(score)):
                    fits = labels == own[a + i] if same else labels != own[a + i]
                    for s in slots[a + i]:
                        at = np.flatnonzero(fits & (score[i] >= s["floor"]) & (score[i] <= s["cap"]))
                        at = at[_best(score[i][at], at, k)]  # rows lie in order of their ids
                        for o, v in zip(out, ([queries[a + i]] * len(at), [s["slot"]] * len(at), score[i][at], ids[at], rows[at])):
                            o.extend(v)
        return pa.table([pa.array(np.array(o, np.int64)).cast(t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["query", "slot", "score", "id", "row"])

    state, best, step = queries.withColumn("seen", F.lit(0)), empty, first
    kind = "query long, label long, vec binary, slots array<struct<slot:int,floor:long,cap:long>>, seen int, cells array<long>"
    of_slot = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id", "row")
    with scratch(spark) as own:
        while True:
            state = materialize(state.mapInArrow(plan(step), kind), "scans")
            if not state.where(F.size("cells") > 0).take(1) and not state.where(F.col("seen") < len(space.cell)).take(1):
                own.only(best)
                return best
            asked = state.select("query", "label", "vec", "slots", F.explode("cells").alias("cell"))
            found = asked.groupBy("cell").cogroup(index.groupBy("cell")).applyInArrow(scan, FOUND)
            ranked = best.unionByName(found).withColumn("place", F.row_number().over(of_slot)).where(F.col("place") <= k)
            best = materialize(ranked.drop("place"), "found")
            # a slot that has k rows asks for no less than the last of them
            full = best.groupBy("query", "slot").agg(F.min("score").alias("last"), F.count("*").alias("n")).where(F.col("n") == k)
            full = full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("last"))
            state = state.join(full, "query", "left").select("query", "label", "vec", F.expr("transform(slots, s -> named_struct('slot', s.slot, 'floor', greatest(s.floor, coalesce(last[s.slot], s.floor)), 'cap', s.cap))").alias("slots"), "seen")
            step *= 4


def hard_negatives(vectors: DataFrame, anchor: str, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", rule: Rule | None = None, first: int = FIRST, wave_bytes: int = WAVE_BYTES, **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; index: see build_index().

    anchor: SQL condition on `id`, which rows are anchors. Components are taken as floor(256 x), scores are integer
    inner products, higher first, then smaller ids. An anchor's positives are its first other rows of the same label;
    each one's negatives are the first rows of other labels that score at most as much as it, and `share` hundredths of
    that at least. Anchors without positives, and positives without such rows, give no rows.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Rows that repeat an id
    are different rows, which only their contents tell apart in the result. Missing components of shorter vectors are
    zero. Scores beyond 64 bits are refused. No rows give no rows; other columns are ignored, whatever their names. Of rows equal
    in label and vector, no more are stored than any answer can need, those with the least ids: further ones would come
    after them in every order. Equal anchors are searched for once.
    """
    rule = rule or Rule()
    most = max(rule.positives + 1, rule.negatives)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    used = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"))
    used = used.where("id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    with scratch(vectors.sparkSession) as own:
        rows = materialize(with_row(used).select(ROW, "id", "label", "v").mapInArrow(_quantized, f"{ROW} long, id long, label long, vec binary, norm double"), "vectors")
        alike = Window.partitionBy("label", "vec").orderBy("id", ROW)
        stored = materialize(rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= most).drop("place"), "stored")
        keys, space = build_index(stored, **index)

        anchors = rows.where(F.expr(anchor)).select(ROW, "id", "label", "vec")
        asked = materialize(anchors.groupBy("label", "vec").agg(F.min(ROW).alias("query")), "queries")
        anchors = materialize(anchors.join(asked, ["label", "vec"]).select(F.col(ROW).alias("self"), F.col("id").alias("anchor_id"), "query"), "anchors")
        slot = lambda s, floor, cap: F.struct(F.lit(s).cast("int").alias("slot"), floor.cast("long").alias("floor"), cap.cast("long").alias("cap"))
        open_ = asked.withColumn("slots", F.array(slot(0, F.lit(NO_LEAST), F.lit(NO_MOST))))
        near = search(open_, keys, space, rule.positives + 1, True, first, wave_bytes)
        # each anchor leaves itself out; which of equal anchors that is changes no score, see below
        of_anchor = Window.partitionBy("self").orderBy(F.desc("score"), "id", "row")
        positives = anchors.join(near, "query").where(F.col("row") != F.col("self")).withColumn("slot", F.row_number().over(of_anchor)).where(F.col("slot") <= rule.positives)
        positives = materialize(positives.select("self", "anchor_id", "query", "slot", F.col("id").alias("positive_id"), "score"), "positives")
        # equal anchors have positives of equal scores: leaving out any of several rows of one score leaves the same scores
        scores = positives.select("query", "score").distinct()
        part = F.floor(F.col("score") * F.lit(100 - rule.share).cast("decimal(3,0)") / 100).cast("long")
        wanted = scores.where("score >= 0").withColumn("slot", F.row_number().over(Window.partitionBy("query").orderBy("score"))).withColumn("floor", F.col("score") - part)
        by_query = wanted.groupBy("query").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("floor").cast("long").alias("floor"), F.col("score").cast("long").alias("cap"))).alias("slots"))
        negatives = search(asked.join(by_query, "query"), keys, space, rule.negatives, False, first, wave_bytes)
        negatives = negatives.join(materialize(wanted.select("query", F.col("slot").cast("int").alias("slot"), F.col("score").alias("positive_score")), "wanted"), ["query", "slot"])
        place = F.row_number().over(Window.partitionBy("query", "positive_score").orderBy(F.desc("score"), "id", "row"))
        negatives = materialize(negatives.select("query", "positive_score", place.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
        out = positives.withColumnRenamed("score", "positive_score").join(negatives, ["query", "positive_score"])
        out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
        own.only(out)
    return out
