"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are normalised to words; the automaton of all items (split into blocks of bounded size) is streamed over each
document's words, which gives the longest match ending at each word. A match of `window` words, or of a whole
shorter item, is a hit; hit spans are removed, and documents hit beyond a coverage limit can be dropped whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, U, boxed, materialize, mix, narrow, shingle_hashes, slices, texts, utf8, with_row, word_hashes, words

#: A word is `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. In UTF-8, these bytes: 0-9, a-z, 80-FF.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = np.frombuffer(TO_WORDS, np.uint8) != 0x20
#: Words of test items in one automaton: about 0.5 KB each, so some 100 MB in a task.
BLOCK_WORDS = 200_000


class Automaton:
    """The suffix automaton of some items. Matching keeps (state, length); what ends in a state says which items hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        # equal items are one, so that states don't hold each of them
        equal: dict[tuple[bytes, ...], list[str]] = {}
        for i, item in items:
            equal.setdefault(tuple(item), []).append(i)
        items = [(ids, item) for item, ids in equal.items()]
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        holds: list[set[int]] = [set()]
        short: list[list[tuple[int, int]]] = [[]]
        for k, (_, item) in enumerate(items):
            last = 0
            for w in item:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab) + 1), holds, short)
                holds[last].add(k)
        for k, (_, item) in enumerate(items):
            if 0 < len(item) < window:
                state = 0
                for w in item:
                    state = self.next[state][self.vocab[w]]
                short[state].append((len(item), k))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            if self.length[self.link[v]] >= window:  # of shorter ones nobody asks
                holds[self.link[v]] |= holds[v]
        #: By state: items that hold its suffix of `window` words, and (length, item) of short items that end in it.
        self.full: list[tuple[int, ...]] = [()] * len(self.link)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.full[v] = self.full[up] if self.length[up] >= window else tuple(sorted(holds[v]))
            self.short[v] = self.short[up] + tuple(short[v])
        self.least = min([window, *(len(item) for _, item in items if item)])
        #: The ids of each different item.
        self.ids = [ids for ids, _ in items]

    def _extend(self, last: int, c: int, holds: list, short: list) -> int:
        nxt, link, length = self.next, self.link, self.length

        def new(trans: dict, up: int, n: int) -> int:
            nxt.append(trans), link.append(up), length.append(n), holds.append(set()), short.append([])
            return len(nxt) - 1

        def split(p: int, q: int) -> int:
            clone = new(dict(nxt[q]), link[q], length[p] + 1)
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        own, p = new({}, 0, length[last] + 1), last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = own
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[own] = q if length[q] == length[p] + 1 else split(p, q)
        return own

    def match(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(hit spans of words, unmerged; numbers of items with occurring windows)"""
        codes = np.fromiter(map(self.vocab.get, found, iter(lambda: 0, 1)), np.int64, len(found))
        known = np.concatenate(([0], (codes > 0).astype(np.int8), [0]))
        turns = np.flatnonzero(np.diff(known))
        spans, items = [], set()
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a < self.least:
                continue
            state, n = 0, 0
            for at, c in enumerate(codes[a:b].tolist(), a + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                if (to := self.next[state].get(c)) is not None:
                    state, n = to, n + 1
                if n >= self.window:
                    spans.append((at - self.window, at))
                    items.update(self.full[state])
                for m, k in self.short[state]:
                    if n >= m:
                        spans.append((at - m, at))
                        items.add(k)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, item_id: str, item_text: str, most: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Lists of items with about `most` words in all, read one partition at a time: the driver holds one block. A longer
    item comes in pieces that share all but one word of a window, so that each window is whole in one."""
    block, held = [], 0
    for r in narrow(items, item_id, item_text).select(F.col(item_id).cast("string"), item_text).toLocalIterator():
        found = (r[1] or "").encode().translate(TO_WORDS).split()
        most = max(most, 2 * window)
        for a in range(0, max(len(found) - window + 1, 1), most - window + 1):
            block.append((r[0] if r[0] is not None else "", found[a : a + most]))
            held += len(block[-1][1])
            if held >= most:
                yield block
                block, held = [], 0
    if block:
        yield block


#: Bits of the filter of windows for each of them, at least and at most (32 MB), and how many of them a window sets.
FILTER_BITS, FILTER_LEAST, FILTER_MOST, FILTER_HASHES = 32, 1 << 20, 1 << 28, 4


def _runs(data: np.ndarray, offsets: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text of each, number of words of each text) of the runs of m words in each text."""
    data = np.frombuffer(TO_WORDS, np.uint8)[data]
    starts, ends, at = words(data, offsets)
    h, n = word_hashes(data, starts, ends, 31), np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    runs = shingle_hashes(h, m, 31 + m)
    inside = text[: len(runs)] == text[m - 1 :] if len(runs) else np.zeros(0, bool)
    return runs[inside], text[: len(runs)][inside], n


def _bits(runs: np.ndarray, bits: int) -> np.ndarray:
    """[FILTER_HASHES, runs]: the bits of each run."""
    with np.errstate(over="ignore"):
        return np.array([(mix(runs + U(k) * U(0xC2B2AE3D27D4EB4F)) >> U(65 - bits.bit_length())).astype(np.int64) for k in range(FILTER_HASHES)])


def window_filter(items: DataFrame, item_text: str, window: int) -> tuple[np.ndarray, list[int]]:
    """(filter, lengths): a Bloom filter of all windows of the items, and how many words they have. It only spares work: a
    full one lets every document pass."""
    text = narrow(items, item_text).select(F.col(item_text).alias("text"))

    def spread(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            for m in range(1, window + 1):
                runs, of, n = _runs(data, offsets, m)
                runs = np.unique(runs if m == window else runs[n[of] == m])
                if len(runs) and not bits:
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([len(runs)], pa.int64())], ["at", "bits"])
                elif len(runs):
                    b = _bits(runs, bits).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(b >> 6), pa.array((U(1) << (b & 63).astype(U)).view(np.int64))], ["at", "bits"])

    counts = text.mapInArrow(lambda x: spread(x, 0), "at long, bits long").groupBy("at").agg(F.sum("bits").alias("n")).collect()
    bits = FILTER_LEAST
    while bits < FILTER_BITS * sum(r["n"] for r in counts) and bits < FILTER_MOST:
        bits *= 2
    got = text.mapInArrow(lambda x: spread(x, bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(U), sorted(r["at"] for r in counts)


def sifted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Adds the number of words, and makes texts null that the filter says hold no window."""
    bloom, lengths = shared.value
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        maybe, n = np.zeros(batch.num_rows, bool), np.diff(words(np.frombuffer(TO_WORDS, np.uint8)[data], offsets)[2])
        for m in lengths:
            runs, of, _ = _runs(data, offsets, m)
            b = _bits(runs, len(bloom) * 64)
            hit = np.ones(len(runs), bool)
            for one in b:
                hit &= (bloom[one >> 6] >> (one & 63).astype(U) & U(1)).astype(bool)
            maybe[of[hit]] = True
        text = pc.if_else(pa.array(maybe), batch.column("text"), pa.scalar(None, batch.column("text").type))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), text], [*batch.schema.names[:-1], "n_words", "text"])


def hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    automaton = shared.value
    for batch in slices(batches, "text"):
        spans, items, count = [], [], []
        for t in texts(batch.column("text")):
            found = t.translate(TO_WORDS).split()
            s, k = automaton.match(found)
            spans.append([x for ab in merged(s) for x in ab])
            items.append(sorted({i for n in k for i in automaton.ids[n]}))
            count.append(len(found))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[:-1], "n_words", "spans", "items"])


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, carry_text: bool = False) -> DataFrame:
    """One row per input row: id (and text if carry_text), n_words, spans (start, end of merged hit runs of words, flat), items (ids as sorted strings).

    Null texts have no words. An empty benchmark hits nothing. Items without words are ignored; equal items all count.
    Very long texts and items are matched whole; rows that repeat are matched each. No rows give no rows. Other columns
    are ignored. One block of items needs no shuffle. With more, one pass over the documents finds those that may hold a
    window, by a filter of all items' windows, and the blocks go over these alone; what they find is merged by row.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    automata = (spark.sparkContext.broadcast(Automaton(block, window)) for block in blocks(items, item_id, item_text, block_words, window))
    first = next(automata, None) or spark.sparkContext.broadcast(Automaton([], window))
    second = next(automata, None)
    shown = [F.col("text").alias("shown")] if carry_text else []
    of = f"id {kind}, {'shown string, ' * carry_text}n_words long"
    if second is None:
        return base.select("id", *shown, "text").mapInArrow(lambda b: hits(b, first), f"{of}, spans array<long>, items array<string>")
    bloom = spark.sparkContext.broadcast(window_filter(items, item_text, window))
    rows = materialize(with_row(base.select("id", *shown, "text").mapInArrow(lambda b: sifted(b, bloom), f"{of}, text string")), "sifted")
    some = rows.where("text is not null").select(ROW, "text")

    def one(shared) -> DataFrame:
        found = some.mapInArrow(lambda b: hits(b, shared), f"{ROW} long, n_words long, spans array<long>, items array<string>")
        return materialize(found.where(F.size("spans") > 0).drop("n_words"), "hits")

    every = one(first)
    for shared in (second, *automata):
        every = every.unionByName(one(shared))
    every = every.withColumn("spans", F.expr("transform(sequence(0, size(spans) - 1, 2), i -> struct(spans[i] as a, spans[i + 1] as b))"))
    both = every.groupBy(ROW).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = F.aggregate("spans", F.expr("cast(array() as array<bigint>)"), lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"])))).otherwise(F.concat(acc, F.array(s["a"], s["b"]))))
    out = rows.drop("text").join(both.withColumn("spans", join), ROW, "left")
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    return out.select("id", *(["shown"] if carry_text else []), "n_words", F.coalesce("spans", none("bigint")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated. See find_hits() for nulls and empty tables."""
    total = F.aggregate(F.expr("transform(spans, (x, i) -> if(i % 2 = 0, -x, x))"), F.lit(0).cast("long"), lambda a, x: a + x)
    return find_hits(docs, items, id_col, **how).select(
        F.col("id").alias(id_col), "n_words", total.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without(text: bytes, spans: list[int]) -> bytes:
    """The text without the given runs of words, from each run's first byte to its last."""
    data = np.frombuffer(text, np.uint8)
    solid = np.concatenate(([0], WORD[data].astype(np.int8), [0]))
    turns = np.flatnonzero(np.diff(solid)).tolist()
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at : turns[2 * a]])
        at = turns[2 * b - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.5, **how) -> DataFrame:
    """The documents with hit spans removed from their texts and all columns kept; those with more than `coverage` of their words hit go.

    Documents without a hit are returned unchanged. n_chars, where it is a column, follows the new text.
    """
    rows = materialize(boxed(docs), "rows")
    body = rows.select(ROW, F.col(f"doc.`{text_col}`").alias("text"))
    found = find_hits(body, items, ROW, "text", **how).where(F.size("spans") > 0).select(F.col("id").alias(ROW), "n_words", "spans")
    found = materialize(found, "found")
    total = F.aggregate(F.expr("transform(spans, (x, i) -> if(i % 2 = 0, -x, x))"), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("n_hit", total)
    clean = rows.join(found.select(ROW), ROW, "left_anti")
    kept = found.where(F.col("n_hit") <= coverage * F.col("n_words")).select(ROW, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [without(t, s) for t, s in zip(texts(batch.column("text")), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array([x.decode() for x in out], pa.string())], [ROW, "cleaned"])

    cleaned = body.join(kept, ROW).mapInArrow(cut, f"{ROW} long, cleaned string")
    new = {text_col: F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    changed = rows.join(cleaned, ROW).select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
    return clean.select("doc.*").unionByName(changed)
