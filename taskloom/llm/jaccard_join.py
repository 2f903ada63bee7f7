"""N-gram Jaccard join by parity sketches.

The shingles of a document are dealt to blocks by hash, and a block is known by the XOR of its shingles' codes. Two sets
that differ in d shingles differ in at most d blocks, so among d + 1 blocks one agrees. Documents are put in bands by set
size, which fixes the number of blocks; those near the upper end of a band are sketched in the next one too. Documents
that agree in a block are compared (blocks that many documents share are sent last, so that a common passage brings few
together), first each with the least of its block, then those that the links so far leave
apart, so that a group of n near copies needs about n comparisons, not n², unless many of them stay apart. Where many
documents of a block do and it halves the comparisons, only those that agree in a block of a second dealing too are compared: linked sets do, as the
same holds of any dealing. A pair is sifted by a parity sketch of 2048 bits, in which each shingle flips one, so that the
Hamming distance bounds the difference from below; then by its texts. Equal sets are linked at sight, and one of them
stands for all. One pass over the texts makes sets, blocks and sketches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import likely
from .common import LOWER_NP, ROW, Scratch, U, few, frequent, hot_above, join_by_key, materialize, mix, scratch, shingle_hashes, slices, utf8, with_row, word_hashes, words
from .components import components


@dataclass(frozen=True)
class Plan:
    """Shingles of k words; linked when |A & B| >= share * |A | B|."""

    k: int = 3
    share: Fraction = Fraction(9, 10)
    ratio: float = 1.75

    def tops(self, most: int) -> np.ndarray:
        """Upper ends of the bands, and one more. A set's partners are in its own band and the two beside it."""
        out = [1]
        for _ in iter(lambda: len(out) > 1 and out[-2] >= most, True):
            out.append(max(out[-1] + 1, int(out[-1] * self.ratio), math.ceil(out[-1] / self.share)))
        return np.array(out)

    def needs(self, size: np.ndarray, top: int | np.ndarray) -> np.ndarray:
        """One more than the shingles in which a set of `size` may differ from a linked one of up to `top`."""
        p, q = self.share.numerator, self.share.denominator
        return (size + np.minimum(size * q // p, top)) * (q - p) // (q + p) + 1

    def blocks(self, top: int, room: float = 1) -> int:
        """Blocks of a band: as few as leave enough of them with two shingles or more, so that they hold much; `room` times those needed at least."""
        need = int(self.needs(np.array([top]), top)[0])
        n = math.ceil(need * room)
        while n < top / 1.8:  # more blocks than these hold less
            strong = n - n * math.exp(-top / n) * (1 + top / n)
            if strong >= need + 2 * (strong * (n - strong) / n) ** 0.5:
                break
            n += 1
        return n


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's set of k-word shingles, sorted; with fewer words the whole sequence is one."""
    starts, ends, at = words(data, offsets)
    h = word_hashes(data, starts, ends, 3)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    runs = shingle_hashes(h, k, 3)
    inside = text[: len(runs)] == text[k - 1 :] if len(runs) else np.zeros(0, bool)
    of, got = text[: len(runs)][inside], runs[inside]
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        if len(which):
            whole = shingle_hashes(h, short, 50 + short)
            of, got = np.concatenate((of, which)), np.concatenate((got, whole[at[which]]))
    order = np.lexsort((got, of))
    of, got = of[order], got[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (got[1:] != got[:-1])
    of, got = of[first], got[first]
    return got, np.searchsorted(of, np.arange(len(n) + 1))


def _first(which: np.ndarray, owner: np.ndarray, base: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of the marked blocks the first `need` of each owner."""
    seen = np.concatenate(([0], np.cumsum(which)))
    return which & (seen[1:] - seen[base][owner] <= need[owner])


def _blocks(sets: np.ndarray, bounds: np.ndarray, plan: Plan, dealing: int, room: float = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """For a set's own band, and for the next one, the blocks of the sets that are in it, empty ones too: (numbers of those sets, need of
    each, place of its first block; of each block the place of its set among these, shingles, key)."""
    size = np.diff(bounds)
    if not len(sets):
        return
    tops = plan.tops(int(size.max()))
    band = np.searchsorted(tops, size)
    code = mix(sets)
    dealt = mix(sets ^ U(dealing)) if dealing else sets
    sides = [(band, size > 0)]
    # the next band holds sets that may be this much larger
    sides.append((band + 1, (size > 0) & (size * plan.share.denominator > tops[band] * plan.share.numerator)))
    table = {int(b): plan.blocks(int(tops[b]), room) for b in np.unique(np.concatenate((band, band + 1))) if b < len(tops)}
    for side, use in sides:
        which = np.flatnonzero(use)
        if not len(which):
            continue
        counts = np.array([table[b] for b in side[which].tolist()])
        need = plan.needs(size[which], tops[side[which]])
        base = np.cumsum(counts) - counts
        total = int(counts.sum())
        lengths = size[which]
        owner = np.repeat(np.arange(len(which)), lengths)
        pick = np.repeat(bounds[which], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = base[owner] + ((dealt[pick] >> U(32)) * counts[owner].astype(U) >> U(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, codes = place[order], code[pick][order]
        heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        xor, held = np.zeros(total, U), np.zeros(total, np.int64)
        xor[place[heads]] = np.bitwise_xor.reduceat(codes, heads)
        held[place[heads]] = np.diff(np.concatenate((heads, [len(place)])))
        owner_of = np.repeat(np.arange(len(which)), counts)
        nth = np.arange(total) - base[owner_of]
        with np.errstate(over="ignore"):
            key = mix(xor ^ mix(nth.astype(U) * U(0x9E3779B1) + side[which][owner_of].astype(U) * U(0xC2B2AE3D27D4EB4F)))
        yield which, need, base, owner_of, held, key


def sketches(sets: np.ndarray, bounds: np.ndarray, plan: Plan, dealing: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, key) for every block to be sent, in one of several independent dealings of shingles to blocks.

    A set that may differ from a linked one in d blocks sends its first d + 1 strong ones (two shingles or more). One of
    them is the same in the other set; of two sets that do so, take the one whose last is earlier, and the other sends
    it too. A set with fewer strong blocks sends these all and the first d + 1 that aren't empty; failing that, all.
    """
    out_of, out_key = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for which, need, base, owner_of, held, key in _blocks(sets, bounds, plan, dealing):
        many, many_strong = _first(held > 0, owner_of, base, need), _first(held > 1, owner_of, base, need)
        strong_enough, enough = (np.bincount(owner_of[m], minlength=len(which)) >= need for m in (many_strong, many))
        send = np.where(strong_enough[owner_of], many_strong, ~enough[owner_of] | many | (held > 1))
        out_of.append(which[owner_of[send]])
        out_key.append(key[send])
    return np.concatenate(out_of), np.concatenate(out_key)


#: Blocks of the first dealing, as a multiple of those that a set may have to send, so that common ones can be left out.
ROOM = 1.25


def ordered(sets: np.ndarray, bounds: np.ndarray, plan: Plan) -> tuple[pa.Array, pa.Array]:
    """For each set the keys of its blocks, strong ones (two shingles or more) first, and three numbers for each of its bands: how
    many it has to send, how many keys aren't of empty blocks, and how many there are. Of empty blocks only those it may have to send are there."""
    n = len(bounds) - 1
    of, side, kind, keys, sides = ([] for _ in range(5))
    for k, (which, need, base, owner_of, held, key) in enumerate(_blocks(sets, bounds, plan, 0, ROOM)):
        full = np.bincount(owner_of, held > 0, len(which)).astype(np.int64)
        nth_empty = np.cumsum(held == 0) - np.concatenate(([0], np.cumsum(held == 0)))[base][owner_of]
        use = (held > 0) | (nth_empty <= (need - full)[owner_of])
        of.append(which[owner_of[use]])
        side.append(np.full(len(of[-1]), k))
        kind.append(2 - np.minimum(held[use], 2))
        keys.append(key[use])
        sides.append((which, np.stack((need, full, np.bincount(owner_of[use], minlength=len(which))), axis=1)))
    if not of:
        return (pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind)) for kind in (pa.int64(), pa.int32()))
    of, side, kind, keys = (np.concatenate(x) for x in (of, side, kind, keys))
    order = np.lexsort((kind, side, of))
    whose, numbers = np.concatenate([x for x, _ in sides]), np.concatenate([x for _, x in sides])
    by = np.argsort(whose, kind="stable")
    ends = lambda x, width: pa.array((np.searchsorted(x, np.arange(n + 1)) * width).astype(np.int32))
    return (pa.ListArray.from_arrays(ends(of[order], 1), pa.array(keys[order].view(np.int64))),
            pa.ListArray.from_arrays(ends(whose[by], 3), pa.array(numbers[by].reshape(-1).astype(np.int32))))


def sent(every: pa.ListArray, sides: pa.ListArray, common: np.ndarray, tier: np.ndarray) -> pa.ListArray:
    """Of each set's keys (see ordered()) those it sends: as many as it has to in each band, common ones last, by tier.

    If two sets differ in d blocks at most, and each sends its first d + 1 keys in an order that is the same for all sets,
    then they send one in common: of the keys they share, the first one has no more than d before it in either set. Which
    order that is changes no result. common: sorted.
    """
    keys = every.flatten().to_numpy()
    need, full, count = sides.flatten().to_numpy().reshape(-1, 3).astype(np.int64).T
    band = np.repeat(np.arange(len(need)), count)
    nth = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
    rank = np.zeros(len(keys), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        rank = np.where(common[at] == keys, tier[at], rank)
    rank = np.where(nth < full[band], rank, 255)
    keys = keys[np.argsort(band * 256 + rank, kind="stable")][nth < need[band]]
    held = np.concatenate(([0], np.cumsum(np.minimum(need, count))))
    bands = sides.value_lengths().to_numpy() // 3
    return pa.ListArray.from_arrays(pa.array(held[np.concatenate(([0], np.cumsum(bands)))].astype(np.int32)), pa.array(keys))


#: Bits of the sketch by which pairs are sifted before their texts are compared, as longs; and of the one that moves with a block's documents.
SKETCH, NARROW = 32, 8
#: The second dealing; and a block is dealt by it too if it leaves more documents apart than this many times their keys, as then keys are fewer than comparisons.
SECOND, MANY = 0x3C6EF372, 4
#: Keys are counted in one of so many documents; those found so often there are common, of which no more than MOST_COMMON are told apart.
PART, OFTEN, MOST_COMMON = 16, 4, 1 << 18
#: Each starred comparison after the first is followed by another only if less than this is left of what it was to compare.
GAIN, TURNS = 0.9, 2
#: So many of a document's keys, the least ones of each dealing, go with it, so that two documents needn't meet in each block that they share.
LEAST = 4


def folded(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each set's parity sketch of SKETCH * 64 bits, [sets, SKETCH]: every shingle flips one bit."""
    n = len(bounds) - 1
    bit = (mix(sets ^ U(0x5851F42D4C957F2D)) >> U(64 - 11)).astype(np.int64)
    assert SKETCH * 64 == 1 << 11
    flips = np.zeros((n, SKETCH * 64), bool)
    for a in range(0, n, 256):  # counts of a part of the sets at a time
        lo, hi = bounds[a], bounds[min(a + 256, n)]
        of = np.repeat(np.arange(min(256, n - a)), np.diff(bounds[a : a + 257]))
        flips[a : a + 256] = np.bincount(of * (SKETCH * 64) + bit[lo:hi], minlength=min(256, n - a) * SKETCH * 64).reshape(-1, SKETCH * 64) & 1
    return np.packbits(flips, axis=1).view(np.int64)


def _fits(plan: Plan) -> Column:
    """On na, nb: the sizes allow a link."""
    return F.least("na", "nb") * plan.share.denominator >= F.greatest("na", "nb") * plan.share.numerator


def _narrower(sketch: Column, width: int) -> Column:
    """The parity sketch of so many longs that the longer one folds to."""
    return F.array(*(reduce(lambda x, y: x.bitwiseXOR(y), (sketch[i] for i in range(k, SKETCH, width))) for k in range(width)))


def _may_link(plan: Plan, sketches: list[tuple[Column, Column]] | None = None) -> Column:
    """On na, nb, sa, sb: so do the sketches, which differ in no more bits than linked sets may; or those of the given longs."""
    p, q = plan.share.numerator, plan.share.denominator
    sketches = sketches or [(F.col("sa")[i], F.col("sb")[i]) for i in range(SKETCH)]
    far = reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseXOR(y)) for x, y in sketches))
    return _fits(plan) & (far * (p + q) <= (F.col("na") + F.col("nb")) * (q - p))


def _wholes(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A digest of each set."""
    return [hashlib.sha256(sets[a:b]).digest()[:16] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def _linked(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, plan: Plan) -> DataFrame:
    """Those of pairs (a, b) whose texts are linked. Only their texts move, found in docs (id, text) by id and set; a text
    that many pairs share goes to them as Spark splits its part of the join."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            whole = _wholes(*shingle_sets(LOWER_NP[data], offsets, plan.k))
            new = []
            for x in zip(batch.column("id").to_pylist(), whole):
                new.append(x not in seen)
                seen.add(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(whole, pa.binary()), batch.column("text")], ["id", "whole", "text"]).filter(pa.array(new, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text_b", 2 << 20):
                sides = []
                for c in ("text_a", "text_b"):
                    column = batch.column(c).dictionary_encode()
                    data, offsets = utf8(column.dictionary)
                    sides.append((column.indices.to_numpy(), *shingle_sets(LOWER_NP[data], offsets, plan.k)))
                (ia, sa, ba), (ib, sb, bb) = sides
                keep = []
                for i, j in zip(ia.tolist(), ib.tolist()):
                    x, y = sa[ba[i] : ba[i + 1]], sb[bb[j] : bb[j + 1]]
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(common > 0 and common * plan.share.denominator >= plan.share.numerator * (len(both) - common))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    pairs = materialize(pairs.select("a", "b").distinct(), "sifted")
    want = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(firsts, "set").select(F.col("set").alias("node"), F.col("first").alias("id"), "whole")
    want = materialize(want, "want")
    found = likely(docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text"), want, "id", wanted, "id long, whole binary, text string")
    bodies = materialize(found.join(want, ["id", "whole"]).groupBy("node").agg(F.any_value("text").alias("text")), "bodies")
    text = lambda x: bodies.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """(node, id, n_shingles, whole, every, sides, others, sketch) of each row of docs (id, text), written: node is a number of its
    own for the row, whole a digest of its set, every and sides as from ordered(), others the keys of the second dealing."""

    def dealt(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
        of, key = sketches(sets, bounds, plan, SECOND)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(bounds))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            sets, bounds = shingle_sets(LOWER_NP[data], offsets, plan.k)
            whole = _wholes(sets, bounds)
            bits = pa.array(folded(sets, bounds).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(whole, pa.binary()), *ordered(sets, bounds, plan), dealt(sets, bounds),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(bounds), dtype=np.int32) * SKETCH), bits)],
                ["id", "n_shingles", "whole", "every", "sides", "others", "sketch"])

    made = docs.mapInArrow(read, "id long, n_shingles long, whole binary, every array<long>, sides array<int>, others array<long>, sketch array<long>")
    return materialize(with_row(made), "sets").withColumnRenamed(ROW, "node")


def _common(sets: DataFrame) -> DataFrame:
    """(key, n), written: the keys that a part of the documents shows to be common, and about how many documents have them."""
    part = sets.where(F.pmod(F.xxhash64("node"), F.lit(PART)) == 0).select(F.explode("every").alias("key"))
    counted = materialize(part.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).withColumn("n", F.col("n") * PART), "common")
    return frequent(counted, "n", MOST_COMMON) if counted.count() > MOST_COMMON else counted


def _sender(common: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes keys, those that are sent, of the columns every and sides. The common keys go to all tasks, MOST_COMMON at most."""
    rows = common.select("key", F.log2(F.col("n") / (OFTEN * PART)).cast("int").alias("tier")).sort("key").toArrow()
    known = common.sparkSession.sparkContext.broadcast((rows.column("key").to_numpy(), rows.column("tier").to_numpy().astype(np.int64) + 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sent(batch.column("every"), batch.column("sides"), *known.value)
            yield batch.drop_columns(["every", "sides"]).append_column("keys", keys)

    return send


def _meets(keyed: DataFrame, common: DataFrame) -> DataFrame:
    """(key, node, first): rows of keyed (key, node) with the least node of their key, but for that itself. Keys that
    common (key, n) shows to be hot are joined with their least, so that their rows don't gather."""
    bucket = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    cold, found = keyed, []
    if least := hot_above(common):
        cold = keyed = materialize(keyed, "keyed")
        hot = materialize(common.where(F.col("n") > least).select("key"), "hot")
        lows = materialize(keyed.join(few(hot), "key").groupBy("key").agg(F.min("node").alias("first")), "lows")
        found.append(keyed.join(few(lows), "key").select("key", "node", "first"))
        cold = keyed.join(few(hot), "key", "left_anti")
    found.append(cold.withColumn("first", F.first("node").over(bucket)))
    return materialize(reduce(DataFrame.unionByName, found).where("node <> first"), "meets")


def _least(keys: str) -> Column:
    return F.slice(F.array_sort(keys), 1, LEAST).alias(keys)


def _dealt_again(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members (key, node, width, keys, others, and more) with `other`: in blocks with many members once for each of their
    keys in the second dealing, which nodes (node, others) have, if that halves the comparisons (near copies would only
    meet again and again); once with 0 in the rest. keys and others, the node's least ones of each dealing, become those
    below the row's own."""
    many = members.groupBy("key").agg(F.count("*").alias("held"), F.max("width").alias("width")).where(F.col("held") > MANY * F.col("width"))
    many = materialize(many.select("key", "held"), "many")
    every = members.select("key", "node").join(many, "key").join(nodes.select("node", "others"), "node").select("key", "held", F.explode("others").alias("other"))
    each = every.groupBy("key", "other").agg(F.count("*").alias("n"), F.max("held").alias("held"))
    large = each.groupBy("key").agg(F.sum(F.col("n") * F.col("n")).alias("again"), F.max("held").alias("held")).where(F.col("again") * 2 < F.col("held") * F.col("held"))
    large = materialize(large.select("key", F.lit(True).alias("large")), "large")
    below = lambda of, own: F.filter(of, lambda x: x < F.col(own))
    marked = members.join(large, "key", "left").drop("width").withColumn("keys", below("keys", "key"))
    marked = materialize(marked, "marked")
    again = marked.where("large").drop("large").join(nodes.select("node", F.col("others").alias("every")), "node").withColumn("other", F.explode("every")).drop("every")
    again = again.withColumn("others", below("others", "other"))
    alone = marked.where("large is null").drop("large").withColumn("other", F.lit(0).cast("long")).withColumn("others", F.array().cast("array<long>"))
    return alone.unionByName(again)


def _across(members: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of different components that meet in a block of members (see _dealt_again()) and may be linked by their
    narrow sketches. A pair is passed over where a lesser key of both is known: in that block it meets too, or else, as no
    key of the second dealing is shared, it isn't linked. So most pairs come once, not once for each two keys they share."""

    def side(x: str, own: str, none: Column | None = None) -> list[Column]:
        """The sketch and the known keys in columns of their own, which makes short code for each pair; `none` (else the row's own key, which
        none of the lesser ones is) where there are fewer."""
        known = [F.coalesce(F.get(kind, F.lit(i)), F.col(of) if none is None else none).alias(f"{kind}_{x}{i}") for kind, of in (("keys", "key"), ("others", "other")) for i in range(LEAST)]
        return [F.col(own).alias(x), F.col("part").alias(f"part_{x}"), F.col("nb").alias(f"n{x}"), *known, *(F.col("sb")[i].alias(f"s{x}{i}") for i in range(NARROW))]

    odd = members.where("part <> low").select("key", "other", *side("a", "node"))
    members = members.select("key", "other", (F.col("part") == F.col("low")).alias("main"), *side("b", "node", F.lit((1 << 63) - 1)))
    across = (F.col("part_a") != F.col("part_b")) & (F.col("main") | (F.col("a") < F.col("b")))
    known = reduce(lambda x, y: x | y, (F.col(f"{kind}_a{i}") == F.col(f"{kind}_b{j}") for kind in ("keys", "others") for i in range(LEAST) for j in range(LEAST)))
    may = _may_link(plan, [(F.col(f"sa{i}"), F.col(f"sb{i}")) for i in range(NARROW)])
    return odd.join(members, (odd["key"] == members["key"]) & (odd["other"] == members["other"]) & across & ~known & may).select("a", "b")


def jaccard_classes(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    component_id is the least id reachable over links, the document's own included. Texts without a word and null
    texts have no shingles and link with nothing. Rows that repeat an id are one document (their texts are linked);
    a row with a null id keeps a null component_id and links nothing. Very long texts are compared whole. No rows give no
    rows. Other columns are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with scratch(docs.sparkSession) as own:
        out = _classes(base, plan, own).withColumnRenamed("id", id_col)
        own.only(out)
    return out


def _classes(base: DataFrame, plan: Plan, own: Scratch) -> DataFrame:
    """(id, n_shingles, component_id) of each row of base (id, text). See jaccard_classes()."""
    sets = _sets(base, plan)
    usable = sets.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    # of equal sets one stands for all
    firsts = materialize(usable.groupBy("whole").agg(F.min("id").alias("first"), F.min(F.struct("id", "node")).alias("low"), F.count("*").alias("n")).select("whole", "first", F.col("low.node").alias("set"), "n"), "firsts")
    rows = materialize(join_by_key(usable.select("node", "id", "n_shingles", "whole"), firsts.select("whole", "set"), ["whole"]).drop("whole"), "rows")
    # different sets of one id are linked, and equal ones; of large groups of equal sets only one goes on
    several = rows.groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("high")).where("a < high").drop("high")
    same = join_by_key(rows.select("id", F.col("set").alias("b")), several, ["id"]).where("a <> b").select("a", "b").distinct()
    kept = usable.select("node", "every", "sides")
    copies = rows.where("node <> set").select("node", "set")
    if least := hot_above(firsts):
        large = few(materialize(firsts.where(F.col("n") > least).select("whole", "set"), "large"))
        kept = usable.join(large, "whole", "left").where("set is null or node = set").select("node", "every", "sides")
        copies = copies.join(large.select("set"), "set", "left_anti")
    stands = materialize(copies, "stands")
    same = materialize(same.unionByName(stands.select(F.col("set").alias("a"), F.col("node").alias("b"))), "same")

    def standing(table: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            table = table.join(stands.select(F.col("node").alias(c), F.col("set").alias("stand")), c, "left").withColumn(c, F.coalesce("stand", c)).drop("stand")
        return table.distinct()

    common = _common(usable)
    send = _sender(common)
    meets = _meets(kept.mapInArrow(send, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node"), common)
    met = standing(meets.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "a", "b").where("a <> b")
    met = materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    own_node = likely(sets.select("node", F.col("n_shingles").alias("n"), "others", "sketch", "every", "sides"), met.select(F.explode(F.array("a", "b")).alias("node")), "node", send, "node long, n long, others array<long>, sketch array<long>, keys array<long>")
    nodes = materialize(own_node.withColumn("keys", _least("keys")), "nodes")

    def sifted(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that may be linked by size, then by sketch."""
        size = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"))
        bits = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
        sized = pairs.join(size("a"), "a").join(size("b"), "b").where(_fits(plan))
        sized = materialize(sized.select("a", "b", "na", "nb"), "sized")
        return sized.join(bits("b"), "b").join(bits("a"), "a").where(_may_link(plan)).select("a", "b")

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        """parts (node, part) with the components that links (a, b) connect made one: a component is a node of a smaller graph."""
        of = lambda x: parts.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}"))
        known = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        edges = known.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")).where("a <> b")
        moved = components(edges).select(F.col("node").alias("part"), "component")
        every = parts.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("part")))
        return materialize(every.join(moved, "part", "left").select("node", F.coalesce("component", "part").alias("part")), "parts")

    def apart(members: DataFrame, parts: DataFrame) -> DataFrame:
        """(key, node, part, low, held): the blocks whose documents aren't all connected yet; part is a document's component, low the least in its block, which has `held`."""
        now = materialize(members.select("key", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "now")
        ends = now.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("held")).where("low <> high").drop("high")
        return materialize(join_by_key(now, ends, ["key"]), "apart")

    links = _linked(sifted(met), base, firsts, plan)
    parts = materialize(components(links.unionByName(same)).select("node", F.col("component").alias("part")), "parts")
    held = (sets, firsts, rows, stands, same, nodes)  # the other tables go when a round is over
    own.only(*held, meets, parts)
    members = meets.select("key", "node").unionByName(meets.select("key", F.col("first").alias("node")).distinct())
    members = materialize(standing(apart(members, parts), "node"), "members")
    before, left = math.inf, members.agg(F.sum("held")).first()[0]
    # each with another document of its block, picked by hash: groups whose first document is an outlier close here
    for turn in range(1, TURNS + 1):
        if not left or left > GAIN * before:
            break
        picks = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "part")).alias("pick"))
        picked = join_by_key(members, picks, ["key"]).where("part <> pick.part")
        pairs = materialize(picked.select(F.least("pick.node", "node").alias("a"), F.greatest("pick.node", "node").alias("b")).distinct(), "picked")
        parts = joined(parts, materialize(_linked(sifted(pairs), base, firsts, plan), "links"))
        members = apart(members, parts)
        own.only(*held, members, parts)
        before, left = left, members.agg(F.sum("held")).first()[0]
    if left:
        # all that a block still leaves apart is compared by sketch across components, then by text: no link is missed
        members = members.drop("held").join(nodes.select("node", F.col("n").alias("nb"), F.size("others").alias("width"), "keys", _least("others"), _narrower(F.col("sketch"), NARROW).alias("sb")), "node")
        rest = _across(materialize(_dealt_again(members, nodes), "dealt"), plan).distinct()
        parts = joined(parts, materialize(_linked(sifted(materialize(rest, "rest")), base, firsts, plan), "links"))
    # a component's id is the least of its documents'
    label = firsts.join(parts.withColumnRenamed("node", "set"), "set", "left").select("set", "first", F.coalesce("part", "set").alias("part"))
    label = materialize(label, "label")
    least = label.groupBy("part").agg(F.min("first").alias("component_id"))
    ids = join_by_key(label.select("set", "part"), least, ["part"]).drop("part")
    linked = join_by_key(rows.select("id", "n_shingles", "set"), ids, ["set"]).select("id", "n_shingles", "component_id")
    others = sets.where(F.col("id").isNull() | (F.col("n_shingles") == 0)).select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(others)
