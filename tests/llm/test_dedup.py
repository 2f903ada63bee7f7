"""Exact dedup, the Jaccard join and substring dedup against plain Python."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import components as components_module
from taskloom.llm import jaccard_join
from taskloom.llm.components import components
from taskloom.llm.exact_dedup import exact_dedup, keep_one
from taskloom.llm.jaccard_join import Plan, jaccard_classes, sketches
from taskloom.llm.substring_dedup import substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def union(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, rows, bits):
    """Even if nearly all chunk digests collide."""
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    got = {r.doc_id: r for r in exact_dedup(docs, digest_bits=bits).collect()}
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_edges(spark, docs, nothing, rows):
    assert exact_dedup(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.keep_id, r.group_size, r.kept) for r in exact_dedup(twice).collect())
    assert got == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 2, False), (2, 2, True)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({(r[1] or "").translate(LOWER) for r in rows})


@pytest.mark.parametrize("many", [jaccard_join.MANY, 0])
@pytest.mark.parametrize("plan", [Plan(), Plan(5, Fraction(8, 10)), Plan(2, Fraction(1, 2))])
def test_jaccard_classes(docs, rows, plan, many, monkeypatch):
    """Also if every block that stays apart is dealt again."""
    monkeypatch.setattr(jaccard_join, "MANY", many)
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets[r[0]] = {tuple(w[i : i + plan.k]) for i in range(max(1, len(w) - plan.k + 1))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= plan.share * len(sets[a] | sets[b])]
    top = union(ids, pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, plan).collect()}
    assert got == {i: (len(sets[i]), top[i]) for i in ids}


def test_jaccard_large_group_of_near_copies(spark):
    """Links chain through a group whose ends don't link with each other."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i):
            w[j * 2] = f"changed{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(5)]
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), Plan()).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[100 + i] == 100 + i for i in range(5))


@pytest.mark.parametrize("many", [jaccard_join.MANY, 0])
def test_jaccard_common_passage(spark, many, monkeypatch):
    """Texts that share a passage of 40 words and are otherwise apart, with a near copy of each tenth."""
    monkeypatch.setattr(jaccard_join, "MANY", many)
    common = [f"c{i}" for i in range(40)]
    own = lambda i: [f"w{i}x{j}" for j in range(60)]
    rows = [(i, " ".join(common + own(i))) for i in range(300)] + [(1000 + i, " ".join([*common, *own(i)[:-1], "z"])) for i in range(0, 300, 10)]
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), Plan()).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def met(sets, plan, dealings):
    """The pairs of sets that agree in a block of each dealing."""
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    out = []
    for dealing in dealings:
        blocks = defaultdict(list)
        for i, key in zip(*(x.tolist() for x in sketches(np.concatenate(sets), bounds, plan, dealing))):
            blocks[key].append(i)
        out.append({(a, b) for held in blocks.values() for x, a in enumerate(held) for b in held[x + 1 :]})
    return set.intersection(*out)


def test_second_dealing():
    """Linked sets agree in both dealings; sets with a common passage seldom do."""
    r, plan, second = np.random.default_rng(1), Plan(), jaccard_join.SECOND
    drawn = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    common = drawn(38)
    fresh = [np.sort(np.concatenate((common, drawn(60)))) for _ in range(2000)]
    once, twice = met(fresh, plan, [0]), met(fresh, plan, [0, second])
    assert len(once) > 1000 and len(twice) * 100 < len(once)
    for size in (5, 30, 98, 400):
        for _ in range(20):
            base = drawn(size)
            other = base.copy()
            other[: size // 19] = drawn(size // 19)
            assert met([np.sort(base), np.sort(other)], plan, [0, second])


@pytest.mark.parametrize("many", [jaccard_join.MANY, 0])
def test_pairs_meet_once(spark, monkeypatch, many):
    """Sets that share most of their keys of both dealings come out of the last join once, not once for each two keys; none is lost."""
    monkeypatch.setattr(jaccard_join, "MANY", many)
    r, plan = np.random.default_rng(2), Plan()
    common = r.integers(0, 2**64, 188, dtype=np.uint64)
    sets = [np.sort(np.concatenate((common, r.integers(0, 2**64, 6, dtype=np.uint64)))) for _ in range(30)]
    flat, bounds = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    bits = jaccard_join.folded(flat, bounds)
    dealings = [sketches(flat, bounds, plan, d) for d in (0, jaccard_join.SECOND)]
    keys, others = ([key[of == i].view(np.int64).tolist() for i in range(30)] for of, key in dealings)
    rows = [(i, len(sets[i]), keys[i], others[i], bits[i].tolist()) for i in range(30)]
    nodes = spark.createDataFrame(rows, "node long, nb long, keys array<long>, others array<long>, sketch array<long>")
    least, sketch = jaccard_join._least, jaccard_join._narrower(F.col("sketch"), jaccard_join.NARROW)
    members = nodes.select("node", F.explode("keys").alias("key"), F.col("node").alias("part"), F.lit(0).cast("long").alias("low"), "nb", F.size("others").alias("width"), least("keys"), least("others"), sketch.alias("sb"))
    got = [tuple(sorted(x)) for x in jaccard_join._across(jaccard_join._dealt_again(members, nodes), plan).collect()]
    shared = [(a, b, len({*keys[a]} & {*keys[b]}), len({*others[a]} & {*others[b]})) for a in range(30) for b in range(a + 1, 30)]
    linked = {(a, b) for a, b, *_ in shared if len(np.intersect1d(sets[a], sets[b])) * 10 >= 9 * len(np.union1d(sets[a], sets[b]))}
    met_in = sum(k * (o if many == 0 else 1) for _, _, k, o in shared)
    assert len(linked) == 435 and linked <= set(got) and 4 * len(got) < met_in


def test_common_blocks_come_last(spark, monkeypatch):
    """Texts that share a passage hardly meet in its blocks, as they have others to send; their near copies are found."""
    plan, met = Plan(5, Fraction(8, 10)), {}
    common = [f"c{i}" for i in range(54)]
    own = lambda i: [f"w{i}x{j}" for j in range(46)]
    rows = [(i, " ".join(common + own(i))) for i in range(400)] + [(1000 + i, " ".join([*common, *own(i)[:-1], "z"])) for i in range(0, 400, 40)]

    def counting(df, name, write=jaccard_join.materialize):
        out = write(df, name)
        if name == "meets":
            met[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counting)
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    sets = [jaccard_join.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for _, t in rows]
    _, keys = sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), plan)
    unordered = len(keys) - len(np.unique(keys))
    assert unordered > 1500 and 4 * met["meets"] < unordered


@pytest.mark.parametrize("plan", [Plan(), Plan(5, Fraction(8, 10)), Plan(2, Fraction(1, 2))])
def test_any_order_of_keys(plan):
    """Linked sets send a key in common whatever keys count as common, also where blocks are empty or hold one shingle."""
    r, linked = np.random.default_rng(3), 0
    for n in [1, 2, 3, 5, 9, 14, 30, 75, 100, 400] * 8:
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        swap = r.integers(0, int(n * (1 - plan.share) / 2) + 2)
        b = np.unique(np.concatenate((a[: n - swap], r.integers(0, 2**64, r.integers(0, swap + 1), dtype=np.uint64))))
        if len(np.intersect1d(a, b)) < max(plan.share * len(np.union1d(a, b)), 1):
            continue
        linked += 1
        every, sides = jaccard_join.ordered(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), plan)
        shared = np.intersect1d(every[0].values.to_numpy(), every[1].values.to_numpy())
        for common in (shared[:0], shared, shared[r.random(len(shared)) < 0.5], np.unique(every.flatten().to_numpy())):
            one, two = jaccard_join.sent(every, sides, common, r.integers(1, 9, len(common))).to_pylist()
            assert {*one} & {*two}, n
            assert len(one) <= sides[0].values.to_numpy()[::3].sum()
    assert linked > 40


def test_jaccard_edges(spark, nothing):
    assert jaccard_classes(nothing, Plan()).count() == 0
    rows = [(5, "a b c d"), (5, "x y z"), (3, "A b  c D"), (None, "a b c d"), (7, None), (8, " "), (9, "x y z")]
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), Plan()).collect() if r.doc_id != None)  # noqa: E711
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 3)]
    # an id with two texts: the near copy of its second text is linked too
    one, two = " ".join(f"a{i}" for i in range(60)), [f"b{i}" for i in range(60)]
    rows = [(3, one), (5, one), (5, " ".join(two)), (7, " ".join([*two[:-1], "other"])), (6, one + " x"), (6, one + " x"), (9, "c d e")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), Plan()).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (6, 3), (6, 3), (7, 3), (9, 9)]


def test_pigeonhole():
    """Sets within the bound share a key, whatever they hold."""
    r = np.random.default_rng(0)
    plan = Plan(3, Fraction(8, 10))
    for n in [1, 2, 5, 9, 10, 30, 100, 700] * 4:
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        most = int(2 * n * Fraction(1, 5) / (1 + Fraction(4, 5)))
        swap = r.integers(0, most // 2 + 1)
        b = np.unique(np.concatenate((a[: n - swap], r.integers(0, 2**63, swap).astype(np.uint64))))
        if len(np.intersect1d(a, b)) >= plan.share * len(np.union1d(a, b)):
            of, key = sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), plan)
            assert set(key[of == 0].tolist()) & set(key[of == 1].tolist()), n


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 150, 200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars already are written once."""
    written = []
    monkeypatch.setattr(components_module, "materialize", lambda df, name, write=components_module.materialize: written.append(name) or write(df, name))
    edges = [(i, i % 3) for i in range(3, 30)] + [(1, 4), (0, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i % 3 for i in range(30)} and written == ["edges"]


@pytest.mark.parametrize("length,k", [(50, 16), (12, 4)])
def test_substring_dedup(docs, rows, length, k):
    own = {r[0]: words(r[1]) for r in rows}
    low = {}
    for i in sorted(own):
        for a in range(len(own[i]) - length + 1):
            low.setdefault(tuple(own[i][a : a + length]), i)
    got = {r.doc_id: r for r in substring_dedup(docs, length=length, k=k, with_text=True).collect()}
    for i, w in own.items():
        gone = set()
        for a in range(len(w) - length + 1):
            if low[tuple(w[a : a + length])] < i:
                gone.update(range(a, a + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


def test_substring_dedup_edges(spark, nothing):
    assert substring_dedup(nothing).count() == 0
    same = " ".join(["a"] * 60)
    rows = [(2, same), (1, same), (1, same), (None, same), (None, None), (3, "short")]
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0), (1, 60, 0), (2, 60, 60), (3, 1, 0), (99, 0, 0), (99, 60, 60)]
