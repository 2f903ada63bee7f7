"""Language ID and language-model scores: held-out quality, the base score by hand, gradients."""

import collections
import hashlib
import math
import random
import resource
import zlib

import numpy as np
import pyarrow as pa
import pytest

from taskloom.llm import gru, lm_scoring
from taskloom.llm.common import keep_pages
from taskloom.llm.gru import Gru
from taskloom.llm.language_id import language_id
from taskloom.llm.lm_scoring import ROUNDS, fitted, lexicon, score_documents, symbols, word_counts

from .conftest import SCHEMA


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_language_id(documents):
    got = {r.doc_id: r for r in language_id(documents).collect()}
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) and 0 <= got[i].score <= 1 for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)


def test_language_id_edges(spark, nothing):
    assert language_id(nothing).count() == 0
    rows = [(i, ("the of and " if i % 2 else "der die und ") * 20, "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, None, "en"), (101, "12 34 ++", "en"), (102, "", None), (None, "the and the", "en"), (104, "der", None), (104, "der", None), (105, "und die " * 30_000, None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()]
    by = {d: (p, s) for d, p, s in got}
    assert len(got) == 47 and by[100] == by[101] == by[102] == ("und", 0.0) and by[104][0] == by[105][0] == "de"
    unlabelled = language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert unlabelled.lang_pred == "und"


def test_gradients(monkeypatch):
    monkeypatch.setattr(gru, "UNITS", 5)
    m = Gru(np.array([5, 4, 3, 2, 1, 1, 1.0]), 3)
    m.p = {k: a.astype(np.float64) for k, a in m.p.items()}
    r = np.random.default_rng(0)
    x, y, h0 = r.integers(0, 7, (4, 3)), r.integers(0, 7, (4, 3)), r.standard_normal((3, 5))

    def loss():
        h, states = h0, []
        xw = m.p["e"][x] @ m.p["wx"] + m.p["bx"]
        for t in range(4):
            h, _ = m.step(xw[t], h * (x[t] != 0)[:, None])
            states.append(h)
        return -m.log_probabilities(np.concatenate(states), y.reshape(-1))[0].mean()

    _, g = m._window(x, y, h0.copy())
    for k in m.p:
        for _ in range(3):
            i = tuple(r.integers(0, s) for s in m.p[k].shape)
            was = m.p[k][i]
            m.p[k][i] = was + 1e-5
            up = loss()
            m.p[k][i] = was - 1e-5
            down = loss()
            m.p[k][i] = was
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-4


def test_state_is_carried():
    """Scores don't depend on how texts are put side by side or cut in windows, and sum to one over all texts of a length."""
    m = Gru(np.array([5, 4, 3, 2.0]), 2)
    texts = [np.array([1, 2, 3, 1, 1]), np.array([], np.int64), np.array([2] * 40), np.array([3, 1])]
    whole = m.score(texts)
    assert np.allclose(whole, [m.score([t])[0] for t in texts], atol=1e-4) and np.allclose(whole, m.score(texts, most=1), atol=1e-4)
    logs, _ = m.log_probabilities(np.random.default_rng(1).standard_normal((1, gru.UNITS)).astype(np.float32).repeat(4, 0), np.arange(4))
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_training_keeps_its_memory():
    """Windows work on units' rows that lie whole in memory, and find their arrays where the last one left them."""
    m = Gru(np.arange(60.0, 0, -1))
    out, kept = m.step(np.zeros((3 * gru.UNITS, 9), np.float32).T, np.zeros((gru.UNITS, 9), np.float32).T)
    assert all(a.T.flags.c_contiguous for a in (out, *kept))
    texts = [np.random.default_rng(2).integers(1, 60, 400_000).astype(np.uint16)]
    keep_pages()
    m.learn([texts])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    m.learn([texts])
    windows = 400_001 // gru.STREAMS // gru.STEPS
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 300 * windows


def test_words_of_columns():
    """Words of a whole column are those that split() finds in each text; long ones are known by their digest."""
    r = random.Random(4)
    some = [*map(chr, range(256)), "漢", "\u0085", "\u2003", *" \t\n" * 20, "É", "long" * 11]
    rows = [None, "", " ", "\n\n", "a", " A", "a ", "X" * 41, "x" * 40, *("".join(r.choices(some, k=r.randint(0, 150))) for _ in range(500))]
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    want = [[w if len(w) <= 40 else b" " + hashlib.sha256(w).hexdigest()[:32].encode() for w in (t or "").encode().translate(lower).split()] for t in rows]
    for column in (pa.array(rows), pa.array(rows, pa.large_string()), pa.array(["before", *rows]).slice(1)):
        codes, distinct, sizes = lm_scoring.coded(column)
        found = [distinct[i].as_py().encode() for i in codes.tolist()]
        at = [0, *np.cumsum(sizes).tolist()]
        assert [found[a:b] for a, b in zip(at, at[1:])] == want
    assert [lm_scoring._words((t or "").encode()) for t in rows[:60]] == want[:60]


def base_scores(rows):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    own = [(d, (t or "").encode().translate(lower).split() + [None]) for d, t in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = collections.Counter(w for d, ws in own if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in own]


def test_lm_scores(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in score_documents(documents).collect()}
    for d, held, n, known, total, base in base_scores(rows):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges(spark, docs, rows, nothing):
    assert score_documents(nothing).count() == 0
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    for d, held, n, known, total, base in base_scores([r[:2] for r in rows]):
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total) and abs(got[d].base_score - base) < 1e-6 * abs(base) and got[d].score < 0
    only_held = spark.createDataFrame([(3, "a b", *[None] * 8)], SCHEMA) if zlib.crc32(b"3") % 5 == 1 else spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "a b", *[None] * 8)], SCHEMA)
    r = score_documents(only_held).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


def test_lm_learns_from_all(spark):
    """All texts reach the model in every round, copies too, in more than one task; no symbol of a batch is left out."""
    rows = [(i, f"w{i % 7} common x{i} " * (1 + i % 5) if i % 2 else "a copy of one text") for i in range(5000)]
    learn = spark.createDataFrame(rows, "_row long, text string")
    lex = lexicon(word_counts(learn))
    table = lex.table()
    coded = [(i, symbols(t.encode().split(), table, lex)[1].astype("<u2").tobytes()) for i, t in rows]
    model = fitted(spark.createDataFrame(coded, "_row long, symbols binary").repartition(5), lex.symbol_counts())
    assert lex.total == sum(len(t.split()) + 1 for _, t in rows) and model.seen == ROUNDS * lex.total
    plain = Gru(lex.symbol_counts())
    copy = [np.array([lex.words.index(w) for w in b"a copy of one text".split()])]
    assert model.score(copy)[0] > plain.score(copy)[0] + 1
    for sizes in ([3], [0, 0], [500, 700, 1], [9999, 1, 2]):
        assert Gru(np.ones(9)).learn([np.ones(n, np.int64)] for n in sizes) == sum(sizes) + len(sizes)


def naive(m, line):
    """The log probability of one text by the formulas, a symbol at a time, in float64."""
    p = {k: a.astype(np.float64) for k, a in m.p.items()}
    logistic = lambda a: 1 / (1 + np.exp(-a))
    h, total, last, n = np.zeros(gru.UNITS), 0.0, 0, gru.UNITS
    for s in [*line, 0]:
        x = p["e"][m.at[last]] @ p["wx"] + p["bx"]
        u = h @ p["u"]
        z, r = logistic(x[:n] + u[:n]), logistic(x[n : 2 * n] + u[n : 2 * n])
        h = (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h
        c, k = m.of[m.at[s]], m.at[s]
        classes, own = h @ p["wc"] + p["bc"], p["ww"][m.of == c] @ h + p["bw"][m.of == c]
        total += classes[c] - np.log(np.exp(classes).sum())
        total += own[k - np.flatnonzero(m.of == c)[0]] - np.log(np.exp(own).sum())
        last = s
    return total


def test_score_by_brute_force(spark, docs, rows, monkeypatch):
    """The query's score against the formulas: the network a symbol at a time, then a rare word's share of its class."""
    monkeypatch.setattr(lm_scoring, "SYMBOLS", 30)
    monkeypatch.setattr(lm_scoring, "HEAD", 60)
    models = []
    monkeypatch.setattr(lm_scoring, "fitted", lambda *a: models.append(fitted(*a)) or models[-1])
    got = {r.doc_id: r.score for r in score_documents(docs).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    own = {r[0]: lm_scoring._words((r[1] or "").encode()) for r in rows}
    c = collections.Counter(w for d, ws in own.items() if not held(d) for w in [*ws, b"\n"])
    spark_counts = lexicon(word_counts(docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 1")))
    frequent = {w: i for i, w in enumerate(spark_counts.words[: spark_counts.own])}
    assert len(frequent) == 30
    mass, kinds = collections.Counter(), collections.Counter()
    for w, k in c.items():
        if w not in frequent:
            mass[lm_scoring.tail(w)] += k
            kinds[lm_scoring.tail(w)] += 1
    for d, ws in own.items():
        if len(ws) > 500:
            continue
        want = naive(models[0], [frequent.get(w, 30 + lm_scoring.tail(w)) for w in ws]) / math.log(10)
        for w in ws:
            if w not in frequent:
                want += math.log10((c[w] + 0.5) / (mass[lm_scoring.tail(w)] + 0.5 * (kinds[lm_scoring.tail(w)] + 1)))
        assert abs(got[d] - want) < 1e-3 + 1e-4 * abs(want)
