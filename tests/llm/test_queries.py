"""Each query gives a row per document, or what its SQL gives."""

import base64
import hashlib
import struct

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from taskloom.llm import language_id
from taskloom.llm import queries as Q

from .test_models import base_scores


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf_dir), con.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([str(r[c]) for c in columns] for r in got.collect()) == sorted([str(r[i]) for i in at] for r in want.fetchall())


def test_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


def test_registered_bpe(spark, sf_dir):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = Q.queries()["op4_byte_bpe"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_registered_scores(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in Q.queries()["op5_lm_scoring"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for d, held, n, known, total, base in base_scores(rows):
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (held, n, known, total) and abs(got[d].base_score - base) < 1e-6 * abs(base)


def test_registered_languages(spark, sf_dir):
    """The query against the network by its formulas: every filter at every place of every window, the most, softmax, the mean over bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.train(docs)
    got = {r.doc_id: r for r in Q.queries()["op7_language_id"](spark, sf_dir).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for d, text in rows[:60]:
        if not text or not any(c.isalpha() for c in text):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = np.zeros(len(net.labels))
        for a in range(0, len(raw), language_id.WINDOW):
            start = max(min(a, len(raw) - language_id.WINDOW), 0)
            window = [raw[(start + i) % len(raw)] for i in range(language_id.WINDOW)]
            tops = []
            for w, t in zip(language_id.WIDTHS, net.weights):
                answers = [sum(t[k][window[i + k]].astype(float) for k in range(w)) for i in range(len(window) - w + 1)]
                tops.append(np.max(answers, 0))
            z = np.tanh(np.concatenate(tops)) @ net.out + net.bias
            p = np.exp(z - z.max())
            total += p / p.sum() * min(len(raw) - a, language_id.WINDOW)
        total /= len(raw)
        assert abs(got[d].score - total.max()) < 1e-3 and total[net.labels.index(got[d].lang_pred)] > total.max() - 1e-3
