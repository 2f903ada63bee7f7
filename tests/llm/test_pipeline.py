"""The pipeline's stages, each against plain Python on its own input."""

import base64
import hashlib
import re
import struct

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from taskloom.llm.common import BATCH, materialize
from taskloom.llm.exact_dedup import exact_dedup

from .test_dedup import LOWER, union, words
from .test_text import WORD, brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    extra = spark.createDataFrame([(10_001, "12 -- 34", "en", "s", 8), (10_002, None, None, None, None), (10_003, "", "de", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = C.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == names
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})

    before, after = kept["language"]
    assert set(before) - set(after) == {10_001, 10_002, 10_003} and all(after[i] == before[i] for i in after)

    before, after = kept["exact"]
    last = {}
    for i, r in before.items():
        last[r.text.translate(LOWER)] = max(i, last.get(r.text.translate(LOWER), -1))
    assert set(after) == set(last.values()) and all(after[i] == before[i] for i in after)

    before, after = kept["near"]
    sets = {}
    for i, r in before.items():
        w = words(r.text.translate(LOWER))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    top = union(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert set(after) == set(top.values()) and all(after[i] == before[i] for i in after)

    before, after = kept["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = dict(brute([(i, r.text) for i, r in before.items()], items))
    assert set(after) == {i for i, f in found.items() if f[1] <= 0.5 * f[0]}
    assert any(f[4] for f in found.values())
    for i, r in after.items():
        n, hit = found[i][:2]
        assert (r.text == before[i].text) if not hit else (n - hit <= len(re.findall(WORD, r.text)) <= n and len(r.text) < len(before[i].text) and r.n_chars == len(r.text))

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    got = {r.doc_id: r for r in C.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert set(got) == set(after)
    for i, r in after.items():
        ids = enc.encode_ordinary(r.text)
        assert got[i].ids == ids and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    whole = C.run(spark, sf_dir)
    assert {(r.doc_id, r.ids_sha256) for r in whole.select("doc_id", "ids_sha256").collect()} == {(i, r.ids_sha256) for i, r in got.items()}


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_tables(spark, sf_dir, tmp_path):
    """Columns with the names that operators use themselves come through; null and repeated ids and very long texts do no
    harm; a result that isn't written yet survives the stages; the session's settings are as they were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["score", "lang_pred", "_text", "text_", "doc", "_row", "id", "key", "word", "packed", "fold", "spans", "kept"]
    long = " ".join(f"the word{i} of" for i in range(60_000))
    odd = [(None, "a text of the null one " * 9, "en", "s", 1), (None, "another text of a null id " * 9, "en", "s", 1), (7, "the seventh again " * 9, "en", None, 1), (8_000, long, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = materialize(docs.select("*", *(F.lit("?").alias(n) for n in names)), "odd")
    before = {k: spark.conf.get(k) for k in (BATCH, "spark.sql.shuffle.partitions")}
    pending = exact_dedup(docs)
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns
            docs = materialize(out, name)
            assert docs.where("score = '?' and doc = '?' and _text = '?'").count() == docs.count() > 40
        else:
            got = {r.doc_id: r.n_tokens for r in out.collect()}
            assert got[8_000] > 180_000 and None in got
    assert pending.count() == 64 and before == {k: spark.conf.get(k) for k in before}
