"""Licenses, secrets, BPE, decontamination, token counts against plain Python and the tokenizer's own library."""

import base64
import hashlib
import random
import re
import struct

import public_tokenizers as P
import regex
import tiktoken
from pyspark.sql import functions as F

from taskloom.llm import bpe
from taskloom.llm.bpe import LATIN_PATTERN, ODD, PLAIN_PATTERN, encode_decode, encode_word, load_ranks
from taskloom.llm.decontaminate import Automaton, contamination, decontaminate
from taskloom.llm.licenses import BODIES, license_scan
from taskloom.llm.secrets import secret_digest
from taskloom.llm.token_counts import Rollup, signed, words

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


def test_encode_word():
    r = random.Random(2)
    for _ in range(800):
        w = "".join(r.choice("abcdeé =ß漢\n'") for _ in range(r.randint(1, 80))).encode()
        assert encode_word(w, RANKS) == LIBRARY._core_bpe.encode_single_piece(w)
    assert len(encode_word(b"ab" * 20_000, RANKS)) > 1000


def test_latin_pattern_cuts_alike():
    assert P.PATTERN == PLAIN_PATTERN
    fast, slow, odd = re.compile(LATIN_PATTERN).findall, regex.compile(PLAIN_PATTERN).findall, re.compile(ODD).search
    for c in map(chr, range(0x2B0)):
        t = f"a{c}1 {c}b  {c}{c} x'll{c} 's"
        assert odd(t) or fast(t) == slow(t), hex(ord(c))


def test_bpe(spark, docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD", 20)
    monkeypatch.setattr(bpe, "BLOCK", 2000)
    got = {r.doc_id: r for r in encode_decode(docs, RANKS, P.PATTERN, keep_ids=True, keep_decoded=True, carry=("lang", "word")).collect()}
    for i, t, lang, *_ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].decoded == (t or "") and got[i].n_tokens == len(ids) and got[i].lang == lang and got[i].word == "?"
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_decode(nothing, RANKS, P.PATTERN).count() == 0


def test_bpe_hot_long_word(spark, monkeypatch):
    """A word that is too long for the table stands in every block: its rows are spread, and come back to their places."""
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    monkeypatch.setattr(bpe, "BEARS", 5)
    rows = [(i, f"a{i} {'Ab' * 100} b {'x' * (i % 50)}\n{'Ab' * 100}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, plain = [], bpe._encoded

    def encoded(away, shared):
        parts = away.where(F.length("word") > 200).select("word", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        seen.extend(r["count"] for r in parts)
        return plain(away, shared)

    monkeypatch.setattr(bpe, "_encoded", encoded)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.ids for r in encode_decode(docs, RANKS, P.PATTERN, keep_ids=True).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: LIBRARY.encode_ordinary(t) for i, t in rows}
    assert len(seen) > 1 and max(seen) < sum(seen) / 2


def test_bpe_odd_texts(spark):
    texts = ["\x1cx\x85 y　z", "don't WE'LL  ½²", "<|endoftext|>", "🙂🙂 \n\n\n  a", "́e", "a\x00b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_decode(docs, RANKS, P.PATTERN, keep_ids=True).collect()}
    assert got == {i: LIBRARY.encode_ordinary(t) for i, t in enumerate(texts)}


KINDS = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}


def spans(t):
    out = []
    for i, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        flags = re.I | re.A if kind == "assign" else 0
        out += [(m.start(), i, kind, m.end()) for m in re.finditer(pattern, t or "", flags) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark, nothing):
    r = random.Random(3)
    bits = ["password=", "Token: '", "api_key = \"", "secret", "=", "é漢 ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefdeadbeefdeadbeefdeadbeef", " ", "\n", "password = token = abcdefgh12", "x", "LongMixedToken_12345-abcdef"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(200))]
    texts += ["key LONGmixed0123456789zz"] * 2 + ["owner LONGother0123456789zz"]
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts)] + [(1000, "password=abcdefgh1", "a")] * 2
    got = secret_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for i, t, _ in rows:
        want = spans(t)
        assert by[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(want.split(",")) - {""} <= set(by[i].spans.split(","))
        assert by[i].n_live + by[i].n_example == by[i].n_assign + by[i].n_access + by[i].n_hex == len([x for x in want.split(",") if x])
    # a mixed token under two owners is an example; one that stays with its owner is added
    assert by[202].spans == "" and by[203].spans == "" and by[204].spans == "owned:6:27"
    assert secret_digest(nothing).count() == 0


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items, n=10):
    low = lambda t: re.findall(WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    item_words = {i: low(t) for i, t in items}
    for d, t in docs:
        w, hit, ids = low(t), set(), set()
        for i, x in item_words.items():
            m = min(n, len(x))
            wins = {tuple(x[a : a + m]) for a in range(len(x) - m + 1)} if m else set()
            for a in range(len(w) - m + 1 if m else 0):
                if tuple(w[a : a + m]) in wins:
                    hit.update(range(a, a + m))
                    ids.add(str(i))
        yield d, (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))


def test_decontamination(spark, nothing):
    r = random.Random(4)
    line = lambda k: " ".join(r.choice(["a", "B", "c", "é", "d1"]) for _ in range(k))
    items = [(i, line(r.choice([1, 3, 7, 9, 10, 11, 25]) + (4 if i % 2 else 6))) for i in range(25)] + [(98, None), (99, " -- "), (100, "zz"), (101, "zz"), (102, "a a a a a a a a a a a a")]
    docs = [(i, line(r.randint(0, 60)) + (", zz. " if i % 5 == 0 else " ") + (items[i % 25][1] if i % 3 else "")) for i in range(80)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(brute(docs, items))
    for block in (10**6, 60):
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in contamination(frame, bench, block_words=block).collect()}
        assert got == want
    assert contamination(frame, bench.where("false")).where("contaminated").count() == 0
    assert contamination(nothing, bench).count() == 0


def test_decontaminate_removes_spans(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Keep THIS, {passage}! and that " + "more " * 20, 7, "x"), (2, passage, 8, "y"), (3, "clean", 9, "z"), (4, None, None, None), (4, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted(decontaminate(docs, bench).collect(), key=lambda x: x.doc_id)
    assert [x.doc_id for x in got] == [1, 3, 4, 4] and got[0].text == "Keep THIS, ! and that " + "more " * 20 and got[0].n_chars == len(got[0].text) and got[1].text == "clean"


def test_automaton_is_linear():
    items = [("x", [b"a"] * 300)]
    assert len(Automaton(items, 10).link) <= 601


def test_licenses(spark):
    files = [
        (1, "r", "LICENSE", "Released under the MIT License."), (2, "r", "src/a.py", "code\nmore code"), (3, "r", "lib/COPYING.txt", "Licensed under the Apache License, Version 2.0."), (4, "r", "lib/deep/er/b.py", None),
        (5, "r", "lib/c.py", "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (6, "other", "a/b.py", "nothing"), (7, None, None, "free words only"), (8, "r", "libx/d.py", ""), (8, "r", "libx/d.py", ""),
    ]
    docs = spark.createDataFrame(files, "doc_id long, repo string, path string, text string")
    got = sorted((r.doc_id, r.own_license, r.license, r.license_dir) for r in license_scan(docs, "doc_id", "repo", "path", "text").collect())
    assert got == [(1, "MIT", "MIT", None), (2, None, "MIT", ""), (3, "Apache-2.0", "Apache-2.0", None), (4, None, "Apache-2.0", "lib"), (5, "GPL-3.0", "GPL-3.0", None), (6, None, None, None), (7, None, None, None), (8, None, "MIT", ""), (8, None, "MIT", "")]
    assert license_scan(docs.where("false"), "doc_id", "repo", "path", "text").count() == 0


def test_licenses_over_lines(spark):
    """Wrapped headers and full licence texts."""
    gnu = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {} as published by\n *\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n"
    bsd = "# Copyright (c) 2020 Somebody\n#\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n"
    files = [
        (1, "r", "a.c", "int x;\n" + gnu.format("General Public License", 3) + "main\n" * 20), (2, "r", "b.c", gnu.format("General Public License", 2)), (3, "r", "c.c", gnu.format("Lesser General Public License", 3)), (4, "r", "d.py", bsd + "x = 1\n" * 30), (5, "r", "e.py", "plain\nwords\nonly"),
        *((10 + i, name, "LICENSE", "Copyright 2021 The Authors\n" + text[0]) for i, (name, text) in enumerate(BODIES.items())), (90, "GPL-3.0", "src/deep/x.c", "code"), (91, "BSD-3-Clause", "y.c", None),
    ]
    docs = spark.createDataFrame(files, "doc_id long, repo string, path string, text string")
    got = {r.doc_id: r for r in license_scan(docs, "doc_id", "repo", "path", "text").collect()}
    assert [got[i].own_license for i in range(1, 6)] == ["GPL-3.0", "GPL-2.0", "LGPL-3.0", "BSD-3-Clause", None]
    assert {r[1]: got[r[0]].own_license for r in files if 10 <= r[0] < 90} == {name: name for name in BODIES}
    assert (got[90].license, got[90].license_dir, got[91].license) == ("GPL-3.0", "", "BSD-3-Clause")


def test_token_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None), (2, None, None, None), (3, "c", "en", "s")], "doc_id long, text string, lang string, source string")
    r = Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    batch = signed(docs, "v1", words(docs.text))
    assert r.commit("one", batch) and not r.commit("one", batch)
    assert r.commit("two", signed(docs.where("doc_id = 3"), "v1", words(docs.text), -1))
    assert r.commit("none", batch.where("false"))
    got = {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert got == {("s", "en"): (1, 2), (None, None): (2, 0)}
    # a writer that was lost before the ledger entry changes nothing
    batch.withColumn("batch", docs.source).withColumn("attempt", docs.source).limit(0).write.parquet(str(tmp_path / "r/deltas/lost"))
    assert {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()} == got
    assert r.commit("gone", signed(docs.where("doc_id = 1"), "v1", words(docs.text), -1)) and r.totals().count() == 1
