"""Collocations against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taskloom.llm import collocations as C

from .test_dedup import LOWER


def brute(rows, least=10, most=3, inside=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            cuts = [(10**6 * a * a // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            found[p] = (score, a, f[p[: 1 + k]], f[(p[0], *p[1 + k :])])
    gone = {(p[0], *p[i:j]) for p in found for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * f[p] >= inside * f[(p[0], *p[i:j])]}
    out = []
    for lang in n:
        best = sorted(((-s, -a, " ".join(p[1:]).encode(), l, r) for p, (s, a, l, r) in found.items() if p[0] == lang and p not in gone))[:top]
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(best)]
    return sorted(out)


def mine(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(df, **how).collect())


def texts(seed=3, n=150):
    r = random.Random(seed)
    vocab = ["the", "of", "The", "a", "New", "York", "city", "é", "漢", "x-1", "\"q", "b\xa0c"]
    return [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(vocab) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\r\n"]) for _ in range(r.randint(0, 60)))) for _ in range(n)]


ODD = [("en", None), (None, None), ("en", ""), ("en", " . , "), ("en", "a a a a a a a a a a a a a"), ("de", "same pair " * 3000), ("fr", "w" * 100_000 + " long " + "w" * 100_000)]


@pytest.mark.parametrize("how", [{}, {"least": 2}, {"least": 3, "table": 4}, {"least": 2, "table": 0}, {"least": 2, "most_words": 4}, {"least": 2, "most_words": 2, "top": 7}, {"inside": 100, "least": 4}])
def test_against_python(spark, how):
    rows = texts() + ODD + ODD
    assert mine(spark, rows, **how) == brute(rows, how.get("least", 10), how.get("most_words", 3), how.get("inside", 50), how.get("top", 2000))


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 200)
    rows = texts(9)
    assert mine(spark, rows) == brute(rows)


def test_pivots_own_phrases_once(spark):
    """Each phrase comes out of one pivot with its whole count, its words repeated or not."""
    df = spark.createDataFrame([("en", "aa bb aa bb aa cc cc cc")] * 10 + [("en", "aa aa")] * 5, "lang string, text string").repartition(4)
    got = [(r.phrase, r.f) for r in C.phrase_counts(df)[2].collect()]
    assert sorted(got) == [("aa bb", 20), ("aa bb aa", 20), ("aa cc", 10), ("aa cc cc", 10), ("bb aa", 20), ("bb aa bb", 10), ("bb aa cc", 10), ("cc cc", 20), ("cc cc cc", 10)]


def test_empty_and_clashing(spark, docs, nothing):
    assert C.collocations(nothing).count() == 0
    odd = docs.select("*", *(F.lit("?").alias(n) for n in ("pivot", "n", "hash", "l1", "rank", "phrase")))
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in C.collocations(odd).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(rows)
