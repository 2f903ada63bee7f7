"""Quality rules against plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from taskloom.llm.quality import Rules, quality_rules

SPACE, WORD = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]+"


def brute(text, rules):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    again = [line for i, line in enumerate(lines) if line in lines[:i]]
    threes, twice = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if threes[tuple(w[i : i + 3])] > 1:
            twice |= {i, i + 1, i + 2}
    chars = sum(map(len, w))
    out = {"n_words": len(w), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(again), "n_repeat_words": len(twice), "n_lines": len(lines), "line_chars": sum(map(len, again)), "all_line_chars": sum(map(len, lines))}
    failed = {"words"} if len(w) < rules.least_words else set()
    failed |= {"repeat_words"} if 100 * len(twice) > rules.repeat_words * len(w) else set()
    base = bool(failed)
    failed |= {"lines"} if 100 * len(again) > rules.lines * len(lines) else set()
    failed |= {"line_chars"} if 100 * out["line_chars"] > rules.line_chars * out["all_line_chars"] else set()
    for k, most in rules.run.items():
        seen, inside = set(), set()
        for i in range(len(w) - k + 1):
            run = tuple(w[i : i + k])
            inside |= set(range(i, i + k)) if run in seen else set()
            seen.add(run)
        out[f"run_{k}"] = sum(len(w[i]) for i in inside)
        failed |= {f"run_{k}"} if 100 * out[f"run_{k}"] > most * chars else set()
    return out | {"base_failed": base, "failed": sorted(failed), "kept": not failed}


def check(got, rows, rules):
    assert len(got) == len(rows)
    want = sorted(str((i, *brute(t, rules).values())) for i, t in rows)
    names = [*brute("", rules)]
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in got) == want


def test_against_python(spark, docs, rows):
    texts = [r[1] for r in rows]
    odd = ["\n", "\n\n a\n", "a\nb\na\nb \na", "x\r\nx\r\n x\n", "é漢# <b>|\n" * 70, "one two three four five six seven eight nine ten eleven " * 9, "w" * 100_000 + " b\n" + "line of it\n" * 30, " ".join(f"v{i % 5000}" for i in range(20_000))]
    for rules in (Rules(), Rules(run={2: 5, 12: 1}, least_words=3, lines=10)):
        every = [(r[0], t) for r, t in zip(rows, texts)] + [(None, t) for t in odd] + [(3, odd[2]), (3, odd[2])]
        df = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
        check(quality_rules(df, rules=rules).collect(), every, rules)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = quality_rules(docs).collect()
    check(got, rows, Rules())
    assert {r.kept for r in got} == {True, False} and any(not r.kept and r.base_failed for r in got)


def test_coverage_speaks_where_the_base_is_silent(spark):
    """A third of the text comes again in one piece, and no 3-word window covers more than the base rule allows."""
    own = [f"own{i}" for i in range(100)]
    text = " ".join([*own, *own[:20], *(f"more{i}" for i in range(60))])
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not r.base_failed and r.failed == [] and r.run_10 > 0
    text = " ".join([*own, *own[:99], *(f"m{i}" for i in range(200))])
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not r.base_failed and not r.kept and "run_10" in r.failed


def test_empty_and_clashing(spark, docs, nothing):
    assert quality_rules(nothing).count() == 0
    odd = docs.select("*", *(F.lit("?").alias(n) for n in ("n_words", "failed", "kept", "run_5")))
    assert sorted(map(str, quality_rules(odd).collect())) == sorted(map(str, quality_rules(docs).collect()))
