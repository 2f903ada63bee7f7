"""Columns with names that operators use themselves, very long texts, hot keys: no crash, and the results of the plain table."""

import pytest
from pyspark.sql import functions as F

from taskloom.llm import common, decontaminate, jaccard_join
from taskloom.llm.components import components
from taskloom.llm.decontaminate import contamination
from taskloom.llm.exact_dedup import exact_dedup
from taskloom.llm.jaccard_join import Plan, jaccard_classes
from taskloom.llm.language_id import language_id
from taskloom.llm.licenses import license_scan
from taskloom.llm.lm_scoring import score_documents
from taskloom.llm.secrets import secret_digest
from taskloom.llm.substring_dedup import substring_dedup
from taskloom.llm.token_counts import Rollup, signed, words

NAMES = ["_row", "id", "repo", "owner", "term", "hash", "n", "tf", "df", "unit", "key", "spans", "items", "shown", "n_words", "n_docs", "n_tokens", "version", "batch", "attempt", "seeds", "fp", "anchor", "node", "set", "whole", "keys", "recipe", "doc", "held_out", "symbols", "word", "c", "lang_pred", "score"]
LONG = "the api_key=abcdefgh12345 and " + " ".join(f"word{i % 977} the x{i}" for i in range(60_000)) + "\nReleased under the MIT License.\n"


def plain(spark):
    texts = [LONG, LONG, "the quick brown fox " * 30, "der die das und " * 30, "w" * 200_000, "w" * 200_000 + " a b c", "", None, None, "token: secretsecret1 " + "a" * 45]
    rows = [(i if i < 9 else 1, t, ["en", "de"][i % 2], "s", f"d/{i}.txt") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string")


def same(spark, tmp_path, name, docs):
    if name == "token_counts":
        r = Rollup(spark, str(tmp_path / ("odd" if "hash" in docs.columns else "plain")))
        r.commit("one", signed(docs, "v", words(docs.text)))
        out = r.totals()
    else:
        bench = spark.createDataFrame([(1, "word1 the x1 word2 the x2 word3 the x3 word4"), (2, "brown fox")], "item_id long, text string")
        out = {
            "licenses": lambda: license_scan(docs, "doc_id", "source", "path", "text"), "jaccard": lambda: jaccard_classes(docs, Plan()), "secrets": lambda: secret_digest(docs), "scores": lambda: score_documents(docs).drop("score"),
            "exact": lambda: exact_dedup(docs), "language": lambda: language_id(docs), "benchmark": lambda: contamination(docs, bench), "substring": lambda: substring_dedup(docs),
        }[name]()
    return sorted(str(r) for r in out.collect())


@pytest.mark.parametrize("name", ["licenses", "jaccard", "secrets", "scores", "exact", "language", "benchmark", "substring", "token_counts"])
def test_clashing_columns(spark, tmp_path, name):
    docs = plain(spark)
    there = {c.lower() for c in docs.columns}
    odd = docs.select("*", *(F.lit("?").alias(n) for n in NAMES if n not in there))
    got = same(spark, tmp_path, name, odd)
    assert got == same(spark, tmp_path, name, docs) and (name == "token_counts" or len(got) == 10)


def test_long_items_and_filter(spark, monkeypatch):
    """An item longer than a block is matched whole, and blocks over the filter find what one automaton finds."""
    item = " ".join(f"i{n}" for n in range(500))
    docs = spark.createDataFrame([(n, f"before i{n} " + " ".join(f"i{k}" for k in range(n, n + 9 + n % 3)) + " after") for n in range(0, 480, 7)] + [(1000, item), (1001, None), (1002, "i1 i3")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, item), (4, None)], "item_id long, text string")
    one = sorted(map(str, contamination(docs, bench).collect()))
    passes = []
    monkeypatch.setattr(decontaminate, "window_filter", lambda *a, f=decontaminate.window_filter: passes.append(f(*a)) or passes[-1])
    assert sorted(map(str, contamination(docs, bench, block_words=60).collect())) == one and len(passes) == 1
    assert any("n_hit=500" in r for r in one)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_hot_keys(spark, monkeypatch, most):
    """Equal texts, near copies and a common passage as hot keys: each group has its id, whether hot keys are broadcast or shuffled."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(200 + i, " ".join([*base[:-1], f"end{i}"])) for i in range(60)] + [(400 + i, " ".join([*base[:60], *(f"own{i}x{j}" for j in range(60))])) for i in range(30)] + [(500, "alone and short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(common, "BEARS", 5)
    monkeypatch.setattr(common, "MOST_HOT", most)
    joins = []
    monkeypatch.setattr(jaccard_join, "hot_above", lambda *a, f=common.hot_above: joins.append(f(*a)) or joins[-1])
    got = {r.doc_id: r.component_id for r in jaccard_classes(docs, Plan()).collect()}
    assert any(joins) and {got[i] for i in range(60)} | {got[200 + i] for i in range(60)} == {0} and all(got[i] == i for i in (*range(400, 430), 500))


def test_languages_are_refused(spark, monkeypatch):
    """No language past a limit is dropped without a word."""
    from taskloom.llm import language_id as own

    docs = spark.createDataFrame([(i, f"text of {i} words", f"l{i}") for i in range(60)], "doc_id long, text string, lang string")
    monkeypatch.setattr(own, "LANGUAGES", 5)
    with pytest.raises(ValueError, match="languages"):
        language_id(docs)


def test_hot_star(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(100, 140)] + [(5000, 5001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(300), *range(1100, 1140)]) and got[5001] == 5000
