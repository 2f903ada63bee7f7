"""From raw documents to token ids: STAGES in order, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.
"""

from __future__ import annotations

from fractions import Fraction
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.bpe import encode_decode, load_ranks
from taskloom.llm.common import materialize, scratch
from taskloom.llm.decontaminate import decontaminate
from taskloom.llm.exact_dedup import keep_one
from taskloom.llm.jaccard_join import Plan, jaccard_classes
from taskloom.llm.language_id import UNKNOWN, identify, train

#: Documents whose best language has a lower mean probability go, and those without a letter.
LEAST_SCORE = 0.4
#: Near duplicates share this much of their shingles of so many words.
NEAR = Plan(5, Fraction(8, 10))
#: Documents with more of their words in benchmark passages go whole; else the passages go.
COVERAGE = 0.5


#: What the stages over one folder of tables have left in the shared folder. A stage's result is written before the next one begins.
_left: dict[str, list[str]] = {}


def swept(stage):
    """A stage that first drops what earlier ones over the same folder have left, but not what it reads, and at its end
    what its result doesn't read. Tables of others aren't touched."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark) as own:
            own.tables = _left.pop(sf_dir, [])
            own.only(docs)
            out = stage(spark, docs, sf_dir)
            own.only(docs, out)
            _left[sf_dir], own.tables = own.tables, []
        return out

    return run_stage


@swept
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell. Null texts and those without a letter go; no labelled rows, none stays."""
    judged = identify(docs, train(docs), carry=True)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return materialize(kept.select("doc.*"), "language")


@swept
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z, the one with the largest id. Null texts are empty ones."""
    return keep_one(docs)


@swept
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays. Null texts, and rows with a null id, have no group and stay."""
    classes = jaccard_classes(docs, NEAR)
    gone = materialize(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


@swept
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that are benchmark items; those that are mostly that go. Null texts and an empty benchmark change nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), coverage=COVERAGE)


@swept
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document, with the digests of ids and of the decoded text. Null texts have no ids."""
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return materialize(encode_decode(docs, ranks, public_tokenizers.PATTERN, keep_ids=True, carry=("lang", "source")), "tokens")


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]
#: The language network isn't SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as own:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
            own.only(docs)
        out = STAGES[-1][1](spark, docs, sf_dir)
        own.only(out)
    return out
