"""Queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode, load_ranks
from .collocations import collocations
from .common import scratch_dir
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .jaccard_join import Plan, jaccard_classes
from .language_id import language_id
from .licenses import license_scan
from .lm_scoring import score_documents
from .quality import quality_rules
from .secrets import secret_digest
from .substring_dedup import substring_dedup
from .token_counts import Rollup, pieces, signed, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths, so each gets one: a source is a repository of folders of 500 documents and, in these, of
    25; the first document of a folder is its licence file."""
    path = "concat('d', doc_id div 500, case when doc_id % 500 = 0 then '/LICENSE' when doc_id % 25 = 0 then concat('/s', doc_id div 25 % 20, '/LICENSE') else concat('/s', doc_id div 25 % 20, '/', doc_id, '.txt') end)"
    return license_scan(table(spark, sf_dir, "documents").withColumn("path", F.expr(path)), "doc_id", "source", "path", "text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), Plan())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two tokenizer versions; then those of fewer than 40 words are deleted and the words of German
    ones counted anew by pieces; two batches come again."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    short, german = docs.where(words(text) < 40), docs.where((F.col("lang") == "de") & (words(text) >= 40))
    batches = {
        "words": signed(docs, "words", words(text)),
        "pieces": signed(docs, "pieces", pieces(text)),
        "short": signed(short, "words", words(text), -1).unionByName(signed(short, "pieces", pieces(text), -1)),
        "german": signed(german, "words", words(text), -1).unionByName(signed(german, "words", pieces(text))),
    }
    rollup = Rollup(spark, f"{scratch_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    for name in ("words", "pieces", "pieces", "short", "german", "german"):
        rollup.commit(name, batches[name])
    return rollup.totals()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "id % 100 = 0")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
