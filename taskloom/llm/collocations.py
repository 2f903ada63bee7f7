"""Phrase collocations by pivot partitioning.

Each phrase belongs to its rarest word, its pivot. Every occurrence of a word makes one text fragment: the words around
it that phrases can reach, with rarer ones, and all beyond them, blanked out. Equal fragments are counted where they
are read; then they are routed to their pivots, which count their own phrases with no second shuffle. Frequent words
are pivots only among words still more frequent, so that their fragments are few and no pivot gathers many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_NP, U, frequent, materialize, mix, scratch, slices, utf8, word_hashes, words

#: Bytes between words, and those of them that end a piece. Fixed values.
END = np.zeros(256, bool)
END[[*b".,;:!?", *range(10, 14)]] = True
APART = END.copy()
APART[[0x20, 9]] = True
#: So many of the most frequent words are broadcast, as 64-bit hashes in order. The others count as rarer than these, ordered by hash.
TABLE = 1 << 20
UNKNOWN = U(1 << 63)
#: Bytes of text that are worked on at a time; equal fragments of these are sent once.
PART = 4 << 20
#: Parts of a language in which phrases are ranked before all of it is.
PARTS = 16


class Slice:
    """The words of a slice of texts, numbered by language and bytes."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        data = LOWER_NP[data]
        starts, ends, at = words(data, offsets, APART)
        self.langs = batch.column("lang").dictionary_encode()
        lang = np.repeat(self.langs.indices.to_numpy(), np.diff(at)).astype(np.int64)
        names = mix(word_hashes(*_packed(self.langs.dictionary), 41)) if len(self.langs.dictionary) else np.zeros(0, U)
        self.hashes, self.first, self.word, self.counts = np.unique(mix(word_hashes(data, starts, ends, 42) ^ names[lang]), return_index=True, return_inverse=True, return_counts=True)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.piece = np.concatenate(([0], np.cumsum(END[data])))[starts] + text  # grows wherever a piece or a text ends
        self.lang = lang[self.first]  # of each number
        a, b = starts[self.first], ends[self.first]
        size = b - a
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.strings = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[np.repeat(a, size) + inside]))).cast(pa.string())

    def totals(self) -> np.ndarray:
        return np.bincount(self.lang, self.counts, minlength=len(self.langs.dictionary)).astype(np.int64)


def _packed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends), each string after a byte of its own, as word_hashes() takes none that is empty."""
    raw = [b"\0" + s.encode() for s in strings.to_pylist()]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, hash, n) of each slice, and with a null word the number of all its words in a language."""
    for batch in slices(batches, "text", PART):
        s = Slice(batch)
        m = len(s.langs.dictionary)
        lang = s.langs.dictionary.take(pa.array(np.concatenate((s.lang, np.arange(m)))))
        yield pa.RecordBatch.from_arrays([lang, pa.concat_arrays([s.strings, pa.nulls(m, pa.string())]), pa.array(np.concatenate((s.hashes, np.zeros(m, U))).view(np.int64)), pa.array(np.concatenate((s.counts, s.totals())))], ["lang", "word", "hash", "n"])


def _fragments(s: Slice, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, counts) of the distinct fragments: the pivot's number, then those of the words 1, 2, .. to its left and to
    its right, -1 where blank. order: of each number, the larger the rarer, 0 for words that are in no phrase."""
    w, n = s.word, len(s.word)
    key = order[w]
    rows = np.full((n, 2 * most - 1), -1, np.int32)
    rows[:, 0] = w
    for side in (-1, 1):
        open_ = key > 0
        for d in range(1, most):
            a, b = (slice(d, n), slice(0, n - d)) if side < 0 else (slice(0, n - d), slice(d, n))
            fits = np.zeros(n, bool)
            fits[a] = (s.piece[a] == s.piece[b]) & (key[b] > 0) & (key[b] <= key[a])
            if side < 0:  # a phrase that has its pivot twice is counted at the first
                fits[a] &= w[b] != w[a]
            open_ = open_ & fits
            rows[a, d if side < 0 else most - 1 + d] = np.where(open_[a], w[b], -1)
    rows = rows[(rows[:, 1] >= 0) | (rows[:, most] >= 0)]
    with np.errstate(over="ignore"):
        h = np.zeros(len(rows), U)
        for c in rows.T:
            h = mix(h * U(0xD6E8FEB86659FD93) + c.astype(U))
    _, first, counts = np.unique(h, return_index=True, return_counts=True)
    return rows[first], counts


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, most_words: int = 3, table: int = TABLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): lang, n; lang, phrase, f; lang, phrase, words, f. Words and phrases are those with f >= least, all exact.

    See collocations() for what is counted.
    """
    spark = docs.sparkSession
    used = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counted = used.mapInArrow(_counts, "lang string, word string, hash long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("hash").alias("hash"))
    counted = materialize(counted.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    own = counted.where("word is not null")
    known = frequent(own.select("hash", "n"), "n", table).toArrow()
    every = known.num_rows == own.count()
    by_count = known.column("hash").to_numpy().view(U)[np.argsort(-known.column("n").to_numpy(), kind="stable")]
    places = np.argsort(by_count, kind="stable")
    shared = spark.sparkContext.broadcast((by_count[places], (places + 1).astype(np.uint32)))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = shared.value
        for batch in slices(batches, "text", PART):
            s = Slice(batch)
            at = np.minimum(np.searchsorted(hashes, s.hashes), max(len(hashes) - 1, 0))
            there = hashes[at] == s.hashes if len(hashes) else np.zeros(len(s.hashes), bool)
            order = np.where(there, ranks[at].astype(U) if len(hashes) else U(0), U(0) if every else s.hashes | UNKNOWN)
            rows, counts = _fragments(s, order, most_words)
            lang = s.langs.dictionary.take(pa.array(s.lang[rows[:, 0]]))
            columns = [s.strings.take(pa.array(c, mask=c < 0)) for c in rows.T]
            yield pa.RecordBatch.from_arrays([lang, *columns, pa.array(counts.astype(np.int64))], ["lang", "pivot", *sides, "n"])

    sides = [f"l{d}" for d in range(1, most_words)] + [f"r{d}" for d in range(1, most_words)]
    place = lambda i: F.col("pivot" if not i else f"l{-i}" if i < 0 else f"r{i}")
    spans = [(a, b) for a in range(1 - most_words, 1) for b in range(0, most_words) if 2 <= b - a + 1 <= most_words]
    grams = [F.when(place(a).isNotNull() & place(b).isNotNull(), F.concat_ws(" ", *(place(i) for i in range(a, b + 1)))) for a, b in spans]
    sent = used.mapInArrow(fragments, f"lang string, pivot string, {', '.join(f'{c} string' for c in sides)}, n long").repartition("lang", "pivot")
    mined = sent.select("lang", "pivot", "n", F.explode(F.array_compact(F.array(*grams))).alias("phrase")).groupBy("lang", "pivot", "phrase").agg(F.sum("n").alias("f"))
    phrases = materialize(mined.where(F.col("f") >= least).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"), "phrases")
    shared.unpersist()
    return counted.where("word is null").select("lang", "n"), own.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")), phrases


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, most_words: int = 3, inside: int = 50, top: int = 2000, table: int = TABLE) -> DataFrame:
    """Of each language, the first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words at spaces and tabs. Candidates
    are phrases of 2 to most_words words within a piece with a = f(phrase) >= least. A cut into two parts with counts l
    and r scores floor(1000000 a a / (l r)), exactly; the lowest cut counts, of equal ones that with the shortest first
    part. A candidate goes if a longer one that holds it has at least `inside` hundredths of its count. Order: score and a
    descending, then the phrase by its bytes, so that no two tie. n counts all words of the language.

    Null languages are `und`; null and empty texts have no words; repeated rows count each; very long texts are cut whole;
    no rows give no rows; other columns are ignored. Words are told apart by 64-bit hashes within a slice of texts, and
    by their bytes between slices.
    """
    with scratch(docs.sparkSession) as own:
        totals, single, phrases = phrase_counts(docs, lang_col, text_col, least, most_words, table)
        known = materialize(single.unionByName(phrases.select("lang", "phrase", "f")), "parts")
        w, join = F.split("phrase", " "), lambda a, n: F.array_join(F.slice("w", a, n), " ")
        cuts = phrases.withColumn("w", w).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("cut"), join(F.lit(1), k).alias("head"), join(k + 1, F.col("words") - k).alias("tail")))).alias("c")).select("lang", "phrase", "a", "c.*")
        for part, count in (("head", "l"), ("tail", "r")):
            cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
        exact = "cast({} as decimal(15, 0))"
        score = F.expr(f"(1000000BD * ({exact.format('a')} * {exact.format('a')})) div ({exact.format('l')} * {exact.format('r')})")
        scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
        longer = phrases.where("words > 2").withColumn("w", w)
        parts = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
        most = longer.select("lang", "f", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        left = scored.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
        order = [F.desc("s.score"), F.desc("a"), F.col("phrase")]
        # the first of each part of a language, then of all parts
        some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
        some = left.select("lang", "phrase", "a", "s").withColumn("rank", some).where(F.col("rank") <= top).drop("rank")
        first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        out = materialize(first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score"), "collocations")
        own.only(out)
    return out
