"""Language-model scores of whole documents.

Word counts over all training texts come from a shuffle; they give the smoothed base score. Frequent words are symbols
of a gated recurrent model; all others fall in classes by their last bytes, and within a class a word has its smoothed
share of the class's count. The counts of words outside a broadcast table of bounded size are joined. Each text is cut
into words once more to a row of symbols, which is written; the model learns from all training rows where they lie, in
rounds: in each, every partition goes over all of its own, and the weights are averaged by token count.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, frequent, keep_pages, materialize, slices, texts, with_row
from .gru import RATE, Gru
from .language_id import fold

#: Words with a symbol of their own, and classes of the others.
SYMBOLS, TAILS = 1000, 48
#: Most words with counts in the broadcast table. Words of more bytes are known by a digest, so that each fits.
HEAD, HEAD_BYTES = 300_000, 40
#: Rounds of training. Each learns from every training document; after each the weights are averaged.
ROUNDS = 2
#: Bytes of texts that are cut into words at a time: each of their distinct words is looked up once.
SLICE = 8 << 20
#: Symbols that are learned from and scored at a time.
LESSON, PART = 500_000, 5_000_000
#: Stands for the end; no word holds white space.
END = "\n"


def tail(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def _words(text: bytes) -> list[bytes]:
    """The words of a text; a long one is its digest, which begins with white space as no word does."""
    codes, distinct, _ = coded(pa.array([text.decode()]))
    return [texts(distinct)[i] for i in codes.tolist()] if len(codes) else []


def _digest(word: bytes) -> str:
    return " " + hashlib.sha256(word).hexdigest()[:32]


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(the words of all texts as places in distinct, distinct, how many words each text has); null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    every = lists.flatten().dictionary_encode()
    codes, distinct = every.indices.to_numpy(), every.dictionary.cast(pa.string())
    # white space at an end of a text leaves an empty word there
    solid = codes != distinct.index("").as_py()
    sizes = np.diff(np.concatenate(([0], np.cumsum(solid)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
    long = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) > HEAD_BYTES)
    if len(long):
        mask = np.zeros(len(distinct), bool)
        mask[long] = True
        distinct = pc.replace_with_mask(distinct, pa.array(mask), pa.array(list(map(_digest, texts(distinct.take(long)))), distinct.type))
    return codes[solid], distinct, sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in slices(batches, "text", SLICE):
            codes, distinct, _ = coded(batch.column("text"))
            n = np.bincount(codes, minlength=len(distinct))
            found = pa.table({"word": distinct, "c": n}).filter(pa.array(n > 0))
            held += [found, pa.table({"word": [END], "c": [batch.num_rows]}, found.schema)]
            rows += len(found)
            if rows > 1_000_000:
                held = [_summed(held)]
                rows = len(held[0])
                if rows > 500_000:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from _summed(held).to_batches()

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])


class Lexicon:
    """Words of the table: their counts and symbols; what the classes of all other words hold."""

    def __init__(self, words: list[str], counts: np.ndarray, held: np.ndarray, kinds: np.ndarray, total: int, distinct: int):
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
        self.words, self.counts = [words[i].encode() for i in order], counts[order]
        self.own = min(SYMBOLS, len(order)) if order and words[order[0]] == END else 0
        # the classes hold what the symbols leave
        for w, c in zip(self.words[: self.own], self.counts[: self.own].tolist()):
            held[tail(w)] -= c
            kinds[tail(w)] -= 1
        self.held, self.kinds, self.total, self.distinct = held, kinds, total, distinct
        #: Of each word of the table its symbol.
        self.symbol = np.array([i if i < self.own else self.own + tail(w) for i, w in enumerate(self.words)], np.int64)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate((self.counts[: self.own], self.held)).astype(float)

    def table(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def lexicon(counts: DataFrame) -> Lexicon:
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    ending = F.crc32(F.expr("substring(cast(word as binary), greatest(octet_length(word) - 2, 1), 3)")) % TAILS
    held, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        held[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    end = counts.where(F.col("word") == END)
    got = frequent(counts.where(F.col("word") != END), "c", HEAD).unionByName(end).toArrow()
    return Lexicon(got.column("word").to_pylist(), got.column("c").to_numpy(), held, kinds, total or 0, distinct)


def parts(batches: Iterator[pa.RecordBatch], most: int = PART) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with a column of symbols, in parts of about `most` of them; a longer text stands alone."""
    for batch in slices(batches, "symbols", 2 * most):
        yield batch, [np.frombuffer(x, "<u2") for x in batch.column("symbols").to_pylist()]


def fitted(rows: DataFrame, counts: np.ndarray) -> Gru:
    """The model, trained on all rows (_row, symbols) in each round; `seen` has the tokens of all rounds. A partition starts from the
    round's weights and sends only its own and its token count; they are summed in about sqrt(partitions) tasks, then here."""
    spark, model = rows.sparkSession, Gru(counts)
    model.seen = 0
    fields = ["name", "tokens", "weights"]

    def weights(p: dict[str, np.ndarray], tokens: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(p), pa.string()), pa.array([tokens] * len(p), pa.int64()), pa.array([a.tobytes() for a in p.values()], pa.binary())], fields)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Counter(), {}
        for batch in batches:
            for name, n, w in zip(*(batch.column(f).to_pylist() for f in fields)):
                tokens[name] += n
                sums[name] = sums.get(name, 0) + np.frombuffer(w, "<f8")
        for name, w in sums.items():
            yield weights({name: w}, tokens[name])

    for turn in range(ROUNDS):
        start, rate = spark.sparkContext.broadcast(model), RATE * (1 if turn + 1 < ROUNDS else 0.3)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_pages()
            gru = Gru(counts)
            gru.p = {k: a.copy() for k, a in start.value.p.items()}
            n = gru.learn((lines for _, lines in parts(batches, PART // 4)), rate)
            if n:
                yield weights({k: a.astype("<f8").ravel() * n for k, a in gru.p.items()}, n)

        made = rows.select("symbols").mapInArrow(fit, "name string, tokens long, weights binary")
        got = materialize(made.repartition(max(1, math.isqrt(made.rdd.getNumPartitions()))).mapInArrow(add, made.schema), "weights")
        tokens, sums = Counter(), {}
        for r in got.toLocalIterator():
            tokens[r["name"]] += r["tokens"]
            sums[r["name"]] = sums.get(r["name"], 0) + np.frombuffer(r["weights"], "<f8")
        for name, w in sums.items():
            model.p[name] = (w / tokens[name]).astype(np.float32).reshape(model.p[name].shape)
        model.seen += max(tokens.values(), default=0)
        start.unpersist()
    return model


def symbols(found: list[bytes], table: dict[bytes, int], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(places in the table or -1, symbols, the words that aren't there)"""
    at = np.array(list(map(table.get, found, repeat(-1))), np.int64)
    away = np.flatnonzero(at < 0)
    gone = [found[i] for i in away.tolist()]
    out = lex.symbol[at] if len(lex.symbol) else at.copy()
    out[away] = [lex.own + tail(w) for w in gone]
    return at, out, gone


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Rows that repeat count and are scored each, also with null ids. Very long
    texts are scored whole, in windows that hand the state on. If no row is for training, N and V are 0, no word is
    known, and base_score is 0. No rows give no rows. Other columns are ignored. Both scores are log10 probabilities of
    the whole text.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), (fold(id_col) == held_out).alias("held_out"))
    spark = docs.sparkSession
    counts = materialize(word_counts(base.where(~F.col("held_out"))), "counts")
    lex = lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Symbols of each text, its scores as far as the table knows its words, and the words that it doesn't know."""
        own = shared.value
        table = own.table()
        logs = np.log10(own.counts + 0.5)
        room = np.log10(own.held + 0.5 * (own.kinds + 1))
        whole = math.log10(own.total + 0.5 * (own.distinct + 1))
        end = table.get(END.encode(), -1)
        base_end = logs[end] if end >= 0 else math.log10(0.5)
        names = ["id", "held_out", "n_tokens", "known", "plain", "outside", "away", "times", "symbols"]
        for batch in slices(batches, "text", SLICE):
            codes, distinct, sizes = coded(batch.column("text"))
            many, of = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            at, sym, _ = symbols(texts(distinct), table, own)
            at, sym = at[codes], sym[codes]
            here, rare = at >= 0, sym >= own.own
            known = np.bincount(of[here], minlength=many) + (end >= 0)
            plain = np.bincount(of[here], logs[at[here]], many) + base_end - (sizes + 1) * whole
            outside = np.bincount(of[here & rare], logs[at[here & rare]], many) - np.bincount(of[rare], room[sym[rare] - own.own], many)
            # of each text the words that aren't there, each once
            pairs, times = np.unique(of[~here] * len(distinct) + codes[~here], return_counts=True)
            each = pa.array(np.searchsorted(pairs, np.arange(many + 1) * len(distinct)).astype(np.int32))
            away = pa.ListArray.from_arrays(each, distinct.take(pa.array(pairs % max(len(distinct), 1))))
            begin = np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32)
            lines = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(begin), pa.py_buffer(sym.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(plain, pa.float64()), pa.array(outside, pa.float64()), away, pa.ListArray.from_arrays(each, pa.array(times, pa.int64())), lines], names)

    kind = docs.schema[id_col].dataType.simpleString()
    made = base.mapInArrow(read, f"id {kind}, held_out boolean, n_tokens long, known long, plain double, outside double, away array<string>, times array<long>, symbols binary")
    made = materialize(with_row(made), "symbols")
    model = spark.sparkContext.broadcast(fitted(made.where(~F.col("held_out")), lex.symbol_counts()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_pages()
        gru, own = model.value, shared.value.own
        for batch, lines in parts(batches):
            got = gru.score(lines) / math.log(10) if own else np.array([-(len(x) + 1) * math.log10(1 + TAILS) for x in lines])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], [*batch.schema.names[:-1], "own"])

    scored = made.select(ROW, "id", "held_out", "n_tokens", "known", "plain", "outside", "symbols")
    scored = scored.mapInArrow(score, f"{ROW} long, id {kind}, held_out boolean, n_tokens long, known long, plain double, outside double, own double")
    spread = made.select(ROW, F.explode(F.arrays_zip("away", "times")).alias("w")).select(ROW, F.col("w.away").alias("word"), F.col("w.times").alias("times"))
    seen = spread.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = seen.groupBy(ROW).agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.join(more, ROW, "left").fillna(0, ["more", "more_known"])
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("plain") + F.col("more")).alias("base_score"), (F.col("own") + F.col("outside") + F.col("more")).alias("score"))
