"""Byte-level BPE: a global shuffle of distinct words.

Each text is cut into pre-tokens. Words that are frequent in a bounded sample are shuffled first, each distinct one is
encoded once, and they are looked up in a broadcast table of bounded size, so that no word is hot. All others are
exploded with their places, dealt out by word so that each distinct one is encoded once (once for every BEARS blocks,
80 GB of text, so that a word that stands everywhere but isn't in the table is spread), and go back to where they came from. Documents wait in blocks of about BLOCK bytes, as packed word codes in a bucketed table, to which ids come
back without moving it; a word is sent once a block however often it stands there. Ids are put in place by position,
and decoding joins each id to the token-byte table, which is as large as the tokenizer and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BEARS, ROW, bucketed, frequent, materialize, slices, with_row

#: Most words in the broadcast table, and bytes in one of them: with ids some 30 MB at most.
HEAD, HEAD_BYTES = 400_000, 40
#: About so many documents are sampled to choose the table. It changes no result, only how many words are shuffled.
SAMPLE_DOCS = 24_000
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK = 8 << 20
#: For texts of basic Latin to U+02AF without the characters in ODD, these patterns cut alike; the second is faster in `re`.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u02af"
LATIN_PATTERN = rf" ?[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
ODD = "[\x1c-\x1f\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\u02b0-\U0010ffff]"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of neighbouring parts the pair with the lowest rank is joined, leftmost first, until none has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after, before, ends, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue  # one of the two has grown or gone
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(word[a : ends[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, ends[after[a]]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def pack(codes: np.ndarray) -> bytes:
    """Codes as planes of bytes, the lowest first, compressed; the planes that are needed."""
    planes = max(1, -(-int(codes.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes(), 9)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    codes = planes[0].astype(np.uint32)
    for i in range(1, len(planes)):
        codes |= planes[i].astype(np.uint32) << np.uint32(8 * i)
    return codes


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each length, in a row."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


class Table:
    """Arrays of one type, given as bytes, one after the other."""

    def __init__(self, rows: list[bytes], dtype):
        self.lengths = np.array([len(x) for x in rows], np.int64) // np.dtype(dtype).itemsize
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(rows), dtype)


class Named:
    """A broadcast value with a name that is the same in all workers."""

    def __init__(self, shared):
        self.shared, self.id = shared, uuid.uuid4().hex

    @property
    def value(self):
        return self.shared.value


class Codec:
    """For one tokenizer: ranks by token, the pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        if sorted(ranks.values()) != list(range(len(ranks))) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("ranks must be 0..n-1 and hold every single byte")

    def words(self, text: str) -> list[str]:
        if (find := self.__dict__.get("_find")) is None:
            find = self._find = regex.compile(self.pattern).findall
            self._odd, self._latin = re.compile(ODD).search, re.compile(LATIN_PATTERN).findall
        return self._latin(text) if self.pattern == PLAIN_PATTERN and not self._odd(text) else find(text)

    def token_bytes(self) -> Table:
        return Table(sorted(self.ranks, key=self.ranks.__getitem__), np.uint8)

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _sampled(docs: DataFrame, shared) -> DataFrame:
    """(word, n) over a sample of documents by hash."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    part = docs.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in slices(batches, "text", 16 << 20):
            n: Counter = Counter()
            for t in _strings(batch):
                n.update(codec.words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return part.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.octet_length("word") <= HEAD_BYTES)


def id_type(ranks: dict[bytes, int]) -> str:
    """Little-endian, as wide as the ids need."""
    return "<u2" if len(ranks) <= 1 << 16 else "<u4"


def _encoded(rows: DataFrame, shared) -> DataFrame:
    """Rows (word, block, at), sorted by word, to rows (block, at, sizes, ids): the places of some words of a block, and
    their ids as bytes, one after the other. A word that follows itself isn't encoded again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks
        kind = id_type(ranks)
        last, now = None, b""
        for batch in batches:
            ids = []
            for w in batch.column("word").to_pylist():
                if w != last:
                    last, now = w, np.array(encode_word(w.encode(), ranks), kind).tobytes()
                ids.append(now)
            block, at, sizes = batch.column("block").to_numpy(), batch.column("at").to_numpy(), np.array([len(x) for x in ids], np.int32)
            order = np.lexsort((at, block))
            cuts = np.flatnonzero(np.diff(block[order], prepend=block[order][0] - 1)) if len(order) else np.zeros(0, np.int64)
            bounds = pa.array(np.append(cuts, len(order)).astype(np.int32))
            flat = [b"".join(ids[i] for i in order[a:b].tolist()) for a, b in zip(cuts, [*cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cuts]), pa.ListArray.from_arrays(bounds, pa.array(at[order])), pa.ListArray.from_arrays(bounds, pa.array(sizes[order])), pa.array(flat, pa.binary())], ["block", "at", "sizes", "ids"])

    return rows.select("word", "block", "at").mapInArrow(encode, "block long, at array<int>, sizes array<int>, ids binary")


def head_words(docs: DataFrame, shared) -> pa.Table:
    """At most HEAD frequent words with their ids, each encoded once where the shuffle has put it. A threshold on the
    count keeps the bound without a sort."""
    counted = materialize(_sampled(docs, shared), "sampled")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks
        kind = id_type(ranks)
        for batch in batches:
            ids = [np.array(encode_word(w.encode(), ranks), kind).tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["word", "n", "ids"])

    found = frequent(counted, "n", HEAD).select("word", "n").mapInArrow(encode, "word string, n long, ids binary").toArrow()
    return found.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"])


#: The last thing that this worker made from a broadcast value: tasks that follow each other need the same.
_made: list = [None, None]


def _once(key: tuple, make):
    if _made[0] != key:
        _made[:] = None, None  # the old one goes first
        _made[:] = key, make()
    return _made[1]


def _with_away(table: Table, away: pa.ListScalar, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, ids) of the table's words and then a block's own, which came back in parts."""
    parts = away.values
    if parts is None or not len(parts):
        return table.starts, table.lengths, table.flat
    at = parts.field("at").flatten().to_numpy()
    own = parts.field("sizes").flatten().to_numpy().astype(np.int64) // kind.itemsize
    lengths, starts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    lengths[at], starts[at] = own, np.cumsum(own) - own + len(table.flat)
    flat = np.frombuffer(b"".join(parts.field("ids").to_pylist()), kind)
    return np.concatenate((table.starts, starts)), np.concatenate((table.lengths, lengths)), np.concatenate((table.flat, flat))


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; with keep_ids the column ids, with keep_decoded the column decoded.

    Null texts are empty and have no tokens. Rows that repeat are encoded each, and null ids stay null. Special tokens are
    plain text. A very long text is a block of its own. No rows give no rows. carry names input columns to return as they
    are; all others are ignored, so no name can clash.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`") for c in carry if c != text_col))
    shared = spark.sparkContext.broadcast(Codec(ranks, pattern))
    head = Named(spark.sparkContext.broadcast(head_words(base.select("text"), shared)))
    kept = [f for f in base.schema.fields if f.name != "text" or "text" in carry]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: codes of all its words, their number in each text, the words that aren't in the table."""
        codec, known = shared.value, _once(("words", head.id), lambda: {w: i for i, w in enumerate(head.value.column("word").to_pylist())})
        for batch in slices(batches, "text", BLOCK):
            codes, sizes, own = [], [], {}
            for t in _strings(batch):
                found = codec.words(t)
                sizes.append(len(found))
                codes.append(np.fromiter((known[w] if w in known else own.setdefault(w, len(own)) + len(known) for w in found), np.uint32, len(found)))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays([pa.array([pack(np.concatenate(codes))], pa.binary()), one(pa.array(sizes, pa.int32())), one(pa.array(list(own), pa.string())), *(one(batch.column(f.name)) for f in kept)], ["packed", "sizes", "words", *(f"_{f.name}" for f in kept)])

    held = ", ".join(f"`_{f.name}` array<{f.dataType.simpleString()}>" for f in kept)
    blocks = bucketed(with_row(base.mapInArrow(cut, f"packed binary, sizes array<int>, words array<string>, {held}")), ROW, "blocks")
    # a block sends a word once, so that no (word, group) has many more than BEARS rows, whatever the word
    group = F.pmod(F.xxhash64("block"), F.lit(-(-blocks.count() // BEARS) or 1))
    away = blocks.select(F.col(ROW).alias("block"), F.posexplode("words").alias("at", "word")).repartition("word", group).sortWithinPartitions("word")
    back = _encoded(away, shared).groupBy(F.col("block").alias(ROW)).agg(F.collect_list(F.struct("at", "sizes", "ids")).alias("away"))
    joined = blocks.drop("words").join(back, ROW, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(id_type(shared.value.ranks))
        table, spell = _once(("ids", head.id), lambda: (Table(head.value.column("ids").to_pylist(), kind), shared.value.token_bytes()))
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                starts, lengths, flat = _with_away(table, batch.column("away")[0], kind)
                codes, at = unpack(batch.column("packed")[0].as_py()), 0
                n, shas, plain, every, back = [], [], [], [np.zeros(0, np.int32)], []
                for size in batch.column("sizes")[0].as_py():
                    c = codes[at : at + size]
                    at += size
                    ids = flat[expand(starts[c], lengths[c])]
                    raw = spell.flat[expand(spell.starts[ids], spell.lengths[ids])].tobytes()
                    n.append(len(ids))
                    shas.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    plain.append(hashlib.sha256(raw).hexdigest())
                    if keep_ids:
                        every.append(ids.astype(np.int32))
                    if keep_decoded:
                        back.append(raw.decode())
                more = []
                if keep_ids:
                    more.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(np.concatenate(every))))
                if keep_decoded:
                    more.append(pa.array(back, pa.string()))
                every.clear()
                yield pa.RecordBatch.from_arrays([*(batch.column(f"_{f.name}")[0].values for f in kept), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(plain, pa.string()), *more], [*(f.name for f in kept), "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded
    return joined.mapInArrow(finish, schema).withColumnRenamed("id", id_col)
