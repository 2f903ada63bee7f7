"""What the operators share: scratch tables, text as bytes in numpy, word hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"
U = np.uint64
#: What `[^\x20\x09-\x0D]+` takes as white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is named, one in the warehouse, but only on a local master (tests)."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{at.rstrip('/')}/tables"


#: Spark drops a query's shuffle files when it ends, not when the driver happens to collect its garbage. What is written is never computed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes in a batch that goes to Python while a table is written, so that few texts wait on either side.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


class Scratch:
    """The tables that were written in a scope, for those who know when nobody needs them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def only(self, *frames: DataFrame) -> None:
        """Deletes the tables of this scope, but for those that `frames` read."""
        plain = lambda at: at.split(":", 1)[-1].lstrip("/")
        used = {plain(f.rsplit("/", 1)[0]) for df in frames for f in df.inputFiles()}
        hadoop, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        for at in [t for t in self.tables if plain(t) not in used]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(hadoop).delete(path, True)
            self.tables.remove(at)


_scope: ContextVar[Scratch | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A scope of tables. What it still has at its end belongs to the scope around it; without one, it stays in the shared folder."""
    outer, own = _scope.get(), Scratch(spark)
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        if outer:
            outer.tables += own.tables


def _write(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """Calls write with a new path in the shared folder, under the settings above; returns that path."""
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        write(at)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if scope := _scope.get():
        scope.tables.append(at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, lost executors cost nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df.sparkSession, name, df.write.parquet))


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As materialize(), in as many buckets as shuffles have partitions: a join on `column` leaves the table where it is."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).format("parquet")
    _write(spark, name, lambda at: writer.option("path", at).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # only its name: the files stay, and `out` has them
    return out


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, missing ones as null. Other columns can't clash with an operator's own."""
    there = set(docs.columns)
    return docs.select(*(F.col(f"`{c}`") if c in there else F.lit(None).cast("string").alias(c) for c in columns))


def with_row(df: DataFrame) -> DataFrame:
    """A number for each row, fixed only once the table is written: materialize() it before it is read twice."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def boxed(docs: DataFrame) -> DataFrame:
    """A number for each row and the whole row as `doc`, so that no column of its own can clash. See with_row()."""
    return docs.select(F.monotonically_increasing_id().alias(ROW), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


#: A key is hot if it has more rows than these, which one task bears well at any size of table.
BEARS = 10_000
#: Hot keys are broadcast if there are no more than these; else their join is a shuffle whose large parts Spark splits.
MOST_HOT = 1 << 20


def hot_above(table: DataFrame, n: str = "n") -> int | None:
    """BEARS if table, which has a row a key with its number of rows, has a hot key; else None."""
    most = table.agg(F.max(n)).first()[0]
    return BEARS if most and most > BEARS else None


def few(hot: DataFrame) -> DataFrame:
    """A written table of hot keys, marked for broadcast if it is small enough."""
    return F.broadcast(hot) if hot.count() <= MOST_HOT else hot


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined (inner) with a table of one row a key. The table is written first, so that both sides come straight from
    shuffles: then Spark splits the rows of a hot key over tasks as it runs (adaptive skew joins), which it can't do to a
    side that is still to be aggregated."""
    return rows.join(materialize(table, "by-key"), keys)


def frequent(counted: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the greatest n, at most `most` of them: those from a level of log2(n) on, which needs no sort."""
    level = F.least(F.floor(F.log2(n) * 8), F.lit(400)).cast("int")
    left, least = most, 10**6
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return counted.where(level >= least)


def lower_ascii(c) -> F.Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _give_back() -> None:
    """Memory that a task has freed goes back to the system, as its worker stays."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # not every C library has it
        libc.malloc_trim(0)


def keep_pages() -> None:
    """For a task that makes arrays of some MB over and over: they stay in its memory until it ends, else each would be new pages of the system."""
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 8 << 20)  # larger ones still come from the system (M_MMAP_THRESHOLD)
        libc.mallopt(-1, 64 << 20)  # how much is kept (M_TRIM_THRESHOLD)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about `most` bytes of text, so that temporary arrays stay small; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    _give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings or of bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.type != wide:
        column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each text's bytes; null is empty."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    at = offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_places: dict[int, np.ndarray] = {}


def places(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers, the same for every task."""
    if len(_places.get(seed, ())) < n:
        with np.errstate(over="ignore"):
            _places[seed] = mix(np.arange(max(n, 4096), dtype=U) + U(seed) * U(0x632BE59BD9B4E019)) | U(1)
    return _places[seed]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words before each text and at the end) of `[^\\x20\\x09-\\x0D]+` in each text; `space` marks other bytes between words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of words hashed at a time.
PART = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    out, lengths, at = np.zeros(len(starts), U), ends - starts, 0
    total = np.cumsum(lengths)
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] - lengths[at] + PART, side="right")))
        own = lengths[at:to]
        place = places(int(own.max()) + 1, seed)
        first = np.cumsum(own) - own
        inside = np.arange(own.sum()) - np.repeat(first, own)
        with np.errstate(over="ignore"):
            v = (data[np.repeat(starts[at:to], own) + inside].astype(U) + U(1)) * place[inside]
            out[at:to] = mix(np.add.reduceat(v, first) ^ (own.astype(U) * U(0xD6E8FEB86659FD93)))
        at = to
    return out


def shingle_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Of each run of k consecutive words, crossing texts too: callers drop those."""
    if len(h) < k:
        return np.zeros(0, U)
    place = places(k, seed + 77)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for j in range(k):
            out += h[j : j + n] * place[j]
    return mix(out)
