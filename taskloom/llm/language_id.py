"""Language ID by a byte convolutional network, trained in numpy on labelled text.

Filters of several widths over one-hot bytes, the largest answer of each filter in a window, then softmax. Texts are
cut into windows of fixed length that cover them whole; a text's probabilities are the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER_NP, materialize, slices, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The network is fitted on at most about so many windows of each language, a window from each of so many documents. More
#: languages than these are refused, so that the sample stays bounded and no language is left out unseen.
SAMPLE, LANGUAGES = 600, 200
#: Steps of training and windows in each.
STEPS, BATCH, RATE = 400, 64, 0.01
UNKNOWN = "und"


def fold(id_col: str, n: int = 5) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(n))


class ByteNetwork:
    """weights[w][k]: what filter answers byte values at place k of a width-w filter."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.weights = [(r.standard_normal((w, 256, FILTERS)) * 0.3 / w**0.5).astype(np.float32) for w in WIDTHS]
        self.out = (r.standard_normal((len(WIDTHS) * FILTERS, len(labels))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on cross-entropy. Only the place where a filter answers most has a gradient."""
        r = np.random.default_rng(seed)
        params = [*self.weights, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            pick = r.integers(0, len(x), min(BATCH, len(x)))
            b, want = x[pick], y[pick]
            tops, places = [], []
            for w, t in zip(WIDTHS, self.weights):
                n = b.shape[1] - w + 1
                answer = sum(t[k][b[:, k : k + n]] for k in range(w))
                place = answer.argmax(1)
                places.append(place)
                tops.append(np.take_along_axis(answer, place[:, None], 1)[:, 0])
            top = np.concatenate(tops, 1)
            h = np.tanh(top)
            p = self._softmax(h @ self.out + self.bias)
            p[np.arange(len(b)), want] -= 1
            p /= len(b)
            grads = [np.zeros_like(t) for t in self.weights]
            dh = (p @ self.out.T) * (1 - h * h)
            for i, (w, g) in enumerate(zip(WIDTHS, grads)):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    at = np.take_along_axis(b, places[i] + k, 1)
                    np.add.at(g[k], (at, np.arange(FILTERS)[None]), d)
            grads += [h.T @ p, p.sum(0)]
            for q, g, a, s in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ready(self) -> None:
        """Joins the first two places of each filter to one table over pairs of bytes, and so the next two."""
        self._pairs = []
        for w, t in zip(WIDTHS, self.weights):
            self._pairs.append([((t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) if k + 1 < w else t[k], k, k + 1 < w) for k in range(0, w, 2)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows x, [n, WINDOW] bytes."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for a in range(0, len(x), 32):
            b = x[a : a + 32]
            both = b[:, :-1].astype(np.int32) << 8 | b[:, 1:]
            tops = []
            for w, tables in zip(WIDTHS, self._pairs):
                n = b.shape[1] - w + 1
                answer = None
                for t, k, pair in tables:
                    got = t.take((both if pair else b)[:, k : k + n], 0)
                    answer = got if answer is None else np.add(answer, got, out=answer)
                tops.append(answer.max(1))
            out[a : a + 32] = self._softmax(np.tanh(np.concatenate(tops, 1)) @ self.out + self.bias)
        return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each): side by side over each whole text; the last starts earlier, short texts are repeated to fill one."""
    lengths = np.diff(offsets)
    count = -(-lengths // WINDOW)
    of = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(np.minimum(nth * WINDOW, lengths[of] - WINDOW), 0)
    inside = (start[:, None] + np.arange(WINDOW)[None]) % np.maximum(lengths[of], 1)[:, None]
    size = np.minimum(lengths[of] - nth * WINDOW, WINDOW)
    return data[offsets[of][:, None] + inside], of, size


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0) -> ByteNetwork:
    """Fitted on a window of characters from at most about SAMPLE training documents of each language. Rows that repeat
    are drawn once; those with a null id are told apart by their texts. More than LANGUAGES languages raise a ValueError."""
    usable = docs.select(fold(id_col).alias("fold"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    usable = usable.where((F.col("fold") != held_out) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = materialize(usable.groupBy("lang").count(), "languages")
    if (n := counts.count()) > LANGUAGES:
        raise ValueError(f"{n} languages are more than {LANGUAGES}")
    chance = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = 1 + F.pmod(F.xxhash64("id", F.lit(9)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    picked = usable.join(F.broadcast(counts), "lang").where(chance < F.lit(float(SAMPLE)) / F.col("count"))
    picked = picked.select("lang", "id", F.substring("text", start.cast("int"), WINDOW).alias("text")).distinct()
    got = picked.toArrow()
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("id").to_pylist(), got.column("text").to_pylist()), key=lambda r: (r[0], r[1] or "", r[2]))
    labels = sorted({r[0] for r in rows})
    net = ByteNetwork(labels)
    if rows:
        data, offsets = utf8(pa.array([r[2] for r in rows], pa.large_string()))
        x, of, _ = windows(LOWER_NP[data], offsets)
        net.fit(x, np.array([labels.index(r[0]) for r in rows])[of])
    net.ready()
    return net


def identify(docs: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc (the id, or the whole row as a struct if carry), lang_pred, score. Only the text is looked at.

    A null text, one without a letter, and any text if nothing was learned, is `und` with score 0. Each row is judged
    for itself, so repeated rows repeat. score is the mean probability of the language over the text's windows, which
    cover very long texts whole; of equally probable languages the first by name is given. No rows give no rows. Columns of any other name do no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.col(f"`{id_col}`")
    base = docs.select(carried.alias("doc"), F.col(f"`{text_col}`").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "text", 2 << 20):
            data, offsets = utf8(batch.column("text"))
            n, lengths = len(offsets) - 1, np.diff(offsets)
            letters = [any(c.isalpha() for c in t) if t else False for t in batch.column("text").to_pylist()]
            names, scores = [UNKNOWN] * n, [0.0] * n
            if net.labels and len(data):
                x, of, size = windows(LOWER_NP[data], offsets)
                p = net.probabilities(x) * size[:, None]
                total = np.zeros((n, len(net.labels)))
                np.add.at(total, of, p)
                total /= np.maximum(lengths, 1)[:, None]
                best = total.argmax(1)
                for i, ok in enumerate(letters):
                    if ok:
                        names[i], scores[i] = net.labels[best[i]], min(float(total[i, best[i]]), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc", "lang_pred", "score"])

    schema = StructType([base.schema["doc"], *StructType.fromDDL("lang_pred string, score double").fields])
    return base.mapInArrow(judge, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score. See train() and identify()."""
    out = identify(docs, train(docs, id_col, **how), id_col)
    return out.select(F.col("doc").alias(id_col), (fold("doc") == 0).alias("held_out"), "lang_pred", "score")
