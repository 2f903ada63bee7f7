"""Quality rules by repetition coverage: rolling hashes of word runs of several lengths, and of lines, in numpy.

A run of words or a line is a duplicate where it is met again in the same text. The characters inside duplicates are
counted once for each length of run, so a text that says something twice is half covered whatever it says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, mix, shingle_hashes, slices, utf8, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """What a text may hold at most, in hundredths: of its word characters in duplicated runs of n words (run), of its
    characters in duplicated lines (line_chars), of its lines with a word that are duplicates (lines). The limits let a
    short text repeat one line."""

    run: dict[int, int] = field(default_factory=lambda: {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20})
    line_chars: int = 30
    lines: int = 50
    #: Base rules: least number of words, and most of them in hundredths in 3-word windows found twice or more.
    least_words: int = 50
    repeat_words: int = 50


def _per_text(sums: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 or count array between cuts."""
    total = np.concatenate(([0], np.cumsum(sums, dtype=np.int64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, equal to an earlier one) of each key."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, later


def _covered(places: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of k that begins at one of places."""
    turn = np.zeros(n + 1, np.int32)
    turn[places] += 1
    turn[places + k] -= 1
    return np.cumsum(turn)[:-1] > 0


def measure(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column; `run_n` are word characters inside duplicated runs of n words."""
    data, offsets = utf8(column)
    starts, ends, at = words(data, offsets)
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    size = point[ends] - point[starts]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    out = {"n_words": np.diff(at), "word_chars": _per_text(size, at), "n_symbols": _per_text(SYMBOLS[data], offsets)}

    # a line with a word begins after the last line break before its first word, or with its text
    breaks = np.flatnonzero(data == 10)
    nth = np.searchsorted(breaks, starts)
    first = np.flatnonzero((np.diff(nth, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    of, nth = text[first], nth[first]
    a = np.maximum(np.concatenate(([0], breaks + 1))[nth], offsets[of])
    b = np.minimum(np.append(breaks, len(data))[nth], offsets[of + 1])
    cuts = np.searchsorted(of, np.arange(len(offsets)))
    chars = point[b] - point[a]
    with np.errstate(over="ignore"):
        own = mix(np.arange(len(offsets), dtype=U) * U(0x9E3779B97F4A7C15))
        _, again = _repeated(mix(word_hashes(data, a, b, 31) ^ own[of]))
        out |= {"n_lines": np.diff(cuts), "n_dup_lines": _per_text(again, cuts), "line_chars": _per_text(chars * again, cuts), "all_line_chars": _per_text(chars, cuts)}

        h = word_hashes(data, starts, ends, 32)
        for k in (3, *rules.run):
            runs = shingle_hashes(h, k, 33)
            inside = np.flatnonzero(text[: len(runs)] == text[k - 1 :][: len(runs)])
            twice, later = _repeated(mix(runs[inside] ^ own[text[inside]]))
            if k == 3:
                out["n_repeat_words"] = _per_text(_covered(inside[twice], k, len(h)), at)
            if k in rules.run:
                out[f"run_{k}"] = _per_text(size * _covered(inside[later], k, len(h)), at)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "all_line_chars")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row per input row: id, the counts, base_failed, `failed` (names of the rules that the text breaks, sorted) and kept.

    Words are `[^\\x20\\x09-\\x0D]+`, lines are cut at line feeds and count if they have a word. A text is kept if it
    breaks no base rule (words, repeat_words) and none of coverage (run_n, line_chars, lines). Equality is by 64-bit
    hashes within a text. Null texts are empty, have no words and so fail. Ties can't arise; repeated rows and null ids
    are judged each for itself; very long texts are measured whole, alone in their slice. No rows give no rows. Other
    columns are ignored, whatever their names.
    """
    rules = rules or Rules()
    runs = [f"run_{k}" for k in rules.run]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = measure(batch.column("text"), rules)
            base = {"words": m["n_words"] < rules.least_words, "repeat_words": 100 * m["n_repeat_words"] > rules.repeat_words * m["n_words"]}
            more = {"lines": 100 * m["n_dup_lines"] > rules.lines * m["n_lines"], "line_chars": 100 * m["line_chars"] > rules.line_chars * m["all_line_chars"]}
            more |= {f"run_{k}": 100 * m[f"run_{k}"] > most * m["word_chars"] for k, most in rules.run.items()}
            base_failed, broken = np.any([*base.values()], 0), base | more
            failed = [[k for k in sorted(broken) if broken[k][i]] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(m[c], pa.int64()) for c in (*COUNTS, *runs)), pa.array(base_failed), pa.array(failed, pa.list_(pa.string())), pa.array([not f for f in failed])],
                ["id", *COUNTS, *runs, "base_failed", "failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    used = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    out = used.mapInArrow(judge, f"id {kind}, {', '.join(f'{c} long' for c in (*COUNTS, *runs))}, base_failed boolean, failed array<string>, kept boolean")
    return out.withColumnRenamed("id", id_col)
