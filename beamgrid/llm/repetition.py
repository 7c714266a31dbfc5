"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import _stage
from . import _text as t

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Shares of a text's word characters that may lie inside repeated n-grams and in repeated lines.

    The first length also decides the base rule; the list must be consecutive.
    """

    min_words: int = 10
    repeat_words_percent: int = 20
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15})
    line_chars: float = 0.30


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "dup_line_chars long, repeat_chars array<long>, repetition_failed boolean, kept boolean"
)


def measure(buf: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """The measures of each row of a chunk of texts."""
    rows = len(offsets) - 1
    w = t.words(buf, offsets, t.SPACE)
    n_words = w.counts.astype(np.int64)
    point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = point[w.end] - point[w.start]
    word_chars = t.row_sums(chars, w.first)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]

    h, last = t.word_hashes(buf, w), w.last_of_row()
    salt = t.mixed(np.arange(1, rows + 1, dtype=np.uint64) * t.STEP)
    salt_of_word = np.repeat(salt, w.counts)
    repeat_chars, n_repeat, at, rolled, done = [], np.zeros(rows, np.int64), None, None, 0
    for n in sorted(limits.ngrams):
        if rolled is None:
            rolled = t.window_hashes(h, n)
        else:
            for k in range(done, n):  # one more word at the end of each window
                rolled = rolled[: max(0, len(h) - k)] * t.STEP + h[k:] if len(h) > k else rolled[:0]
        if at is None:
            at = np.flatnonzero(np.arange(len(rolled)) + n <= last[: len(rolled)])
        else:  # a repeated n-gram begins and ends with repeated shorter ones
            before = np.zeros(len(h) + 1, bool)
            before[at] = True
            at = at[(at + n <= last[at]) & before[at + n - done]]
        at = at[t.repeated(t.mixed(rolled[at] ^ salt_of_word[at]))]
        inside = t.covered(len(h), at, n)
        if done == 0:
            n_repeat = t.row_sums(inside, w.first)
        repeat_chars.append(t.row_sums(chars * inside, w.first))
        done = n

    n_dup, dup_chars = _duplicate_lines(buf, offsets, w, chars, salt)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_words_percent * n_words)
    whole = np.maximum(word_chars, 1)
    failed = dup_chars > limits.line_chars * whole
    for n, c in zip(sorted(limits.ngrams), repeat_chars, strict=True):
        failed |= c > limits.ngrams[n] * whole
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols.astype(np.int64), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "dup_line_chars": dup_chars, "repeat_chars": np.stack(repeat_chars, 1) if rows else np.zeros((0, len(limits.ngrams)), np.int64),
        "repetition_failed": failed, "kept": ~(base_failed | failed),
    }


def _duplicate_lines(buf: np.ndarray, offsets: np.ndarray, w: t.Words, chars: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the lines with a word that equal an earlier one, and the word characters in them."""
    rows = len(offsets) - 1
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = t.words(buf, offsets, newline)  # runs without \n: the lines that are not empty
    first_word = np.searchsorted(w.start, lines.start)
    after = np.searchsorted(w.start, lines.end)
    with_word = after > first_word
    key = t.span_hashes(buf[lines.is_word], lines.end - lines.start)
    row = lines.row
    key = t.mixed(key ^ salt[row])[with_word] if len(row) else key[:0]
    row, first_word, after = row[with_word], first_word[with_word], after[with_word]
    later = np.ones(len(key), bool)
    later[np.unique(key, return_index=True)[1]] = False
    c = np.concatenate([[0], np.cumsum(chars)])
    own = (c[after] - c[first_word]) * later
    return np.bincount(row, later, rows).astype(np.int64), np.bincount(row, own, rows).astype(np.int64)


def score(docs: DataFrame, text: str = "text", limits: Limits | None = None, into: str = "repetition") -> DataFrame:
    """docs with a struct column (`repetition`) of measures and verdict beside each row.

    A null or empty text has no words: all counts are zero and the base rule fails it. Repeated rows are judged each by itself,
    extra columns stay, but for one named as `into` says, which is replaced. Texts are read whole, whatever their length.
    Window and line equality is decided by 64-bit hashes salted by row.
    """
    limits = limits or Limits()

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    @arrow_udf(SCHEMA)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [measure(buf, offsets, limits) for _, buf, offsets in t.chunks(column)] or [measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), limits)]
            whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            lists = whole.pop("repeat_chars")
            arrays = {k: pa.array(v) for k, v in whole.items()}
            arrays["repeat_chars"] = pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), pa.array(lists.ravel()))
            yield pa.StructArray.from_arrays([arrays[k] for k in names], names)

    return docs.withColumn(into, judge(F.col(text)))


def keep(docs: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of docs whose text passes, with the columns of docs."""
    own = _stage.Own(docs)
    return score(own.df, own.of(text), limits).where("repetition.kept").select(*own.back())
