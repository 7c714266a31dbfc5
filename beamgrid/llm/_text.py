"""Whole texts as one byte buffer: word bounds, word and window hashes, coverage. All numpy, no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; small enough that the work arrays stay in cache and in bounded memory.
CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII that is neither a digit nor a lower-case letter (input is lower-cased first).
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_ONE_MORE = np.arange(1, 257, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_weights = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _position_weights(n: int) -> np.ndarray:
    """n odd 64-bit weights, always the same ones."""
    global _weights
    if n > len(_weights):
        size = 1 << int(n - 1).bit_length()
        _weights = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _weights


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows with about limit bytes, one row at least. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words of some rows: byte bounds, and for each row the index of its first word (one more entry at the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    is_word: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def last_of_row(self) -> np.ndarray:
        """For each word, the index one past its row's last word."""
        return np.repeat(self.first[1:], self.counts)


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Words:
    is_word = ~separator[buf]
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, ends = is_word.copy(), is_word.copy()
    if n:
        begins[1:] &= ~is_word[:-1] | cut[1:-1]
        ends[:-1] &= ~is_word[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, offsets), is_word)


@dataclass
class Runs:
    """Runs of bytes made ready for span_hashes(): where each begins, each byte's place in its run, and each byte plus one."""

    at: np.ndarray
    place: np.ndarray
    one_more: np.ndarray


def runs(values: np.ndarray, lengths: np.ndarray) -> Runs:
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    place -= np.repeat(at.astype(place.dtype), lengths)
    return Runs(at, place, _ONE_MORE[values])


def span_hashes(values: np.ndarray | Runs, lengths: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes; values holds the runs one after another, none of them empty. Families are independent; for several, runs() saves their common steps."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    r = values if isinstance(values, Runs) else runs(values, lengths)
    weights = _position_weights(int(lengths.max()) + 3 * family)[3 * family :]  # other weights for each place
    return mixed(np.add.reduceat(weights.take(r.place) * r.one_more, r.at))


def word_hashes(buf: np.ndarray, w: Words) -> np.ndarray:
    return span_hashes(buf[w.is_word], w.end - w.start)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A polynomial rolling hash of each n consecutive hashes (rows are not regarded)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= STEP
        out += h[j : j + m]
    return out


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """True for each of n places inside any span that begins at starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's words."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[first[1:]] - c[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
