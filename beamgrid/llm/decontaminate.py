"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against windows of training words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import _stage
from . import _text as t

WIDTH = 13
#: What a part of a benchmark may hold in a worker (windows and words together, as Grams.nbytes counts it); larger ones are scanned for in several passes.
BROADCAST_BYTES = 32 << 20
#: Bytes that a window takes besides its words.
_WINDOW = 32
_FILTER_BITS = 22
FOUND = "n_words long, spans array<struct<first: long, last: long, byte_first: long, byte_last: long>>, items array<string>"


class Grams:
    """Windows of benchmark items in numpy arrays over one blob of their words (joined by spaces).

    For each length: sorted window hashes and, in the same order, the windows' bytes in the blob and their item's number. Equal windows
    of one item are there once.
    """

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        column = pa.array([x for _, x in items], pa.large_string())
        blobs, base = [], 0
        parts: dict[int, list[np.ndarray]] = {}
        for first, buf, offsets in t.chunks(column):
            buf = t.LOWER[buf]
            w = t.words(buf, offsets, t.NON_ALNUM)
            h, size = t.word_hashes(buf, w), w.end - w.start
            begin = base + np.cumsum(size + 1) - size - 1
            # Each word's bytes and a space after it.
            blob = np.full(int((size + 1).sum()), 0x20, np.uint8)
            blob[np.arange(len(blob)) - np.repeat(begin - base, size + 1) < np.repeat(size, size + 1)] = buf[w.is_word]
            blobs.append(blob)
            base += len(blob)
            owner = np.array([number[items[first + k][0]] for k in range(len(offsets) - 1)], np.int64)
            short = np.minimum(w.counts, width)
            for n in np.unique(short[short > 0]).tolist():
                at = np.flatnonzero((np.repeat(short, w.counts) == n) & (np.arange(len(h)) + n <= w.last_of_row()))
                rolled = t.window_hashes(h, n)[at]
                parts.setdefault(n, []).append(np.stack([rolled.view(np.int64), begin[at], begin[at + n - 1] + size[at + n - 1], np.repeat(owner, w.counts)[at]]))
        self.blob = np.concatenate(blobs).tobytes() if blobs else b""
        self.hashes: dict[int, np.ndarray] = {}
        self.windows: dict[int, np.ndarray] = {}
        for n in sorted(parts):
            x = np.concatenate(parts[n], axis=1)
            h = x[0].view(np.uint64)
            x = x[:, np.lexsort((x[3], h))]
            h = x[0].view(np.uint64)
            again = np.zeros(len(h), bool)
            same = np.flatnonzero((h[1:] == h[:-1]) & (x[3, 1:] == x[3, :-1])) + 1
            for i in same.tolist():  # equal hashes are no proof
                again[i] = self._words(x, i) == self._words(x, i - 1)
            self.hashes[n], self.windows[n] = h[~again].copy(), np.ascontiguousarray(x[1:, ~again])

    def _words(self, x: np.ndarray, i: int) -> bytes:
        return self.blob[x[1, i] : x[2, i]]

    @property
    def nbytes(self) -> int:
        return len(self.blob) + sum(h.nbytes + self.windows[n].nbytes for n, h in self.hashes.items())

    def owners(self, n: int, key: np.uint64, words: bytes) -> tuple[int, ...]:
        """Numbers of the items that have this window of n words."""
        a, b = np.searchsorted(self.hashes[n], key, "left"), np.searchsorted(self.hashes[n], key, "right")
        begin, end, item = self.windows[n][:, a:b].tolist()
        return tuple({k for x, y, k in zip(begin, end, item, strict=True) if self.blob[x:y] == words})


def _pieces(text: str, width: int, limit: int) -> list[str]:
    """A text cut to pieces that have each of its windows at least once; all but those of very long words are of at most about limit / 8 bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) * _WINDOW // 2 <= limit // 8:
        return [text]
    buf = t.LOWER[raw]
    w = t.words(buf, np.array([0, len(buf)]), t.NON_ALNUM)
    n, out, k = len(w.start), [], 0
    cost = np.cumsum(w.end - w.start + 1 + _WINDOW)
    while k == 0 or k + width <= n:
        spent = cost[k - 1] if k else 0
        stop = max(k + width, min(n, int(np.searchsorted(cost, spent + limit // 8, "right"))))
        out.append(buf[w.start[k] : w.end[min(stop, n) - 1]].tobytes().decode() if n else "")
        k = stop - width + 1
    return out


def _filter(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return bits


def find(buf: np.ndarray, offsets: np.ndarray, grams: Grams, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[list[str]]]:
    """For each row: words, spans of hit words (word numbers and byte offsets, ends exclusive), items found."""
    rows = len(offsets) - 1
    buf = t.LOWER[buf]
    w = t.words(buf, offsets, t.NON_ALNUM)
    h, last = t.word_hashes(buf, w), w.last_of_row()
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(rows)]
    items: list[list[str]] = [[] for _ in range(rows)]
    hits: list[tuple[int, int]] = []
    found: dict[int, set[int]] = {}
    raw, row, seen = b"", None, {}
    for n, known in grams.hashes.items():
        rolled = t.window_hashes(h, n)
        at = np.flatnonzero(filters[n][rolled >> np.uint64(64 - _FILTER_BITS)])
        at = at[at + n <= last[at]]
        place = np.searchsorted(known, rolled[at])
        place[place == len(known)] = 0
        at = at[known[place] == rolled[at]]
        if len(at) and row is None:
            raw, row = buf.tobytes(), w.row
        for i in at.tolist():
            whole = raw[w.start[i] : w.end[i + n - 1]]
            who = seen.get((n, whole))
            if who is None:  # equal hashes are no proof: the words themselves decide
                who = seen[n, whole] = grams.owners(n, rolled[i], b" ".join(raw[w.start[j] : w.end[j]] for j in range(i, i + n)))
            if who:
                hits.append((i, n))
                found.setdefault(int(row[i]), set()).update(who)
    if hits:
        pairs = np.array(hits)
        inside = t.covered(len(h), pairs[:, 0], pairs[:, 1])
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        starts_row = w.first[:-1][w.counts > 0]
        opens[starts_row] |= inside[starts_row]
        begin = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | opens[1:]
        end = np.flatnonzero(closes) + 1
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            r = int(row[a])
            spans[r].append((a - int(w.first[r]), b - int(w.first[r]), int(w.start[a] - offsets[r]), int(w.end[b - 1] - offsets[r])))
        for r, who in found.items():
            items[r] = [grams.items[k] for k in sorted(who)]
    return w.counts.astype(np.int64), spans, items


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES, into: str = "found") -> DataFrame:
    """docs with a struct (`found`) (n_words, spans, items) beside each row.

    Words are runs of letters and digits after lower-casing A-Z (any character beyond ASCII is a letter). A window is `width`
    consecutive words of an item; a shorter item, if it has words, is one window. Null texts have no words. An empty benchmark hits
    nothing. Repeated rows are judged each by itself; repeated items count once by id (a null id is the id "null"). Columns of docs
    stay, but for one named as `into` says, which is replaced.

    A benchmark of more than broadcast_bytes (windows and words, as workers hold them) is dealt out to parts of at most that size, long
    items in pieces; docs are scanned once for each part, one part's windows at a time, and narrow results are put together.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("x"))
    # A window takes at most _WINDOW bytes beside its last word, and a word is followed by one byte at least.
    cost = F.octet_length("x") * (1 + _WINDOW // 2) + F.octet_length("i") + 64
    if (items.agg(F.sum(cost)).first()[0] or 0) > broadcast_bytes:
        sized = _parts_of(items, width, broadcast_bytes)
        parts = [r.part for r in sized.select("part").distinct().orderBy("part").collect()]
    else:
        sized, parts = items.withColumn("part", F.lit(0)), [0]
    own = _stage.Own(docs)

    def look(part: int, column: Column) -> tuple[Any, Column]:
        shared = spark.sparkContext.broadcast(Grams([tuple(r) for r in sized.where(F.col("part") == part).select("i", "x").collect()], width))
        return shared, _finder(shared)(column)

    if len(parts) < 2:
        found = look(parts[0] if parts else 0, F.col(own.of(text)))[1]
        return own.df.withColumn("found", found).select(*own.back(into), F.col("found").alias(into))
    rows = _stage.numbered(own.df, "row")
    tables = []
    for p in parts:
        shared, found = look(p, F.col("x"))
        tables.append(_stage.stored(rows.select("row", F.col(own.of(text)).alias("x")).select("row", found.alias("found")).where("size(found.spans) > 0 or found.n_words > 0"), "found"))
        shared.destroy()
    every = tables[0]
    for x in tables[1:]:
        every = every.unionByName(x)
    merged = every.groupBy("row").agg(F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("found.items"))).alias("items"))
    out = rows.join(merged, "row", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    found = F.struct(F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), empty("spans").alias("spans"), empty("items").alias("items"))
    return out.select(*own.back(into), found.alias(into))


def _parts_of(items: DataFrame, width: int, limit: int) -> DataFrame:
    """i, x, part: pieces of the items, dealt to parts by hash so that none costs more than limit (but for a single piece of very long words)."""

    @arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([_pieces(x.as_py(), width, limit) for x in column], pa.list_(pa.string()))

    pieces = _stage.stored(items.select("i", F.explode(cut(F.col("x"))).alias("x")).withColumn("cost", F.octet_length("x") * (1 + _WINDOW // 2) + F.octet_length("i") + 64), "pieces")
    total, largest = pieces.agg(F.sum("cost"), F.max("cost")).first()
    n = -(-2 * total // limit)
    while True:
        part = F.pmod(F.xxhash64("i", "x"), F.lit(n)).cast("int")
        most = pieces.groupBy(part).agg(F.sum("cost").alias("c")).agg(F.max("c")).first()[0]
        if most <= max(limit, largest):
            return pieces.withColumn("part", part)
        n *= 2


def _finder(shared: Any):
    @arrow_udf(FOUND)
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = shared.value
        filters = {n: _filter(h) for n, h in grams.hashes.items()}
        span = pa.struct([(k, pa.int64()) for k in ("first", "last", "byte_first", "byte_last")])
        for column in batches:
            n, spans, items = [np.zeros(0, np.int64)], [], []
            for _, buf, offsets in t.chunks(column):
                a, b, c = find(buf, offsets, grams, filters)
                n.append(a)
                spans += b
                items += c
            width = np.cumsum([0, *map(len, spans)]).astype(np.int32)
            flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 4)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)], fields=list(span))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.ListArray.from_arrays(width, structs), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return look


def judged(scanned: DataFrame, share_of: int = 20) -> DataFrame:
    """scan()'s result with n_words, n_hit, n_items, items_sha256, contaminated (a `share_of`-th of the words are hit, one at least)."""
    x = scanned.withColumns({"n_words": F.col("found.n_words"), "n_hit": hit_words("found"), "n_items": F.size("found.items").cast("long")})
    x = x.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("found.items"), ","), 256))
    return x.withColumn("contaminated", _contaminated("found", share_of))


def hit_words(found: str) -> Column:
    """How many words lie in any of the spans."""
    spans = F.array_sort(F.transform(f"{found}.spans", lambda s: F.struct(s["first"].alias("a"), s["last"].alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def _contaminated(found: str, share_of: int = 20) -> Column:
    n = hit_words(found)
    return (n > 0) & (share_of * n >= F.col(f"{found}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    own = _stage.Own(docs)
    return scan(own.df, benchmark, own.of(text), into="found", **kw).where(~_contaminated("found")).select(*own.back())


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """docs with the hit words, and what stands between them, cut out of the text. Null texts stay null."""

    @arrow_udf("string")
    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in columns:
            out = []
            for x, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if x is not None and own:
                    raw, at, kept = x.encode(), 0, []
                    for s in sorted(own, key=lambda s: s["byte_first"]):
                        kept.append(raw[at : max(at, s["byte_first"])])
                        at = max(at, s["byte_last"])
                    x = (b"".join(kept) + raw[at:]).decode()
                out.append(x)
            yield pa.array(out, pa.string())

    own = _stage.Own(docs)
    scanned = scan(own.df, benchmark, own.of(text), into="found", **kw)
    return scanned.withColumn(own.of(text), cut(F.col(own.of(text)), F.col("found.spans"))).select(*own.back())
