"""Token-id files: canonical length-limited Huffman codes from global counts, independent blocks with bit-offset checkpoints.

A file set is a folder with three Parquet tables (so that it can live in any store that Spark reaches):

codebook    one row: limit, lengths (bytes: the code length of each id, 0 if the id doesn't occur)
blocks      file, block (from 0 in its file), first_token (ids before it in its file), n_tokens, doc_ids, doc_tokens (ids of each
            document), checkpoints (little-endian uint64: the bit offset of each INTERVAL-th id), payload (codes, most significant
            bit first, zero padded)
Files hold documents in ascending doc_id, file after file. A block holds whole documents and is decoded without any other.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _stage
from . import _text as t

LIMIT, INTERVAL, BLOCK_TOKENS = 20, 128, 1 << 16
#: Distinct pre-tokens whose ids a worker remembers.
MEMO_PIECES = 1_500_000
TOKENS_PER_FILE = 64 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64) if counts.max() > 1 << 50 else counts[used].astype(np.int64)
    levels, packages = [], leaf[:0]
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaf))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order].astype(np.int64)
        width = np.int64(1) << (bits.max() - bits)
        codes[order] = ((np.cumsum(width) - width) >> (bits.max() - bits)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each prefix of `bits` bits: id * 32 + code length."""
    bits = max(1, int(lengths.max(initial=0)))
    table = np.zeros(1 << bits, np.uint32)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((codes[used], lengths[used]))]
    width = np.int64(1) << (bits - lengths[order].astype(np.int64))
    entry = order.astype(np.uint32) << np.uint32(5) | lengths[order].astype(np.uint32)
    filled = np.repeat(entry, width)
    table[: len(filled)] = filled
    return table, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of a block's ids."""
    n = lengths[ids].astype(np.int64)
    if len(ids) and not n.all():
        raise ValueError("an id has no code")
    end = np.cumsum(n)
    at = end - n
    total = int(end[-1]) if len(end) else 0
    words = np.zeros((total + 31) // 32 + 2, np.uint64)
    place = at >> 5
    v = codes[ids] << (64 - n - (at & 31)).astype(np.uint64)
    for k, part in ((0, v >> np.uint64(32)), (1, v & np.uint64(0xFFFFFFFF))):
        words += np.bincount(place + k, part.astype(np.float64), len(words)).astype(np.uint64)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::INTERVAL].astype("<u8").tobytes()


def unpack(payload: bytes, checkpoints: bytes, n: int, table: np.ndarray, bits: int) -> np.ndarray:
    """The n ids of a block: all spans between checkpoints step forward together."""
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    p = np.frombuffer(payload + bytes(8 + INTERVAL * LIMIT // 8), np.uint8).astype(np.uint32)
    window = p[:-3] << np.uint32(24) | p[1:-2] << np.uint32(16) | p[2:-1] << np.uint32(8) | p[3:]
    out = np.empty((len(at), INTERVAL), np.uint32)
    shift = np.uint32(32 - bits)
    for k in range(min(INTERVAL, n)):
        entry = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> shift]
        out[:, k] = entry >> np.uint32(5)
        at += entry & np.uint32(31)
        if k + 1 >= n - (len(at) - 1) * INTERVAL:
            at[-1] = 0  # the last span has ended
    return out.ravel()[:n]


_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: Classes of two-byte characters by second byte, after 0xC2 and after 0xC3 (Latin-1).
_AFTER_C2, _AFTER_C3 = np.full(256, _ODD, np.uint8), np.full(256, _ODD, np.uint8)
_AFTER_C2[0xA1:0xC0] = _OTHER
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_AFTER_C3[0x80:0xC0] = _LETTER
_AFTER_C3[[0x97, 0xB7]] = _OTHER


def _classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower-cased copy of some UTF-8 bytes and each byte's class, that of its character. Latin-1 and common dashes and quotes are known, the rest is odd."""
    low, kind = t.LOWER[buf], _CLASS[buf]
    for lead, table in ((0xC2, _AFTER_C2), (0xC3, _AFTER_C3)):
        at = np.flatnonzero(buf == lead)
        kind[at] = kind[at + 1] = table[buf[at + 1]]
        if lead == 0xC3:
            up = at[(buf[at + 1] <= 0x9E) & (buf[at + 1] != 0x97)] + 1
            low[up] += 0x20
    at = np.flatnonzero(buf == 0xE2)
    at = at[(buf[at + 1] == 0x80) & (buf[at + 2] >= 0x90) & (buf[at + 2] <= 0xA7)]
    for k in range(3):
        kind[at + k] = _OTHER
    return low, kind


class _Pieces:
    """Ids of whole texts: pre-tokens are cut here, and each distinct one goes through the library's BPE once while it is remembered.

    The tokenizer lower-cases, drops white space and cuts texts to contractions, runs of letters, single digits and runs of other
    characters. Texts of characters whose class is plain are cut in numpy and their pieces told apart by two 64-bit hashes; any other
    text, one that names a special token, and one with a piece whose first hash is another's, goes through the whole tokenizer. Tests hold both against whole-text encoding.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core: the library's own threads would only contend
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        spec["normalizer"], spec["pre_tokenizer"] = None, spec["pre_tokenizer"]["pretokenizers"][1]
        self.bpe = Tokenizer.from_str(json.dumps(spec))
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _bpe(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), 4096):
            e = self.bpe.encode(pieces[k : k + 4096], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces[k : k + 4096])))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > MEMO_PIECES:
            self.forget()
        ids, sizes = self._bpe(pieces)
        first = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.first, self.size = np.insert(self.first, at, first), np.insert(self.size, at, sizes)

    def chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all rows of a chunk, how many each row has, and which rows are odd (those have none)."""
        rows = len(offsets) - 1
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        low, kind = (x[: len(buf)] for x in _classes(padded))
        odd = np.zeros(rows, bool)
        strange = np.flatnonzero(kind == _ODD)
        odd[np.searchsorted(offsets, strange, "right") - 1] = True
        raw = buf.tobytes()
        for s in self.specials:
            at = raw.find(s)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        if odd.any():
            kind[np.repeat(odd, np.diff(offsets))] = _SPACE
        used = kind != _SPACE
        begins = used.copy()
        fresh = np.zeros(len(buf) + 1, bool)
        fresh[offsets] = True
        if len(buf):
            begins[1:] &= (kind[1:] != kind[:-1]) | fresh[1:-1] | ((kind[1:] == _DIGIT) & ((buf[1:] & 0xC0) != 0x80))
        start = np.flatnonzero(begins)
        n = np.diff(np.append(np.cumsum(used)[start] - 1, used.sum()))  # pieces are runs of used bytes
        start, n = _contractions(low, kind, start, n, fresh)
        count = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64), odd
        values = low[used]
        values = t.runs(values, n)
        h, check = t.span_hashes(values, n), t.span_hashes(values, n, 1)
        key, which, back = _distinct(h)
        for attempt in range(2):
            at = np.searchsorted(self.keys, key)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == key[known]
            if known.all():
                break
            w = which[~known]
            view = low.tobytes()
            pieces = [view[a : a + k].decode() for a, k in zip(start[w].tolist(), n[w].tolist(), strict=True)]
            before = len(self.keys)
            self._learn(key[~known], check[w], pieces)
            if len(self.keys) < before + len(w):  # it forgot the others
                self._relearn(key[known], check[which[known]], low, start[which[known]], n[which[known]])
        at = np.searchsorted(self.keys, key)[back]
        m = self.size[at]
        clash = np.flatnonzero(self.checks[at] != check)  # another piece of the same hash is known: these rows go whole
        if len(clash):
            odd[np.searchsorted(count, clash, "right") - 1] = True
            m = np.where(np.repeat(odd, np.diff(count)), 0, m)
        upto = np.concatenate([[0], np.cumsum(m)])
        ids = self.flat[np.repeat(self.first[at] - upto[:-1], m) + np.arange(upto[-1])]
        return ids, upto[count[1:]] - upto[count[:-1]], odd

    def _relearn(self, keys: np.ndarray, checks: np.ndarray, low: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
        view = low.tobytes()
        self._learn(keys, checks, [view[a : a + k].decode() for a, k in zip(start.tolist(), n.tolist(), strict=True)])

    def rows(self, texts: pa.Array, end_id: int, kind: str) -> Iterator[tuple[list[int], list[bytes]]]:
        """For chunks of texts: how many ids each has, and the ids, the end id last."""
        end = np.array([end_id], kind).tobytes()
        for row, buf, offsets in t.chunks(texts):
            ids, sizes, odd = self.chunk(buf, offsets)
            data, step = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            upto = (np.concatenate([[0], np.cumsum(sizes)]) * step).tolist()
            out = [data[a:b] + end for a, b in zip(upto, upto[1:])]
            for r in np.flatnonzero(odd).tolist():
                e = self.whole.encode(texts[row + r].as_py() or "", add_special_tokens=False)
                out[r] = np.array(e.ids, kind).tobytes() + end
            yield [len(x) // step for x in out], out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each (any; np.unique's first one needs a slower sort), and where each of h stands among them."""
    order = np.argsort(h)
    ranked = h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(h), np.int32)
    back[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ranked[fresh], order[fresh], back


def _contractions(low: np.ndarray, kind: np.ndarray, start: np.ndarray, n: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An apostrophe alone, right before letters of its own row (which begin where fresh is set) that begin with s, t, m, d, re, ve or ll, takes those."""
    apostrophe = np.flatnonzero((low[start] == 0x27) & (n == 1))
    apostrophe = apostrophe[apostrophe + 1 < len(start)]
    k = apostrophe[(start[apostrophe + 1] == start[apostrophe] + 1) & (kind[start[apostrophe + 1]] == _LETTER) & ~fresh[start[apostrophe + 1]]]
    if not len(k):
        return start, n
    a = low[start[k + 1]]
    b = np.where(n[k + 1] > 1, low[np.minimum(start[k + 1] + 1, len(low) - 1)], 0)
    take = np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 1, 0)
    take = np.where(((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C), 2, take)
    start, n = start.copy(), n.copy()
    n[k] += take
    start[k + 1] += take
    n[k + 1] -= take
    left = n > 0
    return start[left], n[left]


_memo: dict[str, _Pieces] = {}


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, of width(vocabulary)) of each row; a null text is empty."""
    kind = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _memo:  # a worker serves many tasks
            _memo[tokenizer_path] = _Pieces(tokenizer_path)
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1), 0
            for sizes, ids in _memo[tokenizer_path].rows(texts, end_id, kind):
                yield pa.RecordBatch.from_arrays([keys[at : at + len(sizes)], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
                at += len(sizes)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def width(vocabulary: int) -> str:
    """The numpy type of staged ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; the driver gets a row for each id of the vocabulary at most."""
    kind = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            if batch.num_rows:
                column = batch.column(0).cast(pa.large_binary())
                _, at, data = column.buffers()
                at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
                counts += np.bincount(np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for i, n in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


BLOCKS = "file int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary"


def _encoded(lengths: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, file = canonical_codes(lengths), TaskContext.get().partitionId()
        block, before, held, docs, sizes, tokens = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload, checkpoints = pack(ids, codes, lengths)
            row = {"file": file, "block": block, "first_token": before, "n_tokens": len(ids), "doc_ids": docs, "doc_tokens": sizes, "checkpoints": checkpoints, "payload": payload}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for d, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.append(np.frombuffer(x.as_buffer(), kind))
                docs.append(d)
                sizes.append(n)
                tokens += n
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    block, before, held, docs, sizes, tokens = block + 1, before + tokens, [], [], [], 0
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text of docs and writes a file set at path.

    Rows with equal doc_id stay side by side in any order; null doc_ids come first. A null or empty text is the end id alone.
    An empty table gives a file set without blocks. Extra columns are not read. A worker holds a block of ids, or one document.
    """
    spark = docs.sparkSession
    tokens = _stage.stored(tokenised(docs, tokenizer_path, end_id, vocabulary, doc_id, text), "tokens")
    counts = id_counts(tokens, vocabulary)
    lengths = code_lengths(counts)
    spark.createDataFrame([(LIMIT, bytearray(lengths.tobytes()))], "limit_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // TOKENS_PER_FILE + 1)
    ordered = tokens.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_encoded(lengths, width(vocabulary)), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian uint32) of each document, decoded from the files at path."""
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(bytes(book["lengths"]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = decode_table(lengths)
        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["payload"], b["checkpoints"], b["n_tokens"], table, bits).astype("<u4")
                sizes = np.array(b["doc_tokens"], np.int64)
                end = np.cumsum(sizes)
                parts = [ids[e - n : e].tobytes() for e, n in zip(end, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["file"]] * len(parts), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(b["first_token"] + end - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["file", "doc_id", "place", "n_tokens", "ids_crc32", "ids"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # A row for each file, of which there is one for TOKENS_PER_FILE ids.
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("file").agg(F.sum("n_tokens")).collect())
    begin, rows = 0, []
    for f, n in totals:
        rows.append((f, begin))
        begin += n
    starts = F.broadcast(spark.createDataFrame(rows, "file int, before long"))
    docs = blocks.mapInArrow(run, "file int, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(starts, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "ids")
