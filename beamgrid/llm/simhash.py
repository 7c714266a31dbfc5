"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import _components, _stage

SHINGLE, SEED, RADIUS, PIVOTS = 3, 42, 3, 24
#: 64 bits in five blocks: fingerprints that differ in three bits or fewer agree on two blocks at least.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of one key that are compared by one task; larger groups are dealt out in pairs of parts.
PART = 8192
_SMALL = 48
COUNTS = ("met", "in_window", "survived", "close")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes. No words: 0."""
    raw = (text or "").encode().lower().split()
    if not raw:
        return 0
    joined = b" ".join(raw)
    end = np.cumsum([len(w) + 1 for w in raw]) - 1
    n = max(1, len(raw) - shingle + 1)
    last = end[min(shingle, len(raw)) - 1 :].tolist()
    first = [0, *(end[: n - 1] + 1).tolist()]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    h = np.array([digest(view[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):  # bounded, however many there are
        ones += np.unpackbits(h[k : k + (1 << 15), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """docs with a long (`fp`) (the fingerprint's bits) beside each row; whole texts, null ones are empty."""

    @arrow_udf("long")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(np.array([fingerprint(x.as_py()) for x in column], np.uint64).view(np.int64))

    return docs.withColumn(into, mark(F.col(text)))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, always the same ones."""
    return np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def pivot_table(f: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (column) to each pivot (row)."""
    return np.bitwise_count(f[None, :] ^ refs[:, None]).astype(np.int8)


def _survive(table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs have no pivot coordinate that differs by more than radius; these alone can be that close."""
    left = np.arange(len(i))
    for row in table:
        left = left[np.abs(row[i[left]] - row[j[left]]) <= radius]
        if not len(left):
            break
    return left


def link(group: np.ndarray, f: np.ndarray, refs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of positions in f that link all fingerprints of a group as all its close pairs would; group must be in runs. And counts of
    pairs: that met in a group, that the first pivot left, that all pivots left, that are close.

    Fingerprints of a group are sorted by their distance to the first pivot; each probes the window of those up to radius further, and
    the other pivots' coordinates discard pairs there. What survives is verified. Groups with wide windows are not paired in full but
    give a spanning forest, found by walking from fingerprint to fingerprint over those not reached yet.
    """
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(4, np.int64)
    run = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    table = pivot_table(f, refs)
    at = run * 256 + table[0]  # distances are 64 at most, so windows end with their run
    order = np.argsort(at, kind="stable")
    at, f, table = at[order], f[order], table[:, order]
    width = np.searchsorted(at, at + radius, "right") - np.arange(len(at)) - 1
    size = np.bincount(run)
    first = np.cumsum(size) - size
    dense = np.add.reduceat(width, first) > _SMALL * size
    sparse = np.where(np.repeat(dense, size), 0, width)
    a, b, counts = [], [], np.array([int((size * (size - 1) // 2)[~dense].sum()), int(sparse.sum()), 0, 0], np.int64)
    for step in range(1, int(sparse.max()) + 1):
        i = np.flatnonzero(sparse >= step)
        i = i[_survive(table[1:], i, i + step, radius)]
        near = np.bitwise_count(f[i] ^ f[i + step]) <= radius
        counts += [0, 0, len(i), int(near.sum())]
        a.append(i[near])
        b.append(i[near] + step)
    for s, n in zip(first[dense].tolist(), size[dense].tolist(), strict=True):
        x, y, seen = _forest(f[s : s + n], table[:, s : s + n], radius)
        counts += seen
        a.append(x + s)
        b.append(y + s)
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *a])], order[np.concatenate([none, *b])], counts


def _forest(f: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a spanning forest, and counts as link() has them; f is in order of the first pivot's distances."""
    alive, first = np.ones(len(f), bool), table[0]
    left, dead = np.arange(len(f)), 0
    a, b, counts = [], [], np.zeros(4, np.int64)
    queue: list[int] = []
    seed = 0
    while True:
        if queue:
            i = queue.pop()
        else:
            while seed < len(f) and not alive[seed]:
                seed += 1
            if seed == len(f):
                break
            i = seed
            alive[i] = False
            dead += 1
        if dead > len(left) // 2:
            left, dead = left[alive[left]], 0
        w = left[np.searchsorted(first[left], first[i] - radius, "left") : np.searchsorted(first[left], first[i] + radius, "right")]
        w = w[alive[w]]
        met, windowed = len(left) - dead, len(w)
        for row in table[1:]:
            if not len(w):
                break
            w = w[np.abs(row[w] - row[i]) <= radius]
        survived = len(w)
        w = w[np.bitwise_count(f[w] ^ f[i]) <= radius]
        counts += [met, windowed, survived, len(w)]
        if len(w):
            alive[w] = False
            dead += len(w)
            a.append(np.full(len(w), i))
            b.append(w)
            queue += w.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), counts


def _masks() -> list[int]:
    at = np.cumsum([0, *BLOCKS])
    block = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, at, strict=False)]
    return [int(np.uint64(block[i] | block[j]).view(np.int64)) for i, j in combinations(range(len(BLOCKS)), 2)]


def _dealt(distinct: DataFrame, part: int) -> DataFrame:
    """fp, g: fingerprints beside those that they may be close to, in runs of g."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(_masks())]))
    rows = distinct.select("fp", keys.alias("k")).select("fp", "k.band", "k.key")
    large = _stage.frozen(rows.groupBy("band", "key").count().where(F.col("count") > part))
    if large.isEmpty():
        dealt = rows.select("fp", "band", "key", F.lit(0).alias("cell"))
    else:
        parts = F.ceil(F.col("count") / part)
        own = F.pmod(F.xxhash64("fp"), "parts")
        both = rows.join(large.withColumn("parts", parts).drop("count"), ["band", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        # A part meets itself with its neighbour, so a lone diagonal cell is needed only where there is one part.
        both = both.where("parts = 1 or own <> other")
        dealt = both.select("fp", "band", "key", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("cell"))
    dealt = dealt.select("fp", F.xxhash64("band", "key", "cell").alias("g"), "band", "key", "cell")
    return dealt.repartition("g").sortWithinPartitions("g", "band", "key", "cell").select("fp", "g")


def _compared(distinct: DataFrame, radius: int, part: int, counted: bool) -> DataFrame:
    if radius > 3:
        raise ValueError("five blocks of which two are equal find three differing bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        held_f, held_g, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(4, np.int64)

        def out(f: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal total
            i, j, counts = link(g, f, refs, radius)
            total += counts
            if not counted:
                yield pa.RecordBatch.from_arrays([pa.array(f[i].view(np.int64)), pa.array(f[j].view(np.int64))], ["a", "b"])

        for batch in batches:
            f = np.concatenate([held_f, batch.column(0).to_numpy().view(np.uint64)])
            g = np.concatenate([held_g, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0  # the last group may go on
            held_f, held_g = f[cut:], g[cut:]
            if cut:
                yield from out(f[:cut], g[:cut])
        if len(held_g):
            yield from out(held_f, held_g)
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], list(COUNTS))

    return _dealt(distinct, part).mapInArrow(run, ", ".join(f"{c} long" for c in COUNTS) if counted else "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(a, b): links between the fingerprints of distinct (one row for each fp) that connect all which differ in radius bits or fewer.

    A pivot table rules pairs out but doesn't find them, so fingerprints first meet by key: five blocks, of which any two
    are equal in ten keys. No such pair is missed, and a key has 25 or 26 bits. Keys with more than `part` fingerprints are dealt
    out: each pair of its parts is a group of its own, so a task holds 2 * part fingerprints at most.
    """
    return _compared(distinct, radius, part, False).distinct()


def report(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """One row: pairs that met by key, that the first pivot's window left, that all pivots left to verify, that are close."""
    return _compared(distinct, radius, part, True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def classes(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """marked (doc_id, fp and other columns, kept still) with component_id: the smallest doc_id reachable over links.

    Equal fingerprints are one node, whatever their number, so exact copies cost one row. Rows with a null doc_id take part; a
    component of null ids only has a null id.
    """
    distinct = _stage.frozen(marked.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = _components.components(links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = _stage.frozen(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row. Null and empty texts have fingerprint zero and link like any other."""
    marked = _stage.frozen(fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("x")), "x").select("id", "fp"))
    return classes(marked, "id").select(F.col("id").alias(doc_id), hexed().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate component, the one with the smallest doc_id (of repeated ids, the longest text), with the columns of docs."""
    own = _stage.Own(docs)
    rows, doc_id, text = _stage.numbered(own.df, "row"), own.of(doc_id), own.of(text)
    few = rows.select("row", F.col(doc_id).alias("id"), F.octet_length(text).alias("n"), F.col(text).alias("x"))
    few = classes(_stage.stored(fingerprints(few, "x").drop("x"), "marked"), "id")
    best = few.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", -F.coalesce("n", F.lit(0)), "row")).alias("best"))
    return rows.join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select(*own.back())
