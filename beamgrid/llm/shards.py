"""Sharding by sampled splitters: weighted key samples, quantile boundaries, range partitions, overfull ranges cut again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import _stage

#: Null keys sort first; they share their place with this key and are told apart by the row number.
NULL_KEY = -(1 << 63)
_UNIT = float(1 << 53)


@dataclass(frozen=True)
class Plan:
    """Ranges in ascending (key, row) order: their lower bounds (without the first), rows and weight in each."""

    keys: np.ndarray
    rows: np.ndarray
    n: list[int]
    weight: list[int]

    @property
    def ranges(self) -> int:
        return len(self.n)


def range_of(keys: np.ndarray, rows: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many bounds lie at or below each (key, row)."""
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    out = low.copy()
    for a in np.unique(low[high > low]):  # bounds inside one key: a hot key is cut by row number
        own = (low == a) & (high > low)
        b = high[own][0]
        out[own] = a + np.searchsorted(rows[a:b], row[own], "right")
    return out


def range_column(plan_keys: np.ndarray, plan_rows: np.ndarray, key: str, row: str) -> Column:
    @arrow_udf("int")
    def place(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for k, r in columns:
            yield pa.array(range_of(plan_keys, plan_rows, k.to_numpy(zero_copy_only=False), r.to_numpy(zero_copy_only=False)).astype(np.int32))

    return place(F.coalesce(F.col(key), F.lit(NULL_KEY)), F.col(row))


def _sampled(df: DataFrame, key: str, row: str, weight: str, rate: Column, seed: int) -> list[tuple[int, int, float]]:
    """Rows taken with probability rate * weight, at most 1, and the weight that each stands for, in units of 1 / rate."""
    share = rate * F.col(weight)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row)), 11) / F.lit(_UNIT)
    picked = df.where(unit < share).select(F.coalesce(F.col(key), F.lit(NULL_KEY)).alias("k"), F.col(row).alias("r"), F.greatest(share, F.lit(1.0)).alias("w"))
    return [tuple(x) for x in picked.collect()]


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    sample = sorted(sample)
    if not sample or parts < 2:
        return []
    upto = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, "left")
    return [sample[min(i, len(sample) - 1)][:2] for i in at]


def split_ranges(df: DataFrame, key: str, row: str, weight: str, ranges: int, per_range: int = 16, overfull: float = 2.0, seed: int = 11) -> Plan:
    """Bounds of about `ranges` ranges of nearly equal weight.

    df must keep its rows still (a checkpoint or a table): `row` numbers tell equal keys apart, so that a key which holds a third
    of all rows is cut like any other span. The driver gets about ranges * per_range sampled keys and a count for each range,
    whatever the size of df. A range that holds over `overfull` times its share, its largest record left aside, is sampled by itself
    and cut again, until none does or three samples in a row bring no new bound.
    """
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if not n:
        return Plan(np.zeros(0, np.int64), np.zeros(0, np.int64), [], [])
    share = total / ranges
    bounds = sorted(set(_quantiles(_sampled(df, key, row, weight, F.lit(per_range / share), seed), ranges)))
    k = fruitless = 0
    while True:
        keys, rows = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
        placed = df.select(key, row, weight, range_column(keys, rows, key, row).alias("range"))
        got = {r[0]: r[1:] for r in placed.groupBy("range").agg(F.count("*"), F.sum(weight), F.max(weight)).collect()}
        full = {r: x for r, x in got.items() if x[1] - x[2] > overfull * share}
        if not full or fruitless == 3:
            break
        rate = F.element_at(F.create_map(*[F.lit(y) for r, x in full.items() for y in (r, per_range / share)]), F.col("range"))
        again = _sampled(placed.where(F.col("range").isin(list(full))), key, row, weight, rate, seed + k + 1)
        where = range_of(keys, rows, np.array([a[0] for a in again], np.int64), np.array([a[1] for a in again], np.int64)) if again else []
        new = set(bounds)
        for r, x in full.items():
            new |= set(_quantiles([a for a, b in zip(again, where, strict=True) if b == r], int(np.ceil(x[1] / share))))
        k, fruitless = k + 1, fruitless + 1 if len(new) == len(bounds) else 0
        bounds = sorted(new)
    counts = [got.get(r, (0, 0, 0)) for r in range(len(bounds) + 1)]
    return Plan(keys, rows, [c[0] for c in counts], [c[1] or 0 for c in counts])


def shard_by_bytes(df: DataFrame, shards: int, key: str = "doc_id", size: str = "size", row: str = "_row", ranges_per_shard: int = 32, rows_per_range: int = 100_000, most_ranges: int = 100_000) -> DataFrame:
    """df with `shard` (0 to shards - 1, contiguous in key order, bytes near equal) and `slot` (gapless from 0 within a shard).

    Law `bytes`: a shard's bytes differ from an equal share by no more than the record at either end. Records are ordered by key,
    nulls first, and by row number within a key, so ties, repeated rows and hot keys are spread like distinct ones. df needs a
    non-null positive `size` and the unique number `row`, and must keep still between jobs. No shard is made empty on purpose, but
    with records larger than a share some hold none. An empty df gives an empty result. Columns `shard`, `slot` are replaced.
    """
    own = _stage.Own(df)
    df, key, size, row = own.df, own.of(key), own.of(size), own.of(row)
    n = df.count()
    plan = split_ranges(df.select(key, row, size), key, row, size, int(min(most_ranges, max(ranges_per_shard * shards, n // rows_per_range))))
    total = sum(plan.weight)
    spark = df.sparkSession
    before = [(r, int(b), int(c)) for r, (b, c) in enumerate(zip(np.cumsum([0, *plan.weight[:-1]]), np.cumsum([0, *plan.n[:-1]]), strict=True))] if plan.ranges else []
    # A row for each range, at most 2 * most_ranges or so.
    starts = F.broadcast(spark.createDataFrame(before, "range int, bytes_before long, rows_before long"))

    def placed(x: DataFrame) -> DataFrame:
        w = Window.partitionBy("range").orderBy(F.col(key).asc_nulls_first(), row)
        x = x.withColumn("range", range_column(plan.keys, plan.rows, key, row)).withColumns({"upto": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(w)}).join(starts, "range")
        middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col(size)  # of the record, in half bytes
        x = x.withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * shards / (2 * max(total, 1))), F.lit(shards - 1)).cast("int"))
        return x.withColumn("place", F.col("rows_before") + F.col("nth") - 1)

    # A row for each shard.
    first = F.broadcast(placed(df.select(key, row, size)).groupBy("shard").agg(F.min("place").alias("first")))
    out = placed(df).join(first, "shard").withColumn("slot", F.col("place") - F.col("first"))
    return out.select(*own.back("shard", "slot"), "shard", "slot")


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and 16 for the record's head."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
