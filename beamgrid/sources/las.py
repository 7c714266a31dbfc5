"""Uncompressed LAS 1.0 to 1.4. (LAZ needs a codec that is not here.)"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the LAS specification: byte offsets of GPS time and of colour in each point format that has a time.
TIME_AT = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
ROWS_PER_PART = 1_000_000


def header(path: str) -> dict:
    with open(path, "rb") as f:
        h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    minor, (start,) = h[25], struct.unpack_from("<I", h, 96)
    kind, size = h[104] & 0x3F, struct.unpack_from("<H", h, 105)[0]
    if h[104] & 0xC0:
        raise ValueError(f"{path} is compressed")
    n = struct.unpack_from("<I", h, 107)[0] or (struct.unpack_from("<Q", h, 247)[0] if minor >= 4 else 0)
    if kind not in TIME_AT:
        raise ValueError(f"point format {kind} has no time")
    return {"start": start, "format": kind, "size": size, "n": n, "scale": struct.unpack_from("<3d", h, 131), "offset": struct.unpack_from("<3d", h, 155)}


class _Range(InputPartition):
    def __init__(self, first: int, n: int) -> None:
        super().__init__((first, n))
        self.first, self.n = first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        n = header(self.path)["n"]
        return [_Range(k, min(self.rows, n - k)) for k in range(0, n, self.rows)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h = header(self.path)
        fields = {"names": ["p", "i", "t"], "formats": [("<i4", 3), "<u2", "<f8"], "offsets": [0, 12, TIME_AT[h["format"]]], "itemsize": h["size"]}
        if h["format"] in COLOUR_AT:
            fields["names"].append("c")
            fields["formats"].append(("<u2", 3))
            fields["offsets"].append(COLOUR_AT[h["format"]])
        with open(self.path, "rb") as f:
            f.seek(h["start"] + part.first * h["size"])
            d = np.frombuffer(f.read(part.n * h["size"]), np.dtype(fields))
        xyz = d["p"] * np.array(h["scale"]) + np.array(h["offset"])
        rgb = (d["c"] & 0xFF).astype(np.int16) if "c" in d.dtype.names else np.full((len(d), 3), -1, np.int16)
        cols = [np.arange(part.first, part.first + len(d)), *xyz.T, d["t"], *rgb.T, d["i"].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["ray_id", "ex", "ey", "ez", "time", "red", "green", "blue", "intensity"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "ray_id long, ex double, ey double, ez double, time double, red short, green short, blue short, intensity int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rowsperpartition", ROWS_PER_PART)))


def read(spark: SparkSession, path: str, max_intensity: float = 100.0, rows_per_partition: int = ROWS_PER_PART) -> DataFrame:
    spark.dataSource.register(LasSource)
    x = spark.read.format("las").option("rowsPerPartition", rows_per_partition).load(path)
    return x.withColumn("alpha", alpha(F.col("intensity"), max_intensity)).drop("intensity")


def alpha(intensity: Column, max_intensity: float) -> Column:
    """255 times the share of the maximum, truncated, 255 at most."""
    return F.least(F.lit(255), (F.lit(255.0) * intensity / F.lit(float(max_intensity))).cast("long")).cast("short")


def full_if_all_zero(points: DataFrame) -> DataFrame:
    """Clouds without any intensity get alpha 255 everywhere."""
    most = points.agg(F.max("alpha")).scalar()
    return points.withColumn("alpha", F.when(most == 0, F.lit(255)).otherwise(F.col("alpha")).cast("short"))


def write(rays: DataFrame, path: str) -> int:
    """One LAS 1.2 file of format 3 on the driver's disk, in steps of a tenth of a millimetre; intensity is alpha."""
    kind = np.dtype([("p", "<i4", 3), ("i", "<u2"), ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("t", "<f8"), ("c", "<u2", 3)])
    low = rays.agg(*[F.min(f"e{a}") for a in "xyz"], *[F.max(f"e{a}") for a in "xyz"]).first()
    base, top = [float(v or 0.0) for v in low[:3]], [float(v or 0.0) for v in low[3:]]
    n = 0
    with open(path, "wb") as f:
        f.write(bytes(227))
        rows: list[tuple] = []

        def flush() -> None:
            a = np.array(rows, np.float64).reshape(-1, 8)
            out = np.zeros(len(a), kind)
            out["p"] = np.rint((a[:, :3] - base) / 1e-4)
            out["t"], out["c"], out["i"] = a[:, 3], a[:, 4:7], a[:, 7]
            f.write(out.tobytes())
            rows.clear()

        for r in rays.orderBy("ray_id").select("ex", "ey", "ez", "time", "red", "green", "blue", "alpha").toLocalIterator():
            rows.append(tuple(r))
            n += 1
            if len(rows) >= 100_000:
                flush()
        if rows:
            flush()
        h = bytearray(227)
        h[:4], h[24], h[25], h[104] = b"LASF", 1, 2, 3
        struct.pack_into("<HII", h, 94, 227, 227, 0)
        struct.pack_into("<HI", h, 105, kind.itemsize, n)
        struct.pack_into("<6d", h, 131, 1e-4, 1e-4, 1e-4, *base)
        struct.pack_into("<6d", h, 179, top[0], base[0], top[1], base[1], top[2], base[2])
        f.seek(0)
        f.write(h)
    return n
