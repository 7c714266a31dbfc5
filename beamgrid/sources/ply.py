"""Binary little-endian PLY: ray clouds, point clouds and meshes.

register(spark) adds the format "ply", read in byte ranges: rows have a fixed size, so any number of tasks can share a file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from beamgrid.functions import colour as c

#: PLY's names for number types.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
ROWS_PER_PART = 1_000_000


@dataclass
class Header:
    size: int
    elements: list[tuple[str, int, list[tuple[str, ...]]]]

    def dtype(self, element: str) -> np.dtype:
        props = next(p for n, _, p in self.elements if n == element)
        return np.dtype([(p[-1], TYPES[p[0]]) for p in props])

    def count(self, element: str) -> int:
        return next((k for n, k, _ in self.elements if n == element), 0)


def header(path: str) -> Header:
    elements: list[tuple[str, int, list[tuple[str, ...]]]] = []
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is not a PLY file")
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path} has no end of header")
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["format"] and words[1] != "binary_little_endian":
                raise ValueError(f"{path} is {words[1]}; only binary_little_endian is read")
            if words[:1] == ["element"]:
                elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                elements[-1][2].append(tuple(words[1:]))
            elif words[:1] == ["end_header"]:
                return Header(f.tell(), elements)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, n: int) -> None:
        super().__init__((path, first, n))
        self.path, self.first, self.n = path, first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        files = [os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f.endswith(".ply")] if os.path.isdir(self.path) else [self.path]
        return [_Range(f, k, min(self.rows, n - k)) for f in files for n in [header(f).count("vertex")] for k in range(0, n, self.rows)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h = header(part.path)
        kind = h.dtype("vertex")
        with open(part.path, "rb") as f:
            f.seek(h.size + part.first * kind.itemsize)
            data = np.frombuffer(f.read(part.n * kind.itemsize), kind)
        names = kind.names
        col = lambda *options: next((data[o].astype(np.float64) for o in options if o in names), None)
        end = [col(a) for a in "xyz"]
        ray = [col(f"n{a}", f"ray{a}") for a in "xyz"]
        time = col("time")
        out = {"ray_id": np.arange(part.first, part.first + len(data))}
        for a, e, r in zip("xyz", end, ray, strict=True):
            out[f"s{a}"] = e + (r if r is not None else 0.0)
        out |= {f"e{a}": e for a, e in zip("xyz", end, strict=True)}
        out["time"] = time if time is not None else np.full(len(data), np.nan)
        for n in ("red", "green", "blue", "alpha"):
            out[n] = data[n].astype(np.int16) if n in names else np.full(len(data), 255 if n == "alpha" else -1, np.int16)
        out["intensity"] = col("intensity") if "intensity" in names else np.full(len(data), np.nan)
        whole = ~np.isnan(np.stack([*end, *(r for r in ray if r is not None)])).any(0)
        yield pa.RecordBatch.from_arrays([pa.array(v[whole]) for v in out.values()], list(out))


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "ray_id long, sx double, sy double, sz double, ex double, ey double, ez double, time double, red short, green short, blue short, alpha short, intensity double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rowsperpartition", ROWS_PER_PART)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def read_rays(spark: SparkSession, path: str, rows_per_partition: int = ROWS_PER_PART) -> DataFrame:
    """A ray cloud. Rows with a position that isn't a number are dropped; clouds without colour are coloured by time; unbounded rays are black."""
    register(spark)
    x = spark.read.format("ply").option("rowsPerPartition", rows_per_partition).load(path).drop("intensity")
    hue = dict(zip(("red", "green", "blue"), c.spectrum(F.col("time") / F.lit(60.0)), strict=True))
    return x.withColumns({n: F.when(F.col("alpha") == 0, F.lit(0)).when(F.col(n) < 0, c.byte(h)).otherwise(F.col(n)).cast("short") for n, h in hue.items()})


def read_points(spark: SparkSession, path: str, max_intensity: float = 100.0) -> DataFrame:
    """A point cloud to import: see imported()."""
    register(spark)
    return imported(spark.read.format("ply").load(path), max_intensity)


def imported(points: DataFrame, max_intensity: float) -> DataFrame:
    """Points with distinct times and alpha from intensity (NaN: none).

    Each of a run of equal times in file order is a microsecond later than the one before. Intensity gives the ceiling of its 255th
    share of the maximum; -1 marks a non-return (alpha 0), and other negative values count as 1.
    """
    from pyspark.sql import Window

    from beamgrid.operators.order import with_previous

    x = with_previous(points, ["time"])
    fresh = (F.col("last_time").isNull() | (F.col("time") != F.col("last_time"))).cast("int")
    w = Window.partitionBy("time").orderBy("ray_id")
    x = x.withColumn("_run", F.sum(fresh).over(w)).withColumn("_k", F.row_number().over(Window.partitionBy("time", "_run").orderBy("ray_id")) - 1)
    i = F.col("intensity")
    alpha = F.when(F.isnan(i), F.col("alpha")).when(i == -1, F.lit(0)).when(i < 0, F.lit(1)).otherwise(F.ceil(F.lit(255.0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), i / F.lit(float(max_intensity))))))
    return x.withColumns({"time": F.col("time") + F.lit(1e-6) * F.col("_k"), "alpha": alpha.cast("short")}).drop("_run", "_k", "last_time", "intensity")


RAY_TYPE = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("time", "<f8"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("alpha", "u1")])
_NAMES = {"<f4": "float", "<f8": "double", "|u1": "uchar", "<i4": "int"}


def write_rays(rays: DataFrame, path: str, points_only: bool = False) -> int:
    """One PLY file in order of ray_id, on the driver's disk, partition by partition; the count is put into the header at the end."""
    kind = np.dtype([f for f in RAY_TYPE.descr if not (points_only and f[0] in ("nx", "ny", "nz"))])
    head = "ply\nformat binary_little_endian 1.0\nelement vertex {:>20}\n" + "".join(f"property {_NAMES[np.dtype(t).str]} {n}\n" for n, t in kind.descr) + "end_header\n"
    n = 0
    with open(path, "wb") as f:
        f.write(head.format(0).encode())
        rows: list[tuple] = []

        def flush() -> None:
            a = np.array(rows, np.float64).reshape(-1, 11)
            out = np.zeros(len(a), kind)
            for k, name in enumerate(("x", "y", "z")):
                out[name] = a[:, 3 + k]
                if not points_only:
                    out[f"n{name}"] = a[:, k] - a[:, 3 + k]
            out["time"] = a[:, 6]
            for k, name in enumerate(("red", "green", "blue", "alpha")):
                out[name] = a[:, 7 + k]
            f.write(out.tobytes())
            rows.clear()

        for r in rays.orderBy("ray_id").select("sx", "sy", "sz", "ex", "ey", "ez", "time", "red", "green", "blue", "alpha").toLocalIterator():
            rows.append(tuple(r))
            n += 1
            if len(rows) >= 100_000:
                flush()
        if rows:
            flush()
        f.seek(0)
        f.write(head.format(n).encode())
    return n


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """mesh_vertices and mesh_faces of a triangle mesh; it is read on the driver."""
    h = header(path)
    kind = h.dtype("vertex")
    with open(path, "rb") as f:
        f.seek(h.size)
        v = np.frombuffer(f.read(h.count("vertex") * kind.itemsize), kind)
        p = next(p for n, _, p in h.elements if n == "face")[0]
        face = np.dtype([("n", TYPES[p[1]]), ("v", TYPES[p[2]], 3)])
        t = np.frombuffer(f.read(h.count("face") * face.itemsize), face)
    cols = {"vid": np.arange(len(v)), **{a: v[a].astype(np.float64) for a in "xyz"}, **{c_: (v[c_] if c_ in kind.names else np.full(len(v), 255)).astype(np.int16) for c_ in ("red", "green", "blue", "alpha")}}
    faces = {"fid": np.arange(len(t)), **{f"v{k}": t["v"][:, k].astype(np.int64) for k in range(3)}}
    return spark.createDataFrame(pa.table(cols)), spark.createDataFrame(pa.table(faces))


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, flip: bool = False) -> None:
    """One binary PLY file on the driver's disk; vertices are numbered in order of vid. flip turns the faces around."""
    v, t = vertices.orderBy("vid").toPandas(), faces.orderBy("fid").toPandas()
    place = {k: i for i, k in enumerate(v.vid)}
    vk = np.dtype([*((a, "<f4") for a in "xyz"), *((c_, "u1") for c_ in ("red", "green", "blue", "alpha"))])
    tk = np.dtype([("n", "<i4"), ("v", "<i4", 3)])
    a, b = np.zeros(len(v), vk), np.zeros(len(t), tk)
    for n in vk.names:
        a[n] = v[n] if n in v else 127
    b["n"] = 3
    order = ("v0", "v2", "v1") if flip else ("v0", "v1", "v2")
    b["v"] = np.array([[place[x] for x in t[c_]] for c_ in order], np.int32).reshape(3, -1).T
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(a)}\n" + "".join(f"property {_NAMES[np.dtype(k).str]} {n}\n" for n, k in vk.descr) + f"element face {len(b)}\nproperty list int int vertex_indices\nend_header\n"
    with open(path, "wb") as f:
        f.write(head.encode() + a.tobytes() + b.tobytes())
