"""Convex-hull wraps of a cloud: points are bent, partitions keep their own hull's corners, and the driver joins those few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AXES = {"upwards": 1.0, "downwards": -1.0}


def _planes(p: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = p[faces[:, 0]]
    n = np.cross(p[faces[:, 1]] - a, p[faces[:, 2]] - a)
    n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
    return n, (n * a).sum(1)


def _first_four(p: np.ndarray, eps: float) -> np.ndarray | None:
    """Four points that span a body, or None."""
    a, b = p[:, 0].argmin(), p[:, 0].argmax()
    line = p[b] - p[a]
    if np.linalg.norm(line) <= eps:
        return None
    off = np.linalg.norm(np.cross(p - p[a], line), axis=1) / np.linalg.norm(line)
    c = off.argmax()
    if off[c] <= eps:
        return None
    n = np.cross(line, p[c] - p[a])
    height = (p - p[a]) @ (n / np.linalg.norm(n))
    d = np.abs(height).argmax()
    if abs(height[d]) <= eps:
        return None
    return np.array([a, b, c, d] if height[d] < 0 else [a, c, b, d])


def hull(p: np.ndarray) -> np.ndarray:
    """Outward triangles (rows of three point numbers) of the convex hull; none for points in one plane."""
    none = np.zeros((0, 3), np.int64)
    if len(p) < 4:
        return none
    eps = 1e-10 * max(float(np.ptp(p, axis=0).max()), 1e-300)
    four = _first_four(p, eps)
    if four is None:
        return none
    a, b, c, d = four
    faces = np.array([[a, b, c], [a, d, b], [b, d, c], [c, d, a]])
    normals, at = _planes(p, faces)
    left = np.arange(len(p))
    while True:
        # Points inside every face are done; the one that stands out most goes in next.
        best = np.full(len(left), -np.inf)
        for k in range(0, len(faces), 64):
            best = np.maximum(best, (p[left] @ normals[k : k + 64].T - at[k : k + 64]).max(1))
        left, best = left[best > eps], best[best > eps]
        if not len(left):
            return faces
        for i in left[np.argsort(-best)[: max(1, len(left) // 8)]].tolist():
            seen = normals @ p[i] - at > eps
            if not seen.any():
                continue
            old = faces[seen]
            edges = np.concatenate([old[:, [0, 1]], old[:, [1, 2]], old[:, [2, 0]]])
            code = edges[:, 0] * len(p) + edges[:, 1]
            rim = edges[~np.isin(code, edges[:, 1] * len(p) + edges[:, 0])]
            new = np.column_stack([rim, np.full(len(rim), i)])
            n, o = _planes(p, new)
            faces, normals, at = np.vstack([faces[~seen], new]), np.vstack([normals[~seen], n]), np.concatenate([at[~seen], o])


def corners(points: DataFrame) -> DataFrame:
    """The rows of points (vid, x, y, z, bx, by, bz) whose bent place (bx, by, bz) is a corner of their partition's hull.

    A corner of the whole hull is a corner of its partition's, so none is lost. A task holds one batch and the corners before it;
    of points in one plane all stay.
    """
    names = ["vid", "x", "y", "z", "bx", "by", "bz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7))
        ids = np.zeros(0, np.int64)
        for batch in batches:
            held = np.concatenate([held, np.column_stack([batch.column(k).to_numpy() for k in range(7)]).astype(float)])
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            use = np.unique(hull(held[:, 4:]))
            if len(use):
                held, ids = held[use], ids[use]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(held[:, k]) for k in range(1, 7)]], names)

    return points.select(*names).mapInArrow(run, "vid long, " + ", ".join(f"{n} double" for n in names[1:]))


def bent(points: DataFrame, way: str, curvature: float) -> DataFrame:
    """points (vid, x, y, z) with bx, by, bz: drawn to or from their mean (inwards, outwards), or raised along an axis by the distance from it."""
    mean = points.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    x = points.crossJoin(F.broadcast(mean))  # one row
    off = [F.col(a) - F.col(f"m{a}") for a in "xyz"]
    if way in _AXES:
        rise = F.lit(0.5 * curvature * _AXES[way]) * (off[0] * off[0] + off[1] * off[1])
        moved: list[Column] = [F.col("x"), F.col("y"), F.col("z") + rise]
    elif way in ("inwards", "outwards"):
        power = ((1.0 if way == "inwards" else -1.0) / (1.0 + curvature) - 1.0) * 0.5
        squared = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
        scale = F.when(squared > 0, F.pow(squared, F.lit(power))).otherwise(F.lit(0.0))  # a point on the mean itself stays there
        moved = [o * scale for o in off]
    else:
        raise ValueError(f"{way} is none of upwards, downwards, inwards, outwards")
    return x.withColumns(dict(zip(("bx", "by", "bz"), moved, strict=True))).drop("mx", "my", "mz")


def convex_wrap(points: DataFrame, way: str, curvature: float) -> tuple[DataFrame, DataFrame]:
    """mesh_vertices and mesh_faces of the convex hull of the bent points (vid, x, y, z), at the points' own places.

    Upwards and downwards keep the faces that don't look along the axis. Fewer than four points, or points in one plane, give no faces.
    """
    spark = points.sparkSession
    kept = corners(corners(bent(points, way, curvature)).coalesce(1)).toPandas().sort_values("vid").reset_index(drop=True)
    p = kept[["bx", "by", "bz"]].to_numpy()
    faces = hull(p)
    if way in _AXES and len(faces):
        faces = faces[_planes(p, faces)[0][:, 2] * _AXES[way] <= 0.0]
    used = np.unique(faces)
    vid = kept.vid.to_numpy()
    v = [(int(vid[i]), *map(float, kept.loc[i, ["x", "y", "z"]])) for i in used]
    t = [(k, *(int(vid[i]) for i in f)) for k, f in enumerate(faces)]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame(t, "fid long, v0 long, v1 long, v2 long")
