"""Small surfaces and rasters on the driver or in one group: Delaunay meshes, watersheds, images; and leaves."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three point numbers) of points in the plane, each point put in by cutting the circles it lies in."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    mid, span = points.mean(0), max(float(np.ptp(points, 0).max()), 1e-9) * 50
    p = np.vstack([points, mid + span * np.array([[-1.7, -1.0], [1.7, -1.0], [0.0, 2.0]])])
    tri, circles = np.array([[n, n + 1, n + 2]]), None

    def circle(t: np.ndarray) -> np.ndarray:
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        b, c = b - a, c - a
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        bb, cc = (b * b).sum(1), (c * c).sum(1)
        x = np.stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb], 1) / d[:, None]
        return np.column_stack([a + x, (x * x).sum(1)])

    circles = circle(tri)
    for k in np.lexsort((points[:, 1], points[:, 0])):
        hit = ((circles[:, :2] - p[k]) ** 2).sum(1) < circles[:, 2]
        old = tri[hit]
        edges: dict[tuple[int, int], int] = {}
        for t in old.tolist():
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
        new = np.array([[a, b, k] for (a, b), c in edges.items() if c == 1], np.int64).reshape(-1, 3)
        tri, circles = np.vstack([tri[~hit], new]), np.vstack([circles[~hit], circle(new)])
    return tri[(tri < n).all(1)]


def ground_mesh(front: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mesh_vertices and mesh_faces over the ends of ground rays. They are triangulated on the driver: pass a front, not a cloud."""
    rows = front.select("ray_id", "ex", "ey", "ez").orderBy("ray_id").toPandas().drop_duplicates(["ex", "ey"]).reset_index(drop=True)
    t = delaunay(rows[["ex", "ey"]].to_numpy())
    spark = front.sparkSession
    v = [(int(i), *map(float, r[1:])) for i, r in enumerate(rows.itertuples(index=False, name=None))]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(t)], "fid long, v0 long, v1 long, v2 long")


def watershed(field: DataFrame, tile: int, drop: float = 0.1, widest: float = 25.0, pixel: float = 1.0) -> DataFrame:
    """px, py, tree: crowns flooded down from the peaks of a canopy height field (px, py, value), a tile at a time.

    Where two floods meet, the lower peak joins the other if it stands less than `drop` of its height over the meeting point, and
    the two together stay within `widest`. Tiles have no overlap here: cut the field so that trees of interest lie inside.
    """
    import pandas as pd

    def run(df: pd.DataFrame) -> pd.DataFrame:
        h = {(int(a), int(b)): float(c) for a, b, c in zip(df.px, df.py, df.value)}
        order = [(-v, k) for k, v in h.items()]
        heapq.heapify(order)
        head: dict[tuple[int, int], tuple[int, int]] = {}
        root: dict[tuple[int, int], tuple[int, int]] = {}
        box: dict[tuple[int, int], list[int]] = {}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        while order:
            v, k = heapq.heappop(order)
            near = sorted({find(head[n]) for n in ((k[0] + x, k[1] + y) for x in (-1, 0, 1) for y in (-1, 0, 1)) if n in head}, key=lambda r: (-h[r], r))
            if not near:
                root[k] = head[k] = k
                box[k] = [k[0], k[0], k[1], k[1]]
                continue
            top = near[0]
            head[k] = top
            box[top] = [min(box[top][0], k[0]), max(box[top][1], k[0]), min(box[top][2], k[1]), max(box[top][3], k[1])]
            for r in near[1:]:
                both = [min(box[top][0], box[r][0]), max(box[top][1], box[r][1]), min(box[top][2], box[r][2]), max(box[top][3], box[r][3])]
                if h[r] + v < drop * h[r] and max(both[1] - both[0], both[3] - both[2]) * pixel <= widest:
                    root[r], box[top] = top, both
        keys = sorted(h)
        return pd.DataFrame({"px": [k[0] for k in keys], "py": [k[1] for k in keys], "tree": [find(head[k])[0] * 1_000_000 + find(head[k])[1] for k in keys]})

    x = field.select("px", "py", "value", F.floor(F.col("px") / tile).alias("tx"), F.floor(F.col("py") / tile).alias("ty"))
    return x.groupBy("tx", "ty").applyInPandas(run, "px long, py long, tree long")


def leaves(points: DataFrame, per_point: str, width: float) -> DataFrame:
    """ray_id and vx, vy, vz of the points at which a voxel's running share of leaves passes a whole number."""
    x = points.withColumns(g.voxel(width))
    w = Window.partitionBy("vx", "vy", "vz").orderBy("ray_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_s", F.sum(per_point).over(w))
    return x.where(F.floor(F.col("_s") + 1e-9) > F.floor(F.col("_s") - F.col(per_point) + 1e-9)).select("ray_id", "vx", "vy", "vz")


def leaf_mesh(placed: DataFrame, template: list[tuple[float, float, float]]) -> DataFrame:
    """leaf_id, corner, x, y, z: a leaf's shape at each place (leaf_id, x, y, z, yaw)."""
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(n) for n, v in zip("xyz", c, strict=True)]) for k, c in enumerate(template)])).alias("c")
    t = placed.select("*", corners)
    cos, sin = F.cos("yaw"), F.sin("yaw")
    return t.select("leaf_id", F.col("c.k").alias("corner"), (F.col("x") + F.col("c.x") * cos - F.col("c.y") * sin).alias("x"), (F.col("y") + F.col("c.x") * sin + F.col("c.y") * cos).alias("y"), (F.col("z") + F.col("c.z")).alias("z"))


def write_png(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """An RGB image of px, py, red, green, blue (0 to 1), y upwards, on the driver's disk; it holds one image."""
    image = np.zeros((height, width, 3), np.uint8)
    for r in pixels.select("px", "py", "red", "green", "blue").toLocalIterator():
        if 0 <= r.px < width and 0 <= r.py < height:
            image[height - 1 - r.py, r.px] = [int(255.0 * max(0.0, min(1.0, v))) for v in (r.red, r.green, r.blue)]
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
