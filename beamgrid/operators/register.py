"""Registration: two clouds onto each other, or one onto the axes. Spark makes small histograms; the transforms are found on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .voxel import radon


def end_to_end_yaw(rays: DataFrame) -> DataFrame:
    """One row: the direction from the first ray with the least x to the one with the most."""
    p = F.struct("ex", "ey")
    x = rays.agg(F.min_by(p, F.struct("ex", "ray_id")).alias("a"), F.max_by(p, F.struct(F.col("ex"), -F.col("ray_id"))).alias("b"))
    return x.select(F.atan2(F.col("b.ey") - F.col("a.ey"), F.col("b.ex") - F.col("a.ex")).alias("yaw"))


def strongest_line(rays: DataFrame, low: tuple[float, float], cell: float, size: int = 256, angles: int = 256) -> DataFrame:
    """One row: angle, bin, weight of the line in plan that most bounded ends lie along: the y axis of an aligned cloud."""
    cells = rays.where("alpha > 0").groupBy(F.floor((F.col("ex") - F.lit(low[0])) / cell).alias("x"), F.floor((F.col("ey") - F.lit(low[1])) / cell).alias("y")).agg(F.count("*").cast("double").alias("value"))
    lines = radon(cells.where(f"x >= 0 and y >= 0 and x < {size} and y < {size}"), size, angles).withColumn("weight", F.round("weight", 6))
    return lines.orderBy(F.col("weight").desc(), "angle", "bin").limit(1)


def coarse_align(a: DataFrame, b: DataFrame, cell: float = 0.5, turns: int = 72) -> tuple[float, tuple[float, float, float]]:
    """Yaw and shift that lay a onto b: densities in cells, correlated by Fourier transform for each of some turns.

    The driver holds two grids of cells, whose size follows the clouds' extent, not their number of rays.
    """
    import numpy as np

    def cells(r: DataFrame) -> np.ndarray:
        n = r.where("alpha > 0").groupBy(*[F.floor(F.col(f"e{k}") / cell).alias(k) for k in "xyz"]).agg(F.count("*").alias("n")).collect()
        return np.array([(c.x, c.y, c.z, c.n) for c in n], float).reshape(-1, 4)

    ca, cb = cells(a), cells(b)
    if not len(ca) or not len(cb):
        raise ValueError("a cloud has no bounded rays")
    best = (-1.0, 0.0, (0.0, 0.0, 0.0))
    mid = (ca[:, :3].min(0) + ca[:, :3].max(0)) / 2
    for k in range(turns):
        t = 2 * math.pi * k / turns
        p = ca[:, :3] - mid
        q = np.stack([p[:, 0] * math.cos(t) - p[:, 1] * math.sin(t), p[:, 0] * math.sin(t) + p[:, 1] * math.cos(t), p[:, 2]], 1) + mid
        base = np.floor(np.minimum(q.min(0), cb[:, :3].min(0)))
        dims = [1 << int(2 * n + 2).bit_length() - 1 for n in np.maximum(q.max(0), cb[:, :3].max(0)) - base + 1]
        grids = []
        for at, w in ((q, ca[:, 3]), (cb[:, :3], cb[:, 3])):
            grid = np.zeros(dims)
            np.add.at(grid, tuple(np.rint(at - base).astype(int).T), np.sqrt(w))
            grids.append(np.fft.rfftn(grid))
        corr = np.fft.irfftn(np.conj(grids[0]) * grids[1], dims, axes=(0, 1, 2))
        top = np.unravel_index(corr.argmax(), corr.shape)
        if corr[top] > best[0]:
            s = [v - d if v > d // 2 else v for v, d in zip(top, dims, strict=True)]
            m = mid * cell
            turned = (m[0] - (m[0] * math.cos(t) - m[1] * math.sin(t)), m[1] - (m[0] * math.sin(t) + m[1] * math.cos(t)), 0.0)
            best = (float(corr[top]), t, tuple(float(x * cell + o) for x, o in zip(s, turned, strict=True)))
    return best[1], best[2]
