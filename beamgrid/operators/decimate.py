"""Decimation: fewer rays, evenly spread in space, order, range or time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

from .order import numbered

ROOT2 = math.sqrt(2.0)
LEVELS = (-20, 50)


def first_per(rays: DataFrame, **keys) -> DataFrame:
    """The first ray in file order for each key: one shuffle, with one partial row for each key and task."""
    x = rays.withColumns(keys).groupBy(*keys).agg(F.min_by(F.struct(*rays.columns), "ray_id").alias("r"))
    return x.select("r.*")


def voxels(rays: DataFrame, width: float) -> DataFrame:
    """The first ray, bounded or not, that ends in each voxel."""
    return first_per(rays, **g.voxel(width))


def every_nth(rays: DataFrame, n: int) -> DataFrame:
    return numbered(rays).where(F.col("index") % n == 0).drop("index")


def spatio_temporal(rays: DataFrame, width: float, most: int) -> DataFrame:
    """About `most` rays for each voxel, evenly over its rays in file order; the rate is that of the fullest of the 27 voxels around."""
    x = rays.withColumns(g.voxel(width))
    counts = x.groupBy("vx", "vy", "vz").count()
    near = counts
    for v in ("vx", "vy", "vz"):
        near = near.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(v, F.col(v) + F.col("_o")).drop("_o")
    fullest = near.groupBy("vx", "vy", "vz").agg(F.max("count").alias("fullest"))
    left = F.row_number().over(Window.partitionBy("vx", "vy", "vz").orderBy(F.col("ray_id").desc()))
    x = x.withColumn("left", left).join(fullest, ["vx", "vy", "vz"])
    step = F.greatest(F.lit(1.0), F.col("fullest") / F.lit(float(most)))
    return x.where((F.col("left") + F.lit(1.0)) % step <= F.col("left").cast("double") % step).select(*rays.columns)


def angular(rays: DataFrame, radius_per_length: float) -> DataFrame:
    """One ray for each voxel as wide as twice radius_per_length percent of its range, in widths of powers of the root of 2; voxels that hold a finer
    level's voxel give none. Order-free: every occupied voxel shadows the coarser ones above it."""
    d = F.lit(2.0 * 0.01 * radius_per_length) * g.ray_length()
    lo, hi = LEVELS
    level = F.greatest(F.lit(lo), F.least(F.lit(hi), F.round(F.log(d) / F.lit(math.log(ROOT2))))).cast("int")
    widths = F.array(*[F.lit(ROOT2**k) for k in range(lo, hi + 1)])
    x = rays.withColumn("level", level).withColumn("_w", F.element_at(widths, F.col("level") - lo + 1))
    keys = [F.floor(c / F.col("_w")).alias(n) for n, c in zip(("vx", "vy", "vz"), g.ends(), strict=True)]
    first = x.select("*", *keys).groupBy("level", "vx", "vy", "vz").agg(F.min_by(F.struct(*rays.columns), "ray_id").alias("r"))
    scales = F.array(*[F.lit(ROOT2**k) for k in range(1, hi - lo + 1)])
    used = first.select("level").distinct()
    up = first.select(F.col("level").alias("own"), "vx", "vy", "vz").join(F.broadcast(used), F.col("level") > F.col("own"))  # 71 levels at most
    s = F.get(scales, F.col("level") - F.col("own") - 1)
    shadow = up.select("level", *[F.floor(F.col(v) / s).alias(v) for v in ("vx", "vy", "vz")]).distinct()
    return first.join(shadow, ["level", "vx", "vy", "vz"], "left_anti").select("r.*")


def time_slots(rays: DataFrame, seconds: float) -> DataFrame:
    """The first ray of each slot of time: a trajectory."""
    return first_per(rays, slot=F.floor(F.col("time") / F.lit(float(seconds))))


def ray_space(rays: DataFrame, width: float) -> DataFrame:
    """Rays that claim a voxel: each, in file order, takes the first one on its way back from its end to its start that no earlier ray took.

    The greedy order makes this sequential; the cloud goes through one task.
    """
    import numpy as np
    import pandas as pd

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ray_id", kind="stable").reset_index(drop=True)
        taken: set[tuple[int, int, int]] = set()
        keep = np.zeros(len(pdf), bool)
        p = pdf[["ex", "ey", "ez"]].to_numpy() / width
        q = pdf[["sx", "sy", "sz"]].to_numpy() / width
        for i in range(len(pdf)):
            a, b = p[i], q[i]
            d = b - a
            cuts = [np.arange(math.floor(min(a[k], b[k])) + 1, math.ceil(max(a[k], b[k]))) for k in range(3)]
            ts = np.unique(np.concatenate([[0.0, 1.0], *[(c - a[k]) / d[k] for k, c in enumerate(cuts) if len(c)]]))
            for m in (ts[1:] + ts[:-1]) / 2:
                v = tuple(np.floor(a + d * m).astype(int).tolist())
                if v not in taken:
                    taken.add(v)
                    keep[i] = True
                    break
        return pdf[keep]

    return rays.groupBy(F.lit("all")).applyInPandas(claim, rays.schema)
