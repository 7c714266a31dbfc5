"""Aggregates of whole clouds. All are one pass with partial aggregation, but for path statistics, which compare neighbours in file order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

from .order import with_previous


def _if_bounded(x: Column) -> Column:
    return F.when(F.col("alpha") > 0, x)


def bounds(rays: DataFrame) -> DataFrame:
    """One row: bounds of the bounded rays' ends, of all starts, and of all rays."""
    parts = {"ends": lambda a: (_if_bounded(F.col(f"e{a}")),) * 2, "starts": lambda a: (F.col(f"s{a}"),) * 2, "rays": lambda a: (F.least(f"s{a}", f"e{a}"), F.greatest(f"s{a}", f"e{a}"))}
    cols = []
    for n, f in parts.items():
        for a in "xyz":
            lo, hi = f(a)
            cols += [F.min(lo).alias(f"{n}_min_{a}"), F.max(hi).alias(f"{n}_max_{a}")]
    return rays.agg(*cols)


def bounded_bounds(rays: DataFrame) -> DataFrame:
    """One row: bounds of starts and ends of bounded rays together."""
    cols = []
    for a in "xyz":
        cols += [F.min(_if_bounded(F.least(f"s{a}", f"e{a}"))).alias(f"min_{a}"), F.max(_if_bounded(F.greatest(f"s{a}", f"e{a}"))).alias(f"max_{a}")]
    return rays.agg(*cols)


def cloud_info(rays: DataFrame) -> DataFrame:
    """bounds(), counts, time range, centroid of bounded ends (null if there are none), and the sensor's first and last place."""
    b = bounds(rays)
    first, last = F.min_by(F.struct("sx", "sy", "sz"), F.struct("time", "ray_id")), F.max_by(F.struct("sx", "sy", "sz"), F.struct(F.col("time"), -F.col("ray_id")))
    rest = rays.agg(
        F.count("*").alias("num_rays"), F.count_if(F.col("alpha") > 0).alias("num_bounded"), F.min("time").alias("min_time"), F.max("time").alias("max_time"),
        *[F.avg(_if_bounded(F.col(f"e{a}"))).alias(f"centroid_{a}") for a in "xyz"], first.alias("_f"), last.alias("_l"),
    )
    rest = rest.withColumns({f"{n}_{a}": F.col(f"{c}.s{a}") for n, c in (("first", "_f"), ("last", "_l")) for a in "xyz"}).drop("_f", "_l")
    return b.join(F.broadcast(rest))  # one row each


def moments(rays: DataFrame) -> DataFrame:
    """One row of 22: means and population deviations of starts, ends, time, and colours over 255."""
    cols = []
    for n, xs in (("start", g.starts()), ("end", g.ends())):
        cols += [F.avg(x).alias(f"{n}_mean_{a}") for a, x in zip("xyz", xs, strict=True)] + [F.stddev_pop(x).alias(f"{n}_sd_{a}") for a, x in zip("xyz", xs, strict=True)]
    cols += [F.avg("time").alias("time_mean"), F.stddev_pop("time").alias("time_sd")]
    rgba = {k: F.col(k) / F.lit(255.0) for k in ("red", "green", "blue", "alpha")}
    cols += [F.avg(x).alias(f"{k}_mean") for k, x in rgba.items()] + [F.stddev_pop(x).alias(f"{k}_sd") for k, x in rgba.items()]
    return rays.agg(*cols)


def mesh_moments(vertices: DataFrame) -> DataFrame:
    return vertices.agg(*[F.avg(a).alias(f"mean_{a}") for a in "xyz"], *[F.stddev_pop(a).alias(f"sd_{a}") for a in "xyz"])


def _with_parent(segments: DataFrame) -> DataFrame:
    p = segments.select("tree_id", F.col("seg_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return segments.join(p, ["tree_id", "parent_id"])


def tree_volumes(segments: DataFrame) -> DataFrame:
    """tree_id, volume: of the cylinders from each segment's parent to its tip."""
    x = _with_parent(segments)
    length = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2)
    return x.groupBy("tree_id").agg((F.lit(math.pi) * F.sum(length * F.col("radius") ** 2)).alias("volume"))


def forest_moments(segments: DataFrame) -> DataFrame:
    """One row: trees, sizes of the sums of roots and of their squares, sums of trunk radii and of their squares, volume."""
    roots = segments.where("seg_id = 0")
    x = roots.agg(
        F.count("*").alias("trees"), F.sqrt(F.sum("x") ** 2 + F.sum("y") ** 2 + F.sum("z") ** 2).alias("sum_root"),
        F.sqrt(F.sum(F.col("x") ** 2) ** 2 + F.sum(F.col("y") ** 2) ** 2 + F.sum(F.col("z") ** 2) ** 2).alias("sum_root_squares"),
        F.sum("radius").alias("sum_radius"), F.sum(F.col("radius") ** 2).alias("sum_radius_squares"),
    )
    return x.withColumn("volume", tree_volumes(segments).agg(F.sum("volume")).scalar())


def area(rays: DataFrame, pixel: float = 0.5) -> DataFrame:
    """One row: square metres of ground under bounded ends, in whole pixels."""
    cells = rays.where("alpha > 0").select(g.floor_index("ex", pixel), g.floor_index("ey", pixel)).distinct()
    return cells.agg(F.count("*").alias("pixels"), (F.count("*") * F.lit(pixel * pixel)).alias("area"))


def path_statistics(rays: DataFrame, jump: float = 1.00001) -> DataFrame:
    """One row on the sensor's path: rays out of order, jumps in time and space, contiguous blocks, and length and period without jumps."""
    x = with_previous(rays, ["time", "sx", "sy", "sz"]).where("last_time is not null")
    d = F.sqrt(sum((F.col(f"s{a}") - F.col(f"last_s{a}")) ** 2 for a in "xyz"))
    dt = F.abs(F.col("time") - F.col("last_time"))
    tj, sj = dt > jump, d > jump
    return x.agg(
        F.count_if(F.col("time") < F.col("last_time")).alias("out_of_order"), F.count_if(tj).alias("time_jumps"), F.count_if(sj).alias("space_jumps"),
        (F.count_if(tj | sj) + 1).alias("blocks"), F.coalesce(F.sum(F.when(~(tj | sj), d)), F.lit(0.0)).alias("path_length"), F.coalesce(F.sum(F.when(~(tj | sj), dt)), F.lit(0.0)).alias("path_period"),
    )


def lengths_and_colours(rays: DataFrame) -> DataFrame:
    n = g.ray_length()
    cols = [F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.max(_if_bounded(n)).alias("max_bounded"), F.avg(_if_bounded(n)).alias("mean_bounded")]
    for c in ("red", "green", "blue", "alpha"):
        cols += [F.min(_if_bounded(F.col(c))).alias(f"min_{c}"), F.max(_if_bounded(F.col(c))).alias(f"max_{c}")]
    return rays.agg(*cols)


def point_spacing(rays: DataFrame) -> DataFrame:
    """One row: an estimate of the distance between neighbouring bounded ends, from the share of occupied voxels."""
    r = rays.where("alpha > 0")
    b = r.agg(*[(F.max(f"e{a}") - F.min(f"e{a}")).alias(a) for a in "xyz"], F.count("*").alias("n"))
    b = b.withColumn("w0", F.lit(5.0) * F.pow(F.col("x") * F.col("y") * F.col("z"), F.lit(1.0 / 3.0)) / F.sqrt("n"))
    w = b.select("w0").scalar()
    cells = r.withColumn("_w", w).select(*[F.floor(F.col(f"e{a}") / F.col("_w")).alias(f"v{a}") for a in "xyz"]).distinct().agg(F.count("*").alias("voxels"))
    return b.join(F.broadcast(cells)).select((F.col("w0") / F.sqrt(F.col("n") / F.col("voxels"))).alias("spacing"), "n", "voxels")  # one row each
