"""Predicate splits: each adds a column side, inside or outside, so one pass gives both parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

from .neighbours import nearest

Triple = tuple[float, float, float]


def split(rays: DataFrame, outside: Column) -> DataFrame:
    return rays.withColumn("side", F.when(outside, "outside").otherwise("inside"))


def by_time(rays: DataFrame, t: float) -> DataFrame:
    return split(rays, F.col("time") > t)


def by_time_percent(rays: DataFrame, percent: float) -> DataFrame:
    bounds = rays.agg(F.min("time").alias("a"), F.max("time").alias("b"))
    limit = bounds.select(F.col("a") + (F.col("b") - F.col("a")) * F.lit(float(percent)) / F.lit(100.0)).scalar()
    return split(rays, F.col("time") > limit)


def by_alpha(rays: DataFrame, alpha: float) -> DataFrame:
    return split(rays, F.col("alpha") > int(255.0 * alpha))


def _scaled(v: Triple) -> list[Column]:
    n = sum(x * x for x in v)
    return g.vec(*[x / n for x in v])


def by_direction(rays: DataFrame, direction: Triple) -> DataFrame:
    d = g.minus(g.ends(), g.starts())
    n = g.norm(d)
    return split(rays, g.dot([x / n for x in d], _scaled(direction)) > 1.0)


def by_colour(rays: DataFrame, rgb: Triple) -> DataFrame:
    c = [F.col(k) / F.lit(255.0) for k in ("red", "green", "blue")]
    return split(rays, g.dot(c, _scaled(rgb)) > 1.0)


def by_single_colour(rays: DataFrame, rgb: tuple[int, int, int]) -> DataFrame:
    same = [F.col(k) == v for k, v in zip(("red", "green", "blue"), rgb, strict=True)]
    return split(rays, ~(same[0] & same[1] & same[2]))


def by_range(rays: DataFrame, length: float) -> DataFrame:
    return split(rays, g.ray_length() > length)


def remove_unbounded(rays: DataFrame) -> DataFrame:
    return rays.where("alpha > 0")


def number_colours(rays: DataFrame) -> DataFrame:
    """With a column part: a number for each colour, in order of red, green, blue. The table of colours is small; rays aren't sorted."""
    rgb = ["red", "green", "blue"]
    parts = rays.select(*rgb).distinct().withColumn("part", F.dense_rank().over(Window.orderBy(*rgb)).cast("long") - 1)
    return rays.join(F.broadcast(parts), rgb)  # at most 2^24 colours, of 14 bytes each


def _gaps(rays: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Ranges of the previous and the next ray in file order, without one global sort: neighbours across blocks of ray_id meet by their edges."""
    x = rays.withColumns({"r1": g.ray_length(), "_block": F.floor(F.col("ray_id") / block)})
    w = Window.partitionBy("_block").orderBy("ray_id")
    x = x.withColumns({"r0": F.lag("r1").over(w), "r2": F.lead("r1").over(w)})
    edges = x.groupBy("_block").agg(F.min_by("r1", "ray_id").alias("_first"), F.max_by("r1", "ray_id").alias("_last"))
    order = Window.orderBy("_block")  # over a row for each block
    edges = edges.select("_block", F.lag("_last").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"))
    x = x.join(F.broadcast(edges), "_block")
    return x.withColumns({"r0": F.coalesce("r0", "_before"), "r2": F.coalesce("r2", "_after")}).drop("_block", "_before", "_after")


def denoise_by_range(rays: DataFrame, gap: float) -> DataFrame:
    """Keeps unbounded rays and those whose range is near a neighbour's in file order; the first and the last ray go."""
    x = _gaps(rays).where("r0 is not null and r2 is not null")
    near = F.least(F.abs(F.col("r0") - F.col("r2")), F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("r2") - F.col("r1"))) < gap
    return x.where((F.col("alpha") == 0) | near).select(*rays.columns)


def denoise_by_distance(rays: DataFrame, distance: float) -> DataFrame:
    """Keeps unbounded rays and those with another ray's end (bounded or not) nearer than distance: the nearest one decides."""
    own = rays.where("alpha > 0")
    near = nearest(own, rays, 1, distance).where(F.col("d2") < distance * distance).select("ray_id")
    return rays.where("alpha = 0").unionByName(own.join(near, "ray_id", "left_semi"))


def crop_to_cell(rays: DataFrame, width: float, cell: tuple[int, int] = (0, 0)) -> DataFrame:
    """Rays whose end lies in one cell of a grid centred on the origin."""
    at = [F.floor(F.lit(0.5) + F.col(c) / F.lit(float(width))) for c in ("ex", "ey")]
    return rays.where((at[0] == cell[0]) & (at[1] == cell[1]))
