"""Images of clouds as rasters (px, py, ...): one row a pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamgrid.functions import colour as c
from beamgrid.functions import geometry as g

Triple = tuple[float, float, float]
#: view: axis looked along, direction (1: from above), image x axis, image y axis.
VIEWS = {"top": ("z", 1, "x", "y"), "left": ("x", -1, "y", "z"), "right": ("x", 1, "y", "z"), "front": ("y", -1, "x", "z"), "back": ("y", 1, "x", "z")}
RGB = ("red", "green", "blue")


def _placed(rays: DataFrame, low: Triple, width: float, view: str, of: str) -> tuple[DataFrame, int]:
    axis, direction, ax, ay = VIEWS[view]
    o = dict(zip("xyz", low, strict=True))
    at = {a: (F.col(f"{of}{a}") - F.lit(float(o[a]))) / F.lit(float(width)) for a in "xyz"}
    x = rays.where("alpha > 0").withColumns({"px": at[ax].cast("long"), "py": at[ay].cast("long"), "depth": at[axis]} | {f"_{k}": F.col(k) / F.lit(255.0) for k in RGB})
    return x, direction


def nearest_point(rays: DataFrame, low: Triple, width: float, view: str = "top", of: str = "e") -> DataFrame:
    """px, py, red, green, blue (0 to 1), depth, ray_id of the point nearest to the viewer, the first on ties. of: e for ends, s for starts."""
    x, d = _placed(rays, low, width, view, of)
    best = F.max_by(F.struct("_red", "_green", "_blue", "depth", "ray_id"), F.struct(F.col("depth") * d, -F.col("ray_id")))
    return x.groupBy("px", "py").agg(best.alias("b")).select("px", "py", *[F.col(f"b._{k}").alias(k) for k in RGB], "b.depth", "b.ray_id")


def mean_colour(rays: DataFrame, low: Triple, width: float, view: str = "top") -> DataFrame:
    x, _ = _placed(rays, low, width, view, "e")
    return x.groupBy("px", "py").agg(*[F.avg(f"_{k}").alias(k) for k in RGB], F.count("*").cast("double").alias("weight"))


def sum_colour(rays: DataFrame, low: Triple, width: float, view: str = "top") -> DataFrame:
    """Sums of colours over the tone range's upper end."""
    x, _ = _placed(rays, low, width, view, "e")
    x = x.groupBy("px", "py").agg(*[F.sum(f"_{k}").alias(k) for k in RGB], F.count("*").cast("double").alias("weight"))
    top = tone_range(x, "weight").select("max_val").scalar()
    return x.withColumn("_m", top).select("px", "py", *[(F.col(k) / F.col("_m")).alias(k) for k in RGB], "weight")


def tone_range(pixels: DataFrame, value: str) -> DataFrame:
    """One row: mean plus and minus two deviations of the pixels above zero; the mean is the sum of all over how many are above zero."""
    v = F.col(value)
    a = pixels.agg(F.sum(v).alias("s"), F.count_if(v > 0).alias("n"), F.sum(F.when(v > 0, v)).alias("sp"), F.sum(F.when(v > 0, v * v)).alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.lit(2.0) * mean * F.col("sp") + F.col("n") * mean * mean) / F.col("n")))
    return a.select((mean - F.lit(2.0) * sd).alias("min_val"), (mean + F.lit(2.0) * sd).alias("max_val"))


def line_pixels(rays: DataFrame, low: Triple, high: Triple, width: float, view: str = "top") -> DataFrame:
    """px, py and colour of every pixel under each bounded ray, one for each step along its longer axis, after clipping to the box."""
    _, _, ax, ay = VIEWS[view]
    near, far = g.clip_interval(g.vec(*low), g.vec(*high))
    x = rays.where("alpha > 0").withColumns({"_n": near, "_f": far}).where("_n < _f")
    o = dict(zip("xyz", low, strict=True))
    at = lambda a, t: (F.col(f"s{a}") + (F.col(f"e{a}") - F.col(f"s{a}")) * F.col(t) - F.lit(float(o[a]))) / F.lit(float(width))
    x = x.withColumns({"_xa": at(ax, "_n"), "_xb": at(ax, "_f"), "_ya": at(ay, "_n"), "_yb": at(ay, "_f")})
    x = x.withColumn("_xl", F.abs(F.col("_xb") - F.col("_xa")) > F.abs(F.col("_yb") - F.col("_ya")))
    pick = lambda a, b: F.when(F.col("_xl"), F.col(a)).otherwise(F.col(b))
    x = x.withColumns({"_la": pick("_xa", "_ya"), "_lb": pick("_xb", "_yb"), "_sa": pick("_ya", "_xa"), "_sb": pick("_yb", "_xb")})
    x = x.withColumn("_g", (F.col("_sb") - F.col("_sa")) / F.nullif(F.col("_lb") - F.col("_la"), F.lit(0.0))).where("_g is not null")
    up = F.col("_lb") >= F.col("_la")
    x = x.withColumns({"_l0": F.when(up, F.col("_la")).otherwise(F.col("_lb")), "_l1": F.when(up, F.col("_lb")).otherwise(F.col("_la")), "_s0": F.when(up, F.col("_sa")).otherwise(F.col("_sb"))})
    x = x.withColumn("_l", F.explode(F.sequence(F.col("_l0").cast("long"), F.col("_l1").cast("long"))))
    short = (F.col("_s0") + (F.col("_l") + F.lit(0.5) - F.col("_l0")) * F.col("_g")).cast("long")
    x = x.withColumn("_s", short)
    return x.select("ray_id", pick("_l", "_s").alias("px"), pick("_s", "_l").alias("py"), *[(F.col(k) / F.lit(255.0)).alias(k) for k in RGB])


def draw_rays(rays: DataFrame, low: Triple, high: Triple, width: float, view: str = "top") -> DataFrame:
    return line_pixels(rays, low, high, width, view).groupBy("px", "py").agg(*[F.avg(k).alias(k) for k in RGB], F.count("*").cast("double").alias("weight"))


def column_density(densities: DataFrame, width: float) -> DataFrame:
    """px, py, value: densities (vx, vy, vz, density) summed up each column."""
    return densities.groupBy(F.col("vx").alias("px"), F.col("vy").alias("py")).agg((F.sum("density") * F.lit(width)).alias("value"))


def density_colours(columns: DataFrame) -> DataFrame:
    """Brightness by a power of the density, hue once around for each power of ten."""
    v = F.col("value")
    shade = F.lit(0.7) * F.pow(v, F.lit(0.3))
    hue = c.spectrum(F.log10(F.greatest(F.lit(1e-6), v)))
    return columns.select("px", "py", *[(shade * h).alias(k) for k, h in zip(RGB, hue, strict=True)])


def height_shade(points: DataFrame) -> DataFrame:
    """nearest_point() with shade: the depth within the tone range."""
    t = tone_range(points, "depth").select(F.struct("min_val", "max_val")).scalar()
    return points.withColumn("_t", t).withColumn("shade", (F.col("depth") - F.col("_t.min_val")) / (F.col("_t.max_val") - F.col("_t.min_val"))).drop("_t")


def grid_bounds(rays: DataFrame, width: float) -> DataFrame:
    """One row: the grid cell that the middle of the bounded ends lies in."""
    b = rays.where("alpha > 0").agg(*[((F.min(f"e{a}") + F.max(f"e{a}")) / F.lit(2.0)).alias(a) for a in "xy"])
    return b.select(*[(F.round(F.col(a) / F.lit(width)) * F.lit(width) + F.lit(s * width / 2)).alias(f"{n}_{a}") for a in "xy" for n, s in (("min", -1), ("max", 1))])


def world_transform(rays: DataFrame, pixel: float) -> DataFrame:
    """One row: from image pixels to the world, scale and offsets."""
    b = rays.where("alpha > 0").agg(F.min("ex").alias("x"), F.max("ey").alias("y"))
    return b.select(F.lit(pixel).alias("scale_x"), F.col("x").alias("offset_x"), F.lit(-pixel).alias("scale_y"), F.col("y").alias("offset_y"))
