"""Per-ray projections: positions, times and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamgrid.functions import colour as c
from beamgrid.functions import geometry as g

Triple = tuple[float, float, float]


def convert(rays: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Any change of columns."""
    return rays.withColumns(columns)


def translate(rays: DataFrame, by: Triple, seconds: float = 0.0) -> DataFrame:
    moved = {f"{p}{a}": F.col(f"{p}{a}") + F.lit(float(d)) for p in "se" for a, d in zip("xyz", by, strict=True)}
    return rays.withColumns(moved | {"time": F.col("time") + F.lit(float(seconds))})


def transform(rays: DataFrame, matrix: list[list[float]], shift: Sequence[float] = (0.0, 0.0, 0.0), seconds: float = 0.0) -> DataFrame:
    """A rigid motion of both ends, and a shift in time."""
    s, e = g.applied(matrix, g.starts(), shift), g.applied(matrix, g.ends(), shift)
    return rays.withColumns(dict(zip(("sx", "sy", "sz", "ex", "ey", "ez"), (*s, *e), strict=True)) | {"time": F.col("time") + F.lit(float(seconds))})


def rotate(rays: DataFrame, degrees: Triple) -> DataFrame:
    """By a rotation vector in degrees about the origin."""
    return transform(rays, g.rotation(degrees))


def remove_start(rays: DataFrame) -> DataFrame:
    """Relative to the first ray's end."""
    first = rays.agg(F.min_by(F.struct("ex", "ey", "ez"), "ray_id")).scalar()
    x = rays.withColumn("_o", first)
    return x.withColumns({f"{p}{a}": F.col(f"{p}{a}") - F.col(f"_o.e{a}") for p in "se" for a in "xyz"}).drop("_o")


def fixed_start(points: DataFrame, at: Triple) -> DataFrame:
    return points.withColumns(dict(zip(("sx", "sy", "sz"), g.vec(*at), strict=True)))


def fixed_direction(points: DataFrame, ray: Triple) -> DataFrame:
    """Starts one given ray vector before the ends."""
    if not any(ray):
        raise ValueError("the ray vector is zero")
    return points.withColumns({f"s{a}": F.col(f"e{a}") - F.lit(float(d)) for a, d in zip("xyz", ray, strict=True)})


def shorten_non_returns(rays: DataFrame, length: float = 0.1) -> DataFrame:
    """Unbounded rays that go down end shortly after their start."""
    n = g.ray_length()
    down = (F.col("alpha") == 0) & (F.col("ez") < F.col("sz"))
    return rays.withColumns({f"e{a}": F.when(down, F.col(f"s{a}") + F.lit(length) * (F.col(f"e{a}") - F.col(f"s{a}")) / n).otherwise(F.col(f"e{a}")) for a in "xyz"})


def full_intensity(rays: DataFrame) -> DataFrame:
    return rays.withColumn("alpha", F.lit(255).cast("short"))


def flat_colour(rays: DataFrame, rgb: Triple) -> DataFrame:
    return rays.withColumns({k: F.lit(int(255.0 * v)).cast("short") for k, v in zip(("red", "green", "blue"), rgb, strict=True)})


def flat_alpha(rays: DataFrame, alpha: float) -> DataFrame:
    return rays.withColumn("alpha", F.lit(int(255.0 * alpha)).cast("short"))


def _painted(rays: DataFrame, rgb: list[Column]) -> DataFrame:
    return rays.withColumns({k: c.byte(v) for k, v in zip(("red", "green", "blue"), rgb, strict=True)})


def colour_by_time(rays: DataFrame, period: float = 60.0) -> DataFrame:
    return _painted(rays, c.spectrum(F.col("time") / F.lit(period)))


def colour_by_height(rays: DataFrame, wavelength: float = 10.0) -> DataFrame:
    return _painted(rays, c.spectrum(F.col("ez") / F.lit(wavelength)))


def colour_by_alpha(rays: DataFrame) -> DataFrame:
    return _painted(rays, c.gradient(F.col("alpha") / F.lit(255.0)))


def colour_by_image(rays: DataFrame, image: DataFrame, width: int, height: int) -> DataFrame:
    """Colours of an image (px, py, red, green, blue) stretched over the ends' bounds; the upper bounds take the last pixel."""
    box = rays.where("alpha > 0").agg(*[f("e" + a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xy"])
    x = rays.withColumn("_b", box.select(F.struct("*")).scalar())
    pixel = lambda a, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.lit(float(n)) * (F.col(f"e{a}") - F.col(f"_b.lo{a}")) / (F.col(f"_b.hi{a}") - F.col(f"_b.lo{a}"))))).cast("long")
    x = x.withColumns({"px": pixel("x", width), "py": pixel("y", height)}).drop("red", "green", "blue", "_b")
    return x.join(image, ["px", "py"], "left").select(*rays.columns)


def colour_by_id(rays: DataFrame, number: Column) -> DataFrame:
    return rays.withColumns(dict(zip(("red", "green", "blue"), c.id_to_colour(number), strict=True)))


def colour_by_raster(rays: DataFrame, raster: DataFrame, width: float) -> DataFrame:
    """Each ray takes the id (px, py, value) of the pixel that its end lies in; others turn black."""
    x = rays.withColumns({"px": g.floor_index("ex", width), "py": g.floor_index("ey", width)}).join(raster, ["px", "py"], "left")
    rgb = c.id_to_colour(F.coalesce(F.col("value"), F.lit(-1)).cast("long"))
    return x.withColumns(dict(zip(("red", "green", "blue"), rgb, strict=True))).select(*rays.columns)


def time_text(rays: DataFrame) -> DataFrame:
    """With a column when: the time in words, in the session's time zone."""
    return rays.withColumn("when", F.date_format(F.timestamp_seconds(F.floor("time")), "E dd/MM/yyyy HH:mm:ss"))


def subtract_ground(rays: DataFrame, ground: DataFrame, width: float, sign: float = -1.0) -> DataFrame:
    """Heights less (or plus) those of a ground raster (px, py, value); rays off the raster stay."""
    x = rays.withColumns({"px": g.floor_index("ex", width), "py": g.floor_index("ey", width)}).join(ground, ["px", "py"], "left")
    h = F.lit(sign) * F.coalesce("value", F.lit(0.0))
    return x.withColumns({"sz": F.col("sz") + h, "ez": F.col("ez") + h}).select(*rays.columns)
