"""Synthetic clouds: each ray follows from its number and a seed, so any task can make any of them."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid.functions import colour as c

SECONDS = 0.001


def _rand(seed: int, k: int) -> Column:
    """Even in 0 to 1, from ray_id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("ray_id")), 11) / F.lit(float(1 << 53))


def _finished(x: DataFrame, bounded: Column | None = None) -> DataFrame:
    hue = c.spectrum(F.col("time") / F.lit(60.0))
    hit = bounded if bounded is not None else F.lit(True)
    x = x.withColumns({n: F.when(hit, c.byte(h)).otherwise(F.lit(0)).cast("short") for n, h in zip(("red", "green", "blue"), hue, strict=True)} | {"alpha": F.when(hit, F.lit(255)).otherwise(F.lit(0)).cast("short")})
    return x.select("ray_id", "sx", "sy", "sz", "ex", "ey", "ez", "time", "red", "green", "blue", "alpha")


def _aimed(x: DataFrame, seed: int) -> DataFrame:
    z = F.lit(2.0) * _rand(seed, 1) - 1.0
    turn = F.lit(2.0 * math.pi) * _rand(seed, 2)
    flat = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_dz") * F.col("_dz")))
    return x.withColumn("_dz", z).withColumns({"_dx": F.cos(turn) * flat, "_dy": F.sin(turn) * flat})


def room(spark: SparkSession, seed: int, rays: int, longest: float = 20.0) -> DataFrame:
    """A scan inside a box with a door and cupboards that only the second half sees; rays beyond `longest` are unbounded."""
    r = random.Random(seed)
    w, l, h = r.uniform(3, 6), r.uniform(3, 6), r.uniform(2.75, 3)
    boxes = [((r.uniform(0.2, w - 1), 0.0, 0.0), (0.8, 0.5, 1.8)) for _ in range(2)]
    x = spark.range(rays).withColumnRenamed("id", "ray_id").withColumns({"time": F.col("ray_id") * F.lit(SECONDS) + F.when(F.col("ray_id") >= rays // 2, 0.5).otherwise(0.0), "sx": F.lit(w / 2), "sy": F.lit(l / 2), "sz": F.lit(1.3)})
    x = _aimed(x, seed)
    wall = F.least(*[F.when(d > 0, (F.lit(n) - s) / d).when(d < 0, -s / d).otherwise(F.lit(1e9)) for s, d, n in ((F.col("sx"), F.col("_dx"), w), (F.col("sy"), F.col("_dy"), l), (F.col("sz"), F.col("_dz"), h))])
    door = (F.col("sy") + F.col("_dy") * F.col("_t") < 1e-6) & ((F.col("sx") + F.col("_dx") * F.col("_t")).between(w * 0.4, w * 0.4 + 0.9)) & (F.col("sz") + F.col("_dz") * F.col("_t") < 2.0)
    x = x.withColumn("_t", wall)
    x = x.withColumn("_t", F.when(door, F.lit(longest * 2)).otherwise(F.col("_t")))
    for (bx, by, bz), (dx, dy, dz) in boxes:
        near, far = F.lit(0.0), F.lit(1e9)
        for s, d, lo, n in ((F.col("sx"), F.col("_dx"), bx, dx), (F.col("sy"), F.col("_dy"), by, dy), (F.col("sz"), F.col("_dz"), bz, dz)):
            one, two = (F.lit(lo) - s) / F.nullif(d, F.lit(0.0)), (F.lit(lo + n) - s) / F.nullif(d, F.lit(0.0))
            near, far = F.greatest(near, F.coalesce(F.least(one, two), F.lit(0.0))), F.least(far, F.coalesce(F.greatest(one, two), F.lit(1e9)))
        hit = (near < far) & (F.col("ray_id") >= rays // 2)
        x = x.withColumn("_t", F.when(hit, F.least("_t", near)).otherwise(F.col("_t")))
    x = x.withColumn("_b", F.col("_t") < longest).withColumn("_t", F.least("_t", F.lit(longest)))
    x = x.withColumns({f"e{a}": F.col(f"s{a}") + F.col(f"_d{a}") * F.col("_t") for a in "xyz"})
    return _finished(x, F.col("_b"))


def _height(x: Column, y: Column, seed: int, waves: int) -> Column:
    r = random.Random(seed)
    out = F.lit(0.0)
    for k in range(waves):
        turn, size = r.uniform(0, 2 * math.pi), 0.1 * 1.3**k
        out = out + F.lit(size) * F.sin((x * F.lit(math.cos(turn)) + y * F.lit(math.sin(turn))) / F.lit(4.0 * size) + F.lit(r.uniform(0, 6)))
    return out


def terrain(spark: SparkSession, seed: int, rays: int, waves: int = 10) -> DataFrame:
    """Ground of plane waves, seen from a sensor that walks a Lissajous path 1.3 m above it."""
    u = F.col("ray_id") / F.lit(float(max(1, rays))) * F.lit(2.0 * math.pi)
    x = spark.range(rays).withColumnRenamed("id", "ray_id").withColumns({"time": F.col("ray_id") * F.lit(SECONDS), "sx": F.lit(20.0) * F.sin(u * 3), "sy": F.lit(20.0) * F.sin(u * 2)})
    x = x.withColumn("sz", _height(F.col("sx"), F.col("sy"), seed, waves) + 1.3)
    far, turn = F.lit(0.3) + F.lit(6.0) * F.sqrt(_rand(seed, 1)), F.lit(2.0 * math.pi) * _rand(seed, 2)
    x = x.withColumns({"ex": F.col("sx") + far * F.cos(turn), "ey": F.col("sy") + far * F.sin(turn)})
    return _finished(x.withColumn("ez", _height(F.col("ex"), F.col("ey"), seed, waves)))


def field(spark: SparkSession, seed: int, rays: int, depth: float = 0.5) -> DataFrame:
    """A crop seen from above: how far rays get into it falls off exponentially, to the ground at most."""
    x = spark.range(rays).withColumnRenamed("id", "ray_id").withColumns({"time": F.col("ray_id") * F.lit(SECONDS), "ex": F.lit(10.0) * _rand(seed, 1), "ey": F.lit(10.0) * _rand(seed, 2)})
    down = F.least(F.lit(1.0), -F.lit(depth) * F.log(F.greatest(F.lit(1e-12), F.lit(1.0) - _rand(seed, 3))))
    return _finished(x.withColumns({"ez": F.lit(1.0) - down, "sx": F.col("ex"), "sy": F.col("ey"), "sz": F.lit(3.0)}))
