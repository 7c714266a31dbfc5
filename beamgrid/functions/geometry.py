"""Vectors, voxels and rounding as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
Vec = Sequence[Column]


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ends() -> list[Column]:
    return [F.col("ex"), F.col("ey"), F.col("ez")]


def starts() -> list[Column]:
    return [F.col("sx"), F.col("sy"), F.col("sz")]


def vec(*x: float) -> list[Column]:
    return [F.lit(float(v)) for v in x]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def ray_length() -> Column:
    return norm(minus(ends(), starts()))


def floor_index(x: ColumnLike, width: float) -> Column:
    return F.floor(col(x) / F.lit(float(width))).cast("long")


def voxel(width: float, at: Vec | None = None) -> dict[str, Column]:
    """vx, vy, vz of a point, the ray's end if none is given."""
    return {n: floor_index(c, width) for n, c in zip(("vx", "vy", "vz"), at or ends(), strict=True)}


def truncated(x: Column) -> Column:
    """Towards zero, as a long."""
    return x.cast("long")


def rounded(x: ColumnLike, digits: int = 6) -> Column:
    """For comparison between engines: rounded, and never minus zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def rotation(vector: tuple[float, float, float]) -> list[list[float]]:
    """The matrix of a rotation vector in degrees; none for a zero vector."""
    angle = math.sqrt(sum(v * v for v in vector))
    if angle == 0.0:
        return [[float(i == j) for j in range(3)] for i in range(3)]
    x, y, z = (v / angle for v in vector)
    s, c = math.sin(math.radians(angle)), math.cos(math.radians(angle))
    t = 1.0 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def quaternion_matrix(w: float, x: float, y: float, z: float) -> list[list[float]]:
    n = math.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def applied(matrix: list[list[float]], p: Vec, shift: Sequence[float] = (0.0, 0.0, 0.0)) -> list[Column]:
    return [F.lit(m[0]) * p[0] + F.lit(m[1]) * p[1] + F.lit(m[2]) * p[2] + F.lit(float(t)) for m, t in zip(matrix, shift, strict=True)]


def clip_interval(low: Vec, high: Vec, eps: float = 0.0) -> tuple[Column, Column]:
    """Where a ray enters and leaves a box, as fractions of its length; it misses the box if near >= far."""
    near, far = F.lit(0.0), F.lit(1.0)
    for s, e, a, b in zip(starts(), ends(), low, high, strict=True):
        d = e - s
        one, other = (a + eps - s) / F.nullif(d, F.lit(0.0)), (b - eps - s) / F.nullif(d, F.lit(0.0))
        inside = (s >= a) & (s <= b)
        near = F.greatest(near, F.when(d == 0.0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(one, other)))
        far = F.least(far, F.when(d == 0.0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(one, other)))
    return near, far
