"""Clipping and geometric splits: one ray gives parts on either side. Parts without the true end turn unbounded (colour and alpha 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

Triple = tuple[float, float, float]


def _part(side: str, a: Column, b: Column, has_end: Column, when: Column) -> Column:
    """A part between two fractions of the ray, null where it isn't made."""
    return F.when(when, F.struct(F.lit(side).alias("side"), a.alias("a"), b.alias("b"), has_end.alias("has_end")))


def _cut(rays: DataFrame, parts: list[Column]) -> DataFrame:
    """Replaces each ray by its parts; fractions 0 and 1 are the ends themselves."""
    x = rays.withColumn("_p", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    at = lambda axis, t: F.when(t == 0.0, F.col(f"s{axis}")).when(t == 1.0, F.col(f"e{axis}")).otherwise(F.col(f"s{axis}") + (F.col(f"e{axis}") - F.col(f"s{axis}")) * t)
    moved = {f"{p}{axis}": at(axis, F.col(f"_p.{t}")) for p, t in (("s", "a"), ("e", "b")) for axis in "xyz"}
    black = {c: F.when(F.col("_p.has_end"), F.col(c)).otherwise(F.lit(0)).cast("short") for c in ("red", "green", "blue", "alpha")}
    return x.withColumns(moved | black | {"side": F.col("_p.side")}).drop("_p")


def in_box(low: Triple, high: Triple) -> Column:
    """Whether the end lies in the half-open box."""
    out = F.lit(True)
    for c, a, b in zip(g.ends(), low, high, strict=True):
        out &= (c >= F.lit(float(a))) & (c < F.lit(float(b)))
    return out


def clip_to_box(rays: DataFrame, low: Triple, high: Triple, eps: float = 0.0) -> DataFrame:
    """The part of each ray inside the box."""
    near, far = g.clip_interval(g.vec(*low), g.vec(*high), eps)
    x = rays.withColumns({"_n": near, "_f": far}).where("_n < _f")
    return _cut(x, [_part("inside", F.col("_n"), F.col("_f"), F.col("_f") == 1.0, F.lit(True))]).drop("_n", "_f", "side")


def hits_box(rays: DataFrame, low: Triple, high: Triple) -> DataFrame:
    near, far = g.clip_interval(g.vec(*low), g.vec(*high))
    return rays.withColumn("hits", near < far)


def boxes_overlap(boxes: DataFrame) -> DataFrame:
    """With a column overlaps: whether boxes (a_lo_x, ... b_hi_z) touch or meet."""
    out = F.lit(True)
    for a in "xyz":
        out &= (F.col(f"a_lo_{a}") <= F.col(f"b_hi_{a}")) & (F.col(f"b_lo_{a}") <= F.col(f"a_hi_{a}"))
    return boxes.withColumn("overlaps", out)


def split_plane(rays: DataFrame, n: Triple) -> DataFrame:
    """At the plane through n, square to it; outside is beyond it. Rays within the plane are inside."""
    s = sum(v * v for v in n)
    v = g.vec(*[x / s for x in n])
    x = rays.withColumns({"_d1": g.dot(g.starts(), v) - 1.0, "_d2": g.dot(g.ends(), v) - 1.0})
    d1, d2 = F.col("_d1"), F.col("_d2")
    crosses = (d1 * d2 <= 0.0) & (d1 != d2)
    t = d1 / F.nullif(d1 - d2, F.lit(0.0))
    zero, one, yes, no = F.lit(0.0), F.lit(1.0), F.lit(True), F.lit(False)
    parts = [
        _part("outside", zero, one, yes, ~crosses & (d1 > 0.0)),
        _part("inside", zero, one, yes, ~crosses & (d1 <= 0.0)),
        _part("outside", zero, t, no, crosses & (d1 > 0.0)),
        _part("inside", t, one, yes, crosses & (d1 > 0.0)),
        _part("inside", zero, t, no, crosses & (d1 <= 0.0)),
        _part("outside", t, one, yes, crosses & (d1 <= 0.0)),
    ]
    return _cut(x, parts).drop("_d1", "_d2")


def split_box(rays: DataFrame, centre: Triple, radius: Triple) -> DataFrame:
    """At a box; a radius of 0 means no bound on that axis."""
    r = [v or 1e7 for v in radius]
    low, high = [c - v for c, v in zip(centre, r, strict=True)], [c + v for c, v in zip(centre, r, strict=True)]
    near, far = g.clip_interval(g.vec(*low), g.vec(*high))
    x = rays.withColumns({"_n": near, "_f": far, "_in": in_box(tuple(low), tuple(high))})
    n, f, hit = F.col("_n"), F.col("_f"), F.col("_n") < F.col("_f")
    parts = [
        _part("outside", F.lit(0.0), F.lit(1.0), F.lit(True), ~hit),
        _part("inside", n, f, F.col("_in"), hit),
        _part("outside", F.lit(0.0), n, F.lit(False), hit & (n > 0.0)),
        _part("outside", f, F.lit(1.0), F.lit(True), hit & (f < 1.0)),
    ]
    return _cut(x, parts).drop("_n", "_f", "_in")


def split_capsule(rays: DataFrame, a: Triple, b: Triple, radius: float) -> DataFrame:
    """At a capsule around the segment from a to b: the union of the intervals in its cylinder and in the spheres at its ends."""
    length = math.dist(a, b)
    axis = g.vec(*[(q - p) / length if length else 0.0 for p, q in zip(a, b, strict=True)])
    ray, r2 = g.minus(g.ends(), g.starts()), F.lit(float(radius) ** 2)
    from_a = g.minus(g.starts(), g.vec(*a))
    along = g.dot(ray, axis)
    side = [r - d * along for r, d in zip(ray, axis, strict=True)]
    cross = [axis[1] * ray[2] - axis[2] * ray[1], axis[2] * ray[0] - axis[0] * ray[2], axis[0] * ray[1] - axis[1] * ray[0]]
    x = rays.withColumns({"_m": g.norm(cross), "_rl": g.dot(ray, ray), "_gap": F.abs(g.dot(from_a, cross)), "_ss": g.dot(side, side), "_sf": -g.dot(from_a, side)})
    gap = F.col("_gap") / F.nullif(F.col("_m"), F.lit(0.0))
    x = x.withColumn("_gap", gap)
    shift = F.sqrt(F.greatest(r2 - F.col("_gap") ** 2, F.lit(0.0))) / F.nullif(F.sqrt("_ss"), F.lit(0.0))
    mid = F.col("_sf") / F.nullif(F.col("_ss"), F.lit(0.0))
    x = x.withColumns({"_c1": mid - shift, "_c2": mid + shift})
    height = lambda t: (g.dot(from_a, axis) + F.col(t) * along) / F.lit(length or 1.0)
    reaches = F.col("_gap") < radius
    within = lambda t: reaches & (height(t) > 0.0) & (height(t) < 1.0)
    closest, farthest = F.when(within("_c1"), F.col("_c1")).otherwise(F.lit(1e10)), F.when(within("_c2"), F.col("_c2")).otherwise(F.lit(-1e10))
    for end in (a, b):
        to = g.minus(g.vec(*end), g.starts())
        m = g.dot(to, ray) / F.col("_rl")
        rest = [p - q * m for p, q in zip(to, ray, strict=True)]
        off = g.dot(rest, rest)
        s = F.sqrt(F.greatest(r2 - off, F.lit(0.0))) / F.sqrt("_rl")
        closest, farthest = F.least(closest, F.when(off < r2, m - s).otherwise(F.lit(1e10))), F.greatest(farthest, F.when(off < r2, m + s).otherwise(F.lit(-1e10)))
    x = x.withColumns({"_n": closest, "_f": farthest})
    n, f = F.col("_n"), F.col("_f")
    out = (F.coalesce(F.col("_gap") >= radius, F.lit(False))) | (n >= 1.0) | (f <= 0.0)
    parts = [
        _part("outside", F.lit(0.0), F.lit(1.0), F.lit(True), out),
        _part("outside", F.lit(0.0), n, F.lit(False), ~out & (n > 0.0)),
        _part("outside", f, F.lit(1.0), F.lit(True), ~out & (f < 1.0)),
        _part("inside", F.greatest(n, F.lit(0.0)), F.least(f, F.lit(1.0)), f >= 1.0, ~out),
    ]
    return _cut(x, parts).select(*rays.columns, "side")


def split_grid(rays: DataFrame, width: Triple, overlap: float = 0.0, period: float = 0.0) -> DataFrame:
    """Each ray clipped into every cell that it meets, with cx, cy, cz (and ct, cells of time); width 0 leaves an axis whole.

    Cell i spans (i - 0.5) to (i + 0.5) widths, wider by half the overlap on either side.
    """
    half = overlap / 2
    x, low, high = rays, [], []
    for a, w in zip("xyz", width, strict=True):
        if w:
            lo, hi = F.least(f"s{a}", f"e{a}"), F.greatest(f"s{a}", f"e{a}")
            x = x.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.lit(0.5) + (lo - half) / w).cast("long"), F.floor(F.lit(0.5) + (hi + half) / w).cast("long"))))
            low.append((F.col(f"c{a}") - 0.5) * w - half)
            high.append((F.col(f"c{a}") + 0.5) * w + half)
        else:
            x = x.withColumn(f"c{a}", F.lit(0).cast("long"))
            low.append(F.lit(-1e7))
            high.append(F.lit(1e7))
    near, far = g.clip_interval(low, high)
    inside = F.lit(True)
    for c, a, b in zip(g.ends(), low, high, strict=True):
        inside &= (c >= a) & (c < b)
    x = x.withColumns({"_n": near, "_f": far, "_in": inside}).where("_n < _f")
    x = _cut(x, [_part("inside", F.col("_n"), F.col("_f"), F.col("_in"), F.lit(True))]).drop("_n", "_f", "_in", "side")
    return x.withColumn("ct", F.floor(F.lit(0.5) + F.col("time") / period).cast("long")) if period else x
