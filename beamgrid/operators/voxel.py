"""Rays through voxels: expansion, densities, occupancy and rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

Triple = tuple[float, float, float]
V = ["vx", "vy", "vz"]


def _planes(a: Column, b: Column) -> Column:
    """Where a segment from a to b crosses whole numbers, as fractions of it."""
    lo, hi = F.floor(F.least(a, b)).cast("long") + 1, F.ceil(F.greatest(a, b)).cast("long") - 1
    none = F.array().cast("array<double>")
    return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: (k - a) / (b - a))).otherwise(none)


def walk(rays: DataFrame, width: float, origin: Triple = (0.0, 0.0, 0.0), axes: str = "xyz", a: Column | None = None, b: Column | None = None) -> DataFrame:
    """A row for each voxel that a ray passes: vx, vy, vz, t_in and t_out (fractions of the ray), length.

    a and b narrow a ray to a part of it. The crossings of all axes are sorted and neighbouring ones make an interval, whose
    middle names the voxel; so lengths add up to the ray's, and corners give no voxel twice.
    """
    u = {c: (F.col(f"s{c}") - F.lit(float(o))) / F.lit(float(width)) for c, o in zip("xyz", origin, strict=True)}
    w = {c: (F.col(f"e{c}") - F.lit(float(o))) / F.lit(float(width)) for c, o in zip("xyz", origin, strict=True)}
    low, high = a if a is not None else F.lit(0.0), b if b is not None else F.lit(1.0)
    x = rays.withColumns({f"_u{c}": u[c] for c in axes} | {f"_w{c}": w[c] for c in axes} | {"_a": low, "_b": high}).where("_a < _b")
    ts = F.concat(F.array("_a", "_b"), *[_planes(F.col(f"_u{c}"), F.col(f"_w{c}")) for c in axes])
    x = x.withColumn("_t", F.array_sort(F.array_distinct(F.filter(ts, lambda t: (t >= F.col("_a")) & (t <= F.col("_b"))))))
    spans = F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda i: F.struct(F.element_at("_t", i).alias("i"), F.element_at("_t", i + 1).alias("o")))
    x = x.withColumn("_s", F.explode(spans)).withColumns({"t_in": F.col("_s.i"), "t_out": F.col("_s.o")})
    mid = (F.col("t_in") + F.col("t_out")) / F.lit(2.0)
    x = x.withColumns({f"v{c}": F.floor(F.col(f"_u{c}") + (F.col(f"_w{c}") - F.col(f"_u{c}")) * mid).cast("long") for c in axes})
    x = x.withColumn("length", (F.col("t_out") - F.col("t_in")) * g.ray_length())
    return x.drop("_a", "_b", "_t", "_s", *[f"_u{c}" for c in axes], *[f"_w{c}" for c in axes])


def seed_walk(rays: DataFrame, width: float) -> DataFrame:
    """walk(), only through voxels in which a bounded ray ends: a semi-join before anything is shuffled for more."""
    seeds = rays.where("alpha > 0").select(*[c.alias(n) for n, c in g.voxel(width).items()]).distinct()
    return walk(rays, width).join(seeds, V, "left_semi")


def traversal_counts(rays: DataFrame, width: float) -> DataFrame:
    return walk(rays, width).groupBy(*V).agg(F.count("*").alias("rays"), F.sum("length").alias("path_len"))


def peaks(rays: DataFrame, low: Triple, high: Triple, width: float) -> DataFrame:
    """px, py, peak: the highest bounded end in each column, in voxels from the box's floor. Ends outside the box count where the ray leaves it."""
    near, far = g.clip_interval(g.vec(*low), g.vec(*high))
    x = rays.where("alpha > 0").withColumns({"_n": near, "_f": far}).where("_n < _f")
    end = {a: (F.when(F.col("_f") == 1.0, F.col(f"e{a}")).otherwise(F.col(f"s{a}") + (F.col(f"e{a}") - F.col(f"s{a}")) * F.col("_f")) - F.lit(float(o))) / F.lit(width) for a, o in zip("xyz", low, strict=True)}
    return x.select(F.floor(end["x"]).cast("long").alias("vx"), F.floor(end["y"]).cast("long").alias("vy"), end["z"].alias("h")).groupBy("vx", "vy").agg(F.max("h").alias("peak"))


def density(rays: DataFrame, low: Triple, high: Triple, width: float, flat_top: bool = False) -> DataFrame:
    """vx, vy, vz, hits, rays, path_len of the rays clipped to a box. A ray hits the voxel that it ends in, if bounded and within the box.

    flat_top: a ray that comes down through a column's highest point counts in that voxel only from there.
    """
    near, far = g.clip_interval(g.vec(*low), g.vec(*high), 1e-10)
    x = rays.withColumns({"_n": near, "_f": far}).where("_n < _f")
    x = walk(x, width, low, a=F.col("_n"), b=F.col("_f"))
    hit = (F.col("alpha") > 0) & (F.col("t_out") == F.col("_f"))
    length = F.col("length")
    if flat_top:
        x = x.join(peaks(rays, low, high, width), ["vx", "vy"], "left")
        z = lambda t: (F.col("sz") + (F.col("ez") - F.col("sz")) * F.col(t) - F.lit(float(low[2]))) / F.lit(width)
        comes = (F.col("ez") < F.col("sz")) & (z("t_in") > F.col("peak")) & (z("t_out") <= F.col("peak"))
        share = F.greatest(F.lit(0.0), F.least(F.lit(0.99), (z("t_in") - F.col("peak")) / (z("t_in") - z("t_out"))))
        length = F.when(comes, length * (F.lit(1.0) - share)).otherwise(length)
    return x.groupBy(*V).agg(F.count_if(hit).cast("double").alias("hits"), F.count("*").cast("double").alias("rays"), F.sum(length).alias("path_len"))


def leaf_density(voxels: DataFrame, least: int = 2) -> DataFrame:
    """With a column density: surface per volume, 2 (n - 1) hits / (n path), 0 for few rays."""
    n = F.col("rays")
    return voxels.withColumn("density", F.when(n <= least, F.lit(0.0)).otherwise(F.lit(2.0) * (n - 1.0) * F.col("hits") / (F.lit(1e-10) + n * F.col("path_len"))))


def flat_top(voxels: DataFrame, tops: DataFrame) -> DataFrame:
    """Hits in each column's highest voxel times (n - 2) / (n - 1), for n hits over 2."""
    x = voxels.join(tops.select("vx", "vy", F.floor("peak").cast("long").alias("_top")), ["vx", "vy"], "left")
    n = F.col("hits")
    fix = (F.col("vz") == F.col("_top")) & (n > 2.0)
    return x.withColumn("hits", F.when(fix, n * (n - 2.0) / (n - 1.0)).otherwise(n)).select(*voxels.columns)


def neighbour_priors(voxels: DataFrame, needed: float = 10.0) -> DataFrame:
    """Voxels with fewer rays than needed take from their 6 faces, then 12 edges, then 8 corners, each ring scaled down to what is lacking."""
    c = ("hits", "rays", "path_len")
    offsets = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
    spread = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(abs(x) + abs(y) + abs(z)).alias("ring")) for x, y, z in offsets]))
    lent = voxels.withColumn("_o", spread).select(*[(F.col(v) + F.col(f"_o.{a}")).alias(v) for v, a in zip(V, "xyz", strict=True)], F.col("_o.ring").alias("ring"), *c)
    rings = lent.groupBy(*V).agg(*[F.coalesce(F.sum(F.when(F.col("ring") == r, F.col(k))), F.lit(0.0)).alias(f"{k}{r}") for r in (1, 2, 3) for k in c])
    x = voxels.join(rings, V, "left").na.fill(0.0)
    lack, out = F.lit(needed) - F.col("rays"), {k: F.col(k) for k in c}
    for r in (1, 2, 3):
        scale = F.when(lack <= 0.0, F.lit(0.0)).when(F.col(f"rays{r}") >= lack, lack / F.nullif(F.col(f"rays{r}"), F.lit(0.0))).otherwise(F.lit(1.0))
        x = x.withColumn(f"_s{r}", F.coalesce(scale, F.lit(0.0)))
        out = {k: out[k] + F.col(f"{k}{r}") * F.col(f"_s{r}") for k in c}
        lack = lack - F.col(f"rays{r}") * F.col(f"_s{r}")
    return x.select(*V, *[e.alias(k) for k, e in out.items()])


def foliage_area(densities: DataFrame, width: float) -> DataFrame:
    return densities.agg((F.sum("density") * F.lit(width**3)).alias("area"))


def height_field(rays: DataFrame, width: float) -> DataFrame:
    """px, py, low, high of bounded ends."""
    return rays.where("alpha > 0").groupBy(g.floor_index("ex", width).alias("px"), g.floor_index("ey", width).alias("py")).agg(F.min("ez").alias("low"), F.max("ez").alias("high"))


def occupancy(rays: DataFrame, pixel: float, low: float, high: float) -> DataFrame:
    """px, py, space: the share of 16 sub-pixels that no ray passes between two heights, less those in which one ends there."""
    sub = pixel / 4.0
    d = F.col("ez") - F.col("sz")
    flat = d == 0.0
    one, two = (F.lit(low) - F.col("sz")) / F.nullif(d, F.lit(0.0)), (F.lit(high) - F.col("sz")) / F.nullif(d, F.lit(0.0))
    within = (F.col("sz") >= low) & (F.col("sz") <= high)
    a = F.when(flat, F.when(within, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.greatest(F.lit(0.0), F.least(one, two)))
    b = F.when(flat, F.when(within, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), F.greatest(one, two)))
    passed = walk(rays, sub, axes="xy", a=a, b=b).select("vx", "vy")
    bit = F.call_function("shiftleft", F.lit(1), (F.pmod("vx", F.lit(4)) + 4 * F.pmod("vy", F.lit(4))).cast("int"))
    pixels = lambda x, n: x.groupBy(F.floor(F.col("vx") / 4).alias("px"), F.floor(F.col("vy") / 4).alias("py")).agg(F.bit_or(bit).alias(n))
    free = pixels(passed, "free")
    ended = pixels(rays.where((F.col("alpha") > 0) & F.col("ez").between(low, high)).select(g.floor_index("ex", sub).alias("vx"), g.floor_index("ey", sub).alias("vy")), "ended")
    left = F.col("free").bitwiseAND(F.bitwise_not(F.coalesce("ended", F.lit(0))))
    return free.join(ended, ["px", "py"], "left").select("px", "py", (F.lit(1.0) - F.bit_count(left) / F.lit(16.0)).alias("space"))


def pixel_rays(rays: DataFrame, pixels: DataFrame, width: float) -> DataFrame:
    """px, py, ray_id: rays that pass over each of some pixels."""
    return walk(rays, width, axes="xy").select(F.col("vx").alias("px"), F.col("vy").alias("py"), "ray_id").join(pixels.select("px", "py"), ["px", "py"], "left_semi").distinct()


def grid_candidates(rays: DataFrame, width: float, least: int = 4) -> DataFrame:
    """vx, vy, vz, offset, n: voxels of four half-shifted grids with `least` bounded ends, whose neighbours above and below, or two on one side, have as many."""
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("offset"), F.lit((k % 2) / 2).alias("dx"), F.lit((k // 2) / 2).alias("dy")) for k in range(4)]))
    x = rays.where("alpha > 0").withColumn("_o", shifts)
    n = x.groupBy(F.col("_o.offset").alias("offset"), F.floor(F.col("ex") / width + F.col("_o.dx")).cast("long").alias("vx"), F.floor(F.col("ey") / width + F.col("_o.dy")).cast("long").alias("vy"), F.floor(F.col("ez") / width).cast("long").alias("vz")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("offset", "vx", "vy").orderBy("vz")
    at = lambda k: F.coalesce(F.max(F.when(F.lit(True), F.col("n"))).over(w.rangeBetween(k, k)), F.lit(0)) >= least
    up1, up2, down1, down2 = at(1), at(2), at(-1), at(-2)
    ok = (up1 & down1) | (up1 & up2) | (down1 & down2)
    return n.withColumn("_ok", ok & (F.col("n") >= least)).where("_ok").drop("_ok")


def smooth_field(field: DataFrame) -> DataFrame:
    """px, py, value: the mean of the set cells of a 3 by 3 neighbourhood, the centre twice."""
    spread = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2.0 if x == y == 0 else 1.0).alias("w")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    lent = field.withColumn("_o", spread).select((F.col("px") + F.col("_o.x")).alias("px"), (F.col("py") + F.col("_o.y")).alias("py"), F.col("_o.w").alias("w"), "value", ((F.col("_o.x") == 0) & (F.col("_o.y") == 0)).alias("own"))
    x = lent.groupBy("px", "py").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), F.max("own").alias("set"))
    return x.where("set").drop("set")


def local_maxima(field: DataFrame) -> DataFrame:
    """Cells above all eight neighbours, and above 0."""
    spread = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]))
    near = field.withColumn("_o", spread).groupBy((F.col("px") + F.col("_o.x")).alias("px"), (F.col("py") + F.col("_o.y")).alias("py")).agg(F.max("value").alias("around"))
    return field.join(near, ["px", "py"], "left").where((F.col("value") > F.coalesce("around", F.lit(0.0))) & (F.col("value") > 0.0)).select(*field.columns)


def radon(cells: DataFrame, size: int = 256, angles: int = 256) -> DataFrame:
    """angle, bin, weight: each cell (x, y in 0 to size, value) drawn as a sine, split between the two bins it lies between."""
    x = cells.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    theta = F.lit(math.pi) * (F.col("angle") + 0.5) / F.lit(float(angles))
    y = F.lit(size / 2.0) + ((F.col("x") - size / 2.0) * F.cos(theta) - (F.col("y") - size / 2.0) * F.sin(theta)) / F.lit(math.sqrt(2.0))
    x = x.withColumn("_y", y).withColumn("_b", F.floor("_y"))
    parts = F.explode(F.array(F.struct(F.col("_b").alias("bin"), (F.col("value") * (F.col("_b") + 1 - F.col("_y"))).alias("w")), F.struct((F.col("_b") + 1).alias("bin"), (F.col("value") * (F.col("_y") - F.col("_b"))).alias("w"))))
    return x.select("angle", parts.alias("p")).groupBy("angle", F.col("p.bin").alias("bin")).agg(F.sum("p.w").alias("weight"))
