"""Nearest neighbours by tiles of equal number, and what follows from them: shapes, normals, ellipsoids, gaps, differences."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamgrid.functions import colour as c
from beamgrid.functions import geometry as g

from .graph import components, kept

E = ("ex", "ey", "ez")


#: Others in a tile, about. Tiles are searched each by itself, so a task's memory follows this, not the cloud's density.
TILE = 16384

#: Pairs of points that a search holds at once.
ONE_ROUND = 1e6


def _finite(*columns: str) -> Column:
    """No point without a place has neighbours."""
    return functools.reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in columns])


def _met(others: DataFrame, points: DataFrame, run: Callable, schema: str | None = None, by: str | None = None) -> DataFrame:
    """run over each tile's others and points. Where a tile has many points, they are dealt out, each part with all its others.

    by: parts are in order of that column (equal values together), else at random.
    """
    cuts = F.percentile_approx(by, [k / 256 for k in range(1, 256)], 10000) if by else F.lit(None)
    parts = points.groupBy("tile").agg(F.count("*").alias("n"), cuts.alias("cuts")).where(F.col("n") > 2 * TILE).collect()
    if parts:
        n = [min(256, math.ceil(x.n / (2 * TILE))) if by else math.ceil(x.n / (2 * TILE)) for x in parts]
        rows = [(x.tile, k, [x.cuts[256 * j // k - 1] for j in range(1, k)] if by and x.cuts else []) for x, k in zip(parts, n, strict=True)]
        many = F.broadcast(points.sparkSession.createDataFrame(rows, "tile int, _parts int, _cuts array<double>"))
        n = F.coalesce("_parts", F.lit(1))
        others = others.join(many, "tile", "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts", "_cuts")
        part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(by))), F.lit(0)) if by else F.pmod(F.xxhash64("ray_id"), n.cast("long")).cast("int")
        points = points.join(many, "tile", "left").withColumn("part", F.when(F.col("_parts").isNull(), 0).otherwise(part)).drop("_parts", "_cuts")
    else:
        others, points = others.withColumn("part", F.lit(0)), points.withColumn("part", F.lit(0))
    if schema is None:
        ray, other = points.schema["ray_id"].dataType.simpleString(), others.schema["other_id"].dataType.simpleString()
        schema = f"ray_id {ray}, ex double, ey double, ez double, within double, near array<struct<other_id: {other}, ox: double, oy: double, oz: double, d2: double, rank: int>>, more array<int>"
    return kept(others.groupBy("tile", "part").cogroup(points.groupBy("tile", "part")).applyInArrow(run, schema))


def nearest(points: DataFrame, others: DataFrame, k: int, distance: float | None = None, self_join: bool = True) -> DataFrame:
    """The k nearest at most distance apart (None: however far), with rank from 1; ties go to the smaller id.

    Others are cut into tiles of nearly equal number (their borders come from some of the points, as in a range partitioning), so
    none is larger where a cloud is dense. Each point is searched in its own tile; then, with the reach that this gives, in every
    other tile that its ball meets. Of others in the same place only the first k (and the point itself) can be among the nearest.
    """
    import numpy as np

    from . import tiles

    o = others.where(_finite(*E)).select(F.col("ray_id").alias("other_id"), *[F.col(e).cast("double").alias(f"o{e[1]}") for e in E])
    place = Window.partitionBy("ox", "oy", "oz").orderBy("other_id")
    o = kept(o.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + self_join).drop("_n"))
    n = o.count()
    share = max(1, TILE // 64)
    some = o.where(F.pmod(F.xxhash64("other_id"), F.lit(share)) == 0) if n > TILE else o.limit(0)
    tree = tiles.splits(some.select("ox", "oy", "oz").toPandas().to_numpy(float).reshape(-1, 3), max(1, TILE // share))
    cut = len(tree[0]) > 0
    o = kept(o.mapInArrow(tiles.tiler(tree, ("ox", "oy", "oz")), T.StructType([*o.schema, T.StructField("tile", T.IntegerType())]))) if cut else o.withColumn("tile", F.lit(1))
    within = F.lit(float("inf") if distance is None else float(distance) * float(distance)).alias("within")
    p = points.where(_finite(*E)).select("ray_id", *[F.col(e).cast("double").alias(e) for e in E], within)
    p = kept(p.mapInArrow(tiles.tiler(tree, E), T.StructType([*p.schema, T.StructField("tile", T.IntegerType())])) if cut else p.withColumn("tile", F.lit(1)))
    boxes, room = None, max(1, int(ONE_ROUND))
    if cut:
        sides = [f(f"o{a}").alias(f"{name}_{a}") for name, f in (("low", F.min), ("high", F.max)) for a in "xyz"]
        b = o.groupBy("tile").agg(*sides).orderBy("tile").toPandas()
        boxes = b["tile"].to_numpy(np.int32), b[[f"low_{a}" for a in "xyz"]].to_numpy(float), b[[f"high_{a}" for a in "xyz"]].to_numpy(float)
    x = _met(o, p, tiles.searcher(k, self_join, room, boxes))
    flat = lambda df: df.select("ray_id", *E, F.inline("near"))
    if not cut:
        return flat(x)
    crossing = x.where(F.size("more") > 0)
    further = _met(o, crossing.select("ray_id", *E, "within", F.explode("more").alias("tile")), tiles.searcher(k, self_join, room, None))
    w = Window.partitionBy("ray_id").orderBy("d2", "other_id")
    both = flat(crossing).unionByName(flat(further)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return flat(x.where(F.size("more") == 0)).unionByName(kept(both))


def nearest_any(points: DataFrame, others: DataFrame, k: int, width: float, self_join: bool = True) -> DataFrame:
    """nearest() however far. width is not needed any more: tiles follow the density."""
    return nearest(points, others, k, None, self_join)


def covariance(points: DataFrame, neighbours: DataFrame, with_self: bool = True) -> DataFrame:
    """ray_id, n, mean_<a> and cov_<ab> of each point's neighbours (and itself). Sums are taken about the point, to keep digits."""
    d = {a: F.col(f"o{a}") - F.col(f"e{a}") for a in "xyz"}
    sums = [F.count("*").alias("_n"), *[F.sum(d[a]).alias(f"_{a}") for a in "xyz"], *[F.sum(d[a] * d[b]).alias(f"_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]]
    x = neighbours.groupBy("ray_id", *E).agg(*sums).withColumn("n", F.col("_n") + (1 if with_self else 0))
    mean = {a: F.col(f"_{a}") / F.col("n") for a in "xyz"}
    cov = {f"cov_{a}{b}": F.col(f"_{a}{b}") / F.col("n") - mean[a] * mean[b] for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return x.select("ray_id", "n", *[(F.col(f"e{a}") + mean[a]).alias(f"mean_{a}") for a in "xyz"], *[v.alias(k) for k, v in cov.items()])


COV = ["cov_xx", "cov_xy", "cov_xz", "cov_yy", "cov_yz", "cov_zz"]


def eigenvalues(cov: DataFrame) -> DataFrame:
    """With l0 <= l1 <= l2, in closed form: no Python, so it stays within generated code."""
    a, b, d, e, f, h = (F.col(x) for x in COV)
    q = (a + e + h) / F.lit(3.0)
    p = F.sqrt(((a - q) ** 2 + (e - q) ** 2 + (h - q) ** 2 + F.lit(2.0) * (b * b + d * d + f * f)) / F.lit(6.0))
    x = cov.withColumns({"_q": q, "_p": p})
    q, p = F.col("_q"), F.col("_p")
    det = ((a - q) * ((e - q) * (h - q) - f * f) - b * (b * (h - q) - f * d) + d * (b * f - (e - q) * d)) / F.nullif(F.lit(2.0) * p * p * p, F.lit(0.0))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det, F.lit(1.0))))) / F.lit(3.0)
    x = x.withColumn("_phi", phi)
    two = F.lit(2.0) * p
    third = F.lit(2.0943951023931953)  # a third of a turn
    x = x.withColumns({"l2": q + two * F.cos("_phi"), "l0": q + two * F.cos(F.col("_phi") + third)})
    return x.withColumn("l1", F.lit(3.0) * q - F.col("l2") - F.col("l0")).drop("_q", "_p", "_phi")


def surfels(rays: DataFrame, k: int, distance: float | None = None) -> DataFrame:
    """ray_id, n, mean, covariance, dims (root of each eigenvalue, 1e-10 at least) and the normal, which faces the sensor.

    Eigenvectors come from numpy, a batch at a time.
    """
    import numpy as np
    import pandas as pd

    own = rays.where("alpha > 0")
    x = covariance(own, nearest(own, own, k, distance)).join(own.select("ray_id", *[(F.col(f"s{a}") - F.col(f"e{a}")).alias(f"to_{a}") for a in "xyz"]), "ray_id")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            m = df[COV].to_numpy()
            value, vector = np.linalg.eigh(m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)) if len(df) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            normal = vector[:, :, 0]
            sign = np.where((normal * df[["to_x", "to_y", "to_z"]].to_numpy()).sum(1) < 0, -1.0, 1.0)
            out = df.drop(columns=["to_x", "to_y", "to_z"])
            for i in range(3):
                out[f"dim{i}"] = np.sqrt(np.maximum(1e-10, value[:, i]))
            for i, a in enumerate("xyz"):
                out[f"n{a}"] = normal[:, i] * sign
            yield out

    schema = x.drop("to_x", "to_y", "to_z").schema
    for f in ("dim0", "dim1", "dim2", "nx", "ny", "nz"):
        schema = schema.add(f, "double")
    return x.mapInPandas(fit, schema)


def ellipsoids(rays: DataFrame, k: int = 16, distance: float = 1.0, scale: float = 1.7, least: int = 4) -> DataFrame:
    """ray_id, time, centre, inverse shape (m_<ab>: a point x is inside if (x - centre)' m (x - centre) <= 1) and extents.

    Of bounded rays with at least `least` bounded ends among the k nearest ends of any kind. The inverse covariance stands for the
    scaled axes, so no eigenvectors are needed; extents bound the ellipsoid exactly.
    """
    near = nearest(rays.where("alpha > 0"), rays, k, distance).join(rays.where("alpha > 0").select(F.col("ray_id").alias("other_id")), "other_id", "left_semi")
    x = covariance(rays, near, with_self=False).where(F.col("n") >= least)
    eps = F.lit(1e-10)
    a, b, d, e, f, h = F.col("cov_xx") + eps, F.col("cov_xy"), F.col("cov_xz"), F.col("cov_yy") + eps, F.col("cov_yz"), F.col("cov_zz") + eps
    x = x.withColumn("_det", a * (e * h - f * f) - b * (b * h - f * d) + d * (b * f - e * d))
    s = F.lit(scale * scale) * F.col("_det")
    inverse = {"m_xx": (e * h - f * f) / s, "m_xy": (d * f - b * h) / s, "m_xz": (b * f - d * e) / s, "m_yy": (a * h - d * d) / s, "m_yz": (b * d - a * f) / s, "m_zz": (a * e - b * b) / s}
    extents = {f"ext_{n}": F.lit(scale) * F.sqrt(v) for n, v in zip("xyz", (a, e, h), strict=True)}
    x = x.where("_det > 0").withColumns(inverse | extents).drop("_det", *COV)
    return x.join(rays.select("ray_id", "time"), "ray_id")


def intersect(shapes: DataFrame, rays: DataFrame, width: float, pass_distance: float = 0.05) -> DataFrame:
    """shape_id, shape_time, ray_id, time (the ray's), outcome (pass or hit) for each ray that meets an ellipsoid.

    Ellipsoids are cut into tiles of nearly equal number, rays go to the tiles whose box they meet, and down a tree of boxes there, so
    that work follows the meetings, not the density in voxels. A ray counts only where its walk through voxels of that width comes to
    a voxel that the ellipsoid's box touches; a ray through the ellipsoid itself does, the others (those that lie beside a ray's
    start, in its line) are walked.
    """
    s, r, run = _tiled(shapes, rays, width, pass_distance)
    schema = T.StructType([s.schema["shape_id"], s.schema["shape_time"], r.schema["ray_id"], r.schema["time"], T.StructField("passes", T.BooleanType()), T.StructField("sure", T.BooleanType())])
    x = run(schema)
    walked = _walked(x.where("not sure"), s, rays, width).select(*x.columns)
    return x.where("sure").unionByName(walked).select("shape_id", "shape_time", "ray_id", "time", F.when(F.col("passes"), "pass").otherwise("hit").alias("outcome"))


def tally(shapes: DataFrame, rays: DataFrame, width: float, pass_distance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """What intersect() finds, without a row for each pair: meets.TALLY with shape_id and shape_time, and the shape_ids of those with pairs besides."""
    from . import meets

    s, r, run = _tiled(shapes, rays, width, pass_distance)
    x = run(T.StructType([s.schema["shape_id"], s.schema["shape_time"], *T._parse_datatype_string(meets.TALLY)]), True)
    odd = x.where("ray_id is not null").select("shape_id", "ray_id", "sure")
    walked = _walked(odd.where("not sure"), s, rays, width)
    besides = kept(odd.where("sure").select("shape_id").unionByName(walked.select("shape_id")).distinct())
    return x.where("ray_id is null"), besides


def _walked(odd: DataFrame, shapes: DataFrame, rays: DataFrame, width: float) -> DataFrame:
    """Those of the pairs (shape_id, ray_id) whose ray comes to a voxel that the ellipsoid's box touches."""
    from .voxel import walk

    steps = walk(rays.join(odd.select("ray_id").distinct(), "ray_id", "left_semi"), width).select("ray_id", "vx", "vy", "vz")
    inside = functools.reduce(lambda p, q: p & q, [F.col(f"v{a}").between(F.col(f"lo_{a}"), F.col(f"hi_{a}")) for a in "xyz"])
    return odd.join(shapes.select("shape_id", *[f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]), "shape_id").join(steps, "ray_id").where(inside).select(*odd.columns).distinct()


def _tiled(shapes: DataFrame, rays: DataFrame, width: float, pass_distance: float) -> tuple[DataFrame, DataFrame, Callable[..., DataFrame]]:
    """The ellipsoids with their voxels, the rays, and the search, which makes rows of a schema: pairs, or a tally."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema

    from . import meets, tiles

    mean = [f"mean_{a}" for a in "xyz"]
    s = shapes.where(_finite(*mean, *[f"ext_{a}" for a in "xyz"], *meets.M)).withColumnRenamed("ray_id", "shape_id").withColumnRenamed("time", "shape_time")
    for a in "xyz":
        lo, hi = F.col(f"mean_{a}") - F.col(f"ext_{a}"), F.col(f"mean_{a}") + F.col(f"ext_{a}")
        s = s.withColumns({f"lo_{a}": F.floor(lo / width), f"hi_{a}": F.floor(hi / width)})
    edges = {f"low_{a}": F.col(f"lo_{a}") * F.lit(float(width)) for a in "xyz"} | {f"high_{a}": (F.col(f"hi_{a}") + 1) * F.lit(float(width)) for a in "xyz"}
    s = kept(s.withColumns(edges).select("shape_id", "shape_time", *mean, *meets.M, *edges, *[f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]))
    n, share, room = s.count(), max(1, TILE // 64), max(1, int(ONE_ROUND))
    some = s.where(F.pmod(F.xxhash64("shape_id"), F.lit(share)) == 0) if n > TILE else s.limit(0)
    tree = tiles.splits(some.select(*mean).toPandas().to_numpy(float).reshape(-1, 3), max(1, TILE // share))
    ends = [f"{e}{a}" for e in "se" for a in "xyz"]
    r = rays.where(_finite(*ends)).select("ray_id", "time", *[F.col(c).cast("double").alias(c) for c in ends])
    of = lambda df, names: np.array(df.agg(*[f(c) for f in (F.min, F.max) for c in names]).first(), float).reshape(2, 3)
    starts, means = of(r, ends[:3]), of(s, mean)
    far = float(np.linalg.norm(np.maximum(starts[1] - means[0], means[1] - starts[0])))  # nan if there are no rays or no shapes
    snug = [c for side in meets.IN for c in side]
    tiled = kept(s.mapInArrow(meets.placer(tree, far), T.StructType([*s.schema, *[T.StructField(c, T.DoubleType()) for c in snug], T.StructField("tile", T.IntegerType())])))
    corners = [*[F.min(c).alias(c) for c in snug[:3]], *[F.max(c).alias(c) for c in snug[3:]]]
    for side, f, least in (("low", F.min, F.least), ("high", F.max, F.greatest)):
        corners += [f(least(f"{side}_{a}", f"in_{side}_{a}")).alias(f"{side}_{a}") for a in "xyz"]
    b = tiled.groupBy("tile").agg(*corners).orderBy("tile").toPandas()
    boxes = b["tile"].to_numpy(np.int32), *[b[list(c)].to_numpy(float) for c in (snug[:3], snug[3:], [f"low_{a}" for a in "xyz"], [f"high_{a}" for a in "xyz"])]
    crossing = kept(r.mapInArrow(meets.crosser(boxes, room), T.StructType([*r.schema, T.StructField("tile", T.IntegerType())])))
    run = lambda schema, tally=False: _met(tiled.select("tile", "shape_id", "shape_time", *mean, *meets.M, *edges, *snug), crossing, meets.finder(pass_distance, to_arrow_schema(schema), tally), schema, "time" if tally else None)
    return s, r, run


def colour_by_shape(rays: DataFrame, k: int, distance: float | None = None) -> DataFrame:
    """Red: sphericity, green: cylindricality, blue: planarity. Unbounded rays, and ends without neighbours, keep their colour."""
    own = rays.where("alpha > 0")
    e = eigenvalues(covariance(own, nearest(own, own, k, distance)))
    d = [F.sqrt(F.greatest(F.lit(1e-10), F.col(x))) for x in ("l0", "l1", "l2")]
    rgb = {"red": d[0] / d[2], "green": F.lit(1.0) - d[1] / d[2], "blue": F.lit(1.0) - d[0] / d[2]}
    return _coloured(rays, e.select("ray_id", *[c.byte(v).alias(f"_{n}") for n, v in rgb.items()]))


def colour_by_normal(rays: DataFrame, k: int, distance: float | None = None) -> DataFrame:
    """The normal as a colour. Unbounded rays, and ends without neighbours, keep theirs."""
    s = surfels(rays, k, distance)
    rgb = {n: c.byte(F.lit(0.5) + F.lit(0.5) * F.col(x)).alias(f"_{n}") for n, x in (("red", "nx"), ("green", "ny"), ("blue", "nz"))}
    return _coloured(rays, s.select("ray_id", *rgb.values()))


def _coloured(rays: DataFrame, colours: DataFrame) -> DataFrame:
    x = rays.join(colours, "ray_id", "left")
    return x.withColumns({n: F.coalesce(f"_{n}", n) for n in ("red", "green", "blue")}).select(*rays.columns)


def smooth(rays: DataFrame, k: int, distance: float | None = None, own_weight: float = 0.2) -> DataFrame:
    """Bounded ends moved along their normals to the weighted mean of their neighbours; others stay."""
    s = surfels(rays, k, distance).select("ray_id", "nx", "ny", "nz")
    own = rays.where("alpha > 0")
    n = nearest(own, own, k, distance).join(s, "ray_id").join(s.toDF("other_id", "mx", "my", "mz"), "other_id")
    w = F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"n{a}") - F.col(f"m{a}")) ** 2 for a in "xyz"))
    off = sum((F.col(f"o{a}") - F.col(f"e{a}")) * F.col(f"n{a}") for a in "xyz")
    m = n.groupBy("ray_id").agg((F.sum(w * off) / (F.sum(w) + F.lit(own_weight))).alias("_s"), *[F.first(f"n{a}").alias(f"_n{a}") for a in "xyz"])
    x = rays.join(m, "ray_id", "left")
    moved = {f"e{a}": F.col(f"e{a}") + F.coalesce(F.col("_s") * F.col(f"_n{a}"), F.lit(0.0)) for a in "xyz"}
    return x.withColumns(moved).select(*rays.columns)


def denoise_by_sigma(rays: DataFrame, sigmas: float, k: int, distance: float) -> DataFrame:
    """Drops bounded rays that lie over `sigmas` deviations from their nearest neighbour's neighbourhood; unbounded ones stay."""
    own = rays.where("alpha > 0")
    near = nearest(own, own, k, distance)
    cov = covariance(own, near).select(F.col("ray_id").alias("other_id"), *[F.col(f"mean_{a}") for a in "xyz"], *COV)
    x = near.where("rank = 1").join(cov, "other_id")
    eps = F.lit(1e-10)
    a, b, d, e, f, h = F.col("cov_xx") + eps, F.col("cov_xy"), F.col("cov_xz"), F.col("cov_yy") + eps, F.col("cov_yz"), F.col("cov_zz") + eps
    det = a * (e * h - f * f) - b * (b * h - f * d) + d * (b * f - e * d)
    t = [F.col(f"e{n}") - F.col(f"mean_{n}") for n in "xyz"]
    form = t[0] * t[0] * (e * h - f * f) + t[1] * t[1] * (a * h - d * d) + t[2] * t[2] * (a * e - b * b)
    form = form + F.lit(2.0) * (t[0] * t[1] * (d * f - b * h) + t[0] * t[2] * (b * f - d * e) + t[1] * t[2] * (b * d - a * f))
    kept = x.where((det > 0) & (form <= F.lit(sigmas * sigmas) * det)).select("ray_id")
    return rays.where("alpha = 0").unionByName(own.join(kept, "ray_id", "left_semi"))


def cloud_distances(a: DataFrame, b: DataFrame, width: float = 1.0) -> DataFrame:
    """ray_id, distance from each bounded end of a to the nearest one of b."""
    x = nearest_any(a.where("alpha > 0"), b.where("alpha > 0"), 1, width, self_join=False)
    return x.select("ray_id", F.sqrt("d2").alias("distance"))


def similarity(distances: DataFrame, within: float) -> DataFrame:
    """One row: the percentage of distances at most `within`, their upper median and their maximum."""
    n = F.count("*")
    middle = F.expr("percentile_disc(0.5) within group (order by distance)")
    return distances.agg((F.lit(100.0) * F.count_if(F.col("distance") <= within) / n).alias("similarity"), middle.alias("median"), F.max("distance").alias("most"))


def paint_differences(rays: DataFrame, distances: DataFrame, limit: float, rgb: tuple[int, int, int], floor: float) -> DataFrame:
    """Rays at some distance from the other cloud, blended to a colour: fully at the limit and beyond, less the nearer it is."""
    x = rays.join(distances.where("distance > 1e-8"), "ray_id")
    w = F.lit(floor) + F.lit(1.0 - floor) * F.least(F.lit(1.0), F.lit(limit) / F.col("distance"))
    blend = {n: (F.col(n) * w + F.lit(float(v)) * (F.lit(1.0) - w)).cast("long").cast("short") for n, v in zip(("red", "green", "blue"), rgb, strict=True)}
    return x.withColumns(blend).select(*rays.columns)


def largest_cluster(rays: DataFrame, gap: float, k: int = 10) -> DataFrame:
    """With side: inside for the largest group of bounded ends that hang together over neighbours nearer than gap."""
    own = rays.where("alpha > 0")
    label = kept(components(nearest(own, own, k, gap).select(F.col("ray_id").alias("a"), F.col("other_id").alias("b"))))
    top = label.groupBy("root").count().orderBy(F.col("count").desc(), "root").limit(1).select("root").scalar()
    inside = label.withColumn("_top", top).where("root = _top").select(F.col("node").alias("ray_id"), F.lit(True).alias("_in"))
    return rays.join(inside, "ray_id", "left").withColumn("side", F.when(F.col("_in"), "inside").otherwise("outside")).drop("_in")
