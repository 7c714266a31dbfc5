"""Branch colours, lit shading, mesh splits, distance shoulders, clusters and rigid fits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

from .graph import components, kept
from .neighbours import E, nearest, surfels
from .terrain import _corners


def colour_branches(rays: DataFrame, distance: float | None = None) -> DataFrame:
    """Red: the median alpha of a point and its four nearest, less with range; green: how unlike a line its surroundings are."""
    own = rays.where("alpha > 0")
    near = nearest(own, own, 4, distance).join(own.select(F.col("ray_id").alias("other_id"), F.col("alpha").alias("_a")), "other_id")
    m = near.groupBy("ray_id").agg(F.collect_list("_a").alias("_as"))
    x = own.join(m, "ray_id", "left").withColumn("_as", F.array_sort(F.concat(F.array(F.col("alpha")), F.coalesce("_as", F.array().cast("array<smallint>")))))
    n = F.size("_as")
    median = (F.get("_as", F.floor((n - 1) / 2).cast("int")) + F.get("_as", F.floor(n / 2).cast("int"))) / F.lit(2.0)
    red = F.lit(127.0) + F.lit(2.0) * median / (F.lit(1.0) + g.ray_length() / F.lit(100.0)) - F.lit(200.0)
    x = x.withColumn("_red", F.greatest(F.lit(0.0), F.least(F.lit(255.0), red)).cast("long").cast("short"))
    return x.drop("red", "_as").withColumnRenamed("_red", "red").select(*rays.columns)


def lit(rays: DataFrame, k: int, distance: float | None = None) -> DataFrame:
    """ray_id, light (0 to 1, from direction (0.2, 0.4, 1)) and curvature: how height over the tangent plane grows with squared distance in it."""
    s = surfels(rays, k, distance).select("ray_id", "nx", "ny", "nz")
    own = rays.where("alpha > 0")
    x = nearest(own, own, k, distance).join(s, "ray_id")
    d = [F.col(f"o{a}") - F.col(f"e{a}") for a in "xyz"]
    up = g.dot(d, [F.col("nx"), F.col("ny"), F.col("nz")])
    x = x.withColumns({"_up": up, "_flat": g.dot(d, d) - up * up}).groupBy("ray_id", "nx", "ny", "nz").agg(F.regr_slope("_up", "_flat").alias("curvature"))
    n = math.sqrt(0.2**2 + 0.4**2 + 1.0)
    light = F.greatest(F.lit(0.0), (F.col("nx") * F.lit(0.2 / n) + F.col("ny") * F.lit(0.4 / n) + F.col("nz") * F.lit(1.0 / n)))
    return x.select("ray_id", light.alias("light"), F.coalesce("curvature", F.lit(0.0)).alias("curvature"))


def split_by_mesh(rays: DataFrame, vertices: DataFrame, faces: DataFrame, offset: float, width: float = 1.0) -> DataFrame:
    """With side: inside where an odd number of faces lie straight below the end (shifted up by offset), by pixels of the mesh."""
    f = _corners(vertices, faces)
    for a, p in (("x", "px"), ("y", "py")):
        f = f.withColumn(p, F.explode(F.sequence(F.floor(F.least(f"{a}0", f"{a}1", f"{a}2") / width), F.floor(F.greatest(f"{a}0", f"{a}1", f"{a}2") / width))))
    x = rays.select("ray_id", "ex", "ey", "ez", F.floor(F.col("ex") / width).alias("px"), F.floor(F.col("ey") / width).alias("py")).join(f, ["px", "py"])
    c = F.col
    d = (c("y1") - c("y2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("y0") - c("y2"))
    x = x.withColumn("_d", d).where("_d <> 0")
    u = ((c("y1") - c("y2")) * (c("ex") - c("x2")) + (c("x2") - c("x1")) * (c("ey") - c("y2"))) / c("_d")
    v = ((c("y2") - c("y0")) * (c("ex") - c("x2")) + (c("x0") - c("x2")) * (c("ey") - c("y2"))) / c("_d")
    x = x.withColumns({"_u": u, "_v": v}).where("_u >= 0 and _v >= 0 and _u + _v < 1")
    z = c("_u") * c("z0") + c("_v") * c("z1") + (F.lit(1.0) - c("_u") - c("_v")) * c("z2") + F.lit(float(offset))
    odd = x.where(c("ez") > z).groupBy("ray_id").agg((F.count("*") % 2).alias("_odd")).where("_odd = 1")
    return rays.join(odd, "ray_id", "left").withColumn("side", F.when(c("_odd") == 1, "inside").otherwise("outside")).drop("_odd")


def shoulder(distances: DataFrame, powers: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0), bins: int = 4096) -> DataFrame:
    """power, distance, similarity, error: for each power the best split of sorted distances into two even stretches.

    Distances are first put into `bins` equal ranges of their power, so the running sums go over bins, not over points.
    """
    x = distances.withColumn("power", F.explode(F.array(*[F.lit(p) for p in powers])))
    x = x.withColumn("d", F.pow("distance", F.col("power")))
    top = x.groupBy("power").agg(F.max("d").alias("most"), F.count("*").alias("n"))
    x = x.join(F.broadcast(top), "power").where("most > 0")  # a row for each power
    h = x.groupBy("power", "most", "n", F.least(F.floor(F.col("d") / F.col("most") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("power").orderBy("bin")
    h = h.withColumns({"i": F.sum("c").over(w).cast("double"), "e": (F.col("bin") + 1) * F.col("most") / bins})
    inside, outside = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    c, i, e = F.col("c"), F.col("i"), F.col("e")
    sums = {"ii": F.sum(c * i * i).over(inside), "ie": F.sum(c * i * e).over(inside), "ee": F.sum(c * e * e).over(inside)}
    j, r = i - F.col("n"), F.col("most") - e
    sums |= {"oo": F.coalesce(F.sum(c * j * j).over(outside), F.lit(0.0)), "oe": F.coalesce(F.sum(c * j * r).over(outside), F.lit(0.0)), "rr": F.coalesce(F.sum(c * r * r).over(outside), F.lit(0.0))}
    h = h.withColumns(sums)
    n, rest = F.col("n"), F.nullif(F.col("most") - e, F.lit(0.0))
    q, k = F.coalesce(F.col("rr") / (rest * rest), F.lit(0.0)), F.coalesce(F.lit(2.0) * F.col("oe") / rest, F.lit(0.0))
    a = F.col("ee") / (e * e) + q
    b = -F.lit(2.0) * F.col("ie") / e - k - F.lit(2.0) * n * q
    z = F.col("ii") + F.col("oo") + k * n + q * n * n
    h = h.withColumn("error", F.sqrt(F.greatest(F.lit(0.0), z - b * b / (F.lit(4.0) * a))))
    best = h.groupBy("power").agg(F.min_by(F.struct("e", "i", "n", "error"), F.struct("error", "bin")).alias("b"))
    return best.select("power", F.pow(F.col("b.e"), F.lit(1.0) / F.col("power")).alias("distance"), (F.lit(100.0) * F.col("b.i") / F.col("b.n")).alias("similarity"), F.col("b.error").alias("error"))


def clusters(points: DataFrame, near: float, widest: float, k: int = 8) -> DataFrame:
    """group, ray_id, cluster: nearest pairs first, clusters join while their box stays narrower than widest. cluster is its smallest ray_id.

    Pairs are each point's k nearest within near. No cluster leaves a component of these (group); the order of joins makes
    a component sequential, so one task holds its pairs.
    """
    import numpy as np
    import pandas as pd

    pairs = kept(nearest(points, points, k, near).select("ray_id", "other_id", "d2", *E, "ox", "oy", "oz"))
    label = kept(components(pairs.select(F.col("ray_id").alias("a"), F.col("other_id").alias("b"))).select(F.col("node").alias("ray_id"), F.col("root").alias("group")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        a, b = df.ray_id.to_numpy(), df.other_id.to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        p = np.empty((len(ids), 3))
        p[at] = np.concatenate([df[["ex", "ey", "ez"]].to_numpy(), df[["ox", "oy", "oz"]].to_numpy()])
        x, y = at[: len(a)], at[len(a) :]
        i, j, d = np.minimum(x, y), np.maximum(x, y), df.d2.to_numpy()
        root = list(range(len(ids)))
        low, high = p.copy(), p.copy()

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for m in np.lexsort((j, i, d)).tolist():
            a, b = sorted((find(int(i[m])), find(int(j[m]))))
            if a != b and (np.maximum(high[a], high[b]) - np.minimum(low[a], low[b])).max() < widest:
                root[b] = a
                low[a], high[a] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        return pd.DataFrame({"group": df.group.iloc[0], "ray_id": ids, "cluster": ids[[find(m) for m in range(len(ids))]]})

    joined = pairs.join(label, "ray_id").groupBy("group").applyInPandas(run, "group long, ray_id long, cluster long")
    alone = points.select("ray_id").join(label, "ray_id", "left_anti")
    return joined.unionByName(alone.select(F.col("ray_id").alias("group"), "ray_id", F.col("ray_id").alias("cluster")))


def rigid_motion(pairs: DataFrame) -> tuple[list[list[float]], list[float]]:
    """Rotation and shift that take (ax, ay, az) to (bx, by, bz) with the least squares; one row of sums goes to the driver."""
    import numpy as np

    cols = [F.count("*").alias("n"), *[F.avg(f"{q}{a}").alias(f"{q}{a}") for q in "ab" for a in "xyz"], *[F.avg(F.col(f"a{a}") * F.col(f"b{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"]]
    r = pairs.agg(*cols).first()
    if r["n"] < 3:
        raise ValueError("three pairs are needed")
    a, b = (np.array([r[f"{q}{x}"] for x in "xyz"]) for q in "ab")
    m = np.array([[r[f"{x}{y}"] for y in "xyz"] for x in "xyz"]) - np.outer(a, b)
    u, _, vt = np.linalg.svd(m)
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    rot = vt.T @ d @ u.T
    return rot.tolist(), (b - rot @ a).tolist()
