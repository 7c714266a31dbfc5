"""Ground, meshes and rasters of height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g


def _near(cells: DataFrame, keys: tuple[str, str] = ("px", "py")) -> DataFrame:
    off = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    for k in keys:
        cells = cells.withColumn("_o", F.explode(off)).withColumn(k, F.col(k) + F.col("_o")).drop("_o")
    return cells


def prefilter(rays: DataFrame, width: float) -> DataFrame:
    """Bounded rays that aren't over 45 degrees above the lowest end of any cell around."""
    own = rays.where("alpha > 0").withColumns({"px": g.floor_index("ex", width), "py": g.floor_index("ey", width)})
    low = own.groupBy("px", "py").agg(F.min(F.struct("ez", "ray_id", "ex", "ey")).alias("q"))
    low = _near(low).select("px", "py", F.col("q.ex").alias("qx"), F.col("q.ey").alias("qy"), F.col("q.ez").alias("qz"))
    above = F.col("ez") - F.col("qz") > F.sqrt((F.col("ex") - F.col("qx")) ** 2 + (F.col("ey") - F.col("qy")) ** 2)
    bad = own.join(low, ["px", "py"]).where(above).select("ray_id").distinct()
    return rays.where("alpha > 0").join(bad, "ray_id", "left_anti")


def ground_front(rays: DataFrame, gradient: float, reach: float) -> DataFrame:
    """Bounded rays under which no other end lies within a cone of that gradient: the ground's highest possible surface of that steepness.

    reach bounds how far an end can shadow another: the height range over the gradient. Cells are as wide, so nine hold every pair.
    """
    own = prefilter(rays, reach / 8).withColumns({"px": g.floor_index("ex", reach), "py": g.floor_index("ey", reach)})
    q = _near(own.select("px", "py", F.col("ex").alias("qx"), F.col("ey").alias("qy"), F.col("ez").alias("qz")))
    under = F.col("ez") - F.col("qz") > F.lit(gradient) * F.sqrt((F.col("ex") - F.col("qx")) ** 2 + (F.col("ey") - F.col("qy")) ** 2)
    bad = own.join(q, ["px", "py"]).where(under).select("ray_id").distinct()
    return own.join(bad, "ray_id", "left_anti").select(*rays.columns)


def from_above(rays: DataFrame, gradient: float, reach: float) -> DataFrame:
    """The same, seen from above: heights are negated before and after."""
    flipped = rays.withColumns({"sz": -F.col("sz"), "ez": -F.col("ez")})
    return ground_front(flipped, gradient, reach).withColumns({"sz": -F.col("sz"), "ez": -F.col("ez")})


def _corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    for k in range(3):
        v = vertices.select(F.col("vid").alias(f"v{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
        faces = faces.join(v, f"v{k}")
    return faces


def height_field(vertices: DataFrame, faces: DataFrame, width: float) -> DataFrame:
    """px, py, value: the lowest height at which a vertical line through a pixel's centre meets the mesh."""
    f = _corners(vertices, faces)
    for a, p in (("x", "px"), ("y", "py")):
        lo, hi = F.least(f"{a}0", f"{a}1", f"{a}2"), F.greatest(f"{a}0", f"{a}1", f"{a}2")
        f = f.withColumn(p, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    x, y = (F.col("px") + 0.5) * width, (F.col("py") + 0.5) * width
    c = lambda a: F.col(a)
    d = (c("y1") - c("y2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("y0") - c("y2"))
    f = f.withColumn("_d", d).where("_d <> 0")
    u = ((c("y1") - c("y2")) * (x - c("x2")) + (c("x2") - c("x1")) * (y - c("y2"))) / c("_d")
    v = ((c("y2") - c("y0")) * (x - c("x2")) + (c("x0") - c("x2")) * (y - c("y2"))) / c("_d")
    f = f.withColumns({"_u": u, "_v": v}).where("_u >= 0 and _v >= 0 and _u + _v <= 1")
    z = c("_u") * c("z0") + c("_v") * c("z1") + (F.lit(1.0) - c("_u") - c("_v")) * c("z2")
    return f.groupBy("px", "py").agg(F.min(z).alias("value"))


def over_mesh(rays: DataFrame, vertices: DataFrame, faces: DataFrame, width: float, sign: float = -1.0) -> DataFrame:
    """rays moved down (or, with sign 1, up) by the mesh's height at their end's pixel centre; rays off the mesh stay. An equi-join by pixel."""
    field = height_field(vertices, faces, width)
    x = rays.withColumns({"px": F.floor(F.col("ex") / width), "py": F.floor(F.col("ey") / width)}).join(field, ["px", "py"], "left")
    by = F.lit(sign) * F.coalesce("value", F.lit(0.0))
    return x.withColumns({"sz": F.col("sz") + by, "ez": F.col("ez") + by}).select(*rays.columns)


def fill_gaps(field: DataFrame, rounds: int) -> DataFrame:
    """Empty cells beside set ones take their mean, again and again; each round sees only the one before."""
    from .graph import kept

    for _ in range(rounds):
        lent = _near(field.withColumn("_own", F.lit(True)))
        near = lent.groupBy("px", "py").agg(F.avg("value").alias("value"))
        field = kept(field.unionByName(near.join(field.select("px", "py"), ["px", "py"], "left_anti")))
    return field


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid, new_vid: vertices of any face, numbered from 0 by their first use."""
    use = faces.select(F.posexplode(F.array(*[F.col("fid") * 3 + k for k in range(3)])).alias("k", "place"), F.array("v0", "v1", "v2").alias("v")).select(F.get("v", F.col("k")).alias("vid"), "place")
    first = use.groupBy("vid").agg(F.min("place").alias("place"))
    from .order import numbered

    return numbered(first, "place", "new_vid").join(vertices.select("vid"), "vid", "left_semi").select("vid", "new_vid")


def triangle_hits(rays: DataFrame, triangle: tuple[tuple[float, float, float], ...]) -> DataFrame:
    """ray_id, t: where a ray meets a triangle, as a fraction of its length."""
    p, q, r = triangle
    e1, e2 = [b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, r, strict=True)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    d = g.minus(g.ends(), g.starts())
    l1, l2 = g.vec(*e1), g.vec(*e2)
    h = cross(d, l2)
    x = rays.withColumn("_a", g.dot(l1, h)).where("abs(_a) > 1e-12")
    s = g.minus(g.starts(), g.vec(*p))
    k = cross(s, l1)
    x = x.withColumns({"_u": g.dot(s, h) / F.col("_a"), "_v": g.dot(d, k) / F.col("_a"), "t": g.dot(l2, k) / F.col("_a")})
    return x.where("_u >= 0 and _v >= 0 and _u + _v <= 1 and t >= 0 and t <= 1").select("ray_id", "t")


def in_tetrahedron(point: list[Column], corners: tuple[tuple[float, float, float], ...]) -> Column:
    """Whether a point is on the inner side of all four faces."""
    out = F.lit(True)
    for k in range(4):
        a, b, c, other = (corners[(k + j) % 4] for j in range(4))
        u, v = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
        n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        side = sum(m * (o - x) for m, o, x in zip(n, other, a, strict=True))
        sign = 1.0 if side > 0 else -1.0
        out &= F.lit(sign) * g.dot(g.minus(point, g.vec(*a)), g.vec(*n)) >= 0.0
    return out


def grid_index(low: tuple[float, float, float], width: float, dims: tuple[int, int, int], at: list[Column] | None = None) -> list[Column]:
    """Indices into a dense grid, clamped to it."""
    return [F.greatest(F.lit(0), F.least(F.lit(n - 1), ((p - F.lit(float(o))) / F.lit(width)).cast("long"))) for p, o, n in zip(at or g.ends(), low, dims, strict=True)]


def occupancy_report(rays: DataFrame, width: float) -> DataFrame:
    """One row: filled voxels, ends, and the mean and most in a voxel."""
    n = rays.groupBy(*[c.alias(k) for k, c in g.voxel(width).items()]).count()
    return n.agg(F.count("*").alias("filled"), F.sum("count").alias("ends"), F.avg("count").alias("mean"), F.max("count").alias("most"))
