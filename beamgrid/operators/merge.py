"""Transient objects and merges of clouds: which ellipsoids do rays pass through, and which of the two goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neighbours as nn
from .joins import three_way

MODES = ("min", "max", "oldest", "newest", "order")


def evidence(meets: DataFrame, same_cloud: bool) -> DataFrame:
    """From neighbours.intersect(), for each ellipsoid that a ray meets: hits, passes, opacity, num_before, num_after, first_hit, last_hit.

    Within one cloud, passes before the first hit or after the last one count as gone, and those between lower the opacity.
    Against another cloud, the first passing ray's time, seen from the ellipsoid's, decides for all.
    """
    x = meets
    hit, passes = F.col("outcome") == "hit", F.col("outcome") == "pass"
    a = x.groupBy("shape_id", "shape_time").agg(
        F.count_if(hit).alias("hits"), F.count_if(passes).alias("passes"), F.min(F.when(hit, F.col("time"))).alias("first_hit"), F.max(F.when(hit, F.col("time"))).alias("last_hit"),
        F.min_by("time", F.when(passes, F.col("ray_id"))).alias("first_pass"),
    )
    if not same_cloud:
        return _opacity(a, False)
    before = F.count_if(passes & (F.col("time") < F.coalesce("first_hit", F.lit(float("inf")))) & ~(F.col("time") > F.coalesce("last_hit", F.lit(float("-inf")))))
    after = F.count_if(passes & (F.col("time") > F.coalesce("last_hit", F.lit(float("-inf")))))
    b = x.join(a.drop("shape_time"), "shape_id").groupBy("shape_id").agg(before.alias("num_before"), after.alias("num_after"))
    return _opacity(a.join(b, "shape_id"), True)


def found(shapes: DataFrame, rays: DataFrame, width: float, same_cloud: bool) -> DataFrame:
    """evidence() on the meetings of ellipsoids and rays, from sums for each ellipsoid and part of the rays; only those with odd meetings go by pairs."""
    x, besides = nn.tally(shapes, rays, width)
    w = Window.partitionBy("shape_id")
    k, some = F.col("part"), F.col("hits") > 0
    x = x.join(besides, "shape_id", "left_anti").withColumns({"_a": F.min(F.when(some, k)).over(w), "_b": F.max(F.when(some, k)).over(w)})
    before = F.when(k < F.col("_a"), F.col("passes")).when(k == F.col("_a"), F.col("before")).otherwise(0)
    after = F.when(F.col("_b").isNull() | (k > F.col("_b")), F.col("passes")).when(k == F.col("_b"), F.col("after")).otherwise(0)
    a = x.groupBy("shape_id", "shape_time").agg(
        F.sum("hits").alias("hits"), F.sum("passes").alias("passes"), F.min("first_hit").alias("first_hit"), F.max("last_hit").alias("last_hit"),
        F.min_by("first_pass", "first_ray").alias("first_pass"), F.sum(before).alias("num_before"), F.sum(after).alias("num_after"),
    )
    ev = _opacity(a, same_cloud)
    if not besides.limit(1).count():
        return ev
    return ev.unionByName(evidence(nn.intersect(shapes.join(besides.withColumnRenamed("shape_id", "ray_id"), "ray_id", "left_semi"), rays, width), same_cloud))


def _opacity(a: DataFrame, same_cloud: bool) -> DataFrame:
    """Sums of an ellipsoid's meetings, with opacity; of another cloud, the first passing ray's time decides where passes count."""
    if not same_cloud:
        late = F.col("first_pass") > F.col("shape_time")
        counts = {"num_before": F.when(late, 0).otherwise(F.col("passes")), "num_after": F.when(late, F.col("passes")).otherwise(0)}
        return a.withColumns({"opacity": F.col("hits") / (F.col("hits") + F.col("passes")), **counts}).drop("first_pass")
    h = F.col("hits") + F.lit(1e-8 - 1.0)
    opacity = F.when(F.col("hits") == 0, F.lit(0.0)).otherwise(h / (h + F.col("passes") - F.col("num_before") - F.col("num_after")))
    return a.drop("first_pass").withColumn("opacity", opacity)


def verdicts(ev: DataFrame, mode: str, num_rays: float, shapes_first: bool = True) -> DataFrame:
    """evidence() with verdict: none, shape (the ellipsoid goes) or rays (those that pass through it go)."""
    if mode not in MODES:
        raise ValueError(f"no merge mode {mode}")
    length = F.lit(float(num_rays)) / F.nullif(F.col("opacity"), F.lit(0.0))
    b, a = F.col("num_before"), F.col("num_after")
    enough = (F.greatest(b, a) if mode in ("oldest", "newest") else b + a) >= length
    shape = {"min": F.lit(True), "max": F.lit(False), "order": F.lit(not shapes_first), "oldest": b >= length, "newest": a >= length}[mode]
    return ev.withColumn("verdict", F.when(F.coalesce(enough, F.lit(False)), F.when(shape, "shape").otherwise("rays")).otherwise("none"))


def _rays_gone(shapes: DataFrame, rays: DataFrame, judged: DataFrame, width: float, same_cloud: bool) -> DataFrame:
    """removed_rays(); only ellipsoids whose rays may go are held against the rays again."""
    own = judged.where("verdict = 'rays'").select(F.col("shape_id").alias("ray_id"))
    if not own.limit(1).count():
        return own
    return removed_rays(nn.intersect(shapes.join(own, "ray_id", "left_semi"), rays, width), judged, same_cloud)


def removed_rays(meets: DataFrame, judged: DataFrame, same_cloud: bool) -> DataFrame:
    """ray_id of the rays that go: of those through an ellipsoid, in order of ray_id, one each time that opacities add up to 1."""
    x = meets.where("outcome = 'pass'").join(judged.where("verdict = 'rays'").select("shape_id", "opacity", "first_hit", "last_hit"), "shape_id")
    w = Window.partitionBy("shape_id").orderBy("ray_id")
    n = F.row_number().over(w)
    x = x.withColumn("_n", n).where(F.floor(F.col("_n") * F.col("opacity") + 1e-9) > F.floor((F.col("_n") - 1) * F.col("opacity") + 1e-9))
    if same_cloud:
        x = x.where((F.col("time") < F.col("first_hit")) | (F.col("time") > F.col("last_hit")) | F.col("first_hit").isNull())
    return x.select("ray_id").distinct()


def transients(rays: DataFrame, mode: str, num_rays: float, k: int, distance: float, width: float) -> DataFrame:
    """rays with part: transient or fixed, and the evidence on each ray's ellipsoid (opacity, gone) for colouring."""
    shapes = nn.kept(nn.ellipsoids(rays, k, distance))
    judged = nn.kept(verdicts(found(shapes, rays, width, True), mode, num_rays))
    goes = judged.where("verdict = 'shape'").select(F.col("shape_id").alias("ray_id")).unionByName(_rays_gone(shapes, rays, judged, width, True)).distinct()
    x = rays.join(goes.withColumn("_t", F.lit(True)), "ray_id", "left")
    x = x.join(judged.select(F.col("shape_id").alias("ray_id"), "opacity", (F.col("num_before") + F.col("num_after")).alias("gone")), "ray_id", "left")
    return x.withColumn("part", F.when(F.col("_t"), "transient").otherwise("fixed")).drop("_t")


def coloured(marked: DataFrame) -> DataFrame:
    """transients() with red 0, blue the opacity and green the passes beside 10."""
    return marked.withColumns({"red": F.lit(0).cast("short"), "blue": (F.lit(255.0) * F.coalesce("opacity", F.lit(1.0))).cast("long").cast("short"), "green": (F.lit(255.0) * F.coalesce(F.col("gone") / (F.col("gone") + F.lit(10.0)), F.lit(0.0))).cast("long").cast("short")})


def merge(a: DataFrame, b: DataFrame, mode: str, num_rays: float, k: int, distance: float, width: float) -> DataFrame:
    """Rays of both clouds with cloud (a or b) and part (fixed or transient): each one's ellipsoids are held against the other's rays."""
    gone = None
    for own, name, other, other_name, first in ((a, "a", b, "b", True), (b, "b", a, "a", False)):
        shapes = nn.kept(nn.ellipsoids(own, k, distance))
        judged = nn.kept(verdicts(found(shapes, other, width, False), mode, num_rays, first))
        x = judged.where("verdict = 'shape'").select(F.col("shape_id").alias("ray_id"), F.lit(name).alias("cloud"))
        x = x.unionByName(_rays_gone(shapes, other, judged, width, False).withColumn("cloud", F.lit(other_name)))
        gone = x if gone is None else gone.unionByName(x)
    both = a.withColumn("cloud", F.lit("a")).unionByName(b.withColumn("cloud", F.lit("b")))
    return both.join(gone.distinct().withColumn("_t", F.lit(True)), ["ray_id", "cloud"], "left").withColumn("part", F.when(F.col("_t"), "transient").otherwise("fixed")).drop("_t")


def merge_three_way(base: DataFrame, a: DataFrame, b: DataFrame, mode: str, num_rays: float, k: int, distance: float, width: float) -> DataFrame:
    """ray_id, cloud, part: what both left alone is fixed; of what they changed, mode "all" keeps everything, others merge it."""
    kinds = three_way(base, a, b)
    fixed = kinds.where("part = 'fixed'")
    if mode == "all":
        return fixed.unionByName(kinds.where("part = 'changed'"))
    changed = {n: x.join(kinds.where((F.col("cloud") == n) & (F.col("part") == "changed")).select("ray_id"), "ray_id", "left_semi") for n, x in (("a", a), ("b", b))}
    return fixed.unionByName(merge(changed["a"], changed["b"], mode, num_rays, k, distance, width).select("ray_id", "cloud", "part"))


def voxel_width(spacing: DataFrame) -> DataFrame:
    """One row: four times the point spacing, or a quarter metre if there is none."""
    return spacing.select(F.coalesce(F.when(F.col("spacing") > 0, F.lit(4.0) * F.col("spacing")), F.lit(0.25)).alias("width"))
