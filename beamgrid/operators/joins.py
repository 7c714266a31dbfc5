"""Joins of clouds: by time, by voxel, by quantised ray, and as-of a trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

from .order import numbered

TIME_EPS = 1e-7


def match_by_time(left: DataFrame, right: DataFrame, eps: float = TIME_EPS) -> DataFrame:
    """left_id, right_id of rays whose times differ by eps or less, one to one: each takes its nearest that takes it back.

    A band join: times are put in bins of twice eps and looked for in the bins beside.
    """
    w = 2.0 * eps
    a = left.select(F.col("ray_id").alias("left_id"), F.col("time").alias("lt"), F.explode(F.array(*[F.floor(F.col("time") / w) + k for k in (-1, 0, 1)])).alias("bin"))
    b = right.select(F.col("ray_id").alias("right_id"), F.col("time").alias("rt"), F.floor(F.col("time") / w).alias("bin"))
    gap = F.abs(F.col("lt") - F.col("rt"))
    pairs = a.join(b, "bin").withColumn("gap", gap).where(F.col("gap") <= eps)
    first = F.row_number().over(Window.partitionBy("left_id").orderBy("gap", "right_id"))
    back = F.row_number().over(Window.partitionBy("right_id").orderBy("gap", "left_id"))
    return pairs.withColumns({"_a": first, "_b": back}).where("_a = 1 and _b = 1").select("left_id", "right_id")


def time_differences(edited: DataFrame, full: DataFrame, eps: float = TIME_EPS) -> DataFrame:
    """ray_id and change (matched, added to edited, removed from full)."""
    pairs = match_by_time(full, edited, eps)
    matched = pairs.select(F.col("left_id").alias("ray_id"), F.lit("matched").alias("change"))
    removed = full.join(pairs, F.col("ray_id") == F.col("left_id"), "left_anti").select("ray_id", F.lit("removed").alias("change"))
    added = edited.join(pairs, F.col("ray_id") == F.col("right_id"), "left_anti").select("ray_id", F.lit("added").alias("change"))
    return matched.unionByName(removed).unionByName(added)


def restore_voxels(full: DataFrame, decimated: DataFrame, edited: DataFrame, width: float) -> DataFrame:
    """Rays of full in the voxels of decimated (full, decimated to one ray a voxel) of which edited still has the ray."""
    gone = time_differences(edited, decimated).where("change = 'removed'").select("ray_id")
    kept = decimated.join(gone, "ray_id", "left_anti").select(*[c.alias(n) for n, c in g.voxel(width).items()]).distinct()
    x = full.withColumns(g.voxel(width))
    return x.join(kept, ["vx", "vy", "vz"], "left_semi").select(*full.columns)


def restore_nth(full: DataFrame, step: int, edited: DataFrame) -> DataFrame:
    """Rays of full whose nearest step-th ray edited still has."""
    x = numbered(full)
    decimated = x.where(F.col("index") % step == 0)
    pairs = match_by_time(decimated, edited).select(F.col("left_id").alias("ray_id"))
    places = decimated.join(pairs, "ray_id", "left_semi").select((F.col("index") / step).cast("long").alias("place"))
    return x.withColumn("place", F.floor((F.col("index") + step // 2) / step).cast("long")).join(places, "place", "left_semi").select(*full.columns)


def _lookup(points: DataFrame, trajectory: DataFrame, slot: float) -> DataFrame:
    """Each point with the trajectory nodes before (a) and after (b) its time; those beyond an end get the first or the last two.

    Nodes become intervals to the next node, put into every time slot they touch, so points find theirs by an equi-join.
    """
    # A trajectory's nodes are far fewer than rays, but may be many: they are ordered within slots, which meet by their edges.
    t = trajectory.select("time", F.struct("x", "y", "z").alias("p")).withColumn("_k", F.floor(F.col("time") / slot))
    w = Window.partitionBy("_k").orderBy("time")
    t = t.withColumn("_next", F.lead(F.struct("time", "p")).over(w))
    firsts = t.groupBy("_k").agg(F.min(F.struct("time", "p")).alias("_first")).withColumn("_after", F.lead("_first").over(Window.orderBy("_k")))
    t = t.join(firsts.select("_k", "_after"), "_k").withColumn("_next", F.coalesce("_next", "_after")).where("_next is not null")
    spans = t.select(F.col("time").alias("ta"), F.col("p").alias("pa"), F.col("_next.time").alias("tb"), F.col("_next.p").alias("pb"))
    ends = spans.agg(F.min(F.struct("ta", "tb", "pa", "pb")).alias("lo"), F.max(F.struct("ta", "tb", "pa", "pb")).alias("hi")).select(F.struct("lo", "hi")).scalar()
    slots = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("ta") / slot), F.floor(F.col("tb") / slot))))
    x = points.withColumn("_slot", F.floor(F.col("time") / slot)).withColumn("_e", ends)
    inside = (F.col("time") > F.col("_e.lo.tb")) & (F.col("time") <= F.col("_e.hi.ta"))
    edge = F.when(F.col("time") <= F.col("_e.lo.tb"), F.col("_e.lo")).otherwise(F.col("_e.hi"))
    out = x.where(~inside).withColumns({c: edge[c] for c in ("ta", "tb", "pa", "pb")})
    mid = x.where(inside).join(slots, "_slot").where("time > ta and time <= tb")
    return mid.drop("_slot", "_e").unionByName(out.drop("_slot", "_e"))


def starts_from_trajectory(points: DataFrame, trajectory: DataFrame, extrapolate: bool = True, slot: float = 600.0) -> DataFrame:
    """Rays whose starts are the trajectory's places at their times, linear between nodes, and beyond its ends unless clamped."""
    x = _lookup(points.drop("sx", "sy", "sz"), trajectory, slot)
    u = (F.col("time") - F.col("ta")) / (F.col("tb") - F.col("ta"))
    if not extrapolate:
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
    x = x.withColumn("_u", u)
    return x.withColumns({f"s{a}": F.col(f"pa.{a}") * (F.lit(1.0) - F.col("_u")) + F.col(f"pb.{a}") * F.col("_u") for a in "xyz"}).drop("_u", "ta", "tb", "pa", "pb")


def nearest_node(points: DataFrame, trajectory: DataFrame, slot: float = 600.0) -> DataFrame:
    """Points with x, y, z of the trajectory node nearest in time."""
    x = _lookup(points, trajectory, slot)
    first = (F.col("time") - F.col("ta")) / (F.col("tb") - F.col("ta")) < 0.5
    return x.withColumns({a: F.when(first, F.col(f"pa.{a}")).otherwise(F.col(f"pb.{a}")) for a in "xyz"}).drop("ta", "tb", "pa", "pb")


def quantised(width: float = 0.01) -> list[Column]:
    """Six whole numbers that name a ray to within width."""
    return [F.floor(F.col(f"{p}{a}") / F.lit(width)).cast("long").alias(f"q{p}{a}") for p in "se" for a in "xyz"]


def three_way(base: DataFrame, a: DataFrame, b: DataFrame, width: float = 0.01) -> DataFrame:
    """ray_id, cloud (a or b) and part: fixed (unchanged in both; the copy of the cloud that began later) or changed (not in base)."""
    names = [f"q{p}{c}" for p in "se" for c in "xyz"]
    qa, qb, q0 = (x.select("*", *quantised(width)) for x in (a, b, base))
    later = a.agg(F.min_by("time", "ray_id").alias("t")).join(b.agg(F.min_by("time", "ray_id").alias("u"))).select(F.when(F.col("t") > F.col("u"), "a").otherwise("b")).scalar()
    out = None
    for name, own, other in (("a", qa, qb), ("b", qb, qa)):
        fixed = own.join(other.select(*names).distinct(), names, "left_semi").where(later == name).select("ray_id", F.lit(name).alias("cloud"), F.lit("fixed").alias("part"))
        changed = own.join(q0.select(*names).distinct(), names, "left_anti").select("ray_id", F.lit(name).alias("cloud"), F.lit("changed").alias("part"))
        both = fixed.unionByName(changed)
        out = both if out is None else out.unionByName(both)
    return out


def split_by_trees(rays: DataFrame, segments: DataFrame, distance: float, cell: float = 1.0) -> DataFrame:
    """With side: inside where the end lies in any segment's cylinder (from its parent to its tip) widened by distance."""
    p = segments.select("tree_id", F.col("seg_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    s = segments.join(p, ["tree_id", "parent_id"]).withColumn("r", F.col("radius") + distance)
    for c in "xyz":
        lo, hi = F.least(c, f"p{c}") - F.col("r"), F.greatest(c, f"p{c}") + F.col("r")
        s = s.withColumn(f"v{c}", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    x = rays.select("ray_id", "ex", "ey", "ez", *[F.floor(F.col(f"e{c}") / cell).alias(f"v{c}") for c in "xyz"])
    axis, to = [F.col(c) - F.col(f"p{c}") for c in "xyz"], [F.col(f"e{c}") - F.col(f"p{c}") for c in "xyz"]
    n2 = g.dot(axis, axis)
    along = g.dot(to, axis) / F.nullif(n2, F.lit(0.0))
    off = [t - a * along for t, a in zip(to, axis, strict=True)]
    near = (along >= 0.0) & (along <= 1.0) & (g.dot(off, off) < F.col("r") * F.col("r"))
    hit = x.join(s, ["vx", "vy", "vz"]).where(near).select("ray_id").distinct().withColumn("_hit", F.lit(True))
    return rays.join(hit, "ray_id", "left").withColumn("side", F.when(F.col("_hit"), "inside").otherwise("outside")).drop("_hit")
