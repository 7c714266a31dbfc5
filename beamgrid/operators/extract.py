"""Trunks by repeated fits, paths to the ground, fine alignment, trunk overlaps, and tree generation."""

from __future__ import annotations

import functools
import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid.functions import geometry as g

from . import neighbours, paths, tiles
from .graph import kept
from .neighbours import nearest, surfels
from .trees import trunk_fit, trunk_lean, trunk_points
from .voxel import grid_candidates


def trunks(rays: DataFrame, width: float, rounds: int = 5, score: float = 40.0) -> DataFrame:
    """trunk_id, x, y, z, dx, dy, dz, radius, length, score of upright cylinders: voxel candidates, fitted again and again to the ends in them.

    Each round is one join and two aggregates by trunk; its table is written before the next. Trunks that lean over, run out of
    ends, or score (length over error) too little at the end go.
    """
    c = grid_candidates(rays, width)
    t = c.select(
        F.xxhash64("offset", "vx", "vy", "vz").alias("trunk_id"), ((F.col("vx") + 0.5 - (F.col("offset") % 2) / 2) * width).alias("x"), ((F.col("vy") + 0.5 - F.floor(F.col("offset") / 2) / 2) * width).alias("y"),
        ((F.col("vz") + 0.5) * width).alias("z"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"), F.lit(width).alias("radius"), F.lit(3.0 * width).alias("length"),
    )
    for k in range(rounds):
        t = kept(t)
        p = kept(trunk_points(rays, t, cell=max(1.0, 2 * width)))
        mid = p.groupBy("trunk_id").agg(*[F.avg(f"e{a}").alias(f"m{a}") for a in "xyz"], (F.max("along") - F.min("along")).alias("span"))
        x = t.join(trunk_fit(p).select("trunk_id", F.col("radius").alias("fit"), "error"), "trunk_id").join(trunk_lean(p), "trunk_id").join(mid, "trunk_id")
        n = F.sqrt(F.coalesce("slope_x", F.lit(0.0)) ** 2 + F.coalesce("slope_y", F.lit(0.0)) ** 2 + 1.0)
        x = x.withColumns({"dx": F.coalesce("slope_x", F.lit(0.0)) / n, "dy": F.coalesce("slope_y", F.lit(0.0)) / n, "dz": F.lit(1.0) / n})
        x = x.where(F.col("dz") > (0.85 if k < rounds - 1 else 0.9))
        x = x.withColumns({"x": F.col("mx"), "y": F.col("my"), "z": F.col("mz"), "radius": F.least(F.lit(2.0 * width), F.lit(1.5) * F.col("fit")), "length": F.greatest(F.lit(3.0 * width), F.lit(1.5) * F.col("span")), "score": F.col("span") / F.greatest(F.lit(1e-9), F.col("error"))})
        t = x.select("trunk_id", "x", "y", "z", "dx", "dy", "dz", "radius", "length", *(["score"] if k == rounds - 1 else []))
    return t.where(F.col("score") >= score)


def without_overlaps(found: DataFrame) -> DataFrame:
    """Trunks that no larger one stands in: pairs meet by cells of the plan; of two whose axes come nearer than the larger radius, the smaller goes."""
    top = 4.0
    a = found.select("trunk_id", "x", "y", "radius", F.floor(F.col("x") / top).alias("cx"), F.floor(F.col("y") / top).alias("cy"))
    b = a.toDF("other", "ox", "oy", "oradius", "cx", "cy")
    for c in ("cx", "cy"):
        b = b.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
    larger = (F.col("oradius") > F.col("radius")) | ((F.col("oradius") == F.col("radius")) & (F.col("other") < F.col("trunk_id")))
    inside = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 < F.col("oradius") ** 2
    gone = a.join(b, ["cx", "cy"]).where((F.col("other") != F.col("trunk_id")) & larger & inside).select("trunk_id").distinct()
    return found.join(gone, "trunk_id", "left_anti")


def paths_to_ground(rays: DataFrame, near: float, ground: float, k: int = 20) -> DataFrame:
    """ray_id, parent, root, distance: the cheapest way down from each bounded end, over near neighbours, by squared step length.

    Ends are cut into tiles of nearly equal number. Each tile is searched by itself; then tiles beside ends whose way has become
    another are searched again from those, until none has, so ways may cross any number of tiles. Of ways as long the one with fewer
    links counts, then the one to the smaller root, then over the smaller parent. Ends below `ground` are the roots; ends without a
    way have a null root.
    """
    own = rays.where("alpha > 0").select("ray_id", "ex", "ey", "ez").withColumn("low", F.coalesce(F.col("ez") < ground, F.lit(False)) & ~F.isnan("ez"))
    own = kept(own)
    links = _links(own, near, ground, k)
    tables: list[DataFrame] = []
    last: dict[int, int] = {}  # the round that searched a tile last

    def latest() -> DataFrame:
        parts = [t.where(F.col("tile").isin([x for x, r in last.items() if r == n])) for n, t in enumerate(tables) if n in last.values()]
        return functools.reduce(DataFrame.unionByName, parts) if parts else links.sparkSession.createDataFrame([], paths.LABELS)

    active = sorted(x.tile for x in links.select("tile").distinct().collect())
    while active:
        before = latest().where(F.size("to") > 0)
        known = before.where("root is not null").withColumn("tile", F.explode("to")).where(F.col("tile").isin(active)).select("tile", "node", "root", "distance", "links")
        now = links.where(F.col("tile").isin(active)).groupBy("tile").cogroup(known.groupBy("tile")).applyInArrow(paths.walker, paths.LABELS)
        tables.append(kept(now))
        old = before.where(F.col("tile").isin(active)).select("node", F.struct("root", "distance", "links").alias("old"))
        last.update(dict.fromkeys(active, len(tables) - 1))
        label = F.struct("root", "distance", "links")
        none = F.col("old").isNull() & F.col("root").isNull()
        changed = tables[-1].where(F.size("to") > 0).join(old, "node", "left").where(~none & ~label.eqNullSafe(F.col("old")))
        active = sorted(x.tile for x in changed.select(F.explode("to").alias("tile")).distinct().collect())
    x = own.where("not low").join(latest().select(F.col("node").alias("ray_id"), "parent", "root", "distance"), "ray_id", "left")
    i = F.col("ray_id")
    roots = own.where("low").select(i, i.alias("parent"), i.alias("root"), F.lit(0.0).alias("distance"))
    return roots.unionByName(x.select("ray_id", "parent", "root", "distance"))


def _links(own: DataFrame, near: float, ground: float, k: int) -> DataFrame:
    """paths.LINKS between each end and its neighbours, dealt out to tiles of the ends that are no roots."""
    free = own.where(~F.col("low") & neighbours._finite(*neighbours.E))
    share = max(1, neighbours.TILE // 64)
    some = free.where(F.pmod(F.xxhash64("ray_id"), F.lit(share)) == 0) if free.count() > neighbours.TILE else free.limit(0)
    tree = tiles.splits(some.select(*neighbours.E).toPandas().to_numpy(float).reshape(-1, 3) * paths.FLAT, max(1, neighbours.TILE // share))
    pairs = nearest(own, own, k, near).where(f"ez >= {float(ground)!r} or oz >= {float(ground)!r}")
    return kept(pairs.select("ray_id", "ex", "ey", "ez", "other_id", "ox", "oy", "oz", "d2").mapInArrow(paths.dealer(tree, ground), paths.LINKS))


def fine_align(a: DataFrame, b: DataFrame, k: int, distance: float, rounds: int = 8) -> tuple[list[list[float]], list[float]]:
    """Rotation and shift that lay a onto b, from planes: each round matches surfels, sums up 27 products, and solves on the driver."""
    matrix, shift = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0]
    sa = kept(surfels(a, k, distance).select("ray_id", "mean_x", "mean_y", "mean_z", "nx", "ny", "nz"))
    sb = kept(surfels(b, k, distance).select(F.col("ray_id").alias("other_id"), *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"], *[F.col(f"mean_{c}").alias(f"b{c}") for c in "xyz"]))
    pb = sb.select(F.col("other_id").alias("ray_id"), F.col("bx").alias("ex"), F.col("by").alias("ey"), F.col("bz").alias("ez"))
    for _ in range(rounds):
        moved = g.applied(matrix, [F.col(f"mean_{c}") for c in "xyz"], shift)
        pa = sa.select("ray_id", *[m.alias(f"e{c}") for m, c in zip(moved, "xyz", strict=True)])
        x = nearest(pa, pb, 1, distance, self_join=False).join(sb, "other_id")
        r = sum((F.col(f"b{c}") - F.col(f"e{c}")) * F.col(f"m{c}") for c in "xyz")
        p, m = [F.col(f"e{c}") for c in "xyz"], [F.col(f"m{c}") for c in "xyz"]
        j = [p[1] * m[2] - p[2] * m[1], p[2] * m[0] - p[0] * m[2], p[0] * m[1] - p[1] * m[0], *m]
        w = F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - r * r / F.lit(0.25)), F.lit(2.0))
        sums = [F.sum(w * j[i] * j[q]).alias(f"h{i}{q}") for i in range(6) for q in range(i, 6)] + [F.sum(w * j[i] * r).alias(f"g{i}") for i in range(6)]
        s = x.agg(*sums).first()
        if s["g0"] is None:
            break
        h = np.array([[s[f"h{min(i, q)}{max(i, q)}"] for q in range(6)] for i in range(6)])
        step = np.linalg.lstsq(h + 1e-9 * np.eye(6), np.array([s[f"g{i}"] for i in range(6)]), rcond=None)[0]
        turn = np.array(g.rotation(tuple(np.degrees(step[:3]))))
        matrix, shift = (turn @ np.array(matrix)).tolist(), (turn @ np.array(shift) + step[3:]).tolist()
    return matrix, shift


def tree_segments(spark: SparkSession, seed: int, trees: int, depth: int = 6) -> DataFrame:
    """tree_id, seg_id, x, y, z, radius, parent_id of branching trees: at each fork the cross-sections of the branches add up to the stem's."""
    rows = []
    for t in range(trees):
        r = random.Random(seed * 1_000_003 + t)
        x, y, radius = r.uniform(0, 20), r.uniform(0, 20), r.uniform(0.1, 0.3)
        todo = [((x, y, 0.0), (0.0, 0.0, 1.0), radius, -1, 0)]
        n = 0
        while todo:
            at, way, rad, parent, level = todo.pop(0)
            rows.append((t, n, *at, rad, parent))
            own, n = n, n + 1
            if level >= depth:
                continue
            share = [1.0] if level == 0 else [(s := r.uniform(0.4, 0.6)), 1.0 - s]
            for s in share:
                d = np.array(way) + np.array([r.gauss(0, 0.35), r.gauss(0, 0.35), r.gauss(0.1, 0.2)]) * (level > 0)
                d = d / np.linalg.norm(d)
                todo.append((tuple((np.array(at) + d * rad * 20).tolist()), tuple(d.tolist()), rad * math.sqrt(s), own, level + 1))
    return spark.createDataFrame([(a, b, float(x), float(y), float(z), float(q), p) for a, b, x, y, z, q, p in rows], "tree_id long, seg_id int, x double, y double, z double, radius double, parent_id int")


def scan_trees(segments: DataFrame, per_square_metre: float = 500.0, height: float = 12.0) -> DataFrame:
    """Rays from above onto the surface of segments, as many as their area asks for."""
    p = segments.select("tree_id", F.col("seg_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    s = segments.join(p, ["tree_id", "parent_id"])
    axis = [F.col(c) - F.col(f"p{c}") for c in "xyz"]
    n = F.ceil(F.lit(2.0 * math.pi * per_square_metre) * F.col("radius") * g.norm(axis)).cast("int")
    s = s.withColumn("_k", F.explode(F.sequence(F.lit(1), n))).withColumn("ray_id", F.col("tree_id") * 10_000_000 + F.col("seg_id") * 100_000 + F.col("_k"))
    u = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(k), F.col("ray_id")), 11) / F.lit(float(1 << 53))
    turn = F.lit(2.0 * math.pi) * u(1)
    side = {"x": F.cos(turn) * F.col("radius"), "y": F.sin(turn) * F.col("radius"), "z": F.lit(0.0)}
    s = s.withColumns({f"e{c}": F.col(f"p{c}") + (F.col(c) - F.col(f"p{c}")) * u(2) + side[c] for c in "xyz"})
    return s.select("ray_id", F.col("ex").alias("sx"), F.col("ey").alias("sy"), F.lit(height).alias("sz"), "ex", "ey", "ez", (F.col("ray_id") * F.lit(1e-6)).alias("time"), *[F.lit(v).cast("short").alias(k) for k, v in (("red", 192), ("green", 166), ("blue", 141), ("alpha", 255))])
