"""REG, TER03, FOR01, VOX11, LEF02, JON16."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import geometry as g
from beamgrid.operators import neighbours as nn
from beamgrid.operators import register as reg
from beamgrid.operators import surfaces as su
from beamgrid.operators import terrain as te
from beamgrid.operators import voxel as v
from beamgrid.registry import register

from .common import on_rays, out

on_rays("reg03_end_to_end_yaw", lambda r: out(reg.end_to_end_yaw(r), (), ("yaw",)), "select round(atan2(arg_max(ey, (ex, -ray_id)) - arg_min(ey, (ex, ray_id)), max(ex) - min(ex)), 6) yaw from rays")
_TH = f"({math.pi!r}::double * (angle + 0.5::double) / 32.0::double)"
on_rays("reg04_strongest_line", lambda r: out(reg.strongest_line(r, (0.0, 0.0), 0.25, 128, 32), ("angle", "bin"), ("weight",), 4), f"""
cells as (select floor(ex / 0.25::double) x, floor(ey / 0.25::double) y, count(*)::double v from rays where alpha > 0 group by all), a as (select unnest(range(32))::int angle),
s as (select angle, v, 64.0::double + ((x - 64.0::double) * cos({_TH}) - (y - 64.0::double) * sin({_TH})) / {math.sqrt(2.0)!r}::double y from cells, a where x >= 0 and y >= 0 and x < 128 and y < 128),
p as (select angle, cast(floor(y) as bigint) bin, v * (floor(y) + 1 - y) w from s union all select angle, cast(floor(y) as bigint) + 1, v * (y - floor(y)) from s),
q as (select angle, bin, round(sum(w), 6) w from p group by all) select angle, bin, round(w, 4) weight from q order by w desc, angle, bin limit 1""")


def _aligned(s, d):
    r = adapter.rays(s, d)
    yaw, shift = reg.coarse_align(r, r.withColumns({"ex": F.col("ex") + 3.0, "ey": F.col("ey") - 2.0, "ez": F.col("ez") + 1.0}))
    return s.createDataFrame([(round(yaw, 6), *[round(x, 6) for x in shift])], "yaw double, x double, y double, z double")


register("reg01_coarse_align", _aligned, "select 0.0::double yaw, 3.0::double x, -2.0::double y, 1.0::double z")


def _ground(s, d):
    v_, f = su.ground_mesh(te.ground_front(adapter.rays(s, d), 0.5, 8.0))
    return f.join(v_.select(F.col("vid").alias("v0"), F.col("z").alias("z0")), "v0").select("fid", "v0", "v1", "v2", g.rounded("z0").alias("z0"))


register("ter03_ground_mesh", _ground)
on_rays("for01_watershed", lambda r: su.watershed(v.height_field(r, 0.5).select("px", "py", F.col("high").alias("value")), 20, pixel=0.5), None)
on_rays("vox11_leaves", lambda r: su.leaves(r.where("alpha > 0").withColumn("share", (1 + F.col("ray_id") % 8) / F.lit(16.0)), "share", 1.0), """
s as (select ray_id, cast(floor(ex) as bigint) vx, cast(floor(ey) as bigint) vy, cast(floor(ez) as bigint) vz, (1 + ray_id % 8) / 16.0::double sh from rays where alpha > 0),
t as (select *, sum(sh) over (partition by vx, vy, vz order by ray_id) s from s) select ray_id, vx, vy, vz from t where floor(s + 1e-9) > floor(s - sh + 1e-9)""")
_LEAF = [(0.0, 0.0, 0.0), (0.1, 0.05, 0.0), (0.1, -0.05, 0.02)]
on_rays("lef02_leaf_mesh", lambda r: out(su.leaf_mesh(r.where("alpha > 200").select(F.col("ray_id").alias("leaf_id"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"), (F.col("ray_id") % 7).cast("double").alias("yaw")), _LEAF), ("leaf_id", "corner"), ("x", "y", "z"), 5), f"""
c(k, cx, cy, cz) as (values {', '.join(f'({k}, {x}::double, {y}::double, {z}::double)' for k, (x, y, z) in enumerate(_LEAF))}), l as (select *, (ray_id % 7)::double yaw from rays where alpha > 200)
select ray_id leaf_id, k corner, round(ex + cx * cos(yaw) - cy * sin(yaw), 5) x, round(ey + cx * sin(yaw) + cy * cos(yaw), 5) y, round(ez + cz, 5) z from l, c""")


def _branches(s, d):
    r = adapter.rays(s, d).where("alpha > 0")
    voxels = r.select(*[((F.floor(c) + 0.5)).alias(n) for n, c in zip(("ex", "ey", "ez"), g.ends())]).distinct()
    voxels = voxels.withColumn("ray_id", F.floor("ex") * 10_000 + F.floor("ey") * 100 + F.floor("ez"))
    seg = adapter.segments(s, d).select((F.col("tree_id") * 1000 + F.col("seg_id")).alias("ray_id"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"))
    return nn.nearest(voxels, seg, 12, 2.0, self_join=False).select(F.col("ray_id").alias("voxel"), F.col("rank").cast("long"), F.col("other_id").alias("segment"))


register("jon16_nearest_branches", _branches, duck("""
vx as (select distinct floor(ex) + 0.5::double ex, floor(ey) + 0.5::double ey, floor(ez) + 0.5::double ez from rays where alpha > 0), vo as (select *, cast(floor(ex) * 10000 + floor(ey) * 100 + floor(ez) as bigint) voxel from vx),
j as (select voxel, tree_id * 1000 + seg_id segment, (x - ex) * (x - ex) + (y - ey) * (y - ey) + (z - ez) * (z - ez) d from vo, segments)
select voxel, row_number() over (partition by voxel order by d, segment) rank, segment from j where d <= 4.0 qualify rank <= 12""", "rays", "segments"))
