"""SRC, SNK, GEN: file formats as far as they are expressions, and generated clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.functions import geometry as g
from beamgrid.operators import generate as gen
from beamgrid.registry import register
from beamgrid.sources import las, ply, text

from .common import on_rays, out, sql_out


def _points(r):
    """Times in steps of 20 minutes, so that many are equal, and intensities with non-returns."""
    return r.withColumns({"time": F.floor(F.col("time") / 1200.0) * F.lit(1200.0), "intensity": (F.col("ray_id") % 130 - 2).cast("double")})


on_rays("src02_import_points", lambda r: ply.imported(_points(r), 100.0).select("ray_id", "alpha", F.round((F.col("time") - 1.7e9) * 1e6).cast("long").alias("micros")), """
p as (select ray_id, floor(time / 1200.0::double) * 1200.0::double as time, (ray_id % 130 - 2)::double i from rays), q as (select *, lag(time) over (order by ray_id) lt from p),
s as (select *, sum(case when lt is null or time <> lt then 1 else 0 end) over (partition by time order by ray_id) run from q), k as (select *, row_number() over (partition by time, run order by ray_id) - 1 k from s)
select ray_id, cast(case when i = -1 then 0 when i < 0 then 1 else ceil(255.0::double * least(1.0::double, greatest(0.0::double, i / 100.0::double))) end as smallint) alpha,
  cast(round((time + 1e-6::double * k - 1.7e9::double) * 1e6::double) as bigint) micros from k""")
on_rays("src06_las_alpha", lambda r: las.full_if_all_zero(r.withColumn("alpha", las.alpha(F.col("ray_id") % 150, 100.0))).select("ray_id", "alpha"), "select ray_id, cast(least(255, cast(trunc(255.0::double * (ray_id % 150) / 100.0::double) as bigint)) as smallint) alpha from rays")
on_rays("src08_trajectory_text", lambda t: out(text.parse_trajectory(text.format_trajectory(t)), (), ("time", "x", "y", "z")), f"select {sql_out((), ('time', 'x', 'y', 'z'))} from trajectory", "trajectory")
on_rays("src09_tree_text", lambda s: out(text.parse_trees(text.format_trees(s), "x,y,z,radius,parent_id"), ("tree_id", "seg_id", "parent_id"), ("x", "y", "z", "radius"), 4), "select tree_id, seg_id, parent_id, " + ", ".join(f"round({c}, 4) + 0.0::double {c}" for c in ("x", "y", "z", "radius")) + " from segments", "segments")
on_rays("src10_trunk_text", lambda s: out(text.parse_trunks(s.where("seg_id = 0").select(F.concat_ws(",", *[F.round(c, 5).cast("string") for c in ("x", "y", "z", "radius")]).alias("value"))), (), ("x", "y", "z", "radius"), 4), "select " + ", ".join(f"round({c}, 4) + 0.0::double {c}" for c in ("x", "y", "z", "radius")) + " from segments where seg_id = 0", "segments")
register("src13_projection_text", lambda s, d: text.parse_projection(s.createDataFrame([("+proj=utm +zone=55 +south # a comment +no=1",), ("+datum=WGS84 +units=m",)], "value string")), "select * from (values ('proj', 'utm'), ('zone', '55'), ('south', ''), ('datum', 'WGS84'), ('units', 'm')) t(key, value)")
on_rays("snk05_points_text", lambda r: text.format_points(r, "xyz"), "select ray_id, printf('%.4f %.4f %.4f', ex, ey, ez) as value from rays")
on_rays("snk08_tree_lines", lambda s: text.format_trees(s.withColumns({c: F.lit(0.5) for c in ("x", "y", "z", "radius")})), "select tree_id, string_agg('0.5,0.5,0.5,0.5,' || parent_id, ', ' order by seg_id) as value from segments group by tree_id", "segments")
for _n, _f in (("gen01_room", gen.room), ("gen04_terrain", gen.terrain), ("gen05_field", gen.field)):
    register(_n, lambda s, d, f=_f: f(s, 1, 20_000))
register("gen04_terrain_heights", lambda s, d: out(gen.terrain(s, 1, 5_000).withColumns({"px": g.floor_index("ex", 4.0), "py": g.floor_index("ey", 4.0)}).groupBy("px", "py").agg(F.avg("ez").alias("height")), ("px", "py"), ("height",)))
