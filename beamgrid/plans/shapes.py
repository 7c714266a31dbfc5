"""PRJ17, PRJ18, FLT11, DIF02, NN06, JON04."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import geometry as g
from beamgrid.operators import neighbours as nn
from beamgrid.operators import project
from beamgrid.operators import shapes as sh
from beamgrid.registry import register

from .common import on_rays, out
from .filters import LENGTH
from .relations import _any_sql, _diff
from .trees import _MESH, _mesh

on_rays("prj17_colour_branches", lambda r: sh.colour_branches(r).select("ray_id", "red"), f"""{_any_sql(4)},
al as (select near.ray_id, own.alpha from near join own on own.ray_id = other_id union all select ray_id, alpha from own), md as (select ray_id, median(alpha) m from al group by ray_id)
select ray_id, cast(trunc(greatest(0.0::double, least(255.0::double, 127.0::double + 2.0::double * m / (1.0::double + {LENGTH} / 100.0::double) - 200.0::double))) as smallint) red from own join md using (ray_id)""", "rays")
on_rays("prj18_lit", lambda r: out(sh.lit(r, 8), ("ray_id",), ("light",), 4), None, "rays")
register("flt11_split_by_mesh", lambda s, d: sh.split_by_mesh(adapter.rays(s, d), *_mesh(s, d), 0.5).select("ray_id", "side"), duck(f"""{_MESH},
co as (select fid, {', '.join(f'{n}.x x{k}, {n}.y y{k}, {n}.z z{k}' for k, n in enumerate('abc'))} from faces join vert a on a.vid = v0 join vert b on b.vid = v1 join vert c on c.vid = v2),
j as (select ray_id, ez, co.*, ex x, ey y, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) d from rays join co on ex between least(x0, x1, x2) and greatest(x0, x1, x2) and ey between least(y0, y1, y2) and greatest(y0, y1, y2)),
b as (select *, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / d u, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / d w from j where d <> 0),
o as (select ray_id from b where u >= 0 and w >= 0 and u + w < 1 and ez > u * z0 + w * z1 + (1.0::double - u - w) * z2 + 0.5::double group by ray_id having count(*) % 2 = 1)
select ray_id, case when ray_id in (select ray_id from o) then 'inside' else 'outside' end side from rays"""))
register("dif02_shoulder", lambda s, d: out(sh.shoulder(nn.cloud_distances(*_diff(s, d))), ("power",), ("distance", "similarity"), 3))
on_rays("nn06_clusters", lambda r: sh.clusters(r.where("alpha > 0"), 0.6, 2.0), None, "rays")


def _motion(s, d):
    r = adapter.rays(s, d)
    m, shift = g.rotation((5.0, -10.0, 20.0)), (1.0, 2.0, -0.5)
    moved = project.transform(r, m, shift)
    pairs = r.select("ray_id", *[F.col(f"e{a}").alias(f"a{a}") for a in "xyz"]).join(moved.select("ray_id", *[F.col(f"e{a}").alias(f"b{a}") for a in "xyz"]), "ray_id")
    rot, t = sh.rigid_motion(pairs)
    return s.createDataFrame([(k, *[round(v, 6) + 0.0 for v in rot[k]], round(t[k], 6)) for k in range(3)], "axis int, x double, y double, z double, shift double")


_R = g.rotation((5.0, -10.0, 20.0))
register("jon04_rigid_motion", _motion, "select * from (values " + ", ".join(f"({k}, {', '.join(f'round({v!r}::double, 6)' for v in _R[k])}, {s}::double)" for k, s in enumerate((1.0, 2.0, -0.5))) + ") t(axis, x, y, z, shift)")
