"""TER, MSH, TRE, TRK, FOR, AUX: ground, meshes, trees."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import geometry as g
from beamgrid.operators import terrain as te
from beamgrid.operators import trees as tr
from beamgrid.operators import voxel as v
from beamgrid.registry import register

from .common import on_rays, out

_PRE = lambda w, src="rays": f"ow as (select *, cast(floor(ex / {w!r}::double) as bigint) px, cast(floor(ey / {w!r}::double) as bigint) py from {src} where alpha > 0), lw as (select px, py, arg_min(ex, (ez, ray_id)) qx, arg_min(ey, (ez, ray_id)) qy, min(ez) qz from ow group by px, py), pre as (select * from ow where not exists (select 1 from lw where abs(lw.px - ow.px) <= 1 and abs(lw.py - ow.py) <= 1 and ow.ez - qz > sqrt((ow.ex - qx) ** 2 + (ow.ey - qy) ** 2)))"
on_rays("ter01_prefilter", lambda r: out(te.prefilter(r, 1.0), ("ray_id",)), f"{_PRE(1.0)} select ray_id from pre")
on_rays("ter02_ground_front", lambda r: out(te.ground_front(r, 1.0, 8.0), ("ray_id",), ("ez",)), f"{_PRE(1.0)} select ray_id, round(ez, 6) ez from pre a where not exists (select 1 from pre b where a.ez - b.ez > sqrt((a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2))")
on_rays("aux11_from_above", lambda r: out(te.from_above(r, 1.0, 8.0), ("ray_id",), ("ez",)), f"neg as (select * replace (-ez as ez) from rays), {_PRE(1.0, 'neg')} select ray_id, round(-ez, 6) ez from pre a where not exists (select 1 from pre b where a.ez - b.ez > sqrt((a.ex - b.ex) ** 2 + (a.ey - b.ey) ** 2))")


def _mesh(s, d):
    """A sheet over a coarse grid of cells' mean ends, two faces a square."""
    r = adapter.rays(s, d).where("alpha > 0")
    h = r.groupBy(F.floor(F.col("ex") / 2).alias("i"), F.floor(F.col("ey") / 2).alias("j")).agg(F.min("ez").alias("z"))
    vert = h.select((F.col("i") * 100 + F.col("j")).alias("vid"), (F.col("i") * 2.0).alias("x"), (F.col("j") * 2.0).alias("y"), "z")
    k = lambda a, b: F.col("vid") + 100 * a + b
    faces = vert.select((F.col("vid") * 2).alias("fid"), k(0, 0).alias("v0"), k(1, 0).alias("v1"), k(0, 1).alias("v2")).unionByName(vert.select((F.col("vid") * 2 + 1).alias("fid"), k(1, 0).alias("v0"), k(1, 1).alias("v1"), k(0, 1).alias("v2")))
    ids = vert.select(F.col("vid"))
    for n in ("v0", "v1", "v2"):
        faces = faces.join(ids.withColumnRenamed("vid", n), n, "left_semi")
    return vert, faces


_MESH = """hh as (select cast(floor(ex / 2) as bigint) i, cast(floor(ey / 2) as bigint) j, min(ez) z from rays where alpha > 0 group by all), vert as (select i * 100 + j vid, i * 2.0::double x, j * 2.0::double y, z from hh),
fa as (select vid * 2 fid, vid v0, vid + 100 v1, vid + 1 v2 from vert union all select vid * 2 + 1, vid + 100, vid + 101, vid + 1 from vert),
faces as (select * from fa where v0 in (select vid from vert) and v1 in (select vid from vert) and v2 in (select vid from vert))"""
_FIELD = f"""{_MESH}, co as (select fid, {', '.join(f'{n}.x x{k}, {n}.y y{k}, {n}.z z{k}' for k, n in enumerate('abc'))} from faces join vert a on a.vid = v0 join vert b on b.vid = v1 join vert c on c.vid = v2),
p1 as (select *, unnest(range(cast(floor(least(x0, x1, x2) / 0.5::double) as bigint), cast(floor(greatest(x0, x1, x2) / 0.5::double) as bigint) + 1)) px from co), p2 as (select *, unnest(range(cast(floor(least(y0, y1, y2) / 0.5::double) as bigint), cast(floor(greatest(y0, y1, y2) / 0.5::double) as bigint) + 1)) py from p1),
p3 as (select *, (px + 0.5::double) * 0.5::double x, (py + 0.5::double) * 0.5::double y, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) d from p2),
p4 as (select *, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / d u, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / d w from p3 where d <> 0),
fld as (select px, py, min(u * z0 + w * z1 + (1.0::double - u - w) * z2) v from p4 where u >= 0 and w >= 0 and u + w <= 1 group by px, py)"""
register("msh03_height_field", lambda s, d: out(te.height_field(*_mesh(s, d), 0.5).withColumn("value", F.col("value") + F.lit(1e-9)), ("px", "py"), ("value",)), duck(f"{_FIELD} select px, py, round(v + 1e-9::double, 6) as value from fld"))
register("msh03_filled_field", lambda s, d: out(te.fill_gaps(te.height_field(*_mesh(s, d), 0.5), 1).withColumn("value", F.col("value") + F.lit(1e-9)), ("px", "py"), ("value",)), duck(f"""{_FIELD}, o(ox, oy) as (select a, b from (select unnest([-1, 0, 1]) a), (select unnest([-1, 0, 1]) b)),
nr as (select px + ox px, py + oy py, avg(v) v from fld, o group by 1, 2) select px, py, round(v + 1e-9::double, 6) as value from fld union all select px, py, round(v + 1e-9::double, 6) from nr anti join fld using (px, py)"""))
register("msh04_used_vertices", lambda s, d: te.used_vertices(*_mesh(s, d)), duck(f"""{_MESH}, us as (select v0 vid, fid * 3 p from faces union all select v1, fid * 3 + 1 from faces union all select v2, fid * 3 + 2 from faces)
select vid, row_number() over (order by min(p)) - 1 new_vid from us group by vid"""))
_TRI = ((2.0, 3.0, 1.0), (17.0, 5.0, 2.0), (8.0, 18.0, 4.5))


def _tri_sql() -> str:
    p, q, r = _TRI
    a, b = [y - x for x, y in zip(p, q)], [y - x for x, y in zip(p, r)]
    L = lambda v: [f"({x!r}::double)" for x in v]
    cr = lambda m, n: [f"({m[1]} * {n[2]} - {m[2]} * {n[1]})", f"({m[2]} * {n[0]} - {m[0]} * {n[2]})", f"({m[0]} * {n[1]} - {m[1]} * {n[0]})"]
    dt = lambda m, n: "(" + " + ".join(f"{x} * {y}" for x, y in zip(m, n)) + ")"
    d, s = [f"(e{c} - s{c})" for c in "xyz"], [f"(s{c} - {x!r}::double)" for c, x in zip("xyz", p)]
    h, k = cr(d, L(b)), cr(s, L(a))
    return f"aa as (select *, {dt(L(a), h)} a from rays), bb as (select ray_id, {dt(s, h)} / a u, {dt(d, k)} / a v, {dt(L(b), k)} / a t from aa where abs(a) > 1e-12) select ray_id, round(t, 6) + 0.0::double t from bb where u >= 0 and v >= 0 and u + v <= 1 and t >= 0 and t <= 1"


on_rays("msh06_triangle_hits", lambda r: out(te.triangle_hits(r, _TRI), ("ray_id",), ("t",)), _tri_sql())
_TET = ((0.0, 0.0, 0.0), (20.0, 1.0, 0.0), (2.0, 20.0, 0.5), (6.0, 6.0, 6.0))


def _tet_sql() -> str:
    parts = []
    for k in range(4):
        a, b, c, o = (_TET[(k + j) % 4] for j in range(4))
        u, w = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
        n = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
        sign = 1.0 if sum(m * (z - x) for m, z, x in zip(n, o, a)) > 0 else -1.0
        parts.append(f"{sign}::double * (" + " + ".join(f"(e{q} - {x!r}::double) * {m!r}::double" for q, x, m in zip("xyz", a, n)) + ") >= 0")
    return "select ray_id from rays where " + " and ".join(parts)


on_rays("aux13_in_tetrahedron", lambda r: out(r.where(te.in_tetrahedron(g.ends(), _TET)), ("ray_id",)), _tet_sql())
on_rays("aux01_grid_index", lambda r: r.select("ray_id", *[c.alias(n) for n, c in zip(("ix", "iy", "iz"), te.grid_index((1.0, 1.0, 1.0), 0.7, (20, 20, 4)))]), "select ray_id, " + ", ".join(f"cast(greatest(0, least({n - 1}, cast(trunc((e{a} - 1.0::double) / 0.7::double) as bigint))) as bigint) i{a}" for a, n in zip("xyz", (20, 20, 4))) + " from rays")
on_rays("aux02_occupancy_report", lambda r: out(te.occupancy_report(r, 1.0), ("filled", "ends", "most"), ("mean",)), "n as (select count(*) c from rays group by floor(ex), floor(ey), floor(ez)) select count(*) filled, cast(sum(c) as bigint) ends, max(c) most, round(avg(c), 6) mean from n")

_UP = "w as (select tree_id, seg_id, parent_id, 0.0::double far, seg_id node from segments union all select w.tree_id, w.seg_id, p.parent_id, w.far + sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2), p.seg_id from w join segments c on c.tree_id = w.tree_id and c.seg_id = w.node join segments p on p.tree_id = w.tree_id and p.seg_id = w.parent_id)"
on_rays("tre03_distance_to_tip", lambda s: out(tr.distance_to_tip(s), ("tree_id", "seg_id"), ("value",), 5), f"{_UP} select tree_id, node seg_id, round(max(far), 5) as value from w group by tree_id, node", "segments", recursive=True)
on_rays("tre07_reindexed", lambda s: tr.reindexed(s.where("seg_id % 7 <> 5 or tree_id % 3 <> 0")), """
g as (select * from segments where seg_id % 7 <> 5 or tree_id % 3 <> 0), w as (select tree_id, seg_id, 0 new_id, -1 new_parent from g where parent_id = -1 union all select g.tree_id, g.seg_id, w.new_id + 1, w.new_id from w join g on g.tree_id = w.tree_id and g.parent_id = w.seg_id)
select tree_id, seg_id, cast(new_id as int) new_id, cast(new_parent as int) new_parent from w""", "segments", recursive=True)
on_rays("tre05_taper", lambda s: out(tr.taper(s), ("tree_id",), ("radius",)), "select tree_id, round(pow(avg(pow(radius, 0.25::double)), 4.0::double), 6) radius from segments group by tree_id", "segments")
on_rays("tre02_roots", lambda r: out(tr.roots(r, 1.5, 4.7), ("px", "py", "n", "bx", "by"), ("low", "high")), """
n as (select cast(floor(ex / 1.5::double) as bigint) px, cast(floor(ey / 1.5::double) as bigint) py, count(*) n, min(ez) low, max(ez) high from rays where alpha > 0 group by all), o(ox, oy) as (values (0, 0), (0, 1), (1, 0), (1, 1)),
b as (select px - ox bx, py - oy by_, cast(sum(n) as bigint) n, min(low) low, max(high) high from n, o group by 1, 2), m as (select bx + ox px, by_ + oy py, b.* from b, o),
t as (select * from m semi join n using (px, py) qualify row_number() over (partition by px, py order by n desc, bx, by_) = 1)
select px, py, n, bx, by_ "by", round(low, 6) low, round(high, 6) high from t where high - low >= 4.7""")


def _trunks(s, d):
    k = F.col("tree_id")
    x = adapter.segments(s, d).where("seg_id = 0")
    return x.select(k.alias("trunk_id"), "x", "y", F.lit(2.5).alias("z"), (F.lit(0.3) + (k % 7) / F.lit(10.0)).alias("radius"), F.lit(5.0).alias("length"), F.lit(0.0).alias("dx"), F.lit(0.6).alias("dy"), F.lit(0.8).alias("dz"), (F.lit(0.0) + (k % 11) / F.lit(4.0)).alias("base"), (F.lit(3.0) + (k % 3)).alias("height"))


_TRUNKS = "tk as (select tree_id trunk_id, x, y, 2.5::double z, 0.3::double + (tree_id % 7) / 10::double radius, (tree_id % 11) / 4::double base, 3.0::double + tree_id % 3 height from segments where seg_id = 0)"
_TPTS = f"""{_TRUNKS}, ta as (select trunk_id, ray_id, ex, ey, ez, radius, (ex - x) tx, (ey - y) ty, (ez - z) tz from rays, tk where alpha > 0), tb as (select *, tx * 0.0::double + ty * 0.6::double + tz * 0.8::double along from ta),
tc as (select *, sqrt(greatest(0.0::double, tx * tx + ty * ty + tz * tz - along * along)) "off" from tb), tp as (select * from tc where abs(along) <= 2.5 and "off" <= radius)"""
register("jon11_trunk_points", lambda s, d: out(tr.trunk_points(adapter.rays(s, d), _trunks(s, d)), ("trunk_id", "ray_id"), ("along", "off")), duck(f'{_TPTS} select trunk_id, ray_id, round(along, 6) + 0.0::double along, round("off", 6) "off" from tp', "rays", "segments"))
register("trk02_trunk_fit", lambda s, d: out(tr.trunk_fit(tr.trunk_points(adapter.rays(s, d), _trunks(s, d))), ("trunk_id", "n"), ("radius", "error")), duck(f'{_TPTS}, fr as (select trunk_id, avg("off") r, count(*) n from tp group by trunk_id) select trunk_id, n, round(r, 6) radius, round(sum(abs("off" - r)) / (n - 4), 6) error from tp join fr using (trunk_id) where n > 4 group by trunk_id, n, r', "rays", "segments"))
register("trk02_trunk_lean", lambda s, d: out(tr.trunk_lean(tr.trunk_points(adapter.rays(s, d), _trunks(s, d)).where("trunk_id >= 0")).where("slope_x is not null"), ("trunk_id",), ("slope_x", "slope_y"), 5), duck(f"{_TPTS} select trunk_id, round(regr_slope(ex, ez), 5) + 0.0::double slope_x, round(regr_slope(ey, ez), 5) + 0.0::double slope_y from tp group by trunk_id having min(ez) < max(ez)", "rays", "segments"))
register("jon13_lowest_trunks", lambda s, d: tr.lowest_trunks(_trunks(s, d)).select("trunk_id"), duck(f"{_TRUNKS} select trunk_id from tk a where not exists (select 1 from tk b where b.trunk_id <> a.trunk_id and a.base > b.base + ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2.0::double * b.height))", "rays", "segments"))
register("jon14_permeable_trunks", lambda s, d: out(tr.permeable(adapter.rays(s, d), _trunks(s, d), 0.5), ("trunk_id", "n"), ("mean",)), duck(f"""{_TRUNKS},
q as (select trunk_id, radius, x, y, sx, sy, ex - sx dx, ey - sy dy from rays, tk), u as (select *, greatest(0.0::double, least(1.0::double, ((x - sx) * dx + (y - sy) * dy) / nullif(dx * dx + dy * dy, 0))) u from q),
nn as (select trunk_id, radius, sqrt((sx + dx * u - x) ** 2 + (sy + dy * u - y) ** 2) near from u) select trunk_id, count(*) n, round(avg(near), 6) mean from nn where near < radius group by trunk_id""", "rays", "segments"))


def _closest(s, d):
    seg = adapter.segments(s, d)
    p = seg.select("tree_id", F.col("seg_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    x = seg.join(p, ["tree_id", "parent_id"])
    r = adapter.rays(s, d).withColumn("tree_id", F.col("ray_id") % 150)
    return out(tr.closest_on_segment(r.join(x, "tree_id")), ("ray_id", "tree_id", "seg_id"), ("distance",))


register("aux04_closest_on_segment", _closest, duck("""
p as (select a.*, b.x px, b.y py, b.z pz from segments a join segments b on a.tree_id = b.tree_id and a.parent_id = b.seg_id),
j as (select ray_id, p.tree_id, seg_id, radius, ex - px tx, ey - py ty, ez - pz tz, x - px ax, y - py ay, z - pz az from rays join p on p.tree_id = ray_id % 150),
k as (select *, greatest(0.0::double, least(1.0::double, coalesce((tx * ax + ty * ay + tz * az) / nullif(ax * ax + ay * ay + az * az, 0), 0.0::double))) d from j)
select ray_id, tree_id, seg_id, round(sqrt((tx - ax * d) ** 2 + (ty - ay * d) ** 2 + (tz - az * d) ** 2) - radius, 6) + 0.0::double distance from k""", "rays", "segments"))
_LAB = lambda r: v.height_field(r, 0.5).withColumn("tree_id", F.floor(F.col("px") / 8) * 100 + F.floor(F.col("py") / 8))
_LABS = "fl as (select cast(floor(ex / 0.5::double) as bigint) px, cast(floor(ey / 0.5::double) as bigint) py, min(ez) low, max(ez) high from rays where alpha > 0 group by all), lb as (select *, (px // 8) * 100 + py // 8 tree_id from fl), cm as (select tree_id, count(*) pixels, max(high) - min(low) height from lb group by tree_id having count(*) >= 25)"
on_rays("for02_crown_metrics", lambda r: out(tr.crown_metrics(_LAB(r), 0.5), ("tree_id", "pixels"), ("crown_radius", "height", "trunk_radius")), f"{_LABS} select tree_id, pixels, round(sqrt(pixels * 0.25::double / {math.pi!r}::double), 6) crown_radius, round(height, 6) height, round(height / 50.0::double, 6) trunk_radius from cm")
on_rays("jon17_field_join", lambda r: v.height_field(r, 0.5).alias("a").join(v.height_field(r.where("ray_id % 2 = 0"), 0.5).select("px", "py", F.col("low").alias("ground")), ["px", "py"]).select("px", "py", g.rounded(F.col("high") - F.col("ground")).alias("above")),
        "a as (select floor(ex / 0.5::double) px, floor(ey / 0.5::double) py, max(ez) h from rays where alpha > 0 group by all), b as (select floor(ex / 0.5::double) px, floor(ey / 0.5::double) py, min(ez) l from rays where alpha > 0 and ray_id % 2 = 0 group by all) select cast(px as bigint) px, cast(py as bigint) py, round(h - l, 6) + 0.0::double above from a join b using (px, py)")


def _space(s, d):
    r = adapter.rays(s, d)
    f = v.height_field(r, 0.5)
    space = f.select("px", "py", (F.col("low") / F.lit(5.0)).alias("space"))
    tips = _LAB(r).groupBy("tree_id").agg(F.max_by(F.struct("px", "py"), F.struct(F.col("high"), -F.col("px"), -F.col("py"))).alias("t"), (F.max("high") * 4).alias("height")).select("tree_id", F.col("t.px").alias("tx"), F.col("t.py").alias("ty"), "height")
    return out(tr.free_space(space, tips), ("tree_id", "px", "py"), ("score",))


register("for03_free_space", _space, duck(f"""{_LABS}, tp as (select tree_id, arg_max(px, (high, -px, -py)) tx, arg_max(py, (high, -px, -py)) ty, max(high) * 4 height from lb group by tree_id),
c as (select tree_id, px, py, low / 5.0::double - 0.25::double * ((px - tx) ** 2 + (py - ty) ** 2) / pow(height * 0.2::double, 2) score from tp join fl on (px - tx) ** 2 + (py - ty) ** 2 <= pow(height * 0.2::double, 2))
select tree_id, px, py, round(score, 6) + 0.0::double score from c qualify row_number() over (partition by tree_id order by score desc, px, py) = 1"""))
