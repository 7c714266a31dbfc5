"""REN, MRG: rendering and merging."""

from __future__ import annotations


from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import colour as c
from beamgrid.operators import info as i
from beamgrid.operators import merge as m
from beamgrid.operators import neighbours as nn
from beamgrid.operators import render as r
from beamgrid.operators import voxel as v
from beamgrid.registry import register

from .common import on_rays, out, sql_out
from .filters import _lits, _slab
from .relations import _EL, D, K
from .voxels import DENSITY, HIGH, LEAF, LOW, WIDTH, walk_sql

ORIGIN, PIXEL = (0.0, 0.0, 0.0), 0.5
RGB = ("red", "green", "blue")
_PIX = lambda q, ax="x", ay="y", az="z": f"pt as (select ray_id, cast(trunc({q}{ax} / 0.5::double) as bigint) px, cast(trunc({q}{ay} / 0.5::double) as bigint) py, {q}{az} / 0.5::double depth, red / 255.0::double red, green / 255.0::double green, blue / 255.0::double blue from rays where alpha > 0)"
for _name, _of in (("ends", "e"), ("starts", "s")):
    on_rays(f"ren01_{_name}", lambda x, of=_of: out(r.nearest_point(x, ORIGIN, PIXEL, "top", of), ("px", "py", "ray_id"), (*RGB, "depth")), f"{_PIX(_of)} select px, py, ray_id, {sql_out((), (*RGB, 'depth'))} from pt qualify row_number() over (partition by px, py order by depth desc, ray_id) = 1")
on_rays("ren01_front", lambda x: out(r.nearest_point(x, ORIGIN, PIXEL, "front"), ("px", "py", "ray_id"), ("depth",)), f"{_PIX('e', 'x', 'z', 'y')} select px, py, ray_id, round(depth, 6) depth from pt qualify row_number() over (partition by px, py order by depth, ray_id) = 1")
_TONE = "t as (select sum({v}) / count(*) filter ({v} > 0) mn, count(*) filter ({v} > 0) n from {s}), tt as (select mn, sqrt(sum(({v} - mn) * ({v} - mn)) filter ({v} > 0) / any_value(n)) sd from {s}, t group by mn)"
on_rays("ren01_height", lambda x: out(r.height_shade(r.nearest_point(x, ORIGIN, PIXEL)), ("px", "py"), ("shade",), 5), f"{_PIX('e')}, h as (select px, py, max(depth) depth from pt group by px, py), {_TONE.format(v='depth', s='h')} select px, py, round((depth - (mn - 2 * sd)) / (4 * sd), 5) + 0.0::double shade from h, tt")
on_rays("ren02_mean", lambda x: out(r.mean_colour(x, ORIGIN, PIXEL), ("px", "py", "weight"), RGB), f"{_PIX('e')} select px, py, count(*)::double weight, " + ", ".join(f"round(avg({k}), 6) {k}" for k in RGB) + " from pt group by px, py")
on_rays("ren02_sum", lambda x: out(r.sum_colour(x, ORIGIN, PIXEL), ("px", "py", "weight"), RGB, 5), f"{_PIX('e')}, g as (select px, py, count(*)::double weight, " + ", ".join(f"sum({k}) {k}" for k in RGB) + f" from pt group by px, py), {_TONE.format(v='weight', s='g')} select px, py, weight, " + ", ".join(f"round({k} / (mn + 2 * sd), 5) {k}" for k in RGB) + " from g, tt")
_LINE = f"""cb as (select *, {_slab(_lits(LOW), _lits(HIGH))} from rays where alpha > 0),
l0 as (select *, {', '.join(f'(s{a} + (e{a} - s{a}) * {t} - {o!r}::double) / 0.5::double {a}{n}' for a, o in (('x', LOW[0]), ('y', LOW[1])) for n, t in (('a', 'n'), ('b', 'f')))} from cb where n < f),
l1 as (select *, abs(xb - xa) > abs(yb - ya) xl from l0), l2 as (select *, case when xl then xa else ya end la, case when xl then xb else yb end lb, case when xl then ya else xa end sa, case when xl then yb else xb end sb from l1),
l3 as (select *, (sb - sa) / nullif(lb - la, 0) gr from l2), l4 as (select *, least(la, lb) p0, greatest(la, lb) p1, case when lb >= la then sa else sb end s0 from l3 where gr is not null),
l5 as (select *, unnest(range(cast(trunc(p0) as bigint), cast(trunc(p1) as bigint) + 1)) l from l4), l6 as (select *, cast(trunc(s0 + (l + 0.5::double - p0) * gr) as bigint) s from l5),
ln as (select ray_id, case when xl then l else s end px, case when xl then s else l end py, red / 255.0::double red, green / 255.0::double green, blue / 255.0::double blue from l6)"""
on_rays("exp04_line_pixels", lambda x: r.line_pixels(x, LOW, HIGH, PIXEL).select("ray_id", "px", "py"), f"{_LINE} select ray_id, px, py from ln")
on_rays("ren03_rays", lambda x: out(r.draw_rays(x, LOW, HIGH, PIXEL), ("px", "py", "weight"), RGB), f"{_LINE} select px, py, count(*)::double weight, " + ", ".join(f"round(avg({k}), 6) {k}" for k in RGB) + " from ln group by px, py")


def _columns(x):
    return r.column_density(v.leaf_density(v.density(x, LOW, HIGH, WIDTH)), WIDTH)


_COL = f"{DENSITY}, col as (select vx px, vy py, sum({LEAF}) * {WIDTH}::double v from dens group by vx, vy)"
on_rays("ren04_density", lambda x: out(_columns(x), ("px", "py"), ("value",), 4), f"{_COL} select px, py, round(v, 4) as value from col")
_HUE = "6.0::double * (log10(greatest(1e-6::double, v)) - floor(log10(greatest(1e-6::double, v))))"
_MIX = lambda k: f"(([{', '.join(f'{s[k]}::double' for s in c.SPECTRUM)}])[cast(floor(hue) as bigint) % 6 + 1] * (1.0::double - (hue - floor(hue))) + ([{', '.join(f'{s[k]}::double' for s in c.SPECTRUM)}])[(cast(floor(hue) as bigint) + 1) % 6 + 1] * (hue - floor(hue)))"
on_rays("ren04_density_rgb", lambda x: out(r.density_colours(_columns(x)), ("px", "py"), RGB, 4), f"{_COL}, hu as (select *, {_HUE} hue, 0.7::double * pow(v, 0.3::double) sh from col) select px, py, " + ", ".join(f"round(sh * {_MIX(k)}, 4) + 0.0::double {n}" for k, n in enumerate(RGB)) + " from hu")
on_rays("ren05_tone_range", lambda x: out(r.tone_range(r.nearest_point(x, ORIGIN, PIXEL), "depth"), (), ("min_val", "max_val"), 5), f"{_PIX('e')}, h as (select max(depth) depth from pt group by px, py), {_TONE.format(v='depth', s='h')} select round(mn - 2 * sd, 5) min_val, round(mn + 2 * sd, 5) max_val from tt")
on_rays("ren06_grid_bounds", lambda x: out(r.grid_bounds(x, 6.0), (), ("min_x", "max_x", "min_y", "max_y")), "b as (select (min(ex) + max(ex)) / 2.0::double x, (min(ey) + max(ey)) / 2.0::double y from rays where alpha > 0) select " + ", ".join(f"round(round({a} / 6.0::double) * 6.0::double + {s}::double, 6) {n}_{a}" for a in "xy" for n, s in (("min", -3.0), ("max", 3.0))) + " from b")
on_rays("snk11_world_transform", lambda x: out(r.world_transform(x, 0.25), ("scale_x", "scale_y"), ("offset_x", "offset_y")), "select 0.25::double scale_x, -0.25::double scale_y, round(min(ex), 6) offset_x, round(max(ey), 6) offset_y from rays where alpha > 0")

W = 0.5


def _form(p: str, q: str) -> str:
    s = {"xx": "m_xx", "xy": "m_xy", "xz": "m_xz", "yy": "m_yy", "yz": "m_yz", "zz": "m_zz"}
    return "(" + " + ".join(f"{s[''.join(sorted(a + b))]} * {p}{a} * {q}{b}" for a in "xyz" for b in "xyz") + ")"


def _shapes_sql(prefix: str = "") -> str:
    e = "1e-10::double"
    return f"""el as (select cov.*, cxx + {e} a, cxy b, cxz d, cyy + {e} e, cyz f, czz + {e} h, r0.time shape_time from cov join {{src}} r0 using (ray_id)),
e5 as (select *, a * (e * h - f * f) - b * (b * h - f * d) + d * (b * f - e * d) det from el),
sh as (select ray_id shape_id, shape_time, mean_x, mean_y, mean_z, (e * h - f * f) / s m_xx, (d * f - b * h) / s m_xy, (b * f - d * e) / s m_xz, (a * h - d * d) / s m_yy, (b * d - a * f) / s m_yz, (a * e - b * b) / s m_zz,
  1.7::double * sqrt(a) ext_x, 1.7::double * sqrt(e) ext_y, 1.7::double * sqrt(h) ext_z from (select *, {1.7 * 1.7!r}::double * det s from e5 where det > 0)),
bx as (select shape_id, {', '.join(f'floor((mean_{k} - ext_{k}) / {W}::double) lo{k}, floor((mean_{k} + ext_{k}) / {W}::double) hi{k}' for k in 'xyz')} from sh)"""


def _meet_sql(rays: str) -> str:
    return walk_sql(rays, W) + f""",
wv as (select ray_id, vx, vy, vz from w), cand as (select distinct shape_id, ray_id from wv join bx on vx between lox and hix and vy between loy and hiy and vz between loz and hiz),
jn as (select sh.*, r.ray_id, r.time, {', '.join(f'r.e{k} - r.s{k} r{k}, mean_{k} - r.s{k} t{k}' for k in 'xyz')} from cand join sh using (shape_id) join {rays} r on r.ray_id = cand.ray_id),
fm as (select *, {_form('r', 'r')} rr, {_form('t', 'r')} tr, {_form('t', 't')} tt, sqrt(rx * rx + ry * ry + rz * rz) len from jn),
al as (select *, sqrt(greatest(0.0::double, 1.0::double - (tt - tr * tr / rr))) along, sqrt(rr) rl, tr / sqrt(rr) ta from fm where tt - tr * tr / rr <= 1.0),
meet as (select shape_id, shape_time, ray_id, time, case when rl * (1.0::double - 0.05::double / len) > ta + along then 'pass' else 'hit' end outcome from al where rl >= ta - along)"""


_SELF = f"{_EL}, {_shapes_sql().format(src='rays')}, {_meet_sql('rays')}"
on_rays("jon07_ellipsoid_rays", lambda x: nn.intersect(nn.ellipsoids(x, K, D), x, W).select("shape_id", "ray_id", "outcome"), f"{_SELF} select shape_id, ray_id, outcome from meet", "rays")
_EV = """ag as (select shape_id, shape_time, count(*) filter (outcome = 'hit') hits, count(*) filter (outcome = 'pass') passes, min(time) filter (outcome = 'hit') fh, max(time) filter (outcome = 'hit') lh from meet group by all),
gn as (select shape_id, count(*) filter (outcome = 'pass' and meet.time < coalesce(fh, 'inf'::double) and not meet.time > coalesce(lh, '-inf'::double)) nb, count(*) filter (outcome = 'pass' and meet.time > coalesce(lh, '-inf'::double)) na from meet join ag using (shape_id) group by shape_id),
ev as (select ag.*, nb, na, case when hits = 0 then 0.0::double else (hits + (1e-8::double - 1.0::double)) / ((hits + (1e-8::double - 1.0::double)) + passes - nb - na) end op from ag join gn using (shape_id))"""
on_rays("mrg01_transient_evidence", lambda x: m.found(nn.kept(nn.ellipsoids(x, K, D)), x, W, True).select("shape_id", "hits", "passes", "num_before", "num_after", F.round("opacity", 5).alias("opacity")), f"{_SELF}, {_EV} select shape_id, hits, passes, nb num_before, na num_after, round(op, 5) opacity from ev", "rays")


def _mode(mode: str, n: float):
    ln = f"({n}::double / nullif(op, 0))"
    if mode in ("oldest", "newest"):
        return f"coalesce(greatest(nb, na) >= {ln}, false)", f"{'nb' if mode == 'oldest' else 'na'} >= {ln}"
    return f"coalesce(nb + na >= {ln}, false)", "true" if mode == "min" else "false"


def _goes(mode: str, n: float) -> str:
    enough, shape = _mode(mode, n)
    return f"""vd as (select *, {enough} eno, {shape} shp from ev), ps as (select meet.*, op, fh, lh, row_number() over (partition by shape_id order by ray_id) k from meet join vd using (shape_id) where outcome = 'pass' and eno and not shp),
gone as (select shape_id ray_id from vd where eno and shp union select ray_id from ps where floor(k * op + 1e-9::double) > floor((k - 1) * op + 1e-9::double) and (time < fh or time > lh or fh is null))"""


for _mode_name in ("min", "max", "oldest", "newest"):
    on_rays(f"mrg01_transients_{_mode_name}", lambda x, mode=_mode_name: m.transients(x, mode, 2.0, K, D, W).select("ray_id", "part"), f"{_SELF}, {_EV}, {_goes(_mode_name, 2.0)} select ray_id, case when ray_id in (select ray_id from gone) then 'transient' else 'fixed' end part from rays", "rays")


def _pair(s, d):
    return adapter.rays(s, d), adapter.rays_b(s, d)


register("mrg02_merge", lambda s, d: m.merge(*_pair(s, d), "min", 1.0, K, D, W).select("ray_id", "cloud", "part"))
register("mrg03_three_way", lambda s, d: m.merge_three_way(adapter.rays(s, d).where("ray_id % 15 <> 0"), adapter.rays(s, d).where("ray_id % 10 <> 5"), adapter.rays(s, d).where("ray_id % 20 <> 0"), "all", 1.0, K, D, W))
on_rays("mrg05_voxel_width", lambda x: out(m.voxel_width(i.point_spacing(x)), (), ("width",)), """
b as (select 5.0::double * pow((max(ex) - min(ex)) * (max(ey) - min(ey)) * (max(ez) - min(ez)), 1.0::double / 3.0::double) / sqrt(count(*)) w, count(*) n from rays where alpha > 0),
c as (select distinct floor(ex / w), floor(ey / w), floor(ez / w) from rays, b where alpha > 0) select round(4.0::double * w / sqrt(n::double / (select count(*) from c)), 6) width from b""")
