"""EXP, VOX and WIN over rasters: rays through voxels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.functions import geometry as g
from beamgrid.operators import voxel as v
from beamgrid.registry import register

from .common import on_rays, out, sql_out
from .filters import LENGTH, _lits, _slab

KEY = ("vx", "vy", "vz")
VOXEL = ("hits", "rays", "path_len")


def walk_sql(source: str, width: float, origin=(0.0, 0.0, 0.0), axes: str = "xyz", a: str = "0.0::double", b: str = "1.0::double") -> str:
    """CTEs up to w: the columns of source, v<axis>, t_in, t_out, length."""
    u = ", ".join(f"(s{c} - {o!r}::double) / {width!r}::double u{c}, (e{c} - {o!r}::double) / {width!r}::double w{c}" for c, o in zip("xyz", origin) if c in axes)
    cuts = ", ".join(f"list_transform(range(cast(floor(least(u{c}, w{c})) as bigint) + 1, cast(ceil(greatest(u{c}, w{c})) as bigint)), lambda k: (k - u{c}) / (w{c} - u{c}))" for c in axes)
    vox = ", ".join(f"cast(floor(u{c} + (w{c} - u{c}) * ((t_in + t_out) / 2.0::double)) as bigint) v{c}" for c in axes)
    return f"""w0 as (select *, {u}, {a} a_, {b} b_ from {source}),
w1 as (select *, list_sort(list_distinct(list_filter(flatten([[a_, b_], {cuts}]), lambda t: t >= a_ and t <= b_))) t from w0 where a_ < b_),
w2 as (select *, unnest(t[:-2]) t_in, unnest(t[2:]) t_out from w1),
w as (select *, {vox}, (t_out - t_in) * {LENGTH} length from w2)"""


on_rays("exp01_walk_grid", lambda r: out(v.traversal_counts(r, 1.0), (*KEY, "rays"), ("path_len",), 4), walk_sql("rays", 1.0) + " select vx, vy, vz, count(*) rays, round(sum(length), 4) path_len from w group by all")
on_rays("exp02_seeded_walk", lambda r: v.seed_walk(r, 0.5).groupBy(*KEY).agg(F.count("*").alias("rays")), walk_sql("rays", 0.5) + ", s as (select distinct " + ", ".join(f"cast(floor(e{a} / 0.5::double) as bigint) v{a}" for a in "xyz") + " from rays where alpha > 0) select vx, vy, vz, count(*) rays from w semi join s using (vx, vy, vz) group by all")
on_rays("exp03_fill_with_rays", lambda r: v.walk(r, 2.0).groupBy(*KEY).agg(F.count("*").alias("n")), walk_sql("rays", 2.0) + " select vx, vy, vz, count(*) n from w group by all")

LOW, HIGH, WIDTH = (1.003, 1.003, 0.253), (18.503, 18.503, 5.753), 0.5
_PEAK = f"""pc as (select *, {_slab(_lits(LOW), _lits(HIGH))} from rays where alpha > 0),
pe as (select {', '.join(f'((case when f = 1.0 then e{a} else s{a} + (e{a} - s{a}) * f end) - {o!r}::double) / {WIDTH!r}::double p{a}' for a, o in zip('xyz', LOW))} from pc where n < f),
peaks as (select cast(floor(px) as bigint) vx, cast(floor(py) as bigint) vy, max(pz) peak from pe group by all)"""
_WALK = walk_sql("(select * from c where n < f)", WIDTH, LOW, a="n", b="f")


def _clip_sql() -> str:
    """The clip with a margin of 1e-10 on the cutting planes only."""
    near, far = ["0.0::double"], ["1.0::double"]
    for a, lo, hi in zip("xyz", LOW, HIGH):
        d, one, two = f"(e{a} - s{a})", f"({lo!r}::double + 1e-10::double - s{a}) / nullif(e{a} - s{a}, 0)", f"({hi!r}::double - 1e-10::double - s{a}) / nullif(e{a} - s{a}, 0)"
        inside = f"s{a} >= {lo!r}::double and s{a} <= {hi!r}::double"
        near.append(f"case when {d} = 0 then case when {inside} then 0.0::double else 2.0::double end else least({one}, {two}) end")
        far.append(f"case when {d} = 0 then case when {inside} then 1.0::double else -1.0::double end else greatest({one}, {two}) end")
    return f"c as (select *, greatest({', '.join(near)}) n, least({', '.join(far)}) f from rays)"


DENSITY = f"{_clip_sql()}, {_WALK}, dens as (select vx, vy, vz, count(*) filter (alpha > 0 and t_out = f)::double hits, count(*)::double rays, sum(length) path_len from w group by all)"
LEAF = "case when rays <= 2 then 0.0::double else 2.0::double * (rays - 1.0::double) * hits / (1e-10::double + rays * path_len) end"


def _density(r, flat: bool = False):
    return v.density(r, LOW, HIGH, WIDTH, flat)


on_rays("vox02_peaks", lambda r: out(v.peaks(r, LOW, HIGH, WIDTH), ("vx", "vy"), ("peak",)), f"{_PEAK} select vx, vy, round(peak, 6) peak from peaks")
on_rays("vox03_ray_density", lambda r: out(_density(r), (*KEY, "hits", "rays"), ("path_len",), 4), f"{DENSITY} select vx, vy, vz, hits, rays, round(path_len, 4) path_len from dens")
_Z = lambda t: f"((sz + (ez - sz) * {t} - {LOW[2]!r}::double) / {WIDTH!r}::double)"
on_rays("vox03_flat_top_density", lambda r: out(_density(r, True), (*KEY, "hits", "rays"), ("path_len",), 4), f"""{_clip_sql()}, {_WALK}, {_PEAK},
j as (select w.*, peak from w left join peaks using (vx, vy)),
k as (select *, case when ez < sz and {_Z('t_in')} > peak and {_Z('t_out')} <= peak then length * (1.0::double - greatest(0.0::double, least(0.99::double, ({_Z('t_in')} - peak) / ({_Z('t_in')} - {_Z('t_out')})))) else length end l from j)
select vx, vy, vz, count(*) filter (alpha > 0 and t_out = f)::double hits, count(*)::double rays, round(sum(l), 4) path_len from k group by all""")
on_rays("vox04_density", lambda r: out(v.leaf_density(_density(r)), KEY, ("density",), 4), f"{DENSITY} select vx, vy, vz, round({LEAF}, 4) density from dens")
on_rays("vox05_flat_top", lambda r: out(v.flat_top(_density(r), v.peaks(r, LOW, HIGH, WIDTH)), KEY, ("hits",)), f"""{DENSITY}, {_PEAK}
select vx, vy, vz, round(case when vz = cast(floor(peak) as bigint) and hits > 2 then hits * (hits - 2.0::double) / (hits - 1.0::double) else hits end, 6) hits from dens left join peaks using (vx, vy)""")


def _priors_sql() -> str:
    offs = ", ".join(f"({x}, {y}, {z}, {abs(x) + abs(y) + abs(z)})" for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0))
    sums = ", ".join(f"coalesce(sum({c}) filter (ring = {r}), 0.0::double) {c}{r}" for r in (1, 2, 3) for c in VOXEL)
    got = ", ".join(f"coalesce({c}{r}, 0.0::double) {c}{r}" for r in (1, 2, 3) for c in VOXEL)
    ctes = [f"o(ox, oy, oz, ring) as (values {offs})", f"ring as (select vx + ox vx, vy + oy vy, vz + oz vz, {sums} from dens, o group by 1, 2, 3)", f"x0 as (select dens.*, {got}, 10.0::double - rays lack from dens left join ring using (vx, vy, vz))"]
    for r in (1, 2, 3):
        ctes.append(f"y{r} as (select *, case when lack <= 0 then 0.0::double when rays{r} >= lack then lack / nullif(rays{r}, 0) else 1.0::double end k{r} from x{r - 1})")
        ctes.append(f"x{r} as (select * replace (lack - rays{r} * coalesce(k{r}, 0.0::double) as lack) from y{r})")
    final = ", ".join(f"round({c} + {' + '.join(f'{c}{r} * coalesce(k{r}, 0.0::double)' for r in (1, 2, 3))}, 4) {c}" for c in VOXEL)
    return ", ".join(ctes) + f" select vx, vy, vz, {final} from x3"


on_rays("vox06_neighbour_priors", lambda r: out(v.neighbour_priors(_density(r)), KEY, VOXEL, 4), f"{DENSITY}, {_priors_sql()}")
on_rays("vox07_foliage_area", lambda r: out(v.foliage_area(v.leaf_density(_density(r)), WIDTH), (), ("area",), 3), f"{DENSITY} select round(sum({LEAF}) * {WIDTH**3!r}::double, 3) area from dens")
on_rays("vox01_trunk_candidates", lambda r: v.grid_candidates(r, 0.6), """
x as (select k as "offset", cast(floor(ex / 0.6::double + (k % 2) / 2.0::double) as bigint) vx, cast(floor(ey / 0.6::double + (k // 2) / 2.0::double) as bigint) vy, cast(floor(ez / 0.6::double) as bigint) vz from rays, (select unnest(range(4))::int k) where alpha > 0),
n as (select "offset", vx, vy, vz, count(*) n from x group by all),
o as (select a.*, coalesce(u1.n, 0) >= 4 u1, coalesce(u2.n, 0) >= 4 u2, coalesce(d1.n, 0) >= 4 d1, coalesce(d2.n, 0) >= 4 d2 from n a
  left join n u1 on (a."offset", a.vx, a.vy, a.vz + 1) = (u1."offset", u1.vx, u1.vy, u1.vz) left join n u2 on (a."offset", a.vx, a.vy, a.vz + 2) = (u2."offset", u2.vx, u2.vy, u2.vz)
  left join n d1 on (a."offset", a.vx, a.vy, a.vz - 1) = (d1."offset", d1.vx, d1.vy, d1.vz) left join n d2 on (a."offset", a.vx, a.vy, a.vz - 2) = (d2."offset", d2.vx, d2.vy, d2.vz))
select "offset", vx, vy, vz, n from o where n >= 4 and ((u1 and d1) or (u1 and u2) or (d1 and d2))""")
_FIELD = "fld as (select cast(floor(ex / 1.0::double) as bigint) px, cast(floor(ey / 1.0::double) as bigint) py, min(ez) low, max(ez) high from rays where alpha > 0 group by all)"
on_rays("vox10_height_field", lambda r: out(v.height_field(r, 1.0), ("px", "py"), ("low", "high")), f"{_FIELD} select px, py, round(low, 6) low, round(high, 6) high from fld")
_DZ = "(ez - sz)"
_a, _b = (f"case when {_DZ} = 0 then case when sz between 2.0 and 4.0 then {x}::double else {y}::double end else {h} end" for x, y, h in (
    ("0.0", "1.0", f"greatest(0.0::double, least((2.0::double - sz) / nullif({_DZ}, 0), (4.0::double - sz) / nullif({_DZ}, 0)))"), ("1.0", "0.0", f"least(1.0::double, greatest((2.0::double - sz) / nullif({_DZ}, 0), (4.0::double - sz) / nullif({_DZ}, 0)))")))
_BITS = lambda src, n: f"(select vx // 4 - case when vx < 0 and vx % 4 <> 0 then 1 else 0 end px, vy // 4 - case when vy < 0 and vy % 4 <> 0 then 1 else 0 end py, bit_or(1 << cast((vx % 4 + 4) % 4 + 4 * ((vy % 4 + 4) % 4) as int)) {n} from {src} group by 1, 2)"
on_rays("vox08_occupancy", lambda r: out(v.occupancy(r, 2.0, 2.0, 4.0), ("px", "py"), ("space",)), f"""{walk_sql('rays', 0.5, axes='xy', a=_a, b=_b)},
e as (select cast(floor(ex / 0.5::double) as bigint) vx, cast(floor(ey / 0.5::double) as bigint) vy from rays where alpha > 0 and ez between 2.0 and 4.0),
fr as {_BITS('w', 'free')}, en as {_BITS('e', 'ended')}
select px, py, round(1.0::double - bit_count(free & ~coalesce(ended, 0)) / 16.0::double, 6) space from fr left join en using (px, py)""")
on_rays("vox09_pixel_rays", lambda r: v.pixel_rays(r, v.height_field(r, 1.0).where("high > 4.8"), 1.0), f"""{walk_sql('rays', 1.0, axes='xy')}, {_FIELD}
select distinct vx px, vy py, ray_id from w semi join (select px vx, py vy from fld where high > 4.8) s using (vx, vy)""")
_OFF = "o(ox, oy) as (select a, b from (select unnest([-1, 0, 1]) a), (select unnest([-1, 0, 1]) b))"
on_rays("win03_smooth_field", lambda r: out(v.smooth_field(v.height_field(r, 1.0).select("px", "py", F.col("high").alias("value"))), ("px", "py"), ("value",)), f"""{_FIELD}, {_OFF},
l as (select px + ox px, py + oy py, case when ox = 0 and oy = 0 then 2.0::double else 1.0::double end k, high, ox = 0 and oy = 0 own from fld, o)
select px, py, round(sum(k * high) / sum(k), 6) as value from l group by px, py having bool_or(own)""")
on_rays("win04_local_maxima", lambda r: out(v.local_maxima(v.height_field(r, 1.0).select("px", "py", F.col("high").alias("value"))), ("px", "py"), ("value",)), f"""{_FIELD}, {_OFF},
m as (select px + ox px, py + oy py, max(high) m from fld, o where ox <> 0 or oy <> 0 group by 1, 2) select px, py, round(high, 6) as value from fld left join m using (px, py) where high > coalesce(m, 0) and high > 0""")


def _cells(r):
    return r.where("alpha > 0").groupBy(F.floor(F.col("ex") * 12).alias("x"), F.floor(F.col("ey") * 12).alias("y")).agg(F.count("*").cast("double").alias("value"))


_TH = f"({math.pi!r}::double * (angle + 0.5::double) / 32.0::double)"
on_rays("exp05_radon", lambda r: out(v.radon(_cells(r), 256, 32), ("angle", "bin"), ("weight",), 4), f"""
cells as (select floor(ex * 12) x, floor(ey * 12) y, count(*)::double v from rays where alpha > 0 group by all), a as (select unnest(range(32))::int angle),
s as (select angle, v, 128.0::double + ((x - 128.0::double) * cos({_TH}) - (y - 128.0::double) * sin({_TH})) / {math.sqrt(2.0)!r}::double y from cells, a),
p as (select angle, cast(floor(y) as bigint) bin, v * (floor(y) + 1 - y) w from s union all select angle, cast(floor(y) as bigint) + 1, v * (y - floor(y)) from s)
select angle, bin, round(sum(w), 4) + 0.0::double weight from p group by all""")
