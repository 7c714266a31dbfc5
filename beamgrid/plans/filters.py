"""FLT: predicate splits, and CLP: geometric ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid.adapter import duck
from beamgrid import adapter
from beamgrid.functions import geometry as g
from beamgrid.operators import clip as k
from beamgrid.operators import filters as f
from beamgrid.registry import register

from .common import COLOURS, POINTS, on_rays, out, sql_out

SIDE = ("ray_id", "side")
LENGTH = "sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz))"


def _split(name, op, outside: str, ctes: str = "", tables: str = "rays") -> None:
    on_rays(name, lambda r: out(op(r), SIDE), f"{ctes}select ray_id, case when {outside} then 'outside' else 'inside' end side from {tables}")


_T = 1704070000.0
_split("flt01_split", lambda r: f.split(r, F.col("ez") > 2.5), "ez > 2.5")
_split("flt02_time", lambda r: f.by_time(r, _T), f"time > {_T}")
_split("flt03_time_percent", lambda r: f.by_time_percent(r, 40), "time > a + (b - a) * 40.0::double / 100.0::double", "m as (select min(time) a, max(time) b from rays) ", "rays, m")
_split("flt04_alpha", lambda r: f.by_alpha(r, 0.4), "alpha > 102")
_D = (0.5, 0.5, -0.25)
_n = sum(x * x for x in _D)
_split("flt05_direction", lambda r: f.by_direction(r, _D), f"((ex - sx) / {LENGTH}) * {_D[0] / _n!r}::double + ((ey - sy) / {LENGTH}) * {_D[1] / _n!r}::double + ((ez - sz) / {LENGTH}) * {_D[2] / _n!r}::double > 1.0")
_C = (0.3, 0.2, 0.4)
_m = sum(x * x for x in _C)
_split("flt06_colour", lambda r: f.by_colour(r, _C), " + ".join(f"({c} / 255.0::double) * {v / _m!r}::double" for c, v in zip(("red", "green", "blue"), _C)) + " > 1.0")
_split("flt07_single_colour", lambda r: f.by_single_colour(r, (30, 180, 90)), "not (red = 30 and green = 180 and blue = 90)")
_split("flt08_range", lambda r: f.by_range(r, 9.0), f"{LENGTH} > 9.0")
on_rays("flt09_remove_unbounded", lambda r: out(f.remove_unbounded(r), ("ray_id", "alpha")), "select ray_id, alpha from rays where alpha > 0")
on_rays("flt10_by_colour", lambda r: out(f.number_colours(r), ("ray_id", "part")), "select ray_id, dense_rank() over (order by red, green, blue) - 1 part from rays")
on_rays("flt14_denoise_range", lambda r: out(f.denoise_by_range(r, 0.1), ("ray_id",)), f"""
x as (select ray_id, alpha, {LENGTH} r1 from rays), y as (select *, lag(r1) over w r0, lead(r1) over w r2 from x window w as (order by ray_id))
select ray_id from y where r0 is not null and r2 is not null and (alpha = 0 or least(abs(r0 - r2), abs(r1 - r0), abs(r2 - r1)) < 0.1)""")
on_rays("flt15_denoise_distance", lambda r: out(f.denoise_by_distance(r, 0.5), ("ray_id",)), """
select ray_id from rays a where alpha = 0 or exists (select 1 from rays b where b.ray_id <> a.ray_id and
  (a.ex - b.ex) * (a.ex - b.ex) + (a.ey - b.ey) * (a.ey - b.ey) + (a.ez - b.ez) * (a.ez - b.ez) < 0.25)""", "rays")
on_rays("flt17_crop", lambda r: out(f.crop_to_cell(r, 6.0, (1, 2)), ("ray_id",)), "select ray_id from rays where floor(0.5::double + ex / 6.0::double) = 1 and floor(0.5::double + ey / 6.0::double) = 2")


def _slab(low, high) -> str:
    """n and f: where a ray enters and leaves a box; low and high are SQL."""
    near, far = ["0.0::double"], ["1.0::double"]
    for a, lo, hi in zip("xyz", low, high):
        d, one, two = f"(e{a} - s{a})", f"({lo} - s{a}) / nullif(e{a} - s{a}, 0)", f"({hi} - s{a}) / nullif(e{a} - s{a}, 0)"
        near.append(f"case when {d} = 0 then case when s{a} >= {lo} and s{a} <= {hi} then 0.0::double else 2.0::double end else least({one}, {two}) end")
        far.append(f"case when {d} = 0 then case when s{a} >= {lo} and s{a} <= {hi} then 1.0::double else -1.0::double end else greatest({one}, {two}) end")
    return f"greatest({', '.join(near)}) n, least({', '.join(far)}) f"


def _lits(v) -> list[str]:
    return [f"({float(x)!r}::double)" for x in v]


_AT = lambda axis, t: f"case when {t} = 0.0 then s{axis} when {t} = 1.0 then e{axis} else s{axis} + (e{axis} - s{axis}) * {t} end"
#: From a relation parts (ray columns, side, a, b, has_end) to rounded parts.
_PARTS = "cut as (select ray_id, side" + "".join(f", {_AT(x, t)} {q}{x}" for q, t in (("s", "a"), ("e", "b")) for x in "xyz") + "".join(f", case when has_end then {c} else 0::smallint end {c}" for c in COLOURS) + " from parts)"
_KEYS = ("ray_id", "side", *COLOURS)
LO, HI = (4.0, 5.0, 1.0), (12.0, 15.0, 4.0)
on_rays("clp01_clip_box", lambda r: out(k.clip_to_box(r, LO, HI), ("ray_id", "alpha"), POINTS), f"""
x as (select *, {_slab(_lits(LO), _lits(HI))} from rays), parts as (select *, '' side, n a, f b, f = 1.0 has_end from x where n < f), {_PARTS} select {sql_out(('ray_id', 'alpha'), POINTS)} from cut""")
on_rays("clp02_hits_box", lambda r: out(k.hits_box(r, LO, HI), ("ray_id", "hits")), f"x as (select ray_id, {_slab(_lits(LO), _lits(HI))} from rays) select ray_id, n < f hits from x")
on_rays("clp03_in_box", lambda r: out(r.where(k.in_box(LO, HI)), ("ray_id",)), "select ray_id from rays where " + " and ".join(f"e{a} >= {lo} and e{a} < {hi}" for a, lo, hi in zip("xyz", LO, HI)))


def _boxes(s, d):
    r = adapter.rays(s, d)
    b = lambda n: r.groupBy((F.col("ray_id") % 40).alias("k")).agg(*[h(f"e{a}").alias(f"{n}_{q}_{a}") for q, h in (("lo", F.min), ("hi", F.max)) for a in "xyz"])
    x, y = b("a"), b("b").withColumn("k", (F.col("k") + 1) % 40)
    x = x.withColumns({"a_hi_x": F.col("a_lo_x") + F.lit(0.01), "a_hi_y": F.col("a_lo_y") + 1.0})
    return out(k.boxes_overlap(x.join(y, "k")), ("k", "overlaps"))


register("clp04_box_overlap", _boxes, duck("""
b as (select ray_id % 40 k, min(ex) lx, max(ex) hx, min(ey) ly, max(ey) hy, min(ez) lz, max(ez) hz from rays group by 1)
select a.k, a.lx <= c.hx and c.lx <= a.lx + 0.01::double and a.ly <= c.hy and c.ly <= a.ly + 1.0::double and a.lz <= c.hz and c.lz <= a.hz as "overlaps" from b a join b c on a.k = (c.k + 1) % 40"""))
_P = (3.0, 6.0, 1.5)
_ps = sum(x * x for x in _P)
_dot = lambda q: " + ".join(f"{q}{a} * {v / _ps!r}::double" for a, v in zip("xyz", _P))
on_rays("clp05_split_plane", lambda r: out(k.split_plane(r, _P), _KEYS, POINTS), f"""
d as (select *, {_dot('s')} - 1.0::double d1, {_dot('e')} - 1.0::double d2 from rays), x as (select *, d1 * d2 <= 0.0 and d1 <> d2 c, d1 / nullif(d1 - d2, 0) t from d),
parts as (select *, case when d1 > 0 then 'outside' else 'inside' end side, 0.0::double a, 1.0::double b, true has_end from x where not c
  union all select *, case when d1 > 0 then 'outside' else 'inside' end, 0.0::double, t, false from x where c
  union all select *, case when d1 > 0 then 'inside' else 'outside' end, t, 1.0::double, true from x where c), {_PARTS} select {sql_out(_KEYS, POINTS)} from cut""")
_BC, _BR = (8.0, 10.0, 2.0), (3.0, 4.0, 0.0)
_bl = [c - (r or 1e7) for c, r in zip(_BC, _BR)]
_bh = [c + (r or 1e7) for c, r in zip(_BC, _BR)]
on_rays("clp06_split_box", lambda r: out(k.split_box(r, _BC, _BR), _KEYS, POINTS), f"""
x as (select *, {_slab(_lits(_bl), _lits(_bh))}, {" and ".join(f"e{a} >= {lo} and e{a} < {hi}" for a, lo, hi in zip("xyz", _lits(_bl), _lits(_bh)))} ins from rays),
parts as (select *, 'outside' side, 0.0::double a, 1.0::double b, true has_end from x where not n < f union all select *, 'inside', n, f, ins from x where n < f
  union all select *, 'outside', 0.0::double, n, false from x where n < f and n > 0 union all select *, 'outside', f, 1.0::double, true from x where n < f and f < 1), {_PARTS}
select {sql_out(_KEYS, POINTS)} from cut""")
_CA, _CB, _CR = (6.0, 6.0, 1.0), (12.0, 12.0, 5.0), 1.5
_cl = sum((b - a) ** 2 for a, b in zip(_CA, _CB)) ** 0.5
_ax = [(b - a) / _cl for a, b in zip(_CA, _CB)]


def _capsule_sql() -> str:
    d = dict(zip("xyz", (f"{v!r}::double" for v in _ax)))
    r = {a: f"(e{a} - s{a})" for a in "xyz"}
    fa = {a: f"(s{a} - {v!r}::double)" for a, v in zip("xyz", _CA)}
    dot = lambda p, q: "(" + " + ".join(f"{p[a]} * {q[a]}" for a in "xyz") + ")"
    cross = {"x": f"({d['y']} * {r['z']} - {d['z']} * {r['y']})", "y": f"({d['z']} * {r['x']} - {d['x']} * {r['z']})", "z": f"({d['x']} * {r['y']} - {d['y']} * {r['x']})"}
    side = {a: f"({r[a]} - {d[a]} * al)" for a in "xyz"}
    sphere = []
    for i, e in enumerate((_CA, _CB)):
        to = {a: f"({v!r}::double - s{a})" for a, v in zip("xyz", e)}
        rest = {a: f"({to[a]} - {r[a]} * m{i})" for a in "xyz"}
        sphere.append((dot(to, r), dot(rest, rest)))
    return f"""
b0 as (select *, {dot(r, d)} al, {dot(r, r)} rl, sqrt({dot(cross, cross)}) mag, abs({dot(fa, cross)}) gp, {dot(fa, d)} fd from rays),
b1 as (select *, gp / nullif(mag, 0) gap, {dot(side, side)} ss, -{dot(fa, side)} sf, {sphere[0][0]} / rl m0, {sphere[1][0]} / rl m1 from b0),
b2 as (select *, sqrt(greatest({_CR ** 2!r}::double - gap * gap, 0.0::double)) / nullif(sqrt(ss), 0) sh, sf / nullif(ss, 0) md, {sphere[0][1]} o0, {sphere[1][1]} o1 from b1),
b3 as (select *, md - sh c1, md + sh c2 from b2),
b4 as (select *, case when gap < {_CR} and (fd + c1 * al) / {_cl!r}::double > 0 and (fd + c1 * al) / {_cl!r}::double < 1 then c1 else 1e10::double end k1,
  case when gap < {_CR} and (fd + c2 * al) / {_cl!r}::double > 0 and (fd + c2 * al) / {_cl!r}::double < 1 then c2 else -1e10::double end k2,
  {', '.join(f"case when o{i} < {_CR ** 2!r} then m{i} - sqrt(greatest({_CR ** 2!r}::double - o{i}, 0.0::double)) / sqrt(rl) else 1e10::double end p{i}, case when o{i} < {_CR ** 2!r} then m{i} + sqrt(greatest({_CR ** 2!r}::double - o{i}, 0.0::double)) / sqrt(rl) else -1e10::double end q{i}" for i in (0, 1))} from b3),
b5 as (select *, least(k1, p0, p1) n, greatest(k2, q0, q1) f from b4),
x as (select *, coalesce(gap >= {_CR}, false) or n >= 1.0 or f <= 0.0 o from b5),
parts as (select *, 'outside' side, 0.0::double a, 1.0::double b, true has_end from x where o union all select *, 'outside', 0.0::double, n, false from x where not o and n > 0
  union all select *, 'outside', f, 1.0::double, true from x where not o and f < 1 union all select *, 'inside', greatest(n, 0.0::double), least(f, 1.0::double), f >= 1 from x where not o), {_PARTS}
select {sql_out(_KEYS, POINTS)} from cut"""


on_rays("clp07_split_capsule", lambda r: out(k.split_capsule(r, _CA, _CB, _CR), _KEYS, POINTS), _capsule_sql())
_CELL = ("ray_id", "cx", "cy", "cz", "ct", *COLOURS)
_gl = [f"(c{a} - 0.5::double) * {w}::double - 0.25::double" for a, w in zip("xy", (5.0, 4.0))] + ["-1e7::double"]
_gh = [f"(c{a} + 0.5::double) * {w}::double + 0.25::double" for a, w in zip("xy", (5.0, 4.0))] + ["1e7::double"]
_range = lambda a, w: f"unnest(range(cast(floor(0.5::double + (least(s{a}, e{a}) - 0.25::double) / {w}::double) as bigint), cast(floor(0.5::double + (greatest(s{a}, e{a}) + 0.25::double) / {w}::double) as bigint) + 1)) c{a}"
on_rays("clp08_split_grid", lambda r: out(k.split_grid(r, (5.0, 4.0, 0.0), 0.5, 3600.0), _CELL, POINTS), f"""
g1 as (select *, {_range('x', 5.0)} from rays), g2 as (select *, {_range('y', 4.0)} from g1),
x as (select *, 0::bigint cz, cast(floor(0.5::double + time / 3600.0::double) as bigint) ct, {_slab(_gl, _gh)}, {" and ".join(f"e{a} >= {lo} and e{a} < {hi}" for a, lo, hi in zip("xyz", _gl, _gh))} has_end from g2),
parts as (select *, '' side, n a, f b from x where n < f),
cut as (select ray_id, cx, cy, cz, ct{"".join(f", {_AT(a, t)} {q}{a}" for q, t in (("s", "a"), ("e", "b")) for a in "xyz")}{"".join(f", case when has_end then {c} else 0::smallint end {c}" for c in COLOURS)} from parts)
select {sql_out(_CELL, POINTS)} from cut""")
