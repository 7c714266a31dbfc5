"""PRJ: per-ray projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import colour as c
from beamgrid.functions import geometry as g
from beamgrid.operators import project as p
from beamgrid.registry import register

from .common import COLOURS, POINTS, on_rays, out, sql_out

ALL = ("ray_id", *COLOURS)
FLOATS = (*POINTS, "time")
RGB = ("red", "green", "blue")


def _spectrum_sql(v: str, stops, cyclic: bool) -> str:
    """red, green, blue as bytes, of v in stops."""
    lists = ["[" + ", ".join(f"{s[k]}::double" for s in stops) + "]" for k in range(3)]
    i = f"cast(floor({v}) as bigint)"
    return ", ".join(f"cast(trunc(255.0::double * ({a}[{i} % 6 + 1] * (1.0::double - ({v} - floor({v}))) + {a}[({i} + 1) % 6 + 1] * ({v} - floor({v})))) as smallint) {n}" for a, n in zip(lists, RGB, strict=True))


def _matrix_sql(m, shift=(0.0, 0.0, 0.0)) -> str:
    return ", ".join(f"round({r[0]!r}::double * {q}x + {r[1]!r}::double * {q}y + {r[2]!r}::double * {q}z + {t!r}::double, 6) + 0.0::double {q}{a}" for q in "se" for a, r, t in zip("xyz", m, shift, strict=True))


on_rays("prj02_translate", lambda r: out(p.translate(r, (10.0, -20.5, 3.25), 30.0), ("ray_id",), FLOATS),
        f"select ray_id, {', '.join(f'round({q}{a} + {d}::double, 6) + 0.0::double {q}{a}' for q in 'se' for a, d in zip('xyz', (10.0, -20.5, 3.25)))}, round(time + 30.0::double, 6) + 0.0::double as time from rays")
_ROT = (10.0, 20.0, 30.0)
on_rays("prj03_rotate", lambda r: out(p.rotate(r, _ROT), ("ray_id",), POINTS), f"select ray_id, {_matrix_sql(g.rotation(_ROT))} from rays")
_Q = g.quaternion_matrix(0.8, 0.2, -0.4, 0.4)
on_rays("prj04_rigid_transform", lambda r: out(p.transform(r, _Q, (1.0, 2.0, 3.0), -5.0), ("ray_id",), FLOATS),
        f"select ray_id, {_matrix_sql(_Q, (1.0, 2.0, 3.0))}, round(time - 5.0::double, 6) + 0.0::double as time from rays")
on_rays("prj05_remove_start", lambda r: out(p.remove_start(r), ("ray_id",), POINTS),
        "o as (select arg_min(ex, ray_id) ox, arg_min(ey, ray_id) oy, arg_min(ez, ray_id) oz from rays) select ray_id, " + ", ".join(f"round({q}{a} - o{a}, 6) + 0.0::double {q}{a}" for q in "se" for a in "xyz") + " from rays, o")
on_rays("prj06_fixed_start", lambda r: out(p.fixed_start(r, (1.0, 2.0, 3.0)), ("ray_id",), POINTS), "select ray_id, 1.0::double sx, 2.0::double sy, 3.0::double sz, " + sql_out((), ("ex", "ey", "ez")) + " from rays")
on_rays("prj07_fixed_direction", lambda r: out(p.fixed_direction(r, (0.5, 0.25, 8.0)), ("ray_id",), POINTS),
        "select ray_id, " + ", ".join(f"round(e{a} - {d}::double, 6) + 0.0::double s{a}" for a, d in zip("xyz", (0.5, 0.25, 8.0))) + ", " + sql_out((), ("ex", "ey", "ez")) + " from rays")
_LEN = "sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz))"
on_rays("prj08_shorten_non_returns", lambda r: out(p.shorten_non_returns(r), ("ray_id", "alpha"), POINTS),
        f"x as (select ray_id, alpha, sx, sy, sz, {', '.join(f'case when alpha = 0 and ez < sz then s{a} + 0.1::double * (e{a} - s{a}) / {_LEN} else e{a} end e{a}' for a in 'xyz')} from rays) select {sql_out(('ray_id', 'alpha'), POINTS)} from x")
on_rays("prj09_full_intensity", lambda r: out(p.full_intensity(r), ALL), "select ray_id, red, green, blue, 255::smallint alpha from rays")
on_rays("prj10_flat_colour", lambda r: out(p.flat_alpha(p.flat_colour(r, (0.25, 0.5, 1.0)), 0.3), ALL), "select ray_id, 63::smallint red, 127::smallint green, 255::smallint blue, 76::smallint alpha from rays")
_T = "6.0::double * (time / 60.0::double - floor(time / 60.0::double))"
on_rays("prj11_colour_by_time", lambda r: out(p.colour_by_time(r), ALL), f"select ray_id, {_spectrum_sql(_T, c.SPECTRUM, True)}, alpha from rays")
_H = "6.0::double * (ez / 10.0::double - floor(ez / 10.0::double))"
on_rays("prj12_colour_by_height", lambda r: out(p.colour_by_height(r), ALL), f"select ray_id, {_spectrum_sql(_H, c.SPECTRUM, True)}, alpha from rays")
_A = "(0.5::double + 4.0::double * greatest(0.0::double, least(1.0::double, alpha / 255.0::double)))"
on_rays("prj13_colour_by_alpha", lambda r: out(p.colour_by_alpha(r), ALL), f"select ray_id, {_spectrum_sql(_A, c.GRADIENT, False)}, alpha from rays")


def _image(spark):
    n = F.col("id")
    return spark.range(64 * 48).select((n % 64).alias("px"), F.floor(n / 64).alias("py"), (n * 7 % 256).cast("short").alias("red"), (n * 11 % 256).cast("short").alias("green"), (n * 13 % 256).cast("short").alias("blue"))


register("prj14_colour_by_image", lambda s, d: out(p.colour_by_image(adapter.rays(s, d), _image(s), 64, 48), ALL), duck("""
b as (select min(ex) lx, max(ex) hx, min(ey) ly, max(ey) hy from rays where alpha > 0),
n as (select unnest(range(64 * 48)) n),
img as (select n % 64 px, n // 64 py, cast(n * 7 % 256 as smallint) red, cast(n * 11 % 256 as smallint) green, cast(n * 13 % 256 as smallint) blue from n),
x as (select ray_id, alpha, cast(greatest(0, least(63, floor(64.0::double * (ex - lx) / (hx - lx)))) as bigint) px, cast(greatest(0, least(47, floor(48.0::double * (ey - ly) / (hy - ly)))) as bigint) py from rays, b)
select ray_id, img.red, img.green, img.blue, alpha from x left join img using (px, py)"""))
_ID = [" + ".join(f"((y >> {i}) & 1) * {1 << (7 - i // 3)}" for i in range(k, 24, 3)) for k in range(3)]
on_rays("prj19_id_colours", lambda r: out(p.colour_by_id(r, F.col("ray_id")).withColumn("id", c.colour_to_id(F.col("red"), F.col("green"), F.col("blue"))), ("ray_id", *RGB, "id")),
        f"x as (select ray_id, ray_id + 1 y from rays) select ray_id, {', '.join(f'cast({e} as smallint) {n}' for e, n in zip(_ID, RGB))}, ray_id id from x")
on_rays("prj22_time_text", lambda r: out(p.time_text(r), ("ray_id", "when")), "select ray_id, strftime(make_timestamp(cast(floor(time) as bigint) * 1000000), '%a %d/%m/%Y %H:%M:%S') \"when\" from rays")


def _raster(r):
    return r.groupBy(g.floor_index("ex", 2.0).alias("px"), g.floor_index("ey", 2.0).alias("py")).agg(F.min("ray_id").alias("value"))


def _ground(r, width: float):
    return r.where("alpha > 0").groupBy(g.floor_index("ex", width).alias("px"), g.floor_index("ey", width).alias("py")).agg(F.min("ez").alias("value"))


on_rays("prj23_raster_colours", lambda r: out(p.colour_by_raster(r, _raster(r.where("alpha > 100")), 2.0), ALL), f"""
k as (select *, cast(floor(ex / 2.0::double) as bigint) px, cast(floor(ey / 2.0::double) as bigint) py from rays),
ras as (select px, py, min(ray_id) v from k where alpha > 100 group by px, py), x as (select ray_id, alpha, coalesce(v, -1) + 1 y from k left join ras using (px, py))
select ray_id, {', '.join(f'cast({e} as smallint) {n}' for e, n in zip(_ID, RGB))}, alpha from x""")
on_rays("prj21_subtract_ground", lambda r: out(p.subtract_ground(r, _ground(r, 0.25), 0.25), ("ray_id",), ("sz", "ez")), f"""
k as (select *, cast(floor(ex / 0.25::double) as bigint) px, cast(floor(ey / 0.25::double) as bigint) py from rays),
gr as (select px, py, min(ez) v from k where alpha > 0 group by px, py), x as (select ray_id, sz - coalesce(v, 0.0::double) sz, ez - coalesce(v, 0.0::double) ez from k left join gr using (px, py))
select {sql_out(('ray_id',), ('sz', 'ez'))} from x""")
