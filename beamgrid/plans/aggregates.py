"""AGG, DEC, WIN, SRT, SET: aggregates, decimation, order and set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import geometry as g
from beamgrid.operators import decimate as dec
from beamgrid.operators import info as i
from beamgrid.operators import order as o
from beamgrid.registry import register

from .common import COLOURS, POINTS, on_rays, out, sql_out
from .filters import LENGTH

_VOX = lambda w, t="": ", ".join(f"cast(floor({t}e{a} / {float(w)!r}::double) as bigint) v{a}" for a in "xyz")
_B = {"ends": ("case when alpha > 0 then e{a} end",) * 2, "starts": ("s{a}",) * 2, "rays": ("least(s{a}, e{a})", "greatest(s{a}, e{a})")}
_BOUNDS = [(f"{n}_{m}_{a}", f"{m}({p[k].format(a=a)})") for n, p in _B.items() for a in "xyz" for k, m in enumerate(("min", "max"))]
_INFO = [*[n for n, _ in _BOUNDS], "min_time", "max_time", *[f"centroid_{a}" for a in "xyz"], *[f"{n}_{a}" for n in ("first", "last") for a in "xyz"]]


def _sel(pairs, digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0::double {n}" for n, e in pairs)


_INFO_SQL = [*_BOUNDS, ("min_time", "min(time)"), ("max_time", "max(time)"), *[(f"centroid_{a}", f"avg(e{a}) filter (alpha > 0)") for a in "xyz"],
             *[(f"first_{a}", f"arg_min(s{a}, (time, ray_id))") for a in "xyz"], *[(f"last_{a}", f"arg_max(s{a}, (time, -ray_id))") for a in "xyz"]]
on_rays("agg01_cloud_info", lambda r: out(i.cloud_info(r), ("num_rays", "num_bounded"), _INFO), f"select count(*) num_rays, count(*) filter (alpha > 0) num_bounded, {_sel(_INFO_SQL)} from rays")
_BB = [(f"{m}_{a}", f"{m}(case when alpha > 0 then {h}(s{a}, e{a}) end)") for a in "xyz" for m, h in (("min", "least"), ("max", "greatest"))]
on_rays("agg02_bounded_bounds", lambda r: out(i.bounded_bounds(r), (), [n for n, _ in _BB]), f"select {_sel(_BB)} from rays")
_MOM = [(f"{n}_{m}_{a}", f"{f}({q}{a})") for n, q in (("start", "s"), ("end", "e")) for m, f in (("mean", "avg"), ("sd", "stddev_pop")) for a in "xyz"]
_MOM += [("time_mean", "avg(time)"), ("time_sd", "stddev_pop(time)"), *[(f"{c}_mean", f"avg({c} / 255::double)") for c in COLOURS], *[(f"{c}_sd", f"stddev_pop({c} / 255::double)") for c in COLOURS]]
on_rays("agg03_moments", lambda r: out(i.moments(r), (), [n for n, _ in _MOM], 3), f"select {_sel(_MOM, 3)} from rays")
_PARENT = "p as (select a.*, b.x px, b.y py, b.z pz from segments a join segments b on a.tree_id = b.tree_id and a.parent_id = b.seg_id), v as (select tree_id, pi() * sum(sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) * radius * radius) volume from p group by tree_id)"
_FM = ("sum_root", "sum_root_squares", "sum_radius", "sum_radius_squares", "volume")
on_rays("agg04_forest_moments", lambda s: out(i.forest_moments(s), ("trees",), _FM, 3), f"""{_PARENT}, r as (select * from segments where seg_id = 0)
select count(*) trees, round(sqrt(sum(x) ** 2 + sum(y) ** 2 + sum(z) ** 2), 3) sum_root, round(sqrt(sum(x * x) ** 2 + sum(y * y) ** 2 + sum(z * z) ** 2), 3) sum_root_squares,
  round(sum(radius), 3) sum_radius, round(sum(radius * radius), 3) sum_radius_squares, round((select sum(volume) from v), 3) volume from r""", "segments")
on_rays("agg04_mesh_moments", lambda s: out(i.mesh_moments(s), (), [f"{m}_{a}" for m in ("mean", "sd") for a in "xyz"], 5),
        "select " + ", ".join(f"round({f}({a}), 5) {m}_{a}" for m, f in (("mean", "avg"), ("sd", "stddev_pop")) for a in "xyz") + " from segments", "segments")
on_rays("agg05_tree_volume", lambda s: out(i.tree_volumes(s), ("tree_id",), ("volume",), 5), f"{_PARENT} select tree_id, round(volume, 5) volume from v", "segments")
on_rays("agg06_area", lambda r: out(i.area(r), ("pixels",), ("area",)), "c as (select distinct floor(ex / 0.5::double), floor(ey / 0.5::double) from rays where alpha > 0) select count(*) pixels, count(*) * 0.25::double area from c")
_PATH = """x as (select *, lag(time) over w lt, sqrt((sx - lag(sx) over w) ** 2 + (sy - lag(sy) over w) ** 2 + (sz - lag(sz) over w) ** 2) d from rays window w as (order by ray_id)),
y as (select time < lt back, abs(time - lt) > 1.00001 tj, d > 1.00001 sj, d, abs(time - lt) dt from x where lt is not null)
select count(*) filter (back) out_of_order, count(*) filter (tj) time_jumps, count(*) filter (sj) space_jumps, count(*) filter (tj or sj) + 1 blocks,
  round(coalesce(sum(d) filter (not (tj or sj)), 0.0::double), 4) path_length, round(coalesce(sum(dt) filter (not (tj or sj)), 0.0::double), 4) path_period from y"""
on_rays("agg07_path_statistics", lambda r: out(i.path_statistics(r), ("out_of_order", "time_jumps", "space_jumps", "blocks"), ("path_length", "path_period"), 4), _PATH)
_LC = [f"{m}_{c}" for c in COLOURS for m in ("min", "max")]
on_rays("agg08_lengths_and_colours", lambda r: out(i.lengths_and_colours(r), _LC, ("min_length", "max_length", "max_bounded", "mean_bounded")),
        f"select round(min({LENGTH}), 6) min_length, round(max({LENGTH}), 6) max_length, round(max({LENGTH}) filter (alpha > 0), 6) max_bounded, round(avg({LENGTH}) filter (alpha > 0), 6) mean_bounded, " + ", ".join(f"{m}({c}) filter (alpha > 0) {m}_{c}" for c in COLOURS for m in ("min", "max")) + " from rays")
on_rays("nn05_point_spacing", lambda r: out(i.point_spacing(r), ("n", "voxels"), ("spacing",)), """
b as (select 5.0::double * pow((max(ex) - min(ex)) * (max(ey) - min(ey)) * (max(ez) - min(ez)), 1.0::double / 3.0::double) / sqrt(count(*)) w, count(*) n from rays where alpha > 0),
c as (select distinct floor(ex / w), floor(ey / w), floor(ez / w) from rays, b where alpha > 0)
select n, (select count(*) from c) voxels, round(w / sqrt(n::double / (select count(*) from c)), 6) spacing from b""")

_FIRST = lambda keys, where="": f"select {sql_out(('ray_id', *COLOURS), (*POINTS, 'time'))} from rays {where} qualify row_number() over (partition by {keys} order by ray_id) = 1"
_ALL = lambda df: out(df, ("ray_id", *COLOURS), (*POINTS, "time"))
_FL = lambda w: ", ".join(f"floor(e{a} / {float(w)!r}::double)" for a in "xyz")
on_rays("dec01_voxel_decimate", lambda r: _ALL(dec.voxels(r, 0.5)), _FIRST(_FL(0.5)))
on_rays("dec02_every_nth", lambda r: out(dec.every_nth(r, 7), ("ray_id",)), "select ray_id from rays qualify (row_number() over (order by ray_id) - 1) % 7 = 0")
on_rays("dec03_spatio_temporal", lambda r: out(dec.spatio_temporal(r, 1.0, 3), ("ray_id",)), f"""
v as (select ray_id, {_VOX(1.0)} from rays), c as (select vx, vy, vz, count(*) n from v group by all),
m as (select a.vx, a.vy, a.vz, max(b.n) f from c a join c b on abs(a.vx - b.vx) <= 1 and abs(a.vy - b.vy) <= 1 and abs(a.vz - b.vz) <= 1 group by all),
l as (select v.*, row_number() over (partition by vx, vy, vz order by ray_id desc) k from v), s as (select ray_id, k::double k, greatest(1.0::double, f / 3.0::double) s from l join m using (vx, vy, vz))
select ray_id from s where (k + 1.0) % s <= k % s""")
_W = "[" + ", ".join(f"{math.sqrt(2.0) ** k!r}::double" for k in range(-20, 51)) + "]"
_S = "[" + ", ".join(f"{math.sqrt(2.0) ** k!r}::double" for k in range(1, 71)) + "]"
on_rays("dec05_angular", lambda r: out(dec.angular(r, 5.0), ("ray_id",)), f"""
l as (select ray_id, ex, ey, ez, cast(greatest(-20, least(50, round(ln({2.0 * 0.01 * 5.0!r}::double * {LENGTH}) / {math.log(math.sqrt(2.0))!r}::double))) as int) lv from rays),
v as (select ray_id, lv, {', '.join(f'cast(floor(e{a} / ({_W})[lv + 21]) as bigint) v{a}' for a in 'xyz')} from l),
f as (select lv, vx, vy, vz, min(ray_id) ray_id from v group by all),
s as (select distinct u.lv, {', '.join(f'cast(floor(f.v{a} / ({_S})[u.lv - f.lv]) as bigint) v{a}' for a in 'xyz')} from f join (select distinct lv from f) u on u.lv > f.lv)
select ray_id from f anti join s using (lv, vx, vy, vz)""")
on_rays("dec06_time_slots", lambda r: _ALL(dec.time_slots(r, 1800.0)), _FIRST("floor(time / 1800.0::double)"))
register("dec04_ray_space", lambda s, d: out(dec.ray_space(adapter.rays(s, d), 1.0), ("ray_id",)))

on_rays("win01_adjacent_rays", lambda r: out(o.adjacent_change(r), ("ray_id",), ("range_change", "time_change")), f"""
x as (select ray_id, {LENGTH} r, time from rays), y as (select ray_id, r - lag(r) over w range_change, time - lag(time) over w time_change from x window w as (order by ray_id))
select {sql_out(('ray_id',), ('range_change', 'time_change'))} from y""")


def _left(r):
    from pyspark.sql import Window

    return r.withColumns(g.voxel(1.0)).select("ray_id", F.row_number().over(Window.partitionBy("vx", "vy", "vz").orderBy(F.col("ray_id").desc())).cast("long").alias("left"))


on_rays("win02_count_down", _left, f"select ray_id, row_number() over (partition by {_FL(1.0)} order by ray_id desc) as \"left\" from rays")
on_rays("win05_percentiles", lambda r: out(r.groupBy("alpha").agg(F.avg("ez").alias("mean"), F.median("ez").alias("median"), F.element_at(F.array_sort(F.collect_list("ez")), (F.floor(F.lit(0.9) * F.count("*")) + 1).cast("int")).alias("p90")), ("alpha",), ("mean", "median", "p90"), 8),
        "select alpha, round(avg(ez), 8) mean, round(median(ez), 8) median, round(list_sort(list(ez))[cast(floor(0.9::double * count(*)) as bigint) + 1], 8) p90 from rays group by alpha")
on_rays("srt01_by_time", lambda r: out(r.orderBy("time", "ray_id"), ("ray_id",), ("time",)), "select ray_id, round(time, 6) as time from rays order by rays.time, ray_id")
on_rays("srt02_trees_by_radius", lambda s: out(s.groupBy("tree_id").agg(F.max("radius").alias("crown")).orderBy(F.col("crown").desc(), "tree_id"), ("tree_id",), ("crown",)), "select tree_id, round(max(radius), 6) crown from segments group by tree_id order by max(radius) desc, tree_id", "segments")
on_rays("srt03_fullest_voxel", lambda r: r.withColumns(g.voxel(2.0)).groupBy("vx", "vy", "vz").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "vx", "vy", "vz").limit(1), f"v as (select {_VOX(2.0)} from rays) select vx, vy, vz, count(*) n from v group by all order by n desc, vx, vy, vz limit 1")


def _peak(r):
    from pyspark.sql import Window

    n = r.groupBy(F.floor(F.col("ex")).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    w = Window.orderBy("bin")  # over a histogram's bins
    x = n.withColumns({"y0": F.lag("n").over(w), "y2": F.lead("n").over(w)}).where("n > y0 and n > y2")
    return out(x.withColumn("peak", F.col("bin") + F.lit(0.5) * (F.col("y0") - F.col("y2")) / (F.col("y0") + F.col("y2") - 2.0 * F.col("n"))), ("bin",), ("peak",))


on_rays("srt04_parabola_peaks", _peak, """n as (select cast(floor(ex) as bigint) bin, count(*)::double n from rays group by 1),
x as (select *, lag(n) over (order by bin) y0, lead(n) over (order by bin) y2 from n) select bin, round(bin + 0.5::double * (y0 - y2) / (y0 + y2 - 2.0::double * n), 6) peak from x where n > y0 and n > y2""")
register("set01_union_all", lambda s, d: out(adapter.rays(s, d).unionByName(adapter.rays_b(s, d)), ("ray_id",), ("ex", "ey", "ez")), duck(f"x as (select * from rays union all select * from rays_b) select {sql_out(('ray_id',), ('ex', 'ey', 'ez'))} from x", "rays_b"))
register("set03_partition", lambda s, d: adapter.rays(s, d).groupBy(F.when(F.col("time") > 1704070000.0, "outside").otherwise("inside").alias("side")).agg(F.count("*").alias("n")), duck("select case when time > 1704070000.0 then 'outside' else 'inside' end side, count(*) n from rays group by 1"))
