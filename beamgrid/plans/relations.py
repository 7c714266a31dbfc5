"""JON, NN, DIF, MRG: joins, neighbours, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.functions import geometry as g
from beamgrid.operators import decimate as dec
from beamgrid.operators import joins as j
from beamgrid.operators import neighbours as nn
from beamgrid.registry import register

from .common import COLOURS, on_rays, out, sql_out


def _edited(s, d):
    """A decimated cloud without some rays and with some others."""
    r = adapter.rays(s, d)
    one = dec.voxels(r, 1.0)
    return r, one, one.where("ray_id % 5 <> 0").unionByName(adapter.rays_b(s, d).where("ray_id % 97 = 1").withColumn("time", F.col("time") + 0.25))


_ONE = "one as (select * from rays qualify row_number() over (partition by floor(ex), floor(ey), floor(ez) order by ray_id) = 1), ed as (select * from one where ray_id % 5 <> 0 union all select * replace (time + 0.25::double as time) from rays_b where ray_id % 97 = 1)"
register("jon01_match_by_time", lambda s, d: (lambda x: j.time_differences(x[2], x[1]))(_edited(s, d)), duck(f"""{_ONE},
p as (select a.ray_id l, b.ray_id r from one a join ed b on abs(a.time - b.time) <= 1e-7)
select l ray_id, 'matched' change from p union all select ray_id, 'removed' from one where ray_id not in (select l from p) union all select ray_id, 'added' from ed where ray_id not in (select r from p)""", "rays_b"))
register("jon02_restore_voxels", lambda s, d: (lambda x: out(j.restore_voxels(x[0], x[1], x[2], 1.0), ("ray_id",)))(_edited(s, d)), duck(f"""{_ONE},
k as (select distinct floor(ex) x, floor(ey) y, floor(ez) z from one where exists (select 1 from ed where abs(ed.time - one.time) <= 1e-7))
select ray_id from rays where (floor(ex), floor(ey), floor(ez)) in (select (x, y, z) from k)""", "rays_b"))
register("jon03_restore_nth", lambda s, d: out(j.restore_nth(adapter.rays(s, d), 10, adapter.rays(s, d).where("ray_id % 10 = 0 and ray_id % 3 <> 0")), ("ray_id",)), duck("""
n as (select *, row_number() over (order by ray_id) - 1 i from rays), p as (select i // 10 k from n where i % 10 = 0 and ray_id % 10 = 0 and ray_id % 3 <> 0)
select ray_id from n where (i + 5) // 10 in (select k from p)"""))
_SPAN = """t as (select *, lead(time) over w tb, lead(x) over w xb, lead(y) over w yb, lead(z) over w zb from trajectory window w as (order by time)),
n as (select * from t where tb is not null), mm as (select min(tb) lo, max(time) hi from n),
q as (select r.ray_id, r.time rt, n.* from rays r, mm, n where case when r.time <= lo then n.tb = lo when r.time > hi then n.time = hi else r.time > n.time and r.time <= n.tb end),
u as (select *, (rt - time) / (tb - time) u from q)"""
register("jon05_starts_from_trajectory", lambda s, d: out(j.starts_from_trajectory(adapter.rays(s, d), adapter.trajectory(s, d)), ("ray_id",), ("sx", "sy", "sz")), duck(f"""{_SPAN}
select ray_id, {', '.join(f'round({a} * (1.0::double - u) + {a}b * u, 6) + 0.0::double s{a}' for a in 'xyz')} from u""", "trajectory"))
register("jon06_nearest_node", lambda s, d: out(j.nearest_node(adapter.rays(s, d), adapter.trajectory(s, d)), ("ray_id",), ("x", "y", "z")), duck(f"""{_SPAN}
select ray_id, {', '.join(f'round(case when u < 0.5 then {a} else {a}b end, 6) {a}' for a in 'xyz')} from u""", "trajectory"))
_QK = ", ".join(f"floor({p}{a} / 0.01::double) q{p}{a}" for p in "se" for a in "xyz")
_QN = "(" + ", ".join(f"q{p}{a}" for p in "se" for a in "xyz") + ")"
_TW = f"""qa as (select ray_id, time, {_QK} from rays where ray_id % 4 <> 1), qb as (select ray_id, time, {_QK} from rays where ray_id % 4 <> 2 union all select ray_id, time, {_QK} from rays_b where ray_id % 4 = 2), q0 as (select {_QK} from rays where ray_id % 5 <> 4),
pref as (select case when (select arg_min(time, ray_id) from qa) > (select arg_min(time, ray_id) from qb) then 'a' else 'b' end p),
fx as (select ray_id, 'a' cloud, 'fixed' part from qa, pref where p = 'a' and {_QN} in (select {_QN} from qb) union all select ray_id, 'b', 'fixed' from qb, pref where p = 'b' and {_QN} in (select {_QN} from qa)),
ch as (select ray_id, 'a' cloud, 'changed' part from qa where {_QN} not in (select {_QN} from q0) union all select ray_id, 'b', 'changed' from qb where {_QN} not in (select {_QN} from q0))"""


def _three(s, d):
    r = adapter.rays(s, d)
    return j.three_way(r.where("ray_id % 5 <> 4"), r.where("ray_id % 4 <> 1"), r.where("ray_id % 4 <> 2").unionByName(adapter.rays_b(s, d).where("ray_id % 4 = 2")))


register("jon08_three_way", _three, duck(f"{_TW} select * from fx union all select * from ch", "rays_b"))
register("set02_quantised_sets", lambda s, d: _three(s, d).groupBy("cloud", "part").agg(F.count("*").alias("n")), duck(f"{_TW} select cloud, part, count(*) n from (select * from fx union all select * from ch) group by all", "rays_b"))
register("flt12_split_by_trees", lambda s, d: out(j.split_by_trees(adapter.rays(s, d), adapter.segments(s, d), 0.2), ("ray_id", "side")), duck("""
g as (select a.x, a.y, a.z, b.x px, b.y py, b.z pz, a.radius + 0.2::double r from segments a join segments b on a.tree_id = b.tree_id and a.parent_id = b.seg_id),
h as (select ray_id, r, ex - px tx, ey - py ty, ez - pz tz, x - px ax, y - py ay, z - pz az from rays, g where ex between least(x, px) - r and greatest(x, px) + r and ey between least(y, py) - r and greatest(y, py) + r and ez between least(z, pz) - r and greatest(z, pz) + r),
k as (select *, (tx * ax + ty * ay + tz * az) / nullif(ax * ax + ay * ay + az * az, 0) u from h),
i as (select distinct ray_id from k where u >= 0 and u <= 1 and (tx - ax * u) * (tx - ax * u) + (ty - ay * u) * (ty - ay * u) + (tz - az * u) * (tz - az * u) < r * r)
select ray_id, case when ray_id in (select ray_id from i) then 'inside' else 'outside' end side from rays""", "rays", "segments"))

D, K = 1.5, 8
_D2 = "(a.ex - b.ex) * (a.ex - b.ex) + (a.ey - b.ey) * (a.ey - b.ey) + (a.ez - b.ez) * (a.ez - b.ez)"
_NEAR = f"""own as (select * from rays where alpha > 0), pr as (select a.ray_id, b.ray_id other_id, {_D2} d2, a.ex, a.ey, a.ez, b.ex ox, b.ey oy, b.ez oz from own a join own b on a.ray_id <> b.ray_id and {_D2} <= {D * D}),
near as (select *, row_number() over (partition by ray_id order by d2, other_id) rank from pr qualify rank <= {K})"""


def _any_sql(k: int) -> str:
    """The k nearest at any distance: points that have k within D take theirs there, the others are held against all."""
    pair = f"a.ray_id, b.ray_id other_id, {_D2} d2, a.ex, a.ey, a.ez, b.ex ox, b.ey oy, b.ez oz"
    return f"""own as (select * from rays where alpha > 0), pw as (select {pair} from own a join own b on a.ray_id <> b.ray_id and {_D2} <= {D * D}),
en as (select ray_id from pw group by ray_id having count(*) >= {k}), pr as (select pw.* from pw semi join en using (ray_id) union all select {pair} from own a join own b on a.ray_id <> b.ray_id where a.ray_id not in (select ray_id from en)),
near as (select *, row_number() over (partition by ray_id order by d2, other_id) rank from pr qualify rank <= {k})"""


_ANY = _any_sql(K)
_COVS = ("xx", "xy", "xz", "yy", "yz", "zz")
_COV = "sm as (select ray_id, ex, ey, ez, count(*) + 1 n, " + ", ".join(f"sum(o{a} - e{a}) s{a}" for a in "xyz") + ", " + ", ".join(f"sum((o{a} - e{a}) * (o{b} - e{b})) s{a}{b}" for a, b in _COVS) + " from near group by all), cov as (select ray_id, n, " + ", ".join(f"e{a} + s{a} / n mean_{a}" for a in "xyz") + ", " + ", ".join(f"s{a}{b} / n - s{a} / n * (s{b} / n) c{a}{b}" for a, b in _COVS) + " from sm)"
_EIG = """e1 as (select *, (cxx + cyy + czz) / 3.0::double q from cov), e2 as (select *, sqrt(((cxx - q) ** 2 + (cyy - q) ** 2 + (czz - q) ** 2 + 2.0::double * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6.0::double) p from e1),
e3 as (select *, acos(greatest(-1.0::double, least(1.0::double, coalesce(((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / nullif(2.0::double * p * p * p, 0), 1.0::double)))) / 3.0::double phi from e2),
e4 as (select *, q + 2.0::double * p * cos(phi) l2, q + 2.0::double * p * cos(phi + 2.0943951023931953::double) l0 from e3), eig as (select *, 3.0::double * q - l2 - l0 l1 from e4)"""


def _own(r):
    return r.where("alpha > 0")


on_rays("nn01_knn", lambda r: nn.nearest(_own(r), _own(r), K, D).select("ray_id", F.col("rank").cast("long"), "other_id", g.rounded("d2").alias("d2")), f"{_NEAR} select ray_id, rank, other_id, round(d2, 6) d2 from near", "rays")
on_rays("nn01_knn_any_distance", lambda r: nn.nearest_any(_own(r), _own(r), 3, 0.6).select("ray_id", F.col("rank").cast("long"), "other_id"), f"""own as (select * from rays where alpha > 0)
select a.ray_id, row_number() over (partition by a.ray_id order by {_D2}, b.ray_id) rank, b.ray_id other_id from own a join own b on a.ray_id <> b.ray_id qualify rank <= 3""", "rays")
_CN = [f"mean_{a}" for a in "xyz"] + [f"cov_{x}" for x in _COVS]
on_rays("nn02_covariance", lambda r: out(nn.covariance(_own(r), nn.nearest(_own(r), _own(r), K)).withColumns({c: F.col(c) + F.lit(1e-9) for c in _CN}), ("ray_id", "n"), _CN, 7), f"{_ANY}, {_COV} select ray_id, n, " + ", ".join(f"round(mean_{a} + 1e-9::double, 7) + 0.0::double mean_{a}" for a in "xyz") + ", " + ", ".join(f"round(c{x} + 1e-9::double, 7) + 0.0::double cov_{x}" for x in _COVS) + " from cov", "rays")
_DIMS = ", ".join(f"round(sqrt(greatest(1e-10::double, l{i})), 4) dim{i}" for i in range(3))
on_rays("nn02_surfel_dimensions", lambda r: out(nn.surfels(r, K).where("n > 4"), ("ray_id",), ("dim1", "dim2"), 4), f"{_ANY}, {_COV}, {_EIG} select ray_id, " + ", ".join(f"round(sqrt(greatest(1e-10::double, l{i})), 4) dim{i}" for i in (1, 2)) + " from eig where n > 4", "rays")
on_rays("nn02_eigenvalues", lambda r: out(nn.eigenvalues(nn.covariance(_own(r), nn.nearest(_own(r), _own(r), K))).where("n > 4"), ("ray_id",), ("l0", "l1", "l2"), 5), f"{_ANY}, {_COV}, {_EIG} select ray_id, " + ", ".join(f"round(l{i}, 5) + 0.0::double l{i}" for i in range(3)) + " from eig where n > 4", "rays")
on_rays("nn03_normals", lambda r: out(nn.surfels(r, K), ("ray_id",), ("nx", "ny", "nz"), 4), None, "rays")
on_rays("prj15_colour_by_normal", lambda r: out(nn.colour_by_normal(r, K), ("ray_id", *COLOURS)), None, "rays")
on_rays("prj16_colour_by_shape", lambda r: out(nn.colour_by_shape(r, K), ("ray_id", "green")), f"""{_ANY}, {_COV}, {_EIG}
select ray_id, case when l1 is null then green else cast(trunc(255.0::double * (1.0::double - sqrt(greatest(1e-10::double, l1)) / sqrt(greatest(1e-10::double, l2)))) as smallint) end green from rays left join eig using (ray_id)""", "rays")
on_rays("prj20_smooth", lambda r: out(nn.smooth(r, 16), ("ray_id",), ("ex", "ey", "ez"), 4), None, "rays")
on_rays("flt16_denoise_sigma", lambda r: out(nn.denoise_by_sigma(r, 2.0, 8, D), ("ray_id",)), f"""{_NEAR}, {_COV},
x as (select near.*, mean_x, mean_y, mean_z, cxx + 1e-10::double a, cxy b, cxz d, cyy + 1e-10::double e, cyz f, czz + 1e-10::double h from near join cov on cov.ray_id = other_id where rank = 1),
y as (select *, a * (e * h - f * f) - b * (b * h - f * d) + d * (b * f - e * d) det, ex - mean_x p, ey - mean_y q, ez - mean_z r from x)
select ray_id from rays where alpha = 0 union all select ray_id from y where det > 0 and p * p * (e * h - f * f) + q * q * (a * h - d * d) + r * r * (a * e - b * b) + 2.0::double * (p * q * (d * f - b * h) + p * r * (b * f - d * e) + q * r * (b * d - a * f)) <= 4.0::double * det""", "rays")
on_rays("flt13_gap", lambda r: out(nn.largest_cluster(r, 0.8), ("ray_id", "side")), """
own as (select * from rays where alpha > 0), pr as (select a.ray_id a, b.ray_id b, row_number() over (partition by a.ray_id order by (a.ex - b.ex) * (a.ex - b.ex) + (a.ey - b.ey) * (a.ey - b.ey) + (a.ez - b.ez) * (a.ez - b.ez), b.ray_id) k from own a join own b on a.ray_id <> b.ray_id
  and (a.ex - b.ex) * (a.ex - b.ex) + (a.ey - b.ey) * (a.ey - b.ey) + (a.ez - b.ez) * (a.ez - b.ez) <= 0.8::double * 0.8::double qualify k <= 10),
ed as (select a, b from pr union select b, a from pr), reach as (select ray_id a, ray_id l from own union select ed.b, reach.l from reach join ed on ed.a = reach.a where ed.b > reach.l),
lab as (select a, min(l) l from reach group by a), top as (select l from lab group by l order by count(*) desc, l limit 1)
select ray_id, case when ray_id in (select a from lab where l = (select l from top)) then 'inside' else 'outside' end side from rays""", "rays", recursive=True)


def _diff(s, d):
    b = adapter.rays_b(s, d)
    return adapter.rays(s, d), b.withColumns({"ex": F.col("ex") + 0.11, "ey": F.col("ey") + 0.03})


_DIST = f"""a as (select * from rays where alpha > 0), b as (select ray_id, ex + 0.11::double ex, ey + 0.03::double ey, ez from rays_b where alpha > 0),
dist as (select a.ray_id, sqrt(min({_D2})) distance from a, b group by a.ray_id)"""
register("jon09_cloud_distances", lambda s, d: out(nn.cloud_distances(*_diff(s, d)), ("ray_id",), ("distance",)), duck(f"{_DIST} select ray_id, round(distance, 6) distance from dist", "rays", "rays_b"))
register("dif01_similarity", lambda s, d: out(nn.similarity(nn.cloud_distances(*_diff(s, d)), 0.15), (), ("similarity",)), duck(f"{_DIST} select round(100.0::double * count(*) filter (distance <= 0.15) / count(*), 6) similarity from dist", "rays", "rays_b"))
register("dif03_median_and_most", lambda s, d: out(nn.similarity(nn.cloud_distances(*_diff(s, d)), 0.15), (), ("median", "most")), duck(f"{_DIST} select round(quantile_disc(distance, 0.5), 6) median, round(max(distance), 6) most from dist", "rays", "rays_b"))
register("dif04_painted", lambda s, d: (lambda a, b: out(nn.paint_differences(a, nn.cloud_distances(a, b), 0.12, (255, 0, 127), 0.25), ("ray_id", *COLOURS)))(*_diff(s, d)), duck(f"""{_DIST},
w as (select rays.*, 0.25::double + 0.75::double * least(1.0::double, 0.12::double / distance) w from rays join dist using (ray_id) where distance > 1e-8)
select ray_id, {', '.join(f'cast(trunc({n} * w + {v}.0::double * (1.0::double - w)) as smallint) {n}' for n, v in zip(('red', 'green', 'blue'), (255, 0, 127)))}, alpha from w""", "rays", "rays_b"))
_EL = _NEAR.replace("own b on", "rays b on") + """, nb as (select near.* from near semi join own on own.ray_id = near.other_id),
sm as (select ray_id, ex, ey, ez, count(*) n, """ + ", ".join(f"sum(o{a} - e{a}) s{a}" for a in "xyz") + ", " + ", ".join(f"sum((o{a} - e{a}) * (o{b} - e{b})) s{a}{b}" for a, b in _COVS) + """ from nb group by all having count(*) >= 4),
cov as (select ray_id, n, """ + ", ".join(f"e{a} + s{a} / n mean_{a}" for a in "xyz") + ", " + ", ".join(f"s{a}{b} / n - s{a} / n * (s{b} / n) c{a}{b}" for a, b in _COVS) + " from sm)"
on_rays("nn04_ellipsoids", lambda r: out(nn.ellipsoids(r, K, D), ("ray_id", "n"), ("mean_x", "mean_y", "mean_z", "ext_x", "ext_y", "ext_z"), 7), _EL + " select ray_id, n, " + ", ".join(f"round(mean_{a}, 7) mean_{a}, round(1.7::double * sqrt(c{a}{a} + 1e-10::double), 7) ext_{a}" for a in "xyz") + f" from cov where (cxx + 1e-10::double) * ((cyy + 1e-10::double) * (czz + 1e-10::double) - cyz * cyz) - cxy * (cxy * (czz + 1e-10::double) - cyz * cxz) + cxz * (cxy * cyz - (cyy + 1e-10::double) * cxz) > 0", "rays")
