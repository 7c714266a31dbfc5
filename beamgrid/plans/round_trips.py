"""SRC, SNK, PRJ01, JON10, MSH01: whole files written and read again, points over a mesh, and wraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter, registry
from beamgrid.adapter import duck
from beamgrid.functions import geometry as g
from beamgrid.operators import surfaces, terrain, wrap
from beamgrid.operators.graph import file_path, kept
from beamgrid.registry import register
from beamgrid.schema import loaded, mapped
from beamgrid.sources import images, las, ply, text

from . import voxels  # noqa: F401  (registers the query that the cache holds)
from .common import out, sql_out
from .trees import _FIELD, _MESH, _mesh

_ENDS = ("ex", "ey", "ez")
_PARTS = {"sx": 1000, "ex": 100, "ey": 100, "ez": 10_000}
_NEAR = [f"cast(round({c} * {_PARTS[c]}) as bigint) {c}" for c in _ENDS]


def _micros():
    return F.round((F.col("time") - 1.7e9) * 1e6).cast("long").alias("micros")


def _whole(*cols: str):
    return [F.round(F.col(c) * _PARTS.get(c, 100)).cast("long").alias(c) for c in cols]


def _ply(s, d):
    path = file_path(s, "cloud.ply")
    ply.write_rays(adapter.rays(s, d), path)
    return ply.read_rays(s, path, 2_000)


# Positions are four-byte floats in the file, so they are compared in whole parts that no coordinate lies halfway between; unbounded rays are black.
_BLACK = ", ".join(f"cast(case when alpha = 0 then 0 else {c} end as smallint) {c}" for c in ("red", "green", "blue"))
register("src01_ply_scan", lambda s, d: _ply(s, d).select("ray_id", *_whole("sx", *_ENDS), "red", "green", "blue", "alpha", _micros()),
         duck(f"select row_number() over (order by ray_id) - 1 ray_id, cast(round(sx * 1000) as bigint) sx, {', '.join(_NEAR)}, {_BLACK}, alpha, cast(round((time - 1.7e9::double) * 1e6::double) as bigint) micros from rays"))


def _las(s, d):
    path = file_path(s, "cloud.las")
    las.write(adapter.rays(s, d), path)
    return las.read(s, path, 255.0, 2_000)


register("src05_las_scan", lambda s, d: _las(s, d).select("ray_id", *_whole(*_ENDS), "red", "green", "blue", "alpha"),
         duck(f"select row_number() over (order by ray_id) - 1 ray_id, {', '.join(_NEAR)}, red, green, blue, alpha from rays"))


def _mesh_file(s, d):
    path = file_path(s, "mesh.ply")
    ply.write_mesh(*_mesh(s, d), path, flip=True)
    return ply.read_mesh(s, path)


def _corners(v, f):
    for k in range(3):
        own = v.select(F.col("vid").alias(f"v{k}"), *_whole("x", "y", "z")).withColumnsRenamed({"x": f"x{k}", "y": f"y{k}", "z": f"z{k}"})
        f = f.join(own, f"v{k}")
    return f.select(*[f"{a}{k}" for k in range(3) for a in "xyz"])


_FLIPPED = ", ".join(f"cast(round({n}.{a} * 100) as bigint) {a}{k}" for k, n in enumerate("acb") for a in "xyz")
register("src07_mesh_scan", lambda s, d: _corners(*_mesh_file(s, d)), duck(f"{_MESH} select {_FLIPPED} from faces join vert a on a.vid = v0 join vert b on b.vid = v1 join vert c on c.vid = v2"))


def _png(s, d):
    path = file_path(s, "image.png")
    r = adapter.rays(s, d).where("alpha > 0").groupBy(g.floor_index("ex", 1.0).alias("px"), g.floor_index("ey", 1.0).alias("py")).agg(F.max("red").alias("red"), F.max("green").alias("green"), F.max("blue").alias("blue"))
    surfaces.write_png(r.withColumns({c: (F.col(c) + 0.5) / 255.0 for c in ("red", "green", "blue")}), path, 20, 21)
    return images.read_png(s, path)


register("src12_image_scan", _png, duck("""p as (select floor(ex) px, floor(ey) py, max(red) red, max(green) green, max(blue) blue from rays where alpha > 0 group by all)
select cast(x as bigint) px, cast(y as bigint) py, cast(coalesce(red, 0) as smallint) red, cast(coalesce(green, 0) as smallint) green, cast(coalesce(blue, 0) as smallint) blue, 255::smallint alpha
from range(20) a(x) cross join range(21) b(y) left join p on px = x and py = y"""))


def _tiff(s, d):
    path = file_path(s, "heights.tif")
    f = adapter.rays(s, d).where("alpha > 0").groupBy(g.floor_index("ex", 1.0).alias("px"), g.floor_index("ey", 1.0).alias("py")).agg(F.max("ez").alias("value"))
    images.write_geotiff(f, path, 20, 21, 1.0, (500.0, 900.0), {"proj": "utm", "zone": "55", "south": "", "datum": "WGS84"})
    read, about = images.read_geotiff(s, path)
    x, y = about["origin"]
    return read.select("px", "py", F.round(F.col("value") * 10_000).cast("long").alias("value"), (F.col("px") * about["pixel"] + x).alias("east"), (F.col("py") * about["pixel"] + y).alias("north"), F.lit(about["epsg"]).alias("epsg"))


register("snk10_geotiff", _tiff, duck("""select cast(floor(ex) as bigint) px, cast(floor(ey) as bigint) py, cast(round(max(ez) * 10000) as bigint) as value,
floor(ex) + 500.0::double east, floor(ey) + 900.0::double north, 32755 epsg from rays where alpha > 0 and ex >= 0 and ex < 20 and ey >= 0 and ey < 21 group by floor(ex), floor(ey)"""))


def _trajectory(s, d):
    path = f"{file_path(s, 'x')}-lines"
    text.format_trajectory(adapter.trajectory(s, d)).select("value").write.text(path)
    return out(text.read_trajectory(s, path), (), ("time", "x", "y", "z"))


register("snk07_trajectory_file", _trajectory, duck(f"select {sql_out((), ('time', 'x', 'y', 'z'))} from trajectory", "trajectory"))

register("jon10_points_over_mesh", lambda s, d: out(terrain.over_mesh(adapter.rays(s, d), *_mesh(s, d), 0.5).withColumns({c: F.col(c) + F.lit(1e-9) for c in ("sz", "ez")}), ("ray_id",), ("sz", "ez")),
         duck(f"{_FIELD} select ray_id, round(sz - coalesce(v, 0.0::double) + 1e-9::double, 6) + 0.0::double sz, round(ez - coalesce(v, 0.0::double) + 1e-9::double, 6) + 0.0::double ez from rays left join fld on px = cast(floor(ex / 0.5::double) as bigint) and py = cast(floor(ey / 0.5::double) as bigint)"))


def _wrap(s, d, way: str):
    points = adapter.rays(s, d).where("alpha > 0").select(F.col("ray_id").alias("vid"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"))
    return wrap.convex_wrap(points, way, 0.05)[1]


for _way in ("upwards", "downwards", "inwards", "outwards"):
    register(f"msh01_wrap_{_way}", lambda s, d, w=_way: _wrap(s, d, w))


def _points(s, d):
    path = file_path(s, "points.ply")
    ply.write_rays(adapter.rays(s, d), path, points_only=True)
    ply.register(s)
    return s.read.format("ply").load(path)  # as the file has them: an import would part equal times


register("snk03_points_ply", lambda s, d: _points(s, d).select("ray_id", *_whole(*_ENDS), "red", "green", "blue", "alpha", _micros()),
         duck(f"select row_number() over (order by ray_id) - 1 ray_id, {', '.join(_NEAR)}, red, green, blue, alpha, cast(round((time - 1.7e9::double) * 1e6::double) as bigint) micros from rays"))
register("src03_load", lambda s, d: loaded(adapter.rays(s, d)).agg(F.count("*").alias("n"), F.sum("ray_id").cast("long").alias("ids")), duck("select count(*) n, cast(sum(ray_id) as bigint) ids from rays"))
register("prj01_row_map", lambda s, d: out(mapped(adapter.rays(s, d), {"ez": F.col("sz"), "sz": F.col("ez"), "red": 255 - F.col("red"), "time": F.col("time") + 1}), ("ray_id", "red"), ("sz", "ez", "time")),
         duck("select ray_id, cast(255 - red as smallint) red, round(ez, 6) + 0.0::double sz, round(sz, 6) + 0.0::double ez, round(time + 1, 6) + 0.0::double as time from rays"))
# The cache of an occupancy grid is a table in the shared folder.
register("src11_occupancy_cache", lambda s, d: kept(registry._QUERIES["vox08_occupancy"](s, d)), registry._SQL.get("vox08_occupancy"))
