"""Hulls hold all their points; images and rasters survive a round trip."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from beamgrid.operators import wrap
from beamgrid.sources import images


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hull_holds_all_points(seed):
    p = np.random.default_rng(seed).normal(size=(700, 3))
    p = np.vstack([p, p[:50], [[0, 0, 0]]])
    f = wrap.hull(p)
    n, at = wrap._planes(p, f)
    assert (p @ n.T - at).max() < 1e-9
    edges = [tuple(e) for t in f.tolist() for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
    assert len(np.unique(f)) - len(edges) // 2 + len(f) == 2


def test_hull_of_a_cube_and_of_flat_points():
    cube = np.array([[x, y, z] for x in (0, 1, 0.5) for y in (0, 1, 0.5) for z in (0, 1, 0.5)], float)
    f = wrap.hull(cube)
    a, b, c = (cube[f[:, k]] for k in range(3))
    assert np.isclose((a * np.cross(b, c)).sum() / 6, 1.0)
    flat = np.array([[x, y, 1.0] for x in range(4) for y in range(4)])
    assert not len(wrap.hull(flat)) and not len(wrap.hull(flat[:3])) and not len(wrap.hull(np.ones((9, 3)))) and not len(wrap.hull(np.zeros((0, 3))))


def test_partition_corners_give_the_same_wrap(spark):
    p = np.random.default_rng(5).uniform(size=(3000, 3))
    rows = [(i, *map(float, x)) for i, x in enumerate(p)]
    points = spark.createDataFrame(rows, "vid long, x double, y double, z double")
    for way in ("upwards", "inwards", "outwards"):
        one, many = (wrap.convex_wrap(points.repartition(k), way, 0.3) for k in (1, 7))
        assert {r.vid for r in one[0].collect()} == {r.vid for r in many[0].collect()}
        assert one[1].count() == many[1].count() > 0
    flat = points.withColumn("z", points.z * 0)
    assert wrap.convex_wrap(flat, "inwards", 0.0)[1].count() == 0
    assert wrap.convex_wrap(points.limit(0), "upwards", 0.1)[1].count() == 0


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png_filters(spark, tmp_path, colour):
    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    image = np.random.default_rng(colour).integers(0, 256, (10, 6, c), dtype=np.uint8)
    raw, above = b"", np.zeros(6 * c, int)
    for y, line in enumerate(image.reshape(10, -1).astype(int)):
        left, corner = (np.concatenate([np.zeros(c, int), x[:-c]]) for x in (line, above))
        guess = left + above - corner
        d = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        near = np.choose(d.argmin(0), [left, above, corner])
        raw += bytes([y % 5]) + ((line - [0 * line, left, above, (left + above) // 2, near][y % 5]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    path = tmp_path / "a.png"
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = {(r.px, r.py): (r.red, r.green, r.blue, r.alpha) for r in images.read_png(spark, str(path)).collect()}
    for y in range(10):
        for x in range(6):
            v = image[9 - y, x].tolist()
            rgb = v[:3] if c > 2 else v[:1] * 3
            assert got[x, y] == (*rgb, v[-1] if c in (2, 4) else 255)


def test_geotiff(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    raster = spark.createDataFrame([(0, 0, 1.5), (2, 1, -3.0), (9, 9, 1.0)], "px long, py long, value double")
    images.write_geotiff(raster, path, 3, 2, 0.5, (10.0, 20.0), {"init": "epsg:4326"})
    back, about = images.read_geotiff(spark, path)
    assert sorted(map(tuple, back.collect())) == [(0, 0, 1.5), (2, 1, -3.0)] and about == {"pixel": 0.5, "origin": (10.0, 20.0), "epsg": 4326}
    assert images.epsg_of({"proj": "utm", "zone": "55", "south": "", "datum": "GDA94"}) == 28355 and images.epsg_of({}) is None
