"""Rays against ellipsoids: tiles and trees of boxes against all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from beamgrid.operators import neighbours as nn
from beamgrid.operators.voxel import walk


def test_all_pairs(spark, monkeypatch):
    """Small tiles, rays dealt out in parts, shapes in a ray's line before its start, and a ray without length."""
    monkeypatch.setattr(nn, "TILE", 64)
    rng = np.random.default_rng(4)
    n = 400
    mean, ext, start, end = rng.uniform(0, 4, (n, 3)), rng.uniform(0.02, 0.3, (n, 3)), rng.uniform(0, 4, (n, 3)), rng.uniform(0, 4, (n, 3))
    end[0] = start[0]
    shapes = [(k, float(k), *mean[k].tolist(), *ext[k].tolist(), *map(float, (1 / ext[k, 0] ** 2, 0, 0, 1 / ext[k, 1] ** 2, 0, 1 / ext[k, 2] ** 2))) for k in range(n)]
    rays = [(k, float(k), *start[k].tolist(), *end[k].tolist(), 1) for k in range(n)]
    s = spark.createDataFrame(shapes, "ray_id long, time double, mean_x double, mean_y double, mean_z double, ext_x double, ext_y double, ext_z double, m_xx double, m_xy double, m_xz double, m_yy double, m_yz double, m_zz double")
    r = spark.createDataFrame(rays, "ray_id long, time double, sx double, sy double, sz double, ex double, ey double, ez double, alpha int")
    got = {(x.shape_id, x.ray_id): x.outcome for x in nn.intersect(s, r, 0.5).collect()}
    through, near = {}, {}
    for i in range(n):
        for k in range(1, n):
            d, to = (end[k] - start[k]) / ext[i], (mean[i] - start[k]) / ext[i]
            rl = np.sqrt(d @ d)
            at = (to @ d) / rl
            d2 = to @ to - at * at
            if d2 <= 1 and rl >= at - np.sqrt(1 - d2):
                along = np.sqrt(1 - d2)
                near[i, k] = "pass" if rl * (1 - 0.05 / np.linalg.norm(end[k] - start[k])) > at + along else "hit"
                if at + along > 1e-6:
                    through[i, k] = near[i, k]
    assert through.items() <= got.items() <= near.items() and len(through) > 500
    behind = {k: v for k, v in near.items() if k not in through}
    low, high = np.floor((mean - ext) / 0.5), np.floor((mean + ext) / 0.5)
    walked = {x.ray_id: [] for x in r.select("ray_id").collect()}
    for x in walk(r, 0.5).select("ray_id", "vx", "vy", "vz").collect():
        walked[x.ray_id].append((x.vx, x.vy, x.vz))
    want = {(i, k) for i, k in behind if any((low[i] <= v).all() and (high[i] >= v).all() for v in walked[k])}
    assert {k for k in got if k in behind} == want and want
    assert nn.intersect(s.limit(0), r, 0.5).count() == nn.intersect(s, r.where(F.lit(False)), 0.5).count() == 0
