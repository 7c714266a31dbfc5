"""Sums of an ellipsoid's meetings against its pairs, and how many pairs are tried."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beamgrid.operators import meets, merge
from beamgrid.operators import neighbours as nn

SHAPE = "ray_id long, time double, mean_x double, mean_y double, mean_z double, ext_x double, ext_y double, ext_z double, m_xx double, m_xy double, m_xz double, m_yy double, m_yz double, m_zz double"


@pytest.mark.parametrize("same", [True, False])
def test_sums_are_those_of_the_pairs(spark, monkeypatch, same):
    """Rays dealt out in order of time, equal times, rays without one, and shapes behind a ray's start."""
    monkeypatch.setattr(nn, "TILE", 16)
    rng = np.random.default_rng(6)
    n = 400
    mean, ext, start, end, time = rng.uniform(0, 4, (n, 3)), rng.uniform(0.02, 0.4, (n, 3)), rng.uniform(0, 4, (n, 3)), rng.uniform(0, 4, (n, 3)), rng.integers(0, 60, n)
    shapes = [(k, float(rng.integers(0, 60)), *mean[k].tolist(), *ext[k].tolist(), *map(float, (1 / ext[k, 0] ** 2, 0, 0, 1 / ext[k, 1] ** 2, 0, 1 / ext[k, 2] ** 2))) for k in range(n)]
    rays = [(k, None if k < 3 else float(time[k]), *start[k].tolist(), *end[k].tolist(), 1) for k in range(n)]
    s, r = spark.createDataFrame(shapes, SHAPE), spark.createDataFrame(rays, "ray_id long, time double, sx double, sy double, sz double, ex double, ey double, ez double, alpha int")
    x, besides = nn.tally(s, r, 0.5)
    assert x.agg(F.max("part")).first()[0] > 1 and 0 < besides.count() < n
    got = {row.shape_id: row.asDict() for row in merge.found(s, r, 0.5, same).collect()}
    want = {row.shape_id: row.asDict() for row in merge.evidence(nn.intersect(s, r, 0.5), same).collect()}
    assert got == want and len(got) > 200


def test_few_pairs_are_tried(monkeypatch):
    """Ellipsoids much smaller than a voxel: pairs that only share a voxel are not worked out."""
    rng = np.random.default_rng(7)
    n = 1500
    mean, end, r = rng.uniform(1, 4, (n, 3)), rng.uniform(1, 4, (n, 3)), np.full(n, 0.03)
    low, high = np.floor((mean - 0.03) / 0.5) * 0.5, np.floor((mean + 0.03) / 0.5) * 0.5 + 0.5
    shape = {"shape_id": np.arange(n), "shape_time": np.arange(n) * 1.0} | {f"{k}_{a}": v[:, j] for k, v in (("mean", mean), ("low", low), ("high", high)) for j, a in enumerate("xyz")}
    shape |= {m: 1 / r**2 if m in ("m_xx", "m_yy", "m_zz") else r * 0 for m in meets.M}
    if hasattr(meets, "snug"):
        box = meets.snug(mean, np.stack([shape[m] for m in meets.M], 1), low, high, 8.0)
        shape |= {c: b[:, j] for names, b in zip(meets.IN, box, strict=True) for j, c in enumerate(names)}
    ray = {"ray_id": np.arange(n), "time": np.arange(n) * 1.0} | {f"s{a}": np.full(n, 0.1) for a in "xyz"} | {f"e{a}": end[:, j] for j, a in enumerate("xyz")}
    tried, form = [], meets._form
    monkeypatch.setattr(meets, "_form", lambda m, p, q: (tried.append(len(p[0]) if isinstance(p, list) else len(p)), form(m, p, q))[1])
    schema = pa.schema([("shape_id", pa.int64()), ("shape_time", pa.float64()), ("ray_id", pa.int64()), ("time", pa.float64()), ("passes", pa.bool_()), ("sure", pa.bool_())])
    out = meets.finder(0.05, schema)((), pa.table(shape), pa.table(ray))
    assert 100 < len(out) and sum(tried) / 3 < 4 * len(out)
