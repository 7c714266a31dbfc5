"""Neighbours at any distance."""

from __future__ import annotations

import pytest

from beamgrid import adapter
from beamgrid.operators import neighbours as nn
from beamgrid.operators import shapes as sh


def test_clouds_far_apart(spark):
    make = lambda rows: spark.createDataFrame(rows, "ray_id long, ex double, ey double, ez double, alpha int")
    a, b = make([(1, 0.0, 0.0, 0.0, 1), (2, 99.0, 0.0, 0.0, 1)]), make([(7, 100.0, 0.0, 0.0, 1)])
    assert {r.ray_id: r.distance for r in nn.cloud_distances(a, b).collect()} == {1: 100.0, 2: 1.0}
    assert nn.nearest_any(a, a, 3, 0.6).count() == 2  # all there are
    assert nn.cloud_distances(a, b.limit(0)).count() == 0


def _brute(points, k, distance):
    rows = {}
    for i, p in points.items():
        d = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, q in points.items() if j != i)
        rows[i] = [j for d2, j in d if distance is None or d2 <= distance * distance][:k]
    return rows


@pytest.mark.parametrize("distance", [None, 1.5])
@pytest.mark.parametrize("one_round", [0.0, 1e9])
def test_rounds_against_brute_force(spark, monkeypatch, distance, one_round):
    """A dense heap with copies and ties, a sparse rest and points far off."""
    monkeypatch.setattr(nn, "ONE_ROUND", one_round)
    points = {i: (i % 5 / 16, i % 7 / 16, i % 3 / 16) for i in range(150)}
    points |= {200 + i: (i * 0.9, i * i % 7 * 1.0, 0.0) for i in range(25)} | {300: (500.0, 0.0, 0.0), 301: (500.0, 0.0, 1.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "ray_id long, ex double, ey double, ez double")
    got = {i: [] for i in points}
    for r in nn.nearest(df, df, 4, distance).orderBy("ray_id", "rank").collect():
        got[r.ray_id].append(r.other_id)
    assert got == _brute(points, 4, distance)


def test_colours_keep_all_rays(spark):
    rays = adapter.rays(spark, "/root/testdata/sf0.001")
    for f in (nn.colour_by_normal, nn.colour_by_shape):
        x = f(rays, 8)
        assert x.columns == rays.columns and x.count() == rays.count()
        assert x.where("alpha = 0").exceptAll(rays).isEmpty()


def test_clusters_cross_slabs(spark):
    """A chain over x = 4 is one cluster up to its width; a lone point is its own."""
    df = spark.createDataFrame([(i, 3.0 + i * 0.5, 0.0, 0.0) for i in range(5)] + [(9, 90.0, 0.0, 0.0)], "ray_id long, ex double, ey double, ez double")
    got = {r.ray_id: r.cluster for r in sh.clusters(df, 0.6, 3.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}
