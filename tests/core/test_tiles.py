"""Neighbours over many tiles, against brute force."""

from __future__ import annotations

import random

import pytest

from beamgrid.operators import neighbours as nn


def _brute(points, others, k, distance, self_join):
    rows = {}
    for i, p in points.items():
        d = sorted((sum((a - b) * (a - b) for a, b in zip(p, q)), j) for j, q in others.items() if not self_join or j != i)
        rows[i] = [j for d2, j in d if distance is None or d2 <= distance * distance][:k]
    return rows


@pytest.mark.parametrize(("k", "distance", "self_join"), [(4, None, True), (4, 0.3, True), (1, None, False), (3, 0.5, False)])
def test_tiles_against_brute_force(spark, monkeypatch, k, distance, self_join):
    """A dense heap on a lattice (ties over tile borders), a place with many ends, a sparse rest, points far off, one without a place."""
    monkeypatch.setattr(nn, "TILE", 16)
    r = random.Random(3)
    others = {i: (r.randrange(8) / 8, r.randrange(8) / 8, r.randrange(4) / 8) for i in range(250)}
    others |= {1000 + i: (0.5, 0.5, 0.25) for i in range(90)} | {2000 + i: (r.uniform(0, 40), r.uniform(0, 40), 0.0) for i in range(40)} | {3000: (5000.0, 0.0, 0.0)}
    points = others if self_join else {i: (r.uniform(-1, 2), r.uniform(-1, 2), r.uniform(-3, 3)) for i in range(120)} | {500: (-900.0, 3.0, 1.0)}
    make = lambda x: spark.createDataFrame([(i, *p) for i, p in x.items()] + [(9999, None, 0.0, 0.0), (9998, float("nan"), 0.0, 0.0)], "ray_id long, ex double, ey double, ez double")
    a, b = make(points), make(others)
    got = {i: [] for i in points}
    for x in nn.nearest(a, b, k, distance, self_join).orderBy("ray_id", "rank").collect():
        assert x.rank == len(got[x.ray_id]) + 1
        got[x.ray_id].append(x.other_id)
    assert got == _brute(points, others, k, distance, self_join)


def test_pairs_follow_the_points_not_their_density(spark):
    """Forty thousand ends in a box narrower than the first width of before, a quarter of them in one place."""
    df = spark.range(40_000).selectExpr("id as ray_id", *[f"if(id % 4 = 0, 0.25, pmod(xxhash64(id, {n}), 1000003) / 2000006) as e{a}" for n, a in enumerate("xyz")])
    got = nn.nearest_any(df, df, 2, 1.0)
    assert got.count() == 80_000
    assert {x.other_id for x in got.where("ray_id % 4 = 0").select("other_id").distinct().collect()} == {0, 4, 8}
