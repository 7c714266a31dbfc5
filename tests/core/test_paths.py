"""Ways to the ground over many tiles, against one search of the whole graph."""

from __future__ import annotations

import heapq

import numpy as np

from beamgrid.operators import extract, neighbours


def plain(p: np.ndarray, near: float, ground: float, k: int) -> dict[int, tuple]:
    links: dict[int, list] = {i: [] for i in range(len(p))}
    for i in range(len(p)):
        d = p[i, 0] - p[:, 0]
        d2 = d * d
        for a in (1, 2):
            d = p[i, a] - p[:, a]
            d2 += d * d
        others = [j for j in np.lexsort((np.arange(len(p)), d2)).tolist() if j != i and d2[j] <= near * near]
        for j in others[:k]:
            links[i].append((j, d2[j]))
            links[j].append((i, d2[j]))
    got: dict[int, tuple] = {}
    heap = [(0.0, 0, i, i, i) for i in range(len(p)) if p[i, 2] < ground]
    heapq.heapify(heap)
    while heap:
        d, n, root, parent, i = heapq.heappop(heap)
        if i not in got:
            got[i] = (parent, root, d)
            for j, w in links[i]:
                heapq.heappush(heap, (d + w, n + 1, root, i, j))
    return got


def check(spark, p: np.ndarray, near: float, k: int) -> None:
    rays = [(i, *map(float, x), 1) for i, x in enumerate(p)] + [(9000, float("nan"), 1.0, 1.0, 1), (9001, 1.0, 1.0, 0.1, 0)]
    out = extract.paths_to_ground(spark.createDataFrame(rays, "ray_id long, ex double, ey double, ez double, alpha int"), near, 0.5, k)
    got = {x.ray_id: (x.parent, x.root, x.distance) for x in out.collect()}
    want = plain(p, near, 0.5, k)
    assert got == {i: want.get(i, (None, None, None)) for i in [*range(len(p)), 9000]}


def test_way_over_many_tiles(spark, monkeypatch):
    """A chain of 30 metres on the level with one root at its end, and an end that nothing reaches."""
    monkeypatch.setattr(neighbours, "TILE", 16)
    x = np.arange(61) / 2
    check(spark, np.r_[np.stack([x, x % 1, 1 + x * 0], 1), [[30.0, 0.0, 0.4], [60.0, 0.0, 3.0]]], 1.5, 20)


def test_equal_ways(spark, monkeypatch):
    """Ends on a coarse grid, many in the same place, so that most ways have equals."""
    monkeypatch.setattr(neighbours, "TILE", 32)
    rng = np.random.default_rng(8)
    check(spark, np.column_stack([rng.integers(0, 12, (700, 2)) / 2, rng.integers(0, 10, 700) / 4]), 1.5, 8)


def test_query_has_links_to_twenty_neighbours(spark):
    from beamgrid import adapter, registry

    rays = adapter.rays(spark, "/root/testdata/sf0.001").where("alpha > 0").orderBy("ray_id").toPandas()
    got = {rays.index[rays.ray_id == x.ray_id][0]: x.distance for x in registry.queries()["tre01_paths_to_ground"](spark, "/root/testdata/sf0.001").collect()}
    want = plain(rays[["ex", "ey", "ez"]].to_numpy(), 1.5, 0.5, 20)
    assert got == {i: want[i][2] if i in want else None for i in range(len(rays))}
