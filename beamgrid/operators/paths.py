"""Cheapest ways to the ground by tiles: each tile is searched from its roots and from what it knows of the ends beside it."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .tiles import _xyz, tile_of

#: Heights count less than the plan where tiles are cut, since ways go down.
FLAT = np.array([1.0, 1.0, 0.1])

#: tile: where node lies. other: its neighbour, in tile beside, or 0 for a root.
LINKS = "tile int, node long, other long, beside int, d2 double"

#: to: other tiles with neighbours of the node.
LABELS = "tile int, node long, parent long, root long, distance double, links int, to array<int>"


def dealer(tree: tuple[np.ndarray, ...], ground: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbours as links of the tiles of both ends. Of a node's roots in a batch only the nearest stays; no way goes into a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table(b)
            i, j, d2 = (t[c].to_numpy() for c in ("ray_id", "other_id", "d2"))
            p, q = _xyz(t, ("ex", "ey", "ez")), _xyz(t, ("ox", "oy", "oz"))
            ti, tj = (np.where(x[:, 2] < ground, 0, tile_of(tree, x * FLAT)).astype(np.int32) for x in (p, q))
            free = (ti > 0) & (tj > 0)
            apart = free & (ti != tj)
            up, down = (ti > 0) & (tj == 0), (ti == 0) & (tj > 0)
            node, root, w, tile = (np.concatenate(x) for x in ((i[up], j[down]), (j[up], i[down]), (d2[up], d2[down]), (ti[up], tj[down])))
            by = np.lexsort((root, w, node))
            by = by[np.r_[True, node[by][1:] != node[by][:-1]]] if len(by) else by
            columns = (ti[free], tj[apart], tile[by]), (i[free], j[apart], node[by]), (j[free], i[apart], root[by]), (tj[free], ti[apart], np.zeros(len(by), np.int32)), (d2[free], d2[apart], w[by])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["tile", "node", "other", "beside", "d2"])

    return run


def _search(start: np.ndarray, to: list[int], d2: list[float], offers: list[tuple], ids: list[int]) -> list[tuple | None]:
    """For each node the least (distance, links, root, parent), from offers (the same, with the node behind) and over links to[start[v]:start[v + 1]]."""
    got: list[tuple | None] = [None] * len(ids)
    least = [float("inf")] * len(ids)
    heapq.heapify(offers)
    while offers:
        top = heapq.heappop(offers)
        d, n, root, _, v = top
        if got[v] is not None:
            continue
        got[v] = top
        for e in range(start[v], start[v + 1]):
            u = to[e]
            far = d + d2[e]
            if far <= least[u] and got[u] is None:
                least[u] = far
                heapq.heappush(offers, (far, n + 1, root, ids[v], u))
    return got


def walker(key: tuple, links: pa.Table, known: pa.Table) -> pa.Table:
    """LABELS of a tile's nodes, from its LINKS and the labels known (node, root, distance, links) of nodes beside it."""
    tile = key[0].as_py()
    node, other, beside, d2 = (links[c].to_numpy() for c in ("node", "other", "beside", "d2"))
    ids, at = np.unique(node, return_inverse=True)
    own = beside == tile
    a, b, w = at[own], np.searchsorted(ids, other[own]), d2[own]
    a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    from_root = beside == 0
    best = np.full(len(ids), np.inf)
    np.minimum.at(best, at[from_root], d2[from_root])
    use = w < best[b]  # else the way from a root is nearer, or as near with fewer links
    a, b, w = a[use], b[use], w[use]
    by = np.argsort(a, kind="stable")
    start = np.searchsorted(a[by], np.arange(len(ids) + 1)).tolist()
    first = from_root & (d2 <= best[at])
    offers = [(d, 1, r, r, v) for d, r, v in zip(d2[first].tolist(), other[first].tolist(), at[first].tolist(), strict=True)]
    out = ~own & ~from_root
    if len(known):
        k = known.sort_by("node")
        kn = k["node"].to_numpy()
        x = np.flatnonzero(out)
        p = np.minimum(np.searchsorted(kn, other[x]), len(kn) - 1)
        x, p = x[kn[p] == other[x]], p[kn[p] == other[x]]
        d, n, r = (k[c].to_numpy()[p] for c in ("distance", "links", "root"))
        far = d + d2[x]
        near = far <= best[at[x]]
        offers += zip(far[near].tolist(), (n[near] + 1).tolist(), r[near].tolist(), other[x][near].tolist(), at[x][near].tolist(), strict=True)
    got = _search(start, b[by].tolist(), w[by].tolist(), offers, ids.tolist())
    pairs = np.unique(np.stack([at[out], beside[out]], 1), axis=0) if out.any() else np.zeros((0, 2), np.int64)
    to = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1)), pa.int32()), pa.array(pairs[:, 1], pa.int32()))
    part = lambda n, kind: pa.array([g[n] if g else None for g in got], kind)
    columns = [pa.array(np.full(len(ids), tile), pa.int32()), pa.array(ids, pa.int64()), part(3, pa.int64()), part(2, pa.int64()), part(0, pa.float64()), part(1, pa.int32()), to]
    return pa.table(columns, ["tile", "node", "parent", "root", "distance", "links", "to"])
