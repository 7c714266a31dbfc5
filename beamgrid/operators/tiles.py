"""Nearest points by tiles of bounded size: numpy searches a tile, and only points whose ball meets other tiles go on to those."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def _first_reach(at: np.ndarray, span: float, k: int) -> float:
    """span, halved until a point's cell of that width holds some k / 2 places beside its own."""
    p = np.unique(at, axis=0)
    p -= p.min(0)
    reach = span / 2
    while reach > span * 2e-6:
        c = (p / reach).astype(np.int64)
        n = np.unique((c[:, 0] << 40) | (c[:, 1] << 20) | c[:, 2], return_counts=True)[1]
        if (n * n).sum() / len(p) - 1 <= 0.75 * k:
            break
        reach /= 2
    return reach


def _runs(at: np.ndarray, points: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of at by cells, and for each point 9 runs of it (starts, lengths) that hold the 27 cells around the point."""
    low = at.min(0)
    dims = np.floor((at.max(0) - low) / width).astype(np.int64) + 7  # three empty cells on each side
    c = np.floor((at - low) / width).astype(np.int64) + 3
    key = (c[:, 0] * dims[1] + c[:, 1]) * dims[2] + c[:, 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    q = np.clip(np.floor((points - low) / width), -2, dims - 5).astype(np.int64) + 3
    middle = np.stack([((q[:, 0] + x) * dims[1] + q[:, 1] + y) * dims[2] + q[:, 2] for x in (-1, 0, 1) for y in (-1, 0, 1)], 1)
    start = np.searchsorted(key, middle - 1)
    return order, start, np.searchsorted(key, middle + 1, "right") - start


def search(at: np.ndarray, ids: np.ndarray, points: np.ndarray, own: np.ndarray | None, within: np.ndarray, k: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of points, its k nearest of at with d2 <= within: rows of points, rows of at and d2, by point, d2 and id.

    own: the points' ids, which don't count as their neighbours. Rounds of growing reach decide the points that have k
    neighbours within it or are not to look farther. room: pairs held at once.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rest = np.arange(len(points)) if len(at) else np.arange(0)
    span = float((at.max(0) - at.min(0)).max()) if len(at) else 0.0
    reach = _first_reach(at, span, k) if span > 0 else 0.0
    while len(rest):
        last = reach >= span
        if last:
            order, start, length = np.arange(len(at)), np.zeros((len(rest), 1), np.int64), np.full((len(rest), 1), len(at), np.int64)
        else:
            order, start, length = _runs(at, points[rest], reach * (1 + 1e-9))
        cap = within[rest] if last else np.minimum(within[rest], reach * reach)
        over, n = last | (reach * reach >= within[rest]), length.sum(1)
        ends, left, a = np.cumsum(n), [], 0
        while a < len(rest):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + room, "right")))
            size = length[a:b].ravel()
            i = order[np.repeat(start[a:b].ravel() - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            p = np.repeat(np.arange(a, b), n[a:b])
            row = rest[p]
            d = points[row, 0] - at[i, 0]
            d2 = d * d
            for axis in (1, 2):
                d = points[row, axis] - at[i, axis]
                d2 += d * d
            near = d2 <= cap[p]
            if own is not None:
                near &= ids[i] != own[row]
            p, i, d2 = p[near], i[near], d2[near]
            done = over[a:b] | (np.bincount(p - a, minlength=b - a) >= k)
            left.append(rest[a:b][~done])
            p, i, d2 = (x[done[p - a]] for x in (p, i, d2))
            by = np.lexsort((ids[i], d2, p))
            p, i, d2 = p[by], i[by], d2[by]
            first = np.arange(len(p)) - np.searchsorted(p, p) < k
            found.append((rest[p[first]], i[first], d2[first]))
            a = b
        rest = np.concatenate(left)
        reach *= 2
    if not found:
        return np.arange(0), np.arange(0), np.zeros(0)
    p, i, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(p, kind="stable")
    return p[by], i[by], d2[by]


def _meeting(points: np.ndarray, within: np.ndarray, low: np.ndarray, high: np.ndarray, tiles: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of points and tiles whose box their ball meets. No point of a box is nearer than the box, also as doubles."""
    rows, found = [np.arange(0)], [np.arange(0)]
    step = max(1, room // max(1, len(tiles)))
    for a in range(0, len(points) if len(tiles) else 0, step):
        d2 = np.zeros((len(points[a : a + step]), len(tiles)))
        for axis in range(3):
            q = points[a : a + step, axis, None]
            d = np.maximum(np.maximum(low[:, axis] - q, q - high[:, axis]), 0.0)
            d2 += d * d
        p, t = np.nonzero(d2 <= within[a : a + step, None])
        rows.append(p + a)
        found.append(tiles[t])
    return np.concatenate(rows), np.concatenate(found)


def _xyz(t: pa.Table, names: tuple[str, str, str]) -> np.ndarray:
    return np.stack([t[c].to_numpy().astype(float) for c in names], 1)


def searcher(k: int, self_join: bool, room: int, boxes: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For a tile's others (other_id, ox, oy, oz) and its points (ray_id, ex, ey, ez, within): each point with near, its k nearest, and more.

    boxes (tiles, low and high corners): more holds the other tiles that can have nearer ones, within then how near those must be.
    """

    def run(key: tuple, others: pa.Table, points: pa.Table) -> pa.Table:
        at, q, within = _xyz(others, ("ox", "oy", "oz")), _xyz(points, ("ex", "ey", "ez")), points["within"].to_numpy().copy()
        ids = others["other_id"].to_numpy()
        p, i, d2 = search(at, ids, q, points["ray_id"].to_numpy() if self_join else None, within, k, room)
        ends = np.searchsorted(p, np.arange(len(q) + 1))
        rank = np.arange(len(p)) - ends[p] + 1
        near = pa.StructArray.from_arrays(
            [pa.array(ids[i], others["other_id"].type), *[pa.array(at[i, n]) for n in range(3)], pa.array(d2), pa.array(rank, pa.int32())], ["other_id", "ox", "oy", "oz", "d2", "rank"]
        )
        rows, tiles = np.arange(0), np.arange(0)
        if boxes is not None:
            full = np.diff(ends) == k
            within[full] = d2[ends[1:][full] - 1]
            usual = within <= np.quantile(within, 0.95) if len(q) else np.zeros(0, bool)
            parts = []
            for some in (usual, ~usual):  # a few points that look far don't make all others try every tile
                own = np.flatnonzero(some)
                if len(own):
                    far = np.sqrt(within[own].max()) * (1 + 1e-9)
                    close = (boxes[0] != key[0].as_py()) & ((boxes[1] <= q[own].max(0) + far) & (boxes[2] >= q[own].min(0) - far)).all(1)
                    r, t = _meeting(q[own], within[own], boxes[1][close], boxes[2][close], boxes[0][close], room)
                    parts.append((own[r], t))
            if parts:
                rows, tiles = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.argsort(rows, kind="stable")
                rows, tiles = rows[by], tiles[by]
        more = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(q) + 1)), pa.int32()), pa.array(tiles, pa.int32()))
        columns = [*[points[c] for c in ("ray_id", "ex", "ey", "ez")], pa.array(within), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near), more]
        return pa.table(columns, ["ray_id", "ex", "ey", "ez", "within", "near", "more"])

    return run


def splits(sample: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """A tree of halves of sample down to leaf points: axis, border, and both children of each node; children below zero are tiles, from -1 down."""
    nodes: list[list[float]] = []
    tiles = 0

    def grow(p: np.ndarray) -> int:
        nonlocal tiles
        side = p.max(0) - p.min(0) if len(p) else np.zeros(3)
        axis = int(side.argmax())
        if len(p) <= leaf or side[axis] <= 0:
            tiles += 1
            return -tiles
        border = float(np.median(p[:, axis]))
        lower = p[:, axis] <= border
        if lower.all():
            border = float(p[:, axis][p[:, axis] < border].max())
            lower = p[:, axis] <= border
        me = len(nodes)
        nodes.append([axis, border, 0, 0])
        nodes[me][2] = grow(p[lower])
        nodes[me][3] = grow(p[~lower])
        return me

    grow(sample)
    n = np.array(nodes, float).reshape(-1, 4)
    return n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3].astype(np.int64)


def tile_of(tree: tuple[np.ndarray, ...], points: np.ndarray) -> np.ndarray:
    """The tile of each point, from 1."""
    axis, border, low, high = tree
    node = np.full(len(points), 0 if len(axis) else -1)
    while len(rest := np.flatnonzero(node >= 0)):
        n = node[rest]
        node[rest] = np.where(points[rest, axis[n]] <= border[n], low[n], high[n])
    return (-node).astype(np.int32)


def tiler(tree: tuple[np.ndarray, ...], names: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with their rows' tile behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("tile", pa.array(tile_of(tree, _xyz(pa.table(b), names)), pa.int32()))

    return run
