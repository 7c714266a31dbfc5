"""Rays against ellipsoids by tiles: a tree of boxes in each tile, which rays go down together in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .tiles import _xyz, tile_of

#: Ellipsoids in a leaf, and rays that go down a tree together.
LEAF, TOGETHER = 8, 2048

RAY = [("sx", "sy", "sz"), ("ex", "ey", "ez")]
M = ["m_xx", "m_xy", "m_xz", "m_yy", "m_yz", "m_zz"]


Axes = list[np.ndarray]


def _reach(o: Axes, inverse: Axes, low: Axes, high: Axes, room: tuple[Axes, Axes] | None = None) -> np.ndarray:
    """Whether the way from o to o + d meets the box; inverse is 1 / d. room: a larger box; a way that begins in it may meet the first one behind its start, too."""
    near, far, behind = -np.inf, np.inf, room is not None
    with np.errstate(invalid="ignore", over="ignore"):
        for axis in range(3):
            a, b = (low[axis] - o[axis]) * inverse[axis], (high[axis] - o[axis]) * inverse[axis]
            near, far = np.fmax(near, np.fmin(a, b)), np.fmin(far, np.fmax(a, b))
            if room is not None:
                behind = behind & (room[0][axis] <= o[axis]) & (o[axis] <= room[1][axis])
    return np.where(behind, near, np.maximum(near, 0.0)) <= np.minimum(far, 1.0)


def _axes(x: np.ndarray) -> Axes:
    return [np.ascontiguousarray(x[:, axis]) for axis in range(x.shape[1])]


def _at(x: Axes, rows: np.ndarray) -> Axes:
    return [a.take(rows) for a in x]


def _inverse(d: Axes) -> Axes:
    with np.errstate(divide="ignore"):
        return [1 / a for a in d]


def wide(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes widened by more than rounding."""
    return low - 1e-9 * (1 + np.abs(low)), high + 1e-9 * (1 + np.abs(high))


IN = ("in_low_x", "in_low_y", "in_low_z"), ("in_high_x", "in_high_y", "in_high_z")


def snug(mean: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes that hold every point where a ray can be found to meet the ellipsoid, starts being `far` from it at most.

    Its own extents, widened by what rounding can do to the form; where that is too much (flat or thin shapes), the given box.
    """
    full = m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    value = np.linalg.eigvalsh(full) if len(full) else np.zeros((0, 3))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        slack = 64 * np.finfo(float).eps * far * far * value[:, 2] * (value[:, 2] / value[:, 0])
        sound = (value[:, 0] > 0) & (slack < 1)
    low, high = low.copy(), high.copy()
    ext = np.sqrt(np.diagonal(np.linalg.inv(full[sound]), axis1=1, axis2=2)) * np.sqrt(1 + slack[sound, None]) * (1 + 1e-6)
    low[sound], high[sound] = mean[sound] - ext, mean[sound] + ext
    return low, high


def placer(tree: tuple[np.ndarray, ...], far: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ellipsoids with their snug boxes and their tile behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table(b)
            mean = _xyz(t, ("mean_x", "mean_y", "mean_z"))
            box = snug(mean, np.stack([t[c].to_numpy() for c in M], 1), _xyz(t, ("low_x", "low_y", "low_z")), _xyz(t, ("high_x", "high_y", "high_z")), far)
            for names, x in zip(IN, box, strict=True):
                for axis, name in enumerate(names):
                    b = b.append_column(name, pa.array(x[:, axis]))
            yield b.append_column("tile", pa.array(tile_of(tree, mean), pa.int32()))

    return run


def crosser(boxes: tuple[np.ndarray, ...], room: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each ray once for each tile whose box it meets, with the tile behind. boxes: tiles, low and high corners of snug boxes and of all."""
    tile, low, high, around = boxes[0], *wide(boxes[1], boxes[2]), wide(boxes[3], boxes[4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, room // max(1, len(tile)))
        for b in batches:
            t = pa.table(b)
            start, end = (_xyz(t, n) for n in RAY)
            o, inverse = _axes(start), _inverse(_axes(end - start))
            for k in range(0, len(start) if len(tile) else 0, step):
                part = [[a[k : k + step, None] for a in x] for x in (o, inverse)]
                r, i = np.nonzero(_reach(*part, low.T, high.T, (around[0].T, around[1].T)))
                yield b.take(pa.array(r + k)).append_column("tile", pa.array(tile[i], pa.int32()))

    return run


def _tree(low: np.ndarray, high: np.ndarray, around: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """An order of the boxes, and nodes: their low and high corners, those of the boxes around, both children (0 for a leaf) and their first and last place in the order."""
    mid, order = (low + high) / 2, np.arange(len(low))
    nodes: list[tuple] = []

    def grow(a: int, b: int) -> int:
        own, me = order[a:b], len(nodes)
        nodes.append((low[own].min(0), high[own].max(0), around[0][own].min(0), around[1][own].max(0), [0, 0], (a, b)))
        if b - a > LEAF:
            p = mid[own]
            half = (b - a) // 2
            order[a:b] = own[np.argpartition(p[:, int(np.ptp(p, axis=0).argmax())], half)]
            nodes[me][4][:] = grow(a, a + half), grow(a + half, b)
        return me

    grow(0, len(low))
    return order, *(np.array([n[k] for n in nodes]) for k in range(6))


def _form(m: Axes, p: Axes, q: Axes) -> np.ndarray:
    out = 0.0
    for i in range(3):
        for j in range(3):
            out = out + m[(0, 1, 2, 1, 3, 4, 2, 4, 5)[3 * i + j]] * p[i] * q[j]
    return out


#: Sums over the sure pairs of an ellipsoid and a part of the rays, parts being in order of time. before and after: passes before the part's first hit and
#: after its last one. first_ray: the first ray that passes, by id. Rows with a ray_id are pairs that are not in these sums.
TALLY = "part int, hits long, passes long, first_hit double, last_hit double, before long, after long, first_ray long, first_pass double, ray_id long, sure boolean"


def _tally(key: tuple, shapes: pa.Table, rays: pa.Table, p: np.ndarray, i: np.ndarray, passes: np.ndarray, sure: np.ndarray) -> pa.Table:
    n, time, ray = len(shapes), rays["time"].to_numpy().astype(float), rays["ray_id"].to_numpy()
    plain = sure & np.isfinite(time[p])
    q, odd, odd_shape, odd_sure = plain & passes, p[~plain], i[~plain], sure[~plain]
    hit_shape, hit_time = i[plain & ~passes], time[p[plain & ~passes]]
    p, i = p[q], i[q]
    hits, gone = np.bincount(hit_shape, minlength=n), np.bincount(i, minlength=n)
    first, last, least, seen = np.full(n, np.inf), np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.zeros(n)
    np.minimum.at(first, hit_shape, hit_time)
    np.maximum.at(last, hit_shape, hit_time)
    np.minimum.at(least, i, ray[p])
    x = least[i] == ray[p]
    seen[i[x]] = time[p[x]]
    before, after = np.bincount(i[time[p] < first[i]], minlength=n), np.bincount(i[time[p] > last[i]], minlength=n)
    own = np.flatnonzero(hits + gone)
    rest = len(odd)
    no_hit, no_pass = (np.r_[x[own] == 0, np.ones(rest, bool)] for x in (hits, gone))
    zero = np.zeros(rest, np.int64)
    rows = pa.array(np.r_[own, odd_shape])
    columns = {c: shapes[c].take(rows) for c in ("shape_id", "shape_time")} | {"part": pa.array(np.full(len(rows), key[1].as_py()), pa.int32())}
    columns |= {k: pa.array(np.r_[v[own], zero]) for k, v in (("hits", hits), ("passes", gone), ("before", before), ("after", after))}
    columns |= {k: pa.array(np.r_[v[own], zero], mask=mask) for k, v, mask in (("first_hit", first, no_hit), ("last_hit", last, no_hit), ("first_ray", least, no_pass), ("first_pass", seen, no_pass))}
    pair = np.r_[np.zeros(len(own), bool), np.ones(rest, bool)]
    return pa.table(columns | {"ray_id": pa.array(np.r_[np.zeros(len(own), np.int64), ray[odd]], mask=~pair), "sure": pa.array(np.r_[np.ones(len(own), bool), odd_sure])})


def finder(pass_distance: float, schema: pa.Schema, tally: bool = False) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For a tile's ellipsoids and rays: the pairs that meet, their outcome, and whether the ray goes through the ellipsoid itself (sure).

    tally: sums for each ellipsoid instead, and only those pairs that are not sure or have no time.
    """

    def run(key: tuple, shapes: pa.Table, rays: pa.Table) -> pa.Table:
        if not len(shapes) or not len(rays):
            return schema.empty_table()
        mean, m = _axes(_xyz(shapes, ("mean_x", "mean_y", "mean_z"))), _axes(np.stack([shapes[c].to_numpy() for c in M], 1))
        box = wide(_xyz(shapes, ("low_x", "low_y", "low_z")), _xyz(shapes, ("high_x", "high_y", "high_z")))
        own = wide(_xyz(shapes, IN[0]), _xyz(shapes, IN[1]))
        around = np.minimum(own[0], box[0]), np.maximum(own[1], box[1])
        beyond = ((own[0] < box[0]) | (own[1] > box[1])).any(1)  # a ray may meet these outside their box
        order, low, high, *outer, child, span = _tree(*own, around)
        low, high, outer, box, own, around = (_axes(low), _axes(high), *([_axes(y) for y in x] for x in (outer, box, own, around)))
        start, end = (_xyz(rays, n) for n in RAY)
        within = np.all([(outer[0][a][0] <= start[:, a]) & (start[:, a] <= outer[1][a][0]) for a in range(3)], 0)
        start, ray = _axes(start), _axes(end - start)
        inverse = _inverse(ray)
        found: list[tuple[np.ndarray, ...]] = []
        for rows, inside in ((np.flatnonzero(within), True), (np.flatnonzero(~within), False)):
            for k in range(0, len(rows), TOGETHER):
                r = rows[k : k + TOGETHER]
                at = np.zeros(len(r), np.int64)
                while len(r):
                    on = _reach(_at(start, r), _at(inverse, r), _at(low, at), _at(high, at), (_at(outer[0], at), _at(outer[1], at)) if inside else None)
                    r, at = r[on], at[on]
                    leaf = child[at, 0] == 0
                    first = span[at[leaf], 0]
                    n = span[at[leaf], 1] - first
                    p = np.repeat(r[leaf], n)
                    i = order.take(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                    on = _reach(_at(start, p), _at(inverse, p), _at(own[0], i), _at(own[1], i), (_at(around[0], i), _at(around[1], i)) if inside else None)
                    p, i = p[on], i[on]
                    odd = np.flatnonzero(beyond[i]) if not inside else np.arange(len(i))
                    off = odd[~_reach(_at(start, p[odd]), _at(inverse, p[odd]), _at(box[0], i[odd]), _at(box[1], i[odd]))]
                    p, i = np.delete(p, off), np.delete(i, off)
                    d = _at(ray, p)
                    to = [x - y for x, y in zip(_at(mean, i), _at(start, p), strict=True)]
                    of = _at(m, i)
                    rr, tr, tt = _form(of, d, d), _form(of, to, d), _form(of, to, to)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d2 = tt - tr * tr / rr
                        on = np.flatnonzero(d2 <= 1.0)
                        p, i, rr, tr, d2, d = p[on], i[on], rr[on], tr[on], d2[on], _at(d, on)
                        along, rl = np.sqrt(np.maximum(0.0, 1.0 - d2)), np.sqrt(rr)
                        middle = tr / rl
                        passes = rl * (1.0 - pass_distance / np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])) > middle + along
                    on = rl >= middle - along
                    sure = np.minimum(rl, middle + along) - np.maximum(0.0, middle - along) > 1e-9 * rl
                    found.append((p[on], i[on], passes[on], sure[on]))
                    r, at = np.repeat(r[~leaf], 2), child[at[~leaf]].ravel()
        p, i, passes, sure = (np.concatenate(x) for x in zip(*found, strict=True))
        if tally:
            return _tally(key, shapes, rays, p, i, passes, sure).select(schema.names).cast(schema)
        columns = [shapes["shape_id"].take(pa.array(i)), shapes["shape_time"].take(pa.array(i)), rays["ray_id"].take(pa.array(p)), rays["time"].take(pa.array(p)), pa.array(passes), pa.array(sure)]
        return pa.table(columns, ["shape_id", "shape_time", "ray_id", "time", "passes", "sure"]).cast(schema)

    return run
