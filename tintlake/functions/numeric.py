"""Numpy helpers over blocks of points and the bounded clusters of one image.

The module is registered for pickling by value, so tasks carry these functions with them and executors do not
need the package installed.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from .constants import OKLAB_FROM_LMS, OKLAB_LMS
from .kernel import _linear

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one column per centre."""
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


FEATURES = ["f0", "f1", "f2"]
SUMS = ["s0", "s1", "s2", "sw"]
# Points whose distances to all centres are held at once.
POINTS_AT_ONCE = 1 << 13


def block_of(rows: pa.Table) -> pa.Table:
    """Rows (key, split, f0..f2, w, pos) as one row (key, split, f, w, pos) of raw values."""
    key, split, *features, w, pos = [rows.column(i) for i in range(rows.num_columns)]
    f = np.stack([c.to_numpy() for c in features], axis=1)
    values = [key[:1], split[:1], [f.tobytes()], [w.to_numpy().tobytes()], [pos.to_numpy().tobytes()]]
    return pa.table(values, [*rows.schema.names[:2], "f", "w", "pos"])


def _blocks(f: pa.Array, w: pa.Array, pos: pa.Array, centres: pa.Array):
    """Features, weights, positions and centres of each block."""
    spots = np.stack([centres.values.field(c).to_numpy() for c in FEATURES], axis=1)
    edges = centres.offsets.to_numpy()
    for i in range(len(f)):
        points, weight, at = (np.frombuffer(a[i].as_buffer(), dtype=t) for a, t in ((f, np.float64), (w, np.float64), (pos, np.int64)))
        yield points.reshape(-1, 3), weight, at, spots[edges[i] : edges[i + 1]]


def _squared(points: np.ndarray, spots: np.ndarray):
    """Squared distances to all centres, of some points at a time, terms added from the first feature on."""
    for lo in range(0, len(points), POINTS_AT_ONCE):
        d = 0.0
        for q in range(3):
            e = points[lo : lo + POINTS_AT_ONCE, q, None] - spots[:, q]
            e *= e
            d += e
        yield d


def _heaviest(mass: np.ndarray, at: np.ndarray) -> tuple[int, int] | None:
    """Rank and place of the point of greatest mass. Masses compare on a fine logarithmic scale, ties by the smaller
    ``at`` (below 2^24). None: no mass."""
    rank = np.floor(np.log(mass + 1.0) * 1e6).astype(np.int64) * (1 << 24) + ((1 << 24) - 1) - at
    best = int(np.where(mass > 0, rank, -1).argmax())
    return (int(rank[best]), best) if mass[best] > 0 else None


def _farthest(points: np.ndarray, weight: np.ndarray, at: np.ndarray, spots: np.ndarray) -> tuple[int, int] | None:
    """The heaviest point by weight times the squared distance to the nearest centre, if there are any."""
    return _heaviest(weight * np.concatenate([d.min(axis=1) for d in _squared(points, spots)]) if len(spots) else weight, at)


def _nearest(points: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point, the first on ties."""
    return np.concatenate([d.argmin(axis=1) for d in _squared(points, spots)])


def _summed(c: np.ndarray, weighted: list[np.ndarray], count: int) -> np.ndarray:
    return np.stack([np.bincount(c, x, count) for x in weighted], axis=1)


def _sums(points: np.ndarray, weight: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """For each centre the weighted feature sums and weight of the points nearest to it, the first on ties."""
    return _summed(_nearest(points, spots), [*[weight * points[:, q] for q in range(3)], weight], len(spots))


def farthest_of_blocks(f: pa.Array, w: pa.Array, pos: pa.Array, centres: pa.Array) -> pa.Array:
    """Rank and features of each block's next seed; null if no point has mass."""
    out = []
    for points, weight, at, spots in _blocks(f, w, pos, centres):
        found = _farthest(points, weight, at, spots)
        out.append((found[0], *points[found[1]].tolist()) if found else (None,) * 4)
    kinds = [pa.int64(), *[pa.float64()] * 3]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["rank", *FEATURES])


def sums_of_blocks(f: pa.Array, w: pa.Array, pos: pa.Array, centres: pa.Array) -> pa.Array:
    """Each block's sums, one struct a centre."""
    sums = [np.zeros((0, 4)), *[_sums(points, weight, spots) for points, weight, _, spots in _blocks(f, w, pos, centres)]]
    edges = np.cumsum([len(s) for s in sums]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in np.concatenate(sums).T], SUMS))


def settled_points(rounds: int, k: int | str):
    """Seeds and rounds of the points of one key, which get ``c``, the number of their centre at rest. ``k`` may name a
    column."""

    def settle(table: pa.Table) -> pa.Table:
        points = np.stack([table.column(x).to_numpy() for x in FEATURES], axis=1)
        weight, at = table.column("w").to_numpy().astype(np.float64), table.column("pos").to_numpy().astype(np.int64)
        wanted = table.column(k)[0].as_py() if isinstance(k, str) else k
        spots, near = np.zeros((0, 3)), None
        while len(spots) < wanted and (found := _heaviest(weight if near is None else weight * near, at)):
            spots = np.concatenate([spots, points[found[1]][None]])
            far = np.concatenate([d[:, 0] for d in _squared(points, spots[-1:])])
            near = far if near is None else np.minimum(near, far)
        lead, weighted = spots[:1], [*[weight * points[:, q] for q in range(3)], weight]
        for _ in range(rounds):
            c = _nearest(points, spots)
            sums = _summed(c, weighted, len(spots))
            with np.errstate(divide="ignore", invalid="ignore"):
                after = np.where(sums[:, 3:] > 0, np.round(sums[:, :3] / sums[:, 3:], 6), lead)
            if (after == spots).all():
                break
            spots = after
        else:
            c = _nearest(points, spots)
        return table.append_column("c", pa.array(c.astype(np.int64)))

    return settle


def labelled(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Points of a key with ``c``, the number of the nearest centre of the key's state, the first on ties."""
    spots = centres.column("centres").combine_chunks()
    spots = np.stack([spots.flatten().field(c).to_numpy() for c in FEATURES], axis=1)
    f = np.stack([points.column(c).to_numpy() for c in FEATURES], axis=1)
    return points.append_column("c", pa.array(_nearest(f, spots).astype(np.int64)))


def merged_hues(least: float):
    """Running means of hues less than ``least`` apart, over rows (palette, ..., run, h, c) ordered by palette, run, hue."""

    def merge(batches):
        row, h, c = None, 0.0, 0.0
        schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for *key, x, y in zip(*[col.to_pylist() for col in batch.columns]):
                if key == row and x - h < least:
                    h, c = (h + x) / 2.0, (c + y) / 2.0
                    continue
                if row is not None:
                    out.append((*row, h, c))
                row, h, c = key, x, y
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*row, h, c), schema)], schema=schema)

    return merge


def merge_closest(f: np.ndarray, w: np.ndarray, extra: np.ndarray, radius: float, floor: int):
    """Merge the nearest pair (first on ties) while it is closer than ``radius`` and more than ``floor`` remain."""
    while len(f) > max(floor, 1):
        d = distances(f, f)
        d[np.tril_indices(len(f))] = np.inf
        i, j = divmod(int(d.argmin()), len(f))
        if not d[i, j] < radius * radius:
            break
        total = w[i] + w[j]
        if total > 0:
            f[i] = (f[i] * w[i] + f[j] * w[j]) / total
        w[i], extra[i] = total, extra[i] + extra[j]
        f, w, extra = (np.delete(v, j, axis=0) for v in (f, w, extra))
    return f, w, extra


_LINEAR = np.array([_linear(i) for i in range(256)])


def oklab_of(rgb: np.ndarray) -> np.ndarray:
    return np.cbrt(_LINEAR[rgb] @ np.array(OKLAB_LMS).T) @ np.array(OKLAB_FROM_LMS).T


def density_labels(radius: float, least: float):
    """Labels ``c`` of the bins of one image: 0 for noise, else the cluster in order of its first core bin."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        f = [table.column(x).to_numpy()[order] for x in FEATURES]
        near = sum((x[:, None] - x[None, :]) ** 2 for x in f) <= radius * radius
        core = np.flatnonzero(near @ table.column("n").to_numpy()[order].astype(np.int64) >= least)
        touched = np.full(len(key), len(core))  # the first core bin that is reached; len(core) for none
        if len(core):
            links, root = near[np.ix_(core, core)], np.arange(len(core))
            while True:
                low = np.where(links, root[None, :], len(core)).min(axis=1)
                low = low[low]
                if (low == root).all():
                    break
                root = low
            touched = np.where(near[:, core], root[None, :], len(core)).min(axis=1)
        c = np.zeros(len(key), np.int64)
        found = np.unique(touched[touched < len(core)])
        c[order] = np.where(touched < len(core), np.searchsorted(found, touched) + 1, 0)
        return table.append_column("c", pa.array(c))

    return run
