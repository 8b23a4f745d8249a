"""Log-polar counts of outlines and their distances, for tasks: sorted rows come as Arrow batches, whole keys are worked out as arrays."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Radius bins (log-spaced edges from 1/8 to 2 mean distances) and angle bins.
RADII, ANGLES, NEAR, FAR = 5, 12, 0.125, 2.0
BINS = RADII * ANGLES
#: Least shares of mean distances of the bins but the first: a share rounds to nine places at the edge or above.
EDGES = np.array([round(NEAR * (FAR / NEAR) ** (k / RADII), 9) - 5e-10 for k in range(1, RADII)])
#: Pairs worked out at a time, so that memory is bounded whatever the size of a shape.
PAIRS = 1 << 18


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places where a row's keys differ from those of the row before, and 0."""
    new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        c = batch.column(k)
        new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut between keys: what a batch cuts waits for the rest of it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and not len(starts(_one([held[-1].slice(held[-1].num_rows - 1), b.slice(b.num_rows - 1)]), keys)) > 1:
            held.append(b)
            continue
        t = _one([*held, b])
        last = int(starts(t, keys)[-1])
        if last:
            yield t.slice(0, last)
        held = [t.slice(last)]
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _each(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for every n."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def counts(first: np.ndarray, slot: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[slot, bin] how many of a shape's other points lie where from a point; the last column counts those without a place.

    A shape's rows begin at `first` (with the number of rows as its end); rows of one point share a `slot`, and slots ascend."""
    n = np.diff(first)
    owner, many = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
    # rows in blocks of a bounded number of pairs
    at = np.cumsum(many) // PAIRS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(many)]])

    def met(a: int, b: int):
        i = np.repeat(np.arange(a, b), many[a:b])
        j = first[owner[i]] + _each(many[a:b])
        keep = slot[i] != slot[j]
        i, j = i[keep], j[keep]
        dx, dy = x[j] - x[i], y[j] - y[i]
        return i, dx, dy, np.sqrt(dx * dx + dy * dy)

    blocks = list(zip(cuts[:-1], cuts[1:]))
    once = [met(*blocks[0])] if len(blocks) == 1 else None
    far, seen = np.zeros(len(n)), np.zeros(len(n))
    for i, _, _, r in once or (met(*c) for c in blocks):
        known = ~np.isnan(r)
        far += np.bincount(owner[i[known]], r[known], len(n))
        seen += np.bincount(owner[i[known]], minlength=len(n))
    mean = far / np.maximum(seen, 1)
    mean[mean == 0] = 1
    out = np.zeros((int(slot[-1]) + 1 if len(slot) else 0, BINS + 1), dtype=np.int64)
    for i, dx, dy, r in once or (met(*c) for c in blocks):
        if len(i):
            turn = np.floor(np.rint((np.arctan2(dy, dx) + math.pi) / (2 * math.pi) * ANGLES * 1e9) / 1e9)
            spot = np.searchsorted(EDGES, r / mean[owner[i]], side="right") * ANGLES + np.minimum(turn, ANGLES - 1)
            spot = np.where(np.isnan(r), BINS, spot).astype(np.int64)
            low, high = int(slot[i[0]]), int(slot[i[-1]]) + 1
            out[low:high] += np.bincount((slot[i] - low) * (BINS + 1) + spot, minlength=(high - low) * (BINS + 1)).reshape(-1, BINS + 1)
    return out


def _counted(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where shapes start (and the end), where points start, and the points' counts, of rows sorted by keys and vertex."""
    shape, point = starts(batch, keys), starts(batch, [*keys, "vertex"])
    slot = np.zeros(batch.num_rows, dtype=np.int64)
    slot[point[1:]] = 1
    return np.append(shape, batch.num_rows), point, counts(np.append(shape, batch.num_rows), np.cumsum(slot), _numbers(batch, "x"), _numbers(batch, "y"))


def polar_rows(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """keys, vertex, bin (null: without a place), n of rows (keys, vertex, x, y) sorted by keys and vertex."""
    for b in whole(batches, keys):
        _, point, c = _counted(b, keys)
        at, spot = np.nonzero(c)
        of = pa.array(point[at])
        columns = {k: b.column(k).take(of) for k in (*keys, "vertex")}
        yield pa.RecordBatch.from_pydict(columns | {"bin": pa.array(spot.astype(np.int32), mask=spot == BINS), "n": pa.array(c[at, spot])})


def alike_rows(batches: Iterable[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """design_id, u, v, distance up to `limit` (and a little over) of the shapes of a key (design_id, block, p, q), of rows
    (key, part, shape_id, vertex, x, y) sorted by key, shape and vertex. Where p and q differ, only shapes of two parts meet."""
    key = ["design_id", "block", "p", "q"]
    for b in whole(batches, key):
        shape, point, c = _counted(b, [*key, "shape_id"])
        rows = shape[:-1]
        first = np.append(np.searchsorted(point, rows), len(point))
        # each bin's shares together, of the bins that occur
        used = np.flatnonzero(c[:, :BINS].any(axis=0))
        share = np.ascontiguousarray((c[:, used] / np.maximum(c.sum(axis=1), 1)[:, None]).T)
        group = np.searchsorted(starts(b, key), rows, side="right")
        size, part, cross = np.diff(first), _numbers(b, "part")[rows], (_numbers(b, "p") != _numbers(b, "q"))[rows]
        # each shape meets those after it in its key; one point alone is no outline
        after = np.searchsorted(group, group, side="right") - np.arange(len(rows)) - 1
        u = np.repeat(np.arange(len(rows)), after)
        v = u + 1 + _each(after)
        keep = (size[u] > 1) & (size[v] > 1) & ~(cross[u] & (part[u] == part[v]))
        u, v = u[keep], v[keep]
        # outlines of equal counts are as far from any other, so a pair of them is worked out once
        alike = _classes(c[:, [*used, BINS]], first)
        _, once, of = np.unique(alike[u] * (len(rows) + 1) + alike[v], return_index=True, return_inverse=True)
        a, z = u[once], v[once]
        far = np.empty(len(a))
        kinds, kind = np.unique(np.stack([size[a], size[z]]), axis=1, return_inverse=True)
        kind = kind.ravel()
        order = np.argsort(kind, kind="stable")
        for (m, n), these in zip(kinds.T, np.split(order, np.cumsum(np.bincount(kind, minlength=kinds.shape[1]))[:-1])):
            step = max(1, PAIRS // int(m * n))
            for k in range(0, len(these), step):
                some = these[k:k + step]
                far[some] = distances(share, first[a[some]], int(m), first[z[some]], int(n))
        far = far[of.ravel()]
        near = far <= limit + 1e-6
        u, v = rows[u[near]], rows[v[near]]
        ids = b.column("shape_id")
        yield pa.RecordBatch.from_pydict({"design_id": b.column("design_id").take(pa.array(u)), "u": ids.take(pa.array(u)), "v": ids.take(pa.array(v)), "distance": pa.array(far[near])})


def _classes(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each outline, whose points' counts are rows of `c` from `first` on, the first outline of equal counts."""
    seen: dict[bytes, int] = {}
    narrow = c.astype(np.int32) if c.size and c.max() < 1 << 31 else c
    return np.array([seen.setdefault(narrow[a:b].tobytes(), k) for k, (a, b) in enumerate(zip(first[:-1], first[1:]))], dtype=np.int64)


def distances(share: np.ndarray, a: np.ndarray, m: int, b: np.ndarray, n: int) -> np.ndarray:
    """For pairs of outlines whose m and n points start at a and b: the mean chi-square of points to their best counterparts, of both sides the greater."""
    left, right = [], np.full((len(a), n), np.inf)
    q = share[:, b[:, None] + np.arange(n)]
    step = max(1, PAIRS // (len(a) * n))
    for k in range(0, m, step):
        p = share[:, a[:, None] + np.arange(k, min(k + step, m))]
        met = np.zeros((len(a), p.shape[2], n))
        for s, t in zip(p, q):
            s, t = s[:, :, None], t[:, None, :]
            met += s * t / np.maximum(s + t, 1e-300)
        chi = 1 - 2 * met
        left.append(chi.min(axis=2))
        right = np.minimum(right, chi.min(axis=1))
    return np.maximum(np.concatenate(left, axis=1).mean(axis=1), right.mean(axis=1))
