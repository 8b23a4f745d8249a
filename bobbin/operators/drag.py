"""Exposed drag of one design, for tasks: ground that hides thread, and how much of each step lies beside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .climbs import distinct
from .outlines import _each
from .pixels import disc

#: Points worked out at a time, stitches of a stretch that counts as a pass, and units of a sample of one.
POINTS, CHUNK, SAMPLE_U = 1 << 20, 16, 5


def blocks(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """0 .. n - 1 for every n in blocks of bounded size: whose it is, and the number."""
    for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // POINTS)) + 1):
        yield np.repeat(k, n[k]), _each(n[k])


def grown(cells: np.ndarray, moves: np.ndarray) -> np.ndarray:
    return np.unique(np.add.outer(cells, moves))


def shrunk(cells: np.ndarray, moves: np.ndarray) -> np.ndarray:
    cells, n = np.unique(np.add.outer(cells, moves), return_counts=True)
    return cells[n == len(moves)]


def drag_rows(key: tuple[pa.Scalar, ...], steps: pa.Table, cell_u: float, radius: int, hop_u: float) -> pa.Table:
    """design_id, drag_mm: thread of the steps (seq, x0, y0, x1, y1, len; hops too) of one design on cells that hide none.

    A cell hides thread if two stretches of sewn steps cross it, or if it is ground that holds when gaps are closed and lone lines opened away."""
    seq = steps.column("seq").to_numpy()
    order = np.argsort(seq, kind="stable")
    x0, y0, x1, y1, size = (steps.column(c).to_numpy()[order] for c in ("x0", "y0", "x1", "y1", "len"))
    # a margin for discs, so that a neighbour's number is the cell's own and a fixed one
    margin = 3 * radius + 2
    left, low = (int(np.floor(min(a.min(), b.min()) / cell_u)) - margin for a, b in ((x0, x1), (y0, y1)))
    tall = int(np.floor(max(y0.max(), y1.max()) / cell_u)) + margin + 1 - low
    code = lambda x, y: (x.astype(np.int64) - left) * tall + (y.astype(np.int64) - low)

    def line(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells of the points from end to end of some steps, and which of these each is of."""
        for of, t in blocks(parts[own]):
            k = own[of]
            at = lambda a, b: np.floor(np.rint((a[k] + (b[k] - a[k]) * t / (parts[k] - 1)) / cell_u * 1e6) / 1e6)
            yield of, code(at(x0, x1), at(y0, y1))

    parts = np.maximum(2, np.floor(size / cell_u).astype(np.int64) + 1)
    sewn = np.flatnonzero(size < hop_u)
    many, crossed = np.maximum(1, np.ceil(size[sewn] / SAMPLE_U)).astype(np.int64), []
    for of, i in blocks(many):
        k = sewn[of]
        at = lambda a, b: np.floor((a[k] + (b[k] - a[k]) * (i + 0.5) / many[of]) / cell_u)
        crossed.append(distinct(code(at(x0, x1), at(y0, y1)), of // CHUNK))
    cells, passes = np.unique(distinct(*(np.concatenate(c) for c in zip(*crossed)))[0], return_counts=True)
    moves = np.array([dx * tall + dy for dy, dx in disc(radius)])
    ground = np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique(c) for _, c in line(sewn[size[sewn] > 0]))]))
    ground = grown(shrunk(shrunk(grown(ground, moves), moves), moves), moves)
    hidden = np.union1d(cells[passes >= 2], ground)
    drawn, bare = np.flatnonzero(size > 0), 0.0
    for of, c in line(drawn):
        share = np.bincount(of, ~np.isin(c, hidden), len(drawn)) / parts[drawn]
        bare += float((share * size[drawn]).sum())
    return pa.table({"design_id": pa.array([key[0].as_py()], key[0].type), "drag_mm": pa.array([bare * 0.1])})
