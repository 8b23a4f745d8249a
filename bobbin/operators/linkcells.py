"""Cover of one design's links, for tasks: cells that thread lies on, samples of links that lie bare, stretches of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .outlines import _each
from .pixels import disc

#: Samples worked out at a time, so that memory is bounded by the design's cells.
SAMPLES = 1 << 20


def samples(ends: np.ndarray, size: np.ndarray, cell_u: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of steps (x0, y0, x1, y1) in blocks: the step, the number, the length and the cell of the middles of equal parts, no longer than a cell."""
    n = np.maximum(1, np.ceil(np.rint(size / cell_u * 1e9) / 1e9)).astype(np.int64)
    block = np.cumsum(n) // SAMPLES
    for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
        of, i = np.repeat(k, n[k]), _each(n[k])
        at = lambda a, b: np.floor(np.rint((ends[a, of] + (ends[b, of] - ends[a, of]) * (i + 0.5) / n[of]) / cell_u * 1e6) / 1e6).astype(np.int64)
        yield of, i, size[of] / n[of], at(0, 2), at(1, 3)


def _last(code: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, with the highest block on it."""
    order = np.lexsort((block, code))
    code, block = code[order], block[order]
    end = np.append(code[1:] != code[:-1], True)[:len(code)]
    return code[end], block[end]


def cover_rows(key: tuple[pa.Scalar, ...], steps: pa.Table, cell_u: float, reach: int) -> pa.Table:
    """design_id, segments, thread_mm, uncovered_mm, max_mm of the steps (block, seq, x0, y0, x1, y1, len, transport) of one design; no row without links."""
    steps = steps.drop_null()
    ends = np.stack([steps.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")])
    block, seq, size = (steps.column(c).to_numpy() for c in ("block", "seq", "len"))
    link = steps.column("transport").to_numpy()
    rows = []
    if link.any():
        # a margin of the reach, so that a neighbour's number is the cell's own and a fixed one
        low = [int(np.floor(min(ends[k].min(), ends[k + 2].min()) / cell_u)) - reach - 1 for k in (0, 1)]
        tall = int(np.floor(max(ends[1].max(), ends[3].max()) / cell_u)) + reach + 2 - low[1]
        code = lambda cx, cy: (cx - low[0]) * tall + (cy - low[1])
        laid = np.flatnonzero(~link)
        found = [_last(code(cx, cy), block[laid][of]) for of, _, _, cx, cy in samples(ends[:, laid], size[laid], cell_u)] if len(laid) else []
        cells, last = _last(*(np.concatenate(c) for c in zip(*found))) if found else (np.empty(0, np.int64),) * 2
        own = np.flatnonzero(link)
        own = own[np.lexsort((seq[own], block[own]))]
        x0, y0, x1, y1 = ends[:, own]
        # where a step doesn't go on from the one before it in its block
        apart = np.append(True, (x1[:-1] != x0[1:]) | (y1[:-1] != y0[1:]) | (np.diff(block[own]) != 0))
        part, bare, fresh = [], [], []
        for of, i, long, cx, cy in samples(ends[:, own], size[own], cell_u):
            here, covered = code(cx, cy), np.zeros(len(of), dtype=bool)
            for dy, dx in disc(reach) if len(cells) else ():
                at = here - dx * tall - dy
                k = np.minimum(np.searchsorted(cells, at), len(cells) - 1)
                covered |= (cells[k] == at) & (last[k] >= block[own][of])
            part.append(long)
            bare.append(~covered)
            fresh.append((i == 0) & apart[of])
        part, bare, fresh = (np.concatenate(c) for c in (part, bare, fresh))
        opens = bare & (fresh | np.append(True, ~bare[:-1]))
        loose = np.where(bare, part, 0.0)
        # samples under thread add nothing to the stretch before them
        rows = [(len(own), part.sum() * 0.1, loose.sum() * 0.1, np.bincount(np.cumsum(opens), loose).max() * 0.1)]
    kinds = {"segments": pa.int64(), "thread_mm": pa.float64(), "uncovered_mm": pa.float64(), "max_mm": pa.float64()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.table({"design_id": pa.array([key[0].as_py()] * len(rows), key[0].type)} | {n: pa.array(list(c), t) for (n, t), c in zip(kinds.items(), columns)})
