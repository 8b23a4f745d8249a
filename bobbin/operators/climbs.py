"""Registration of one design, for tasks: masks of both sides on the lattice, the overlap of a shift, climbs from the seeds.

climbed() and tried() take both sides' steps (x0, y0, x1, y1, len) of one design as Arrow tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .outlines import _each

#: Units of the finest step of the search, and how many of them a cell is wide.
LATTICE_U, CELL = 2.5, 2
#: Steps of the climb in units of the lattice (1.0, 0.5, 0.25 mm), the longest shift in units, and what counts as a gain.
STEPS, REACH_U, GAIN = (4, 2, 1), 400.0, 1e-6
MOVES = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))
#: Samples worked out at a time, and cells up to which a mask is kept as a picture, so that memory is bounded.
SAMPLES, PICTURE = 1 << 20, 1 << 26


def distinct(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The places (x, y) that occur `least` times at least."""
    if not len(x):
        return x, y
    left, low, tall = x.min(), y.min(), y.max() - y.min() + 1
    code, n = np.unique((x - left) * tall + (y - low), return_counts=True)
    code = code[n >= least]
    return code // tall + left, code % tall + low


def lattice(steps: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Points of the lattice that a design's steps touch: the middles of equal parts, none longer than the lattice."""
    x0, y0, x1, y1, size = (steps.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "len"))
    n = np.maximum(1, np.ceil(size / LATTICE_U)).astype(np.int64)
    block = np.cumsum(n) // SAMPLES
    found = []
    for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
        of, i, parts = np.repeat(k, n[k]), _each(n[k]) + 0.5, np.repeat(n[k], n[k])
        at = lambda a, b: np.floor(np.rint((a[of] + (b[of] - a[of]) * i / parts) / LATTICE_U * 1e6) / 1e6).astype(np.int64)
        found.append(distinct(at(x0, x1), at(y0, y1)))
    return distinct(*(np.concatenate(c) for c in zip(*found)))


def solid(x: np.ndarray, y: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places whose square window of `window` cells the cells, each once, fill to `least`; without a window each cell once."""
    if not window:
        return distinct(x, y)
    box = np.arange(-window, window + 1)
    return distinct(np.add.outer(x, np.repeat(box, len(box))).ravel(), np.add.outer(y, np.tile(box, len(box))).ravel(), least * len(box) ** 2 - 1e-9)


def mask(points: tuple[np.ndarray, np.ndarray], rest: tuple[int, int], window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Solid cells under the points moved by a remainder of a cell."""
    cells = distinct(*((p + r) // CELL for p, r in zip(points, rest)))
    return solid(*cells, window, least) if window else cells


def overlap(pro: pa.Table, ours: pa.Table, window: int, least: float) -> Callable[[int, int], float]:
    """The overlap (IoU, to nine places) of both sides' masks by the shift (sx, sy) of ours. A shift is whole cells and a remainder, so CELL * CELL masks serve all."""
    px, py = mask(lattice(pro), (0, 0), window, least)
    points = lattice(ours)
    reach = math.ceil(REACH_U / LATTICE_U / CELL) + 1
    rests = [(i, j) for i in range(CELL) for j in range(CELL)]
    masks = [mask(points, r, window, least) for r in rests]
    xs, ys = (np.concatenate([c, *(m[k] for m in masks)]) for k, c in enumerate((px, py)))
    if not len(xs):
        return lambda sx, sy: 0.0
    # a margin as wide as the reach: a shift adds one number to every cell's
    left, low = xs.min() - reach, ys.min() - reach
    tall = ys.max() + reach + 1 - low
    code = lambda x, y: (x - left) * tall + (y - low)
    here, there = np.sort(code(px, py)), {r: code(*m) for r, m in zip(rests, masks)}
    area = int(xs.max() + reach + 1 - left) * int(tall)
    picture = np.zeros(area, dtype=bool) if area <= PICTURE else None
    if picture is not None:
        picture[here] = True

    def iou(sx: int, sy: int) -> float:
        moved = there[sx % CELL, sy % CELL] + (sx // CELL * tall + sy // CELL)
        if picture is not None:
            both = int(np.count_nonzero(picture[moved]))
        else:
            both = len(np.intersect1d(here, moved, assume_unique=True))
        either = len(here) + len(moved) - both
        # halves away from zero, as SQL rounds
        return (2 * both * 10**9 + either) // (2 * either) / 1e9 if either else 0.0

    return iou


def within(sx: int, sy: int) -> bool:
    return math.sqrt(sx * sx + sy * sy) * LATTICE_U <= REACH_U


def seeds(pro: pa.Table, ours: pa.Table) -> list[tuple[int, int, int]]:
    """Where the climbs start: no shift (seed 0) and, if it is another one within reach, middle on middle (seed 1)."""
    def middle(t: pa.Table, c: str) -> float:
        a, b = (t.column(f"{c}{k}").to_numpy() for k in (0, 1))
        return (min(a.min(), b.min()) + max(a.max(), b.max())) / 2

    at = tuple(math.floor((middle(pro, c) - middle(ours, c)) / LATTICE_U + 0.5) for c in "xy")
    return [(0, 0, 0)] + ([(1, *at)] if at != (0, 0) and within(*at) else [])


def moves(sx: int, sy: int, step: int) -> list[tuple[int, int, int]]:
    """The moves (number, sx, sy) by a step that stay within reach."""
    return [(k, x, y) for k, (i, j) in enumerate(MOVES) if within(x := sx + i * step, y := sy + j * step)]


def climbed(key: tuple[pa.Scalar, ...], pro: pa.Table, ours: pa.Table, window: int, least: float) -> pa.Table:
    """One row: the shift that the climbs reach, the first seed's on ties. A climb goes to the best of the eight moves (the first on ties) if that
    gains, else to the next finer step. Overlaps only grow, so it ends."""
    best = []
    if pro.num_rows and ours.num_rows:
        iou = overlap(pro, ours, window, least)
        for seed, sx, sy in seeds(pro, ours):
            now, level = iou(sx, sy), 0
            while level < len(STEPS):
                top = max(((iou(x, y), -k, x, y) for k, x, y in moves(sx, sy, STEPS[level])), default=(-1.0,))
                if top[0] > now + GAIN:
                    now, _, sx, sy = top
                else:
                    level += 1
            best.append((now, -seed, sx, sy))
    rows = [(sx * LATTICE_U, sy * LATTICE_U, now) for now, _, sx, sy in ([max(best)] if best else [])]
    return _table(key, rows, {"dx_u": pa.float64(), "dy_u": pa.float64(), "iou": pa.float64()})


def tried(key: tuple[pa.Scalar, ...], pro: pa.Table, ours: pa.Table, window: int, least: float) -> pa.Table:
    """A row for every seed (move -1) and each of its moves by the widest step: seed, move, sx, sy, iou."""
    rows = []
    if pro.num_rows and ours.num_rows:
        iou = overlap(pro, ours, window, least)
        rows = [(s, k, x, y, iou(x, y)) for s, sx, sy in seeds(pro, ours) for k, x, y in [(-1, sx, sy), *moves(sx, sy, STEPS[0])]]
    return _table(key, rows, {"seed": pa.int32(), "move": pa.int32(), "sx": pa.int64(), "sy": pa.int64(), "iou": pa.float64()})


def _table(key: tuple[pa.Scalar, ...], rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    own = {n: pa.array(list(c), t) for (n, t), c in zip(kinds.items(), columns)}
    return pa.table({"design_id": pa.array([key[0].as_py()] * len(rows), key[0].type)} | own)
