"""Solid ground of one design's two versions compared, for tasks: what both cover, which colours show, how much of each is met."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .climbs import solid
from .outlines import _each

#: Points worked out at a time, so that memory is bounded by the design's cells.
POINTS = 1 << 20
KINDS = {"iou": pa.float64(), "recall": pa.float64(), "precision": pa.float64(), "agreement": pa.float64(), "worst": pa.float64(), "solid_pro": pa.int64(), "solid_ours": pa.int64()}


def layers(steps: pa.Table, cell_u: float) -> dict[int | None, tuple[np.ndarray, np.ndarray]]:
    """The cells under the points of the steps of each colour, from end to end; None: of all steps."""
    x0, y0, x1, y1, size = (steps.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "len"))
    grp, known = steps.column("grp").fill_null(0).to_numpy(), steps.column("grp").is_valid().to_numpy()
    n = np.maximum(2, np.floor(size / cell_u).astype(np.int64) + 1)
    found: dict[int | None, list] = {}
    for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // POINTS)) + 1):
        of, t = np.repeat(k, n[k]), _each(n[k])
        at = lambda a, b: np.floor(np.rint((a[of] + (b[of] - a[of]) * t / (n[of] - 1)) / cell_u * 1e6) / 1e6).astype(np.int64)
        x, y = at(x0, x1), at(y0, y1)
        for g in [None, *np.unique(grp[k][known[k]]).tolist()]:
            mine = slice(None) if g is None else known[of] & (grp[of] == g)
            found.setdefault(g, []).append(solid(x[mine], y[mine], 0, 0.0))
    return {g: tuple(np.concatenate(c) for c in zip(*some)) for g, some in found.items()}


def ground_rows(key: tuple[pa.Scalar, ...], pro: pa.Table, ours: pa.Table, cell_u: float, window: int, least: float, colour_mm2: float, share: float) -> pa.Table:
    """One row of KINDS of both sides' steps (grp, rank, x0, y0, x1, y1, len) of one design; none without solid ground on either side."""
    sides = []
    for steps in (pro, ours):
        cells = layers(steps, cell_u) if steps.num_rows else {}
        sides.append({g: solid(*solid(*c, 0, 0.0), window, least) for g, c in cells.items()})
    every = [c for s in sides for c in s.values()]
    xs, ys = (np.concatenate([c[k] for c in every]) if every else np.empty(0, np.int64) for k in (0, 1))
    rows = []
    if len(xs):
        left, low, tall = xs.min(), ys.min(), ys.max() - ys.min() + 1
        p, o = ({g: (x - left) * tall + (y - low) for g, (x, y) in s.items()} for s in sides)
        grid = np.union1d(*(s.get(None, np.empty(0, np.int64)) for s in (p, o)))
        n, n_pro, n_ours = len(grid), *(len(s.get(None, ())) for s in (p, o))
        both = n_pro + n_ours - n
        # the colour that shows: of theirs the highest, of ours that whose first block comes last
        seen = ours.select(["grp", "rank"]).group_by("grp").aggregate([("rank", "max")]).drop_null().to_pydict()
        rank = dict(zip(seen["grp"], seen["rank_max"]))
        top = np.zeros((2, n), dtype=np.int64)
        has = np.zeros((2, n), dtype=bool)
        for k, (s, order) in enumerate(((p, lambda g: g), (o, rank.get))):
            for g in sorted((g for g in s if g is not None), key=order):
                at = np.searchsorted(grid, s[g])
                top[k, at], has[k, at] = g, True
        same = (has[0] == has[1]) & (~has[0] | (top[0] == top[1]))
        mm2 = (cell_u * 0.1) ** 2
        area = {g: len(c) * mm2 for g, c in p.items() if g is not None and len(c) * mm2 >= colour_mm2}
        total, recall = sum(area.values()), both / n_pro if n_pro else 0.0
        shown = lambda here: float(same[here].mean()) if here.any() else 1.0
        worst = [shown(has[0] & (top[0] == g)) for g, a in area.items() if a / total >= share]
        rows = [(both / n, recall, both / n_ours if n_ours else 0.0, float(same.mean()), min(worst, default=recall), n_pro, n_ours)]
    columns = zip(*rows) if rows else [()] * len(KINDS)
    return pa.table({"design_id": pa.array([key[0].as_py()] * len(rows), key[0].type)} | {c: pa.array(list(v), t) for (c, t), v in zip(KINDS.items(), columns)})
