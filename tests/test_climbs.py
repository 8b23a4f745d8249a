"""Climbs inside tasks: nothing is written between rounds, and blocks, pictures and windows change nothing."""

import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from bobbin.operators import climbs as C
from bobbin.operators import graph
from bobbin.sources import shared

SF = "/root/testdata/sf0.001"


def steps(seed, n=60, off=(0, 0)):
    rng = np.random.default_rng(seed)
    x, y = (np.cumsum(rng.integers(-30, 31, n)) + o for o in off)
    return pa.table({"x0": x[:-1] * 1.0, "y0": y[:-1] * 1.0, "x1": x[1:] * 1.0, "y1": y[1:] * 1.0, "len": np.hypot(np.diff(x), np.diff(y))})


@pytest.mark.parametrize("name", ["q16_registration_climb", "q16_climb_first_round"])
def test_rounds_write_nothing_and_shuffle_no_mask(spark, monkeypatch, name):
    for of, what in ((graph, "checkpointed"), (shared, "fresh")):
        monkeypatch.setattr(of, what, lambda *a: pytest.fail("a round is written"))
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 2 and "Join" not in plan


@pytest.mark.parametrize("window", [0, 1])
def test_overlaps_equal_sets_of_cells(monkeypatch, window):
    a, b = steps(3), steps(3, 50, (13, -40))
    shifts = [(0, 0), (3, -7), (-5, 16), (160, 0), (-1, -160)]

    def plain(s):
        def cells(t, r):
            p = {((x + r[0]) // 2, (y + r[1]) // 2) for x, y in zip(*(c.tolist() for c in C.lattice(t)))}
            near = lambda x, y: [(x + i, y + j) for i in range(-window, window + 1) for j in range(-window, window + 1)]
            return {q for c in p for q in near(*c) if len(p.intersection(near(*q))) / (2 * window + 1) ** 2 >= (0.3 if window else 0)}

        m, pro = cells(b, s), cells(a, (0, 0))
        return round(len(m & pro) / len(m | pro), 9)

    want = [plain(s) for s in shifts]
    for picture, samples in ((1 << 26, 1 << 20), (0, 1 << 20), (1 << 26, 7)):
        monkeypatch.setattr(C, "PICTURE", picture)
        monkeypatch.setattr(C, "SAMPLES", samples)
        iou = C.overlap(a, b, window, 0.3)
        assert [iou(*s) for s in shifts] == pytest.approx(want, abs=1e-12)
    assert len(set(want)) > 2


def test_middles_ties_and_empty_sides():
    key = (pa.scalar(5),)
    a, far = steps(4), steps(4, 60, (390, 0))
    assert C.seeds(a, a) == [(0, 0, 0)] and C.seeds(a, far) == [(0, 0, 0), (1, -156, 0)] and C.seeds(a, steps(4, 60, (410, 0))) == [(0, 0, 0)]
    assert C.climbed(key, a, far, 0, 0.55).to_pylist() == [{"design_id": 5, "dx_u": -390.0, "dy_u": 0.0, "iou": 1.0}]
    assert C.climbed(key, a, a.slice(0, 0), 0, 0.55).num_rows == C.tried(key, a.slice(0, 0), a, 0, 0.55).num_rows == 0
    # no window is full: overlaps of 0, the first seed stays
    assert C.climbed(key, a, far, 1, 1.1).to_pylist() == [{"design_id": 5, "dx_u": 0.0, "dy_u": 0.0, "iou": 0.0}]
