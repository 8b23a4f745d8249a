"""Outlines meet inside tasks, in parts and blocks of bounded size, against all pairs."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from bobbin.operators import descriptors as D
from bobbin.operators import outlines as O
from bobbin.sources import shared
from pyspark.sql import functions as F
from test_descriptors import plain_histograms

KINDS = "design_id long, shape_id long, vertex int, x double, y double"


def plain(shapes, limit=0.25):
    """All pairs of shapes (design, shape, block) -> points."""
    h = {k: plain_histograms(p) for k, p in shapes.items() if len(p) > 1}
    chi = lambda p, q: 0.5 * sum((a - b) ** 2 / (a + b) for a, b in zip(p, q) if a + b)
    want = {}
    for u in h:
        for v in h:
            if u[0] == v[0] and u[2] == v[2] and u[1] < v[1]:
                c = np.array([[chi(p, q) for q in h[v]] for p in h[u]])
                d = max(c.min(axis=1).mean(), c.min(axis=0).mean())
                if round(d, 9) <= limit:
                    want[u[0], u[1], v[1]] = round(d, 6)
    return want


def test_pairs_of_points_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "checkpointed", lambda df: pytest.fail("pairs of points are written"))
    df = spark.createDataFrame([(1, s, i, float(i % 2 * s), float(i // 2)) for s in (1, 2) for i in range(4)], KINDS)
    plan = D.shape_distances(df, F.lit(0))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1 and "Join" not in plan
    assert "Join" not in D.log_polar(df, ["design_id", "shape_id"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part, batch", [(1_024, 10_000), (12, 5), (1, 3)])
def test_parts_and_batches_change_nothing(spark, monkeypatch, part, batch):
    monkeypatch.setattr(D, "PART_POINTS", part)
    monkeypatch.setattr(shared, "PART_ROWS", 20)
    rng, shapes = np.random.default_rng(8), {}
    for d in range(3):
        for s in range(7):
            own = rng.uniform(-50, 50, (int(rng.integers(1, 6)), 2)).round(1)
            shapes[d, s, s % 2] = own.tolist()
            shapes[d, s + 20, s % 2] = (own * 2 + 100).tolist()
    rows = [(d, s, i, *map(float, p)) for (d, s, _), pts in shapes.items() for i, p in enumerate(pts)]
    rows += [(None, 1, 0, 0.0, 0.0), (1, None, 0, 0.0, 0.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, KINDS).repartition(3)
        out = [tuple(r) for r in D.shape_distances(df, F.col("shape_id") % 20 % 2).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len({r[:3] for r in out}) and {r[:3]: round(r[3], 6) for r in out} == plain(shapes)
    assert len(out) > 15


def test_blocks_of_pairs_change_nothing(monkeypatch):
    rng, rows = np.random.default_rng(9), []
    for s in range(12):
        rows += [(1, 0, 0, 0, 0, s, i, *rng.uniform(-9, 9, 2)) for i in range(int(rng.integers(1, 7)))]
    names = ["design_id", "block", "p", "q", "part", "shape_id", "vertex", "x", "y"]
    batch = pa.RecordBatch.from_pydict({n: pa.array(list(c)) for n, c in zip(names, zip(*rows))})
    found = []
    for pairs in (1 << 18, 20, 1):
        monkeypatch.setattr(O, "PAIRS", pairs)
        polar, = O.polar_rows([batch.slice(0, 7), batch.slice(7, 1), batch.slice(8)], ["design_id", "block"])
        far, = O.alike_rows([batch.slice(0, 3), batch.slice(3)], 2.0)
        found.append((polar.to_pydict(), [{**r, "distance": round(r["distance"], 9)} for r in far.to_pylist()]))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 10


def test_repeated_rows_lone_points_and_unknown_places():
    count = lambda x, y, slot, first: O.counts(np.array(first), np.array(slot), np.array(x, dtype=float), np.array(y, dtype=float))
    twice = count([0, 0, 3, 5], [0, 0, 4, 0], [0, 0, 1, 2], [0, 4])
    assert twice.sum(axis=1).tolist() == [4, 3, 3]  # each row of one point meets each row of the others
    assert count([1], [1], [0], [0, 1]).sum() == 0
    assert count([0, math.nan], [0, 1], [0, 1], [0, 2])[:, O.BINS].tolist() == [1, 1]
    lone = pa.RecordBatch.from_pydict({c: pa.array([0]) for c in ("design_id", "block", "p", "q", "part", "shape_id", "vertex", "x", "y")})
    assert sum(b.num_rows for b in O.alike_rows([lone], 0.25)) == 0 and list(O.alike_rows([], 0.25)) == []


def test_all_shapes_of_a_design_meet(spark):
    """Ids of any remainder, and outlines of equal counts, at any cut into parts."""
    square = [(0, 0), (9, 0), (9, 7), (0, 7)]
    shapes = {(1, s, 0): [(x * k + s, y * k) for x, y in square] for s, k in ((1, 1), (2, 3), (3, 1), (4, 2), (8, 5))}
    shapes[2, 5, 0], shapes[1, 6, 0] = square, [(0, 0), (1, 0), (30, 1)]
    rows = [(d, s, i, float(x), float(y)) for (d, s, _), p in shapes.items() for i, (x, y) in enumerate(p)]
    out = [tuple(r) for r in D.shape_distances(spark.createDataFrame(rows, KINDS)).collect()]
    assert len(out) == 10 and {r[:3]: round(r[3], 6) for r in out} == plain(shapes)


def test_outlines_of_equal_counts_meet_others_once(monkeypatch):
    met, real = [], O.distances
    monkeypatch.setattr(O, "distances", lambda share, a, m, b, n: met.append(len(a)) or real(share, a, m, b, n))
    rows = [(1, 0, 0, 0, 0, s, i, x * (s + 1), y) for s in range(8) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])]
    names = ["design_id", "block", "p", "q", "part", "shape_id", "vertex", "x", "y"]
    out, = O.alike_rows([pa.RecordBatch.from_pydict({n: pa.array(list(c)) for n, c in zip(names, zip(*rows))})], 0.25)
    assert met == [1] and out.num_rows == 28


def test_points_without_a_place_make_another_outline():
    """Their counts are part of the outline's: equal but for them, two outlines are not as far from a third."""
    names = ["design_id", "block", "p", "q", "part", "shape_id", "vertex", "x", "y"]
    square = [(0.0, 0.0), (9.0, 0.0), (9.0, 7.0), (0.0, 7.0)]
    shapes = [square, [*square, (math.nan, 0.0)], square[:3]]
    rows = [(1, 0, 0, 0, 0, s, i, x, y) for s, p in enumerate(shapes) for i, (x, y) in enumerate(p)]
    far = lambda keep: {(r["u"], r["v"]): r["distance"] for b in O.alike_rows([pa.RecordBatch.from_pydict({n: pa.array(list(c)) for n, c in zip(names, zip(*[r for r in rows if r[5] in keep]))})], 2.0) for r in b.to_pylist()}
    assert far({0, 1, 2}) == {k: v for pair in ({0, 1}, {0, 2}, {1, 2}) for k, v in far(pair).items()}
