"""Registration and the score against plain versions and planted shifts."""

import math

import pytest
from pyspark.sql import functions as F

from bobbin.operators import parity as P
from bobbin.operators.stream import sample_segments


def stitches(spark, designs):
    rows = [(d, i, "stitch", int(x), int(y)) for d, pts in designs.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "design_id long, seq long, cmd string, x_u long, y_u long")


def fill(x0, y0, w, h, gap=4):
    """A zigzag of rows."""
    out = []
    for k in range(h // gap + 1):
        row = [(x0 + t, y0 + k * gap) for t in range(0, w + 1, 30)]
        out += row if k % 2 == 0 else row[::-1]
    return out


def ell(dx=0, dy=0, w=240):
    return [(x + dx, y + dy) for x, y in fill(0, 0, w, 60) + fill(0, 60, 60, 120)]


def plain(spark, a, b, design):
    """The climbs with sets of cells, masks made anew for every shift."""
    pts = lambda df: {(math.floor(round(r.x / 2.5, 6)), math.floor(round(r.y / 2.5, 6))) for r in sample_segments(df, 2.5).where(f"design_id = {design}").collect()}
    pa, pb = pts(a), pts(b)
    pro = {(x // 2, y // 2) for x, y in pa}
    mid = lambda df, c: df.where(f"design_id = {design}").agg(((F.min(c) + F.max(c)) / 2)).first()[0]

    def iou(s):
        m = {((x + s[0]) // 2, (y + s[1]) // 2) for x, y in pb}
        return round(len(m & pro) / len(m | pro), 9)

    best = None
    centre = tuple(math.floor((mid(a, c) - mid(b, c)) / 2.5 + 0.5) for c in ("x_u", "y_u"))
    for s in dict.fromkeys([(0, 0), centre]):
        if math.hypot(*s) * 2.5 > 400:
            continue
        cur = iou(s)
        for step in (4, 2, 1):
            while True:
                found = None
                for i, j in P.MOVES:
                    t = (s[0] + i * step, s[1] + j * step)
                    if math.hypot(*t) * 2.5 <= 400 and (found is None or iou(t) > found[0]):
                        found = (iou(t), t)
                if found is None or found[0] <= cur + 1e-6:
                    break
                cur, s = found
        if best is None or cur > best[0]:
            best = (cur, s)
    return best


def test_climb_equals_plain_search(spark):
    a = stitches(spark, {1: ell(), 2: ell(7, 3), 3: fill(0, 0, 120, 40)})
    b = stitches(spark, {1: ell(13, -21, 270), 2: fill(20, 30, 180, 90, 6), 3: fill(500, 0, 120, 40)})
    got = {r.design_id: r for r in P.register(a, b, window=0).collect()}
    for d in (1, 2, 3):
        score, s = plain(spark, a, b, d)
        assert (got[d].iou, got[d].dx_u, got[d].dy_u) == (pytest.approx(score), s[0] * 2.5, s[1] * 2.5), d


def test_planted_shifts_are_found(spark):
    """Shifts on the lattice, up to 40 mm; beyond that the search stays within its reach."""
    plants = {1: (0, 0), 2: (10, -5), 3: (400, 0), 4: (-240, 320), 5: (-35, 95), 6: (900, 0)}
    a = stitches(spark, {d: ell() for d in plants})
    b = stitches(spark, {d: ell(-x, -y) for d, (x, y) in plants.items()})
    got = {r.design_id: r for r in P.register(a, b).collect()}
    for d, (x, y) in plants.items():
        if d == 6:
            assert math.hypot(got[d].dx_u, got[d].dy_u) <= 400
        else:
            assert (got[d].dx_u, got[d].dy_u, got[d].iou) == (x, y, 1.0), d


def test_designs_of_one_side_and_empty_tables(spark):
    a, b = stitches(spark, {1: ell(), 2: ell()}), stitches(spark, {2: ell(), 3: ell()})
    assert [r.design_id for r in P.register(a, b).collect()] == [2]
    assert P.register(a.limit(0), b).count() == 0
    dot = stitches(spark, {1: [(0, 0)]})
    assert P.register(dot, dot).count() == 0


COLOURS = "design_id long, block long, r int, g int, b int"


def score(spark, a, b, our=(200, 0, 0)):
    pro = spark.createDataFrame([(d, 0, 200, 0, 0) for d in (1, 2)], COLOURS)
    ours = spark.createDataFrame([(d, 0, *our) for d in (1, 2)], COLOURS)
    return {r.design_id: r for r in P.parity_score(a, b, pro, ours).collect()}


def test_score_of_equal_and_of_turned_designs(spark):
    a = stitches(spark, {1: ell(), 2: ell()})
    b = stitches(spark, {1: ell(), 2: [(y, x) for x, y in ell()]})
    got = score(spark, a, b)
    one, two = got[1], got[2]
    assert one.score == pytest.approx(100) and one.score_raw == pytest.approx(100)
    assert all(one[k] == pytest.approx(1) for k in P.WEIGHTS)
    # rows at right angles agree in no direction; the ground differs, the thread laid does not
    assert two.direction == 0 and two.direction_raw < 0.2 and two.coverage < 0.9 and two.density > 0.8
    assert two.score == pytest.approx(sum(two[k] * w for k, w in P.WEIGHTS.items())) and two.score < 80


def test_the_shift_is_applied_before_the_score(spark):
    a, b = stitches(spark, {1: ell(), 2: ell()}), stitches(spark, {1: ell(-80, 40), 2: ell(300, 0)})
    grounds = [spark.createDataFrame([(d, 0, 200, 0, 0) for d in (1, 2)], COLOURS)] * 2
    apart = {r.design_id: r for r in P.coverage(a, b, *grounds, 5.0, 1, 0.55).collect()}
    near = score(spark, a, P.moved(b, P.register(a, b)))
    assert near[1].score == pytest.approx(100) and near[2].score == pytest.approx(100)
    assert apart[1].iou < 0.7 and apart[2].iou < 0.1
