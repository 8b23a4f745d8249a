"""Links between shapes on hand-made designs, and the exposure against plain distances."""

import math

import numpy as np

from bobbin.operators import links as N

STEP = "design_id long, block long, run long, seq long, x0 long, y0 long, x1 long, y1 long, len double, transport boolean"


def steps(spark, rows):
    return spark.createDataFrame([(d, b, r, q, *p, math.dist(p[:2], p[2:]), t) for q, (d, b, r, p, t) in enumerate(rows)], STEP)


def cover(spark, rows):
    return {r.design_id: (r.segments, round(r.thread_mm, 6), round(r.uncovered_mm, 6), round(r.max_mm, 6)) for r in N.link_cover(steps(spark, rows)).collect()}


def test_only_own_and_later_blocks_cover_a_link(spark):
    link = lambda d, b: (d, b, 1, (0, 1, 100, 1), True)
    wall = lambda d, b: (d, b, 9, (0, 1, 100, 1), False)
    far = lambda d: (d, 0, 0, (0, 500, 10, 500), False)
    got = cover(spark, [link(1, 1), wall(1, 0), link(2, 1), wall(2, 1), link(3, 1), wall(3, 2), link(4, 1), far(4), far(5)])
    assert got == {1: (1, 10.0, 10.0, 10.0), 2: (1, 10.0, 0.0, 0.0), 3: (1, 10.0, 0.0, 0.0), 4: (1, 10.0, 10.0, 10.0)}


def test_stretches_go_on_over_touching_steps_and_end_at_cover(spark):
    short = [(1, 0, 1, (20 * k, 1, 20 * k + 20, 1), True) for k in range(5)]
    got = cover(spark, [*short, (1, 0, 2, (47, -40, 47, 40), False)])
    # cells of 0.2 mm: the crossing thread covers its own cell and one to either side
    assert got[1][:2] == (5, 10.0) and got[1][2] == 9.4 and got[1][3] == max(4.4, 5.0)
    parted = cover(spark, [(1, 0, 1, (0, 1, 20, 1), True), (1, 0, 1, (24, 1, 44, 1), True)])
    assert parted[1] == (2, 4.0, 4.0, 2.0)
    assert cover(spark, [(1, 0, 1, (0, 1, 20, 1), True), (1, 1, 1, (20, 1, 40, 1), True)])[1][3] == 2.0  # another block is another thread
    assert N.link_cover(steps(spark, [(1, 0, 1, (0, 1, 20, 1), False)])).count() == 0 and cover(spark, [(1, 0, 1, (7, 7, 7, 7), True)]) == {1: (1, 0.0, 0.0, 0.0)}


def test_rule_blocks_over_the_limit_only(spark):
    c = spark.createDataFrame([(1, 2, 9.0, 5.0, 3.0), (2, 2, 9.0, 5.0, 3.001)], "design_id long, segments long, thread_mm double, uncovered_mm double, max_mm double")
    assert [r.design_id for r in N.link_rule(c, 3.0).collect()] == [2] and N.link_rule(c, 0.0).count() == 0


def test_exposure_equals_plain_distances(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d in range(3):
        for r in range(14):
            p = rng.integers(-60, 60, 2)
            for _ in range(3):
                q = p + rng.integers(-40, 40, 2)
                rows.append((d, 0, r, tuple(map(int, (*p, *q))), r % 3 == 0))
                p = q
    got = {(r.design_id, r.run): (round(r.thread_mm, 6), round(r.bare_mm, 6), round(r.worst_mm, 6)) for r in N.link_exposure(steps(spark, rows)).collect()}

    def away(x, y, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = max(0.0, min(1.0, ((x - s[0]) * dx + (y - s[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(x - s[0] - t * dx, y - s[1] - t * dy)

    want = {}
    for d, _, r, s, t in rows:
        if t:
            size = math.dist(s[:2], s[2:])
            n = max(1, math.ceil(round(size, 9)))
            told = want.setdefault((d, r), [0.0, 0.0, 0.0])
            for i in range(n):
                x, y = s[0] + (s[2] - s[0]) * (i + 0.5) / n, s[1] + (s[3] - s[1]) * (i + 0.5) / n
                near = min([8.0, *(away(x, y, o) for e, _, _, o, u in rows if e == d and not u)])
                told[0] += size / n * 0.1
                told[1] += size / n * 0.1 * (round(near, 6) > 2)
                told[2] = max(told[2], near * 0.1)
    assert got == {k: tuple(round(v, 6) for v in t) for k, t in want.items()} and any(v[1] for v in want.values())
