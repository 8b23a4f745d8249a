"""Corners of spines against a plain walk; short spines, ties, stillness, many corners."""

import math

import numpy as np

from bobbin.operators import spines as S


def plain(points, width):
    n = len(points)
    if n < 5:
        return []
    step = sorted(math.dist(a, b) for a, b in zip(points, points[1:]))[(n - 1) // 2]
    if step <= 0:
        return []
    k = max(1, round(round(max(width, 5.0) / step, 9)))
    out = []
    for i in range(k, n - k):
        (ax, ay), (x, y), (cx, cy) = points[i - k], points[i], points[i + k]
        turn = math.degrees(math.atan2(cy - y, cx - x) - math.atan2(y - ay, x - ax))
        turn = round(abs((turn + 180) % 360 - 180), 6)
        if turn >= 30 and (not out or i - out[-1][0] > 2 * k):
            out.append((i, turn))
    return out


def test_corners_equal_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    spines = {k: np.cumsum(rng.normal(0, 6, (int(rng.integers(3, 60)), 2)), axis=0).round(1).tolist() for k in range(25)}
    spines |= {100: [[0.0, 0.0]] * 9, 101: [[10.0 * k, 0.0] for k in range(20)], 102: [[10.0 * k, 0.0] for k in range(9)] + [[80.0, 10.0 * k] for k in range(1, 9)], 103: [[10.0 * k, 25.0 * (k % 2)] for k in range(1500)], 104: [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]}
    rows = [(s, i, x, y, 20.0) for s, p in spines.items() for i, (x, y) in enumerate(p)]
    got = {}
    for r in S.spine_corners(spark.createDataFrame(rows, "spine long, i long, x double, y double, width double"), ["spine"]).collect():
        got.setdefault(r.spine, []).append((r.i, r.turn))
    want = {s: w for s, p in spines.items() if (w := plain(p, 20.0))}
    assert {s: sorted(v) for s, v in got.items()} == want and 102 in want and 101 not in want and len(want[103]) > S.CHUNK
