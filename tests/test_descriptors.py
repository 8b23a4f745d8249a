"""Letter clusters and outline descriptors against all pairs; degenerate shapes; empty tables."""

import math

import numpy as np

from pyspark.sql import functions as F

from bobbin.operators import descriptors as D

SHAPES = "design_id long, shape_id long, cx double, cy double, height double, stroke double"


def linked(p, q):
    alike = lambda a, b: min(a, b) > 0 and min(a, b) / max(a, b) >= 0.5
    return alike(p[4], q[4]) and alike(p[5], q[5]) and round(math.hypot(p[2] - q[2], p[3] - q[3]), 9) <= 3 * max(p[4], q[4])


def test_links_and_clusters_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k % 3), k, float(rng.uniform(-300, 300)), float(rng.uniform(-300, 300)), float(2 ** rng.uniform(-1, 7)), float(2 ** rng.uniform(0, 2))) for k in range(360)]
    rows += [(0, 1000 + k, 900.0 + 3 * 8 * k, 0.0, 8.0, 1.0) for k in range(4)]  # a row of letters, each just in reach of the next
    rows += [(0, 2000, 900.0, 0.0, 0.0, 1.0), (0, 2001, 900.0, 0.0, 8.0, 0.0), (0, 2002, 900.0, 0.0, 16.0, 2.0), (0, 2003, 900.0, 0.0, 4.0, 0.5)]  # no height, no stroke, exactly twice, exactly half
    df = spark.createDataFrame(rows, SHAPES)
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and linked(p, q)}
    got = [tuple(r) for r in D.linked_shapes(df).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    root = {r[:2]: r[1] for r in rows}
    for _ in range(len(rows)):
        moved = [(d, u, v) for d, u, v in want if root[d, u] != root[d, v]]
        if not moved:
            break
        for d, u, v in moved:
            root[d, u] = root[d, v] = min(root[d, u], root[d, v])
    groups = {}
    for r in rows:
        groups.setdefault((r[0], root[r[:2]]), []).append(r)
    out = {(r.design_id, r.shape_id): (r.cluster, r.members, r.stroke) for r in D.text_clusters(df).collect()}
    assert out == {r[:2]: (k, len(g), sorted(x[5] for x in g)[len(g) // 2]) for (_, k), g in groups.items() if len(g) >= 3 for r in g}
    assert D.text_clusters(df.limit(0)).count() == 0


def plain_histograms(points):
    edges = np.logspace(math.log10(0.125), math.log10(2), 6)
    n = len(points)
    r = np.array([[math.dist(p, q) for q in points] for p in points])
    mean = r.sum() / (n * (n - 1))
    out = np.zeros((n, 60))
    for i in range(n):
        for j in range(n):
            if i != j:
                s = r[i, j] / mean if mean else r[i, j]
                a = int(min(max(np.searchsorted(edges, s, side="right") - 1, 0), 4))
                t = (math.atan2(points[j][1] - points[i][1], points[j][0] - points[i][0]) + math.pi) / (2 * math.pi)
                out[i, a * 12 + min(11, int(round(t * 12, 9)))] += 1
    return out / out.sum(axis=1, keepdims=True)


def test_shape_distances_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    shapes = {k: rng.uniform(-50, 50, (9, 2)).round(2) for k in range(6)}
    shapes |= {10 + k: shapes[k] * 3 + rng.normal(0, 0.4, (9, 2)) + 100 for k in range(6)}  # the same, larger and elsewhere
    shapes[30] = np.zeros((4, 2))  # all its points in one place
    rows = [(1, k, i, float(x), float(y)) for k, pts in shapes.items() for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "design_id long, shape_id long, vertex int, x double, y double")
    h = {k: plain_histograms(pts.tolist()) for k, pts in shapes.items()}
    chi = lambda p, q: 0.5 * sum((a - b) ** 2 / (a + b) for a, b in zip(p, q) if a + b)
    want = {}
    for u in shapes:
        for v in shapes:
            if u < v:
                c = np.array([[chi(p, q) for q in h[v]] for p in h[u]])
                d = max(c.min(axis=1).mean(), c.min(axis=0).mean())
                if round(d, 9) <= 0.25:
                    want[u, v] = round(d, 6)
    got = {(r.u, r.v): round(r.distance, 6) for r in D.shape_distances(df, F.lit(0)).collect()}
    assert got == want and {(k, 10 + k) for k in range(6)} <= set(got)
    assert D.shape_distances(df.limit(0), F.lit(0)).count() == 0
