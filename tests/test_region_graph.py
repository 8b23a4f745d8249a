"""Region graphs against brute force: merging rounds, absorbing one at a time, ties, clear pixels, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bobbin.operators import regiongraph as G

PX = "image_id long, y int, x int, r int, g int, b int, a int, label int"


def grow(labels, clear):
    """4-connected components of equal labels: first pixel of each pixel's component."""
    h, w = labels.shape
    root = {}
    for y in range(h):
        for x in range(w):
            if (y, x) in root or clear[y, x]:
                continue
            todo, root[y, x] = [(y, x)], (y, x)
            while todo:
                j, i = todo.pop()
                for p in ((j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)):
                    if 0 <= p[0] < h and 0 <= p[1] < w and p not in root and not clear[p] and labels[p] == labels[y, x]:
                        root[p] = (y, x)
                        todo.append(p)
    return root


def absorb_one_at_a_time(labels, clear, least):
    labels = labels.copy()
    while True:
        root = grow(labels, clear)
        parts = {}
        for p, r in root.items():
            parts.setdefault(r, []).append(p)
        for r in sorted((r for r in parts if len(parts[r]) < least), key=lambda r: (len(parts[r]), r)):
            votes = {}
            for j, i in parts[r]:
                for p in ((j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)):
                    if p in root and root[p] != r:
                        votes[labels[p]] = votes.get(labels[p], 0) + 1
            if votes:
                best = min(votes, key=lambda v: (-votes[v], v))
                for p in parts[r]:
                    labels[p] = best
                break
        else:
            return labels


def test_absorbing_in_rounds_equals_one_at_a_time(spark):
    rng = np.random.default_rng(2)
    images, rows = {}, []
    for k in range(6):
        labels, clear = rng.integers(0, 2 + k % 4, (6, 7)), rng.random((6, 7)) < (0.25 if k % 3 == 0 else 0.0)
        images[k] = labels, clear
        rows += [(k, y, x, 0, 0, 0, 0 if clear[y, x] else 255, int(labels[y, x])) for y in range(6) for x in range(7)]
    rows += [(99, 0, 0, 0, 0, 0, 255, 3), (98, 0, 0, 0, 0, 0, 0, 3)]  # alone, and clear
    px = spark.createDataFrame(rows, PX)
    for least in (5,):
        got = {(r.image_id, r.y, r.x): r.label for r in G.absorb_small_regions(px, least).collect()}
        want = {(99, 0, 0): 3}
        for k, (labels, clear) in images.items():
            done = absorb_one_at_a_time(labels, clear, least)
            want |= {(k, y, x): int(done[y, x]) for y in range(6) for x in range(7) if not clear[y, x]}
        assert got == want
    assert G.absorb_small_regions(px.limit(0), 4).count() == 0


def plain_weight(p, q, edge, total, least_px):
    import colour_reference

    mean = lambda n: [n[k] / n["n"] for k in "lab"]
    w = colour_reference.de2000(mean(p), mean(q))
    small, big = sorted((p["n"], q["n"]))
    if p["face"] or q["face"]:
        w /= 5 / 26
    if small >= least_px and big / small >= 18:
        w /= 0.6
    if edge["bsum"] / edge["blen"] >= 6 and small >= least_px and small >= 0.09 * total:
        w /= 0.5
    return round(w, 6)


def plain_merge(nodes, edges, limit, least_px):
    nodes, edges = {k: dict(v) for k, v in nodes.items()}, {k: dict(v) for k, v in edges.items()}
    root = {k: k for k in nodes}
    total = sum(n["n"] for n in nodes.values())
    while True:
        rank = {k: (plain_weight(nodes[k[0]], nodes[k[1]], e, total, least_px), *k) for k, e in edges.items()}
        under = {k: r for k, r in rank.items() if r[0] < limit}
        best = {}
        for k, r in under.items():
            for end in k:
                best[end] = min(best.get(end, r), r)
        pairs = [k for k, r in under.items() if best[k[0]] == r == best[k[1]]]
        if not pairs:
            return nodes, root
        to = {v: u for u, v in pairs}
        for v, u in to.items():
            for c in ("l", "a", "b", "n"):
                nodes[u][c] += nodes[v][c]
            nodes[u]["face"] |= nodes[v]["face"]
            del nodes[v]
        made = {}
        for (u, v), e in edges.items():
            k = tuple(sorted((to.get(u, u), to.get(v, v))))
            if k[0] != k[1]:
                m = made.setdefault(k, {"bsum": 0.0, "blen": 0})
                m["bsum"] += e["bsum"]
                m["blen"] += e["blen"]
        edges = made
        root = {k: to.get(r, r) for k, r in root.items()}


@pytest.mark.parametrize("limit", [8.0, 30.0])
def test_merging_regions_equals_brute_force(spark, limit):
    rng = np.random.default_rng(7)
    nodes, edges = {}, {}
    for image in range(5):
        n = 24
        for k in range(n):
            size = int(rng.integers(1, 9)) * (40 if k % 8 == 0 else 1)
            mean = rng.uniform((20, -40, -40), (80, 40, 40)) if k % 3 else np.array([50.0, 5.0, 5.0])
            nodes[image, k] = {"l": float(mean[0] * size), "a": float(mean[1] * size), "b": float(mean[2] * size), "n": size, "face": bool(k == 5)}
        for k in range(n):
            for j in {(k + 1) % n, (k + 7) % n}:
                edges[image, min(k, j), max(k, j)] = {"bsum": float(rng.uniform(0, 60)), "blen": int(rng.integers(1, 9))}
    df = spark.createDataFrame([(i, k, v["l"], v["a"], v["b"], v["n"], v["face"]) for (i, k), v in nodes.items()] + [(9, 0, 1.0, 1.0, 1.0, 1, False)], "image_id long, id long, l double, a double, b double, n long, face boolean")
    links = spark.createDataFrame([(i, u, v, e["bsum"], e["blen"]) for (i, u, v), e in edges.items()], "image_id long, u long, v long, bsum double, blen long")
    left, roots = G.merge_regions(df, links, limit, 4)
    got, at = {(r.image_id, r.id): (r.n, round(r.l / r.n, 4), r.face) for r in left.collect()}, {(r.image_id, r.id): r.root for r in roots.collect()}
    assert got.pop((9, 0)) == (1, 1.0, False) and at.pop((9, 0)) == 0
    for image in range(5):
        want, root = plain_merge({k: v for (i, k), v in nodes.items() if i == image}, {(u, v): e for (i, u, v), e in edges.items() if i == image}, limit, 4)
        assert {k: v for (i, k), v in got.items() if i == image} == {k: (v["n"], round(v["l"] / v["n"], 4), v["face"]) for k, v in want.items()}
        assert {k: r for (i, k), r in at.items() if i == image} == root
    assert len(got) < len(nodes)


def test_region_graph_counts_sides_and_steps(spark):
    px = spark.createDataFrame([(1, y, x, 255 * (x > 1), 255 * (x > 1), 255 * (x > 1), 255 if (y, x) != (2, 3) else 0, 0) for y in range(3) for x in range(4)], PX).withColumn("id", (F.col("x") > 1).cast("long"))
    nodes, edges = G.region_graph(px)
    assert {(r.id, r.n) for r in nodes.collect()} == {(0, 6), (1, 5)}
    e = edges.collect()
    assert [(r.u, r.v, r.blen) for r in e] == [(0, 1, 3)] and math.isclose(e[0].bsum, 300, abs_tol=0.1)


def test_absorbing_across_squares_equals_one_at_a_time(spark):
    rng = np.random.default_rng(5)
    labels, clear = rng.integers(0, 4, (9, 70)), rng.random((9, 70)) < 0.05
    px = spark.createDataFrame([(1, y + 28, x - 30, 0, 0, 0, 0 if clear[y, x] else 255, int(labels[y, x])) for y in range(9) for x in range(70)], PX)
    got = {(r.y - 28, r.x + 30): r.label for r in G.absorb_small_regions(px, 4).collect()}
    done = absorb_one_at_a_time(labels, clear, 4)
    assert got == {(y, x): int(done[y, x]) for y in range(9) for x in range(70) if not clear[y, x]}


def test_images_of_one_square_are_absorbed_in_one_pass(spark, monkeypatch):
    turns = []
    monkeypatch.setattr(G, "absorb_squares", lambda *a, f=G.absorb_squares: turns.append(a) or f(*a))
    rng = np.random.default_rng(6)
    px = spark.createDataFrame([(k, y, x, 0, 0, 0, 255, int(rng.integers(0, 3))) for k in range(3) for y in range(24) for x in range(24)], PX)
    assert G.absorb_small_regions(px, 4).count() == 3 * 24 * 24 and len(turns) == 1
