"""Fills of known rows, bare stretches of rings against a plain walk, census of lengths."""

import math
import random

import pytest

from bobbin.operators import census as C


def stitches(spark, designs):
    rows = [(d, i, "stitch", x, y) for d, pts in designs.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "design_id long, seq long, cmd string, x_u long, y_u long")


def tatami(rows=8, gap=6, shift=10):
    """Rows of steps of 50, each begun `shift` further on than the one before."""
    out = []
    for k in range(rows):
        row = [(shift * k + 50 * i, gap * k) for i in range(6)]
        out += row if k % 2 == 0 else row[::-1]
    return out


def test_fill_of_known_rows(spark):
    turned = [(y, x) for x, y in tatami(gap=9)]
    got = {r.design_id: r for r in C.fill_stats(stitches(spark, {1: tatami(), 2: turned, 3: tatami(2)})).collect()}
    assert set(got) == {1, 2}  # two rows are no fill
    assert (got[1].angle, got[1].rows, got[2].angle) == (0, 8, 90)
    # a row's middle lies between the rows' lines by what it shares with its neighbour: the inner gaps are whole
    assert got[1].row_gap == pytest.approx(6, abs=1.1) and got[2].row_gap == pytest.approx(9, abs=1.6)
    assert got[1].step == 50 and len(got[1].stagger) == 7


def plain_arcs(ring):
    n = len(ring)
    flags = [b for _, _, b in ring]
    if not any(flags):
        return []
    step = lambda i: math.dist(ring[i % n][:2], ring[(i + 1) % n][:2])
    if all(flags):
        return [(n, sum(step(i) for i in range(n - 1)))]
    found = []
    for i in range(n):
        if flags[i] and not flags[i - 1]:
            k = 1
            while flags[(i + k) % n]:
                k += 1
            found.append((k, sum(step(i + j) for j in range(k - 1))))
    return found


def test_arcs_equal_a_plain_walk(spark):
    rng = random.Random(5)
    rings = {k: [(rng.randint(0, 90), rng.randint(0, 90), rng.random() < share) for _ in range(n)] for k, (n, share) in enumerate([(1, 1), (1, 0), (2, 1), (7, 1), (7, 0), *[(n, p) for n in (2, 3, 9, 40) for p in (0.2, 0.5, 0.9)]])}
    rings[99] = [(0, 0, True), (3, 4, False), (9, 9, False), (0, 2, True)]  # across the seam
    df = spark.createDataFrame([(k, i, x, y, b) for k, ring in rings.items() for i, (x, y, b) in enumerate(ring)], "ring long, i long, x long, y long, bare boolean")
    got = {}
    for r in C.bare_arcs(df, ["ring"]).collect():
        got.setdefault(r.ring, []).append((r.places, round(r.length, 6)))
    for k, ring in rings.items():
        assert sorted(got.get(k, [])) == sorted((n, round(mm, 6)) for n, mm in plain_arcs(ring)), k
    assert got[99] == [(2, 2.0)]
    assert C.bare_arcs(df.limit(0), ["ring"]).count() == 0


def test_ranks_are_those_of_sorted_values(spark):
    rng = random.Random(2)
    rows = [("ab"[rng.random() < 0.9], float(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in C.ranks(df, "k", df.v, {"p10": 0.1, "median": 0.5, "p90": 0.9}).collect():
        v = sorted(x for k, x in rows if k == r.k)
        assert (r.n, r.p10, r.median, r.p90, r.most) == (len(v), *[v[int(len(v) * q)] for q in (0.1, 0.5, 0.9)], v[-1])
