"""K-means goes on until no centre moves."""

import numpy as np
import pytest

import __spark_entry__ as entry
from bobbin.operators import colour as K
from bobbin.operators import lloyd as L
from bobbin.plans.colour_queries import lab_colours
from bobbin.views import view

SF = "/root/testdata/sf0.01"


def plain(pts, k):
    """Rounds over (L, A, B, weight) until nothing moves: centre -> place and weight."""
    order = sorted(p[:3] for p in pts)
    at = {c: order[(2 * c + 1) * len(order) // (2 * k)] for c in range(k)}
    while True:
        own = [min(at, key=lambda c: (round(sum((a - b) ** 2 for a, b in zip(p, at[c])) ** 0.5, 6), c)) for p in pts]
        w = {c: sum(p[3] for p, o in zip(pts, own) if o == c) for c in set(own)}
        new = {c: tuple(sum(p[x] * p[3] for p, o in zip(pts, own) if o == c) / w[c] for x in range(3)) for c in w}
        if all(sum((a - b) ** 2 for a, b in zip(new[c], at[c])) ** 0.5 <= 1e-6 for c in new):
            return {c: (*(round(v, 6) for v in new[c]), w[c]) for c in new}
        at = new


def test_centres_of_the_query_stay_where_they_are(spark):
    px = view(spark, SF, "v_pixels")
    got = entry.queries()["a53_kmeans_centres"](spark, SF)
    again = K.kmeans_round(lab_colours(px), got.select("image_id", "centre", "L", "A", "B"))
    rows = lambda d: {(r.image_id, r.centre): (r.L, r.A, r.B, r.weight) for r in d.collect()}
    here, there = rows(got), rows(again)
    assert here.keys() == there.keys() and len(here) > 300
    assert all(v == pytest.approx(there[k], abs=2e-6) for k, v in here.items())


def test_whole_loop_equals_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    images = {i: [(*rng.uniform(0, 100, 3).round(3).tolist(), int(w)) for w in rng.integers(1, 9, n)] for i, n in enumerate((1, 2, 5, 90, 400))}
    images[9] = [(5.0, 0.0, 0.0, 2)] * 7
    rows = [(i, *p) for i, pts in images.items() for p in pts]
    df = spark.createDataFrame([*rows, (3, None, 0.0, 0.0, 1), (7, None, 0.0, 0.0, 1)], "image_id long, L double, A double, B double, weight long").repartition(3)
    monkeypatch.setattr(L, "BLOCK", 7)
    out = K.kmeans_centres(df, 4).collect()
    assert len(out) == len({(r.image_id, r.centre) for r in out})
    for i, pts in images.items():
        assert {r.centre: (*(round(v, 6) for v in (r.L, r.A, r.B)), r.weight) for r in out if r.image_id == i} == plain(pts, 4), i
    assert K.kmeans_centres(df.limit(0), 4).count() == 0


def test_owners_that_come_again_end_the_rounds(monkeypatch):
    monkeypatch.setattr(L, "STILL", -1.0)
    at = np.array([[0.0, 0, 0], [1, 0, 0], [9, 0, 0], [10, 0, 0]])
    number, centres, own = L.lloyd(at, np.ones(4, dtype=np.int64), 2, None)
    assert number.tolist() == [0, 1] and centres[:, 0].tolist() == [0.5, 9.5] and own.tolist() == [2, 2]
