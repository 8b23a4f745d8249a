"""Rounds read what was worked out once."""

from pyspark.sql import functions as F

from bobbin.operators import colour as K


def test_kmeans_works_out_its_colours_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(v):
        seen.add(1)
        return v

    rows = [(i, float(v), float(v % 5), 0.0, 1 + v % 3) for i in range(2) for v in range(0, 40, 4)]
    c = spark.createDataFrame(rows, "image_id long, L double, A double, B double, weight long").withColumn("L", told("L"))
    got = {(r.image_id, r.centre): (round(r.L, 6), round(r.A, 6), r.weight) for r in K.kmeans_centres(c, 3, 5).collect()}
    assert seen.value == len(rows)
    pts = [r[1:] for r in rows if r[0] == 0]
    ordered = sorted(p[:3] for p in pts)
    at = [ordered[(2 * k + 1) * len(pts) // 6] for k in range(3)]
    for _ in range(5):
        own = [min(range(3), key=lambda k: (round(sum((a - b) ** 2 for a, b in zip(p, at[k])) ** 0.5, 6), k)) for p in pts]
        w = [sum(p[3] for p, o in zip(pts, own) if o == k) for k in range(3)]
        at = [tuple(sum(p[x] * p[3] for p, o in zip(pts, own) if o == k) / w[k] for x in range(3)) for k in range(3)]
    assert got == {(i, k): (round(at[k][0], 6), round(at[k][1], 6), w[k]) for i in range(2) for k in range(3)}
