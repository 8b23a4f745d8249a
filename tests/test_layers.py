"""Coverage, placement, outlines, rules and long runs on small hand-made tables."""

import math

from bobbin.operators import coverage as V
from bobbin.operators import layout as Y
from bobbin.operators import regions as R
from bobbin.operators import stream as S
from bobbin.plans import qc


def stitches(spark, points, design=1):
    return spark.createDataFrame([(design, k, "stitch", int(x), int(y)) for k, (x, y) in enumerate(points)], "design_id long, seq long, cmd string, x_u long, y_u long")


def test_ribbons_keep_the_area_of_the_thread_and_halve_columns(spark):
    line = stitches(spark, [(k * 30, 5) for k in range(10)])
    rows = V.ribbon_grid(line).collect()
    assert abs(sum(r.units for r in rows) - 270 * 4 / 100) < 1e-9 and {r.cy for r in rows} == {0}
    zigzag = stitches(spark, [(k * 2, 30 * (k % 2)) for k in range(12)])
    assert abs(sum(r.units for r in V.ribbon_grid(zigzag).collect()) - 11 * math.hypot(2, 30) * 4 / 200) < 1e-9


def test_only_large_patches_count_as_stacked(spark):
    patch = [(1, x, y, 3.0) for x in range(5) for y in range(6)]
    grid = spark.createDataFrame([*patch, (1, 40, 40, 4.0), (1, 50, 50, 0.5), (1, 51, 50, 0.1)], "design_id long, cx long, cy long, units double")
    row = V.stacking(grid).first()
    assert (row.over_warn_mm2, row.over_block_mm2, row.most, row.area_mm2) == (30.0, 0.0, 4.0, 32.0)


def test_a_planted_shift_is_found(spark):
    cells = [(1, x, x * x % 7) for x in range(12)]
    a = spark.createDataFrame(cells, "design_id long, cx long, cy long")
    b = spark.createDataFrame([(d, x + 2, y - 1) for d, x, y in cells], "design_id long, cx long, cy long")
    row = V.best_shift(a, b, 3).first()
    assert (row.dx, row.dy, row.iou) == (-2, 1, 1.0)


def test_outlines_of_shifted_squares_and_of_nothing(spark):
    square = lambda image, k: [(image, y, x + k) for y in range(2, 8) for x in range(2, 8)]
    schema = "image_id long, y int, x int"
    frame = spark.createDataFrame([(i, y, x) for i in (1, 2) for y in range(12) for x in range(14)], schema)
    a, b = spark.createDataFrame(square(1, 0) + square(2, 0), schema), spark.createDataFrame(square(1, 3), schema)
    got = {r.image_id: (r.hausdorff, r["mean"]) for r in R.boundary_distance(a, b, frame).collect()}
    edge = lambda k: [(y, x + k) for y in range(2, 8) for x in range(2, 8) if y in (2, 7) or x in (2, 7)]
    near = [min(math.dist(p, q) for q in edge(k2)) for k1, k2 in ((0, 3), (3, 0)) for p in edge(k1)]
    assert got[2] == (None, None)
    assert got[1][0] == max(near) and abs(got[1][1] - sum(near) / len(near)) < 1e-9


def test_placement_turns_centres_scales_and_ends(spark):
    out = Y.place_design(stitches(spark, [(0, 0), (400, 0), (400, 200)]), 90, 10, (100, 100), (1, 0)).orderBy("seq").collect()
    assert [(r.cmd, r.x_u, r.y_u) for r in out] == [("stitch", 60, -100), ("stitch", 60, 100), ("stitch", -40, 100), ("end", 10, 0)]


def test_long_runs_drop_the_points_that_brute_force_drops(spark):
    points = [((k * 7) % 11 + k // 3, (k * 5) % 9) for k in range(900)]
    kept, last = [], None
    for k, p in enumerate(points):
        if last is None or math.dist(p, last) >= 6:
            kept.append(k)
            last = p
    got = sorted(r.seq for r in S.drop_coincident(stitches(spark, points), 6).collect())
    assert got == kept and len(kept) > S.CHUNK


def test_caller_rules_join_the_report(spark):
    st = stitches(spark, [(k * 20, 0) for k in range(40)])
    assert [(r.findings, r.score, r.grade) for r in qc.qc_report(st).collect()] == [(0, 100, "A")]
    try:
        qc.rule("always")(lambda d, limits: d.select("design_id").distinct().selectExpr("design_id", "'mine' AS code", "'block' AS severity", "1.0D AS metric"))
        assert [(r.findings, r.score, r.grade) for r in qc.qc_report(st).collect()] == [(1, 70, "C")]
    finally:
        qc.RULES.clear()


def test_facts_of_a_design_without_satin_or_stitches(spark):
    df = spark.createDataFrame([(1, 0, "trim", 0, 0), (2, 0, "stitch", 0, 0), (2, 1, "color", 0, 0), (2, 2, "stitch", 0, 0)], "design_id long, seq long, cmd string, x_u long, y_u long")
    rows = {r.design_id: r for r in qc.facts(df).collect()}
    assert (rows[1].stitch, rows[1].trim, rows[1].total) == (0, 1, 0) and (rows[2].stitch, rows[2].color, rows[2].shared) == (2, 1, 1)
    assert qc.qc_report(df).count() == 2 and qc.facts(df.limit(0)).count() == 0
