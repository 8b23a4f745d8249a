"""Drag and solid ground are worked out where a design's steps lie, as by joins of cells."""

import re

import pytest
from pyspark.sql import functions as F

from bobbin.operators import drag as D
from bobbin.operators import grounds
from bobbin.operators import measures as M
from bobbin.operators import parity as P
from bobbin.operators import technique as T
from bobbin.operators.pixels import close_cells, open_cells
from bobbin.operators.stream import segments
from bobbin.views import view

SF = "/root/testdata/sf0.001"


def test_no_cell_is_shuffled(spark):
    a, b = view(spark, SF, "v_stitches"), view(spark, SF, "v_stitches_b")
    colours = a.select("design_id", F.lit(0).cast("long").alias("block"), *[F.lit(9).alias(c) for c in "rgb"]).distinct()
    for df in (P.travel(a, b, 20.0, 1), P.coverage(a, b, colours, colours, 20.0, 1, 0.3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*\b(c[xy]|seq|chunk)#", plan)


@pytest.mark.parametrize("radius, hop, points", [(1, 75, 1 << 20), (2, 30, 13)])
def test_drag_equals_joins_of_cells(spark, monkeypatch, radius, hop, points):
    st = view(spark, SF, "v_stitches")
    cells = T.line_cells(segments(st, hop).where("len > 0"), 20.0).select(F.col("design_id").alias("image_id"), F.col("cy").alias("y"), F.col("cx").alias("x")).distinct()
    ground = open_cells(close_cells(cells, radius), radius).select(F.col("image_id").alias("design_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    hidden = M.pass_count_grid(st, 16, 20.0, hop).where("passes >= 2").select("design_id", "cx", "cy").union(ground)
    want = {r.design_id: round(r.drag_mm, 6) for r in T.exposed_drag(st, hidden, 20.0).collect()}
    monkeypatch.setattr(D, "POINTS", points)
    assert {r.design_id: round(r.drag_mm, 6) for r in P.drag(st, 20.0, radius, hop).collect()} == want and len(set(want.values())) > 5


def test_blocks_of_points_change_no_ground(spark, monkeypatch):
    a, b = view(spark, SF, "v_stitches"), view(spark, SF, "v_stitches_b")
    colours = a.select("design_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("block")).distinct().select("*", (F.col("block") % 3 * 90).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    rows = lambda: sorted(tuple(r) for r in P.coverage(a, b, colours, colours, 20.0, 1, 0.3).collect())
    once = rows()
    monkeypatch.setattr(grounds, "POINTS", 17)
    assert rows() == once and len(once) == 10 and len({r[1:] for r in once}) == 10
