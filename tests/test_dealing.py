"""Stitches and pixels are shuffled once, by design or image, in parts whose number grows with the rows."""

import re

from pyspark.sql import functions as F

from bobbin.operators import compare as K
from bobbin.operators import coverage as V
from bobbin.operators import descriptors as D
from bobbin.operators import technique as T
from bobbin.sources import shared
from bobbin.views import view

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange (\w+)\(.*?, (\d+)\), (\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_parts_grow_with_the_table(spark, monkeypatch):
    rows = view(spark, SF, "lineitem").count()
    for size in (1_000, 500):
        monkeypatch.setattr(shared, "PART_ROWS", size)
        for name in ("v_stitches", "v_pixels", "v_stitches_b"):
            found = exchanges(view(spark, SF, name))
            assert found == [("hashpartitioning", str(-(-rows // size)), "REPARTITION_BY_NUM")]


def test_a_chain_of_windows_and_cells_is_one_shuffle(spark):
    assert len(exchanges(V.thread_density(view(spark, SF, "v_stitches")))) == 1


def test_points_of_underlay_are_not_shuffled(spark):
    assert len(exchanges(T.underlay_share(view(spark, SF, "v_stitches")))) == 1


def test_operators_that_gather_by_other_keys_deal_too(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 500)
    corners = view(spark, SF, "v_vertices").selectExpr("design_id", "shape_id", "vertex", "x_u AS x", "y_u AS y")
    rows = corners.count()
    assert {n for _, n, _ in exchanges(D.log_polar(corners, ["design_id", "shape_id"]))} == {str(-(-rows // 500))}
    st = view(spark, SF, "v_stitches")
    assert {n for _, n, _ in exchanges(K.combine_designs(st.withColumn("g", F.floor(F.col("design_id") / 10)), "g"))} == {str(-(-st.count() // 500))}
