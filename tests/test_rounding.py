"""Rounding as the SQL twins do it, where the shortest decimal text and the scaled double fall on different sides of a half."""

import duckdb

from bobbin.functions.columns import rounded
from bobbin.operators.layout import place_design
from bobbin.operators.regiongraph import edge_weights, region_graph, tiles
from bobbin.plans.stitch_queries import r4
from bobbin.views import view


def test_halves_fall_as_in_sql(spark):
    got = spark.range(-40_000, 40_000).selectExpr("(id * 100 + 50) / 1000000D as x").select("x", rounded("x", 4).alias("r")).toPandas()
    want = duckdb.sql("select round(x, 4) as r from got").df()
    assert (got.r == want.r).all() and spark.range(1).selectExpr("23.12035D as x").select(rounded("x", 4)).first()[0] == 23.1203
    odd = spark.sql("select explode(array(double('nan'), double('inf'), 0.5D, -0.5D, null)) as x").select(rounded("x", 0).alias("r")).collect()
    assert [str(r.r) for r in odd] == ["nan", "inf", "1.0", "-1.0", "None"]


def test_place_at_a_half(spark):
    st = view(spark, "/root/testdata/sf0.1", "v_stitches").where("design_id = 402")
    assert place_design(st, 30, None, (130, 180)).where("seq = 396").select("x_u", "y_u").first() == (21, -16)


def test_edge_weight_at_a_half(spark):
    px = view(spark, "/root/testdata/sf0.01", "v_pixels").where("image_id = 15")
    got = r4(edge_weights(*region_graph(tiles(px, 4)), 8), "weight").where("u = 31 and v = 37").first()
    assert got.weight == 23.1203
