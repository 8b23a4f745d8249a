"""Places in cells are floors of scaled doubles, as SQL rounds."""

import duckdb
from pyspark.sql import functions as F

from bobbin.functions.columns import floor_near
from bobbin.operators import coverage as V


def test_cells_are_floors_of_scaled_doubles(spark):
    got = spark.range(-4_000, 4_000).selectExpr("id / 8D + (id % 9) * 1.1e-7 as x").select("x", floor_near(F.col("x")).alias("k")).toPandas()
    assert (got.k == duckdb.sql("select floor(round(x, 6)) as k from got").df().k).all()
    assert "round(" not in spark.range(1).select(V.cell_of(F.col("id"), 10.0))._jdf.queryExecution().optimizedPlan().toString()
