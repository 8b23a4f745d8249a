"""Components by squares against a plain flood, across squares' edges."""

import random

import pytest
from pyspark.sql import functions as F

from bobbin.operators.tiles import SIDE, tiled_components


def flood(cells, eight):
    root = {}
    for start in sorted(cells):
        todo = [] if start in root else [start]
        while todo:
            y, x = todo.pop()
            root[y, x] = start
            for j in (-1, 0, 1):
                for i in (-1, 0, 1):
                    n = (y + j, x + i)
                    if (eight or not j or not i) and cells.get(n) == cells[start] and n not in root:
                        root[n] = start
                        todo.append(n)
    return root


@pytest.mark.parametrize("eight", [True, False])
def test_components_across_squares(spark, eight):
    rng = random.Random(3)
    cells = {(y, x): rng.choice((0, 0, 1)) for y in range(-3, 2 * SIDE + 5) for x in range(SIDE - 9, 2 * SIDE + 7) if rng.random() < 0.9}
    px = spark.createDataFrame([(7, y, x, v) for (y, x), v in cells.items()], "image_id long, y int, x int, label int")
    got = {(r.y, r.x): (r.root_y, r.root_x) for r in tiled_components(px, eight).collect()}
    assert got == flood(cells, eight)


def test_small_images_need_no_graph(spark, monkeypatch):
    from bobbin.operators import tiles

    monkeypatch.setattr(tiles, "components", lambda *a: pytest.fail("a round of the graph"))
    px = spark.range(600).select((F.col("id") % 2).alias("image_id"), F.floor(F.col("id") / 24).cast("int").alias("y"), (F.col("id") % 24).cast("int").alias("x"), F.when(F.col("id") > 3, 1).alias("label"))
    out = tiles.tiled_components(px)
    assert out.count() == 600 and out.where("label is null and (root_y <> y or root_x <> x)").isEmpty() and dict(out.dtypes)["root_y"] == "int"
