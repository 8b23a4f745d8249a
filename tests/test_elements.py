"""Elements of designs in chunks of runs, against the pairs of all boxes."""

import random

import pytest

from bobbin.operators import technique as T


@pytest.mark.parametrize("chunk", [256, 3])
def test_elements_equal_all_pairs(spark, monkeypatch, chunk):
    from bobbin.operators import graph

    monkeypatch.setattr(T, "CHUNK_RUNS", chunk)
    if chunk == 256:
        monkeypatch.setattr(graph, "components", lambda *a: pytest.fail("a round of the graph"))
        monkeypatch.setattr(T, "box_pairs", lambda *a: pytest.fail("pairs"))
    rng, rows, boxes = random.Random(4), [], {}
    for d in range(3):
        seq = run = block = 0
        for _ in range(14):
            x, y = rng.randrange(-300, 300), rng.randrange(-300, 300)
            pts = [(x + rng.randrange(0, 60), y + rng.randrange(0, 60)) for _ in range(3)]
            rows += [(d, seq + i, "stitch", *p) for i, p in enumerate(pts)] + [(d, seq + 3, "color" if rng.random() < 0.2 else "trim", x, y)]
            boxes[d, run] = block, min(p[0] for p in pts) - 3, min(p[1] for p in pts) - 3, max(p[0] for p in pts) + 3, max(p[1] for p in pts) + 3
            block += rows[-1][2] == "color"
            run, seq = run + 1, seq + 4
    root = {k: k for k in boxes}
    for _ in boxes:
        for p, a in boxes.items():
            for q, b in boxes.items():
                if p[0] == q[0] and a[0] == b[0] and a[3] >= b[1] and b[3] >= a[1] and a[4] >= b[2] and b[4] >= a[2]:
                    root[p] = root[q] = min(root[p], root[q])
    st = spark.createDataFrame(rows, "design_id long, seq long, cmd string, x_u long, y_u long")
    got = {(r.design_id, r.run): r.element for r in T.elements(st, hop_u=1000).collect()}
    assert got == {k: r[1] for k, r in root.items()}
    assert T.elements(st.limit(0)).count() == 0
