"""Cover of links is worked out where a design's steps lie: no step or sample is written or shuffled again."""

import math
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from bobbin.operators import graph
from bobbin.operators import linkcells as C
from bobbin.operators import links as N
from bobbin.sources import shared

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q8_link_cover", "q8_link_rule"])
def test_steps_and_samples_stay_where_they_lie(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "shared_dir", lambda *a: pytest.fail("steps are written"))
    monkeypatch.setattr(shared, "PART_ROWS", 500)
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # rows of runs alone are shuffled: both sides by run, then by block, then by design (twice)
    assert len(re.findall(r"ENSURE_REQUIREMENTS", plan)) == 5 and not re.search(r"Exchange hashpartitioning\([^)]*\bc[xy]\b", plan)


@pytest.mark.parametrize("thread", [4.0, 10.0])
def test_cover_equals_plain_cells(spark, monkeypatch, thread):
    rng, rows = np.random.default_rng(6), []
    for d in range(4):
        p = np.array([0, 0])
        for q in range(120):
            to = p + rng.integers(-25, 26, 2)
            rows.append((d, q // 40, q // 6, q, *map(int, (*p, *to)), math.dist(p, to), bool(q // 6 % 3 == 0)))
            p = to if q % 7 else to + 1
    df = spark.createDataFrame([*rows, (None, 0, 0, 0, 0, 0, 9, 0, 9.0, True)], "design_id long, block long, run long, seq long, x0 long, y0 long, x1 long, y1 long, len double, transport boolean").repartition(3)
    reach, want = round(thread / 4), {}
    for d in range(4):
        own = [r for r in rows if r[0] == d]
        mids = lambda r: [tuple(math.floor(round((r[4 + k] + (r[6 + k] - r[4 + k]) * (i + 0.5) / n) / 2, 6)) for k in (0, 1)) for n in [max(1, math.ceil(round(r[8] / 2, 9)))] for i in range(n)]
        laid = [(c, r[1]) for r in own if not r[9] for c in mids(r)]
        stretch, longest, bare_all, before = 0.0, 0.0, 0.0, None
        for r in (r for r in own if r[9]):
            if before is None or before[1] != r[1] or before[6:8] != r[4:6]:
                stretch = 0.0
            cells = mids(r)
            for c in cells:
                bare = not any(math.dist(c, o) <= reach and b >= r[1] for o, b in laid)
                stretch = stretch + r[8] / len(cells) if bare else 0.0
                bare_all += r[8] / len(cells) * bare
                longest = max(longest, stretch)
            before = r
        want[d] = (sum(r[9] for r in own), round(sum(r[8] for r in own if r[9]) * 0.1, 6), round(bare_all * 0.1, 6), round(longest * 0.1, 6))
    monkeypatch.setattr(C, "SAMPLES", 11)
    got = {r.design_id: (r.segments, *(round(v, 6) for v in (r.thread_mm, r.uncovered_mm, r.max_mm))) for r in N.link_cover(df, 2.0, thread).collect()}
    assert got == want and all(0 < w[3] < w[2] < w[1] for w in want.values())
