"""Palette swaps against brute force."""

import numpy as np
import pytest

from bobbin.operators import catalogue as K
from colour_reference import de2000


def lab(r, g, b):
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (r, g, b)]
    rows = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    f = []
    for row, white in zip(rows, (0.95047, 1.0, 1.08883)):
        t = sum(c * w for c, w in zip(lin, row)) / white
        f.append(t ** (1 / 3) if t > 216 / 24389 else (t * 24389 / 27 + 16) / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


@pytest.mark.parametrize("k", [1, 4])
def test_swaps_equal_brute_force_and_never_cost_more(spark, k):
    rng = np.random.default_rng(6)
    colours = [(*map(int, c), int(w)) for c, w in zip(rng.integers(0, 256, (25, 3)), rng.integers(1, 50, 25))]
    chart = [(j + 1, *map(int, c)) for j, c in enumerate(rng.integers(0, 256, (18, 3)))]
    de = {(i, t[0]): round(de2000(lab(*c[:3]), lab(*t[1:])), 6) for i, c in enumerate(colours) for t in chart}
    cost = lambda held: sum(c[3] * min(de[i, t] for t in held) for i, c in enumerate(colours))
    chosen = [t[0] for t in chart[:k]]
    first = cost(chosen)
    while True:
        swaps = [(round(cost(chosen[:m] + [t[0]] + chosen[m + 1 :]), 6), m, t[0]) for m in range(k) for t in chart if t[0] not in chosen]
        if min(swaps)[0] >= round(cost(chosen), 6):
            break
        chosen[min(swaps)[1]] = min(swaps)[2]
    got, total = K.swap_palette(spark.createDataFrame(colours, "r int, g int, b int, weight long"), spark.createDataFrame(chart, "thread_idx long, r int, g int, b int"), [t[0] for t in chart[:k]])
    assert got == chosen and abs(total - cost(chosen)) < 1e-4 and total <= first
