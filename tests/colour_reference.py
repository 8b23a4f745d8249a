"""CIEDE2000 in plain Python, for tests."""

import math


def de2000(p, q):
    (l1, a1, b1), (l2, a2, b2) = p, q
    c7 = ((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * math.sqrt(c7 / (c7 + 25**7))
    a1, a2 = a1 * g, a2 * g
    c1, c2 = math.hypot(a1, b1), math.hypot(a2, b2)
    h1, h2 = (math.degrees(math.atan2(b, a)) % 360 if a or b else 0.0 for a, b in ((a1, b1), (a2, b2)))
    dh, mh = 0.0, h1 + h2
    if c1 * c2:
        dh = (h2 - h1 + 180) % 360 - 180 if abs(h2 - h1) > 180 else h2 - h1
        mh = (h1 + h2) / 2 if abs(h1 - h2) <= 180 else ((h1 + h2 + 360) / 2 if h1 + h2 < 360 else (h1 + h2 - 360) / 2)
    ml, mc = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda k, o: math.cos(math.radians(k * mh + o))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.2 * cos(4, -63)
    sl, sc, sh = 1 + 0.015 * (ml - 50) ** 2 / math.sqrt(20 + (ml - 50) ** 2), 1 + 0.045 * mc, 1 + 0.015 * mc * t
    rt = -2 * math.sqrt(mc**7 / (mc**7 + 25**7)) * math.sin(math.radians(60 * math.exp(-(((mh - 275) / 25) ** 2))))
    dl, dc, dhh = (l2 - l1) / sl, (c2 - c1) / sc, 2 * math.sqrt(c1 * c2) * math.sin(math.radians(dh / 2)) / sh
    return math.sqrt(max(0.0, dl * dl + dc * dc + dhh * dhh + rt * dc * dhh))
