"""Column expressions: units, geometry, colour, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: D65 white, sRGB to XYZ rows, CIE constants.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
EPSILON, KAPPA = 216 / 24389, 24389 / 27
INCH_MM, UNIT_MM = 25.4, 0.1


def to_mm(units: Column) -> Column:
    return units * UNIT_MM


def to_units(mm: Column) -> Column:
    """Tenths of a millimetre, halves away from zero."""
    return F.round(mm / UNIT_MM).cast("int")


def kth(values: Column, q: float) -> Column:
    """The element at index floor(n*q) of the sorted values (an index rank, not an interpolation)."""
    s = F.array_sort(values)
    return F.element_at(s, F.least(F.size(s), (F.floor(F.size(s) * F.lit(q)) + 1).cast("int")))


def rounded(name: str, places: int) -> Column:
    """A column of doubles rounded as SQL engines do that scale it, halves of the scaled double away from zero.

    Spark's round() takes halves of the shortest decimal text: 23.12035 is a half there, but 231203.49999999997 when scaled."""
    x = F.col(name) * 10.0**places
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near) / 10.0**places


def floor_near(x: Column) -> Column:
    """The floor of doubles to six places, as whole numbers; noise in the last digits doesn't move a value over an edge.

    Scaled and rounded as doubles: Spark's round() makes a decimal number of each, which took most of the time of jobs on samples."""
    return F.floor(F.rint(x * 1e6) / 1e6).cast("long")


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def _linear(c: Column) -> Column:
    v = c / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (D65) of 0-255 sRGB channels."""
    rgb = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = sum((c * w for c, w in zip(rgb, row, strict=True)), F.lit(0.0)) / white
        f.append(F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise((t * KAPPA + 16) / 116))
    return f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200


def delta_e76(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def delta_e2000(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """CIEDE2000 with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    c = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    c7 = F.pow(c, F.lit(7.0))
    stretch = (F.lit(1.0) - F.sqrt(c7 / (c7 + 25.0**7))) * 0.5 + 1
    x1, x2 = a1 * stretch, a2 * stretch
    c1, c2 = F.sqrt(x1 * x1 + b1 * b1), F.sqrt(x2 * x2 + b2 * b2)
    hue = lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))
    h1, h2 = hue(x1, b1), hue(x2, b2)
    flat = c1 * c2 == 0
    dh = F.when(flat, 0.0).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
    mean_h = F.when(flat, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
    ml, mc = (l1 + l2) / 2, (c1 + c2) / 2
    turn = lambda k, o: F.cos(F.radians(mean_h * k + o))
    t = F.lit(1.0) - turn(1, -30.0) * 0.17 + turn(2, 0.0) * 0.24 + turn(3, 6.0) * 0.32 - turn(4, -63.0) * 0.20
    m7 = F.pow(mc, F.lit(7.0))
    bend = (ml - 50) * (ml - 50)
    sl, sc, sh = bend * 0.015 / F.sqrt(bend + 20) + 1, mc * 0.045 + 1, mc * t * 0.015 + 1
    lean = (mean_h - 275) / 25
    rt = F.sqrt(m7 / (m7 + 25.0**7)) * -2 * F.sin(F.radians(F.exp(-lean * lean) * 60))
    dl, dc, dhue = (l2 - l1) / sl, (c2 - c1) / sc, F.sqrt(c1 * c2) * 2 * F.sin(F.radians(dh / 2)) / sh
    return F.sqrt(F.greatest(F.lit(0.0), dl * dl + dc * dc + dhue * dhue + rt * dc * dhue))


def with_delta_e2000(df: DataFrame, p: tuple[Column, ...], q: tuple[Column, ...], name: str) -> DataFrame:
    """`df` with the CIEDE2000 of two colours, worked out in steps: as one expression its parts would be written out again
    wherever they occur, which makes plans of tens of thousands of nodes."""
    n = lambda k: F.col(f"__{k}")
    hue = lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))
    size = lambda x, y: F.sqrt(x * x + y * y)
    turn = lambda k, o: F.cos(F.radians(n("mh") * k + o))
    apart, total = n("h2") - n("h1"), n("h1") + n("h2")
    flat = n("c1") * n("c2") == 0
    dh = F.when(flat, 0.0).when(F.abs(apart) <= 180, apart).when(apart > 0, apart - 360).otherwise(apart + 360)
    mh = F.when(flat, total).when(F.abs(apart) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    steps: list[dict[str, Column]] = [
        {f"{c}{i}": v for i, colour in ((1, p), (2, q)) for c, v in zip("lab", colour, strict=True)},
        {"c7": F.pow((size(n("a1"), n("b1")) + size(n("a2"), n("b2"))) / 2, F.lit(7.0))},
        {"g": (F.lit(1.0) - F.sqrt(n("c7") / (n("c7") + 25.0**7))) * 0.5 + 1},
        {"x1": n("a1") * n("g"), "x2": n("a2") * n("g")},
        {k: v for i in (1, 2) for k, v in ((f"c{i}", size(n(f"x{i}"), n(f"b{i}"))), (f"h{i}", hue(n(f"x{i}"), n(f"b{i}"))))},
        {"dh": dh, "mh": mh, "mc": (n("c1") + n("c2")) / 2, "bend": ((n("l1") + n("l2")) / 2 - 50) * ((n("l1") + n("l2")) / 2 - 50)},
        {"t": F.lit(1.0) - turn(1, -30.0) * 0.17 + turn(2, 0.0) * 0.24 + turn(3, 6.0) * 0.32 - turn(4, -63.0) * 0.20, "m7": F.pow(n("mc"), F.lit(7.0)), "lean": (n("mh") - 275) / 25},
        {"rt": F.sqrt(n("m7") / (n("m7") + 25.0**7)) * -2 * F.sin(F.radians(F.exp(-n("lean") * n("lean")) * 60)), "dl": (n("l2") - n("l1")) / (n("bend") * 0.015 / F.sqrt(n("bend") + 20) + 1),
         "dc": (n("c2") - n("c1")) / (n("mc") * 0.045 + 1), "du": F.sqrt(n("c1") * n("c2")) * 2 * F.sin(F.radians(n("dh") / 2)) / (n("mc") * n("t") * 0.015 + 1)},
        {"de": F.sqrt(F.greatest(F.lit(0.0), n("dl") * n("dl") + n("dc") * n("dc") + n("du") * n("du") + n("rt") * n("dc") * n("du")))},
    ]
    out = df
    for step in steps:
        out = out.withColumns({f"__{k}": v for k, v in step.items()})
    return out.withColumn(name, n("de")).drop(*(f"__{k}" for step in steps for k in step))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance (Rec. 709 weights) of linear channels, 0 to 1."""
    return _linear(r) * 0.2126 + _linear(g) * 0.7152 + _linear(b) * 0.0722


def chi2_distance(a: Column, b: Column) -> Column:
    """Half the sum of (p-q)^2/(p+q) of two histograms, each scaled to sum 1; an empty place adds 0."""
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    sa, sb = norm(a), norm(b)
    part = lambda x, y: F.when(x / sa + y / sb == 0, 0.0).otherwise(F.pow(x / sa - y / sb, F.lit(2.0)) / (x / sa + y / sb))
    return F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, x: s + x) / 2


def size_band(size: Column) -> tuple[Column, Column]:
    """Recommended sizes, three quarters to twice; null for what isn't positive."""
    ok = size > 0
    return F.when(ok, F.round(size * 0.75, 1)), F.when(ok, F.round(size * 2.0, 1))


def chance_correct(observed: Column, chance: Column) -> Column:
    """Agreement above chance, not below 0; unchanged where chance leaves no room."""
    return F.when(chance >= 0.999, observed).otherwise(F.greatest(F.lit(0.0), (observed - chance) / (1 - chance)))


def gate_confidence(value: Column, threshold: float, margin: float) -> Column:
    return F.least(F.lit(1.0), F.abs(value - threshold) * 0.5 / margin + 0.5)


#: How much a class of region counts.
CLASS_WEIGHTS = {"eyes": 9.0, "skin": 4.5, "subject": 2.0, "background": 1.0}


def region_weight(area: Column, kind: Column) -> Column:
    """Area times its class's weight; no class counts once, an unknown class is an error."""
    w = F.when(kind.isNull(), F.lit(1.0))
    for name, value in CLASS_WEIGHTS.items():
        w = w.when(kind == name, F.lit(value))
    return area * w.otherwise(F.raise_error(F.concat(F.lit("unknown class "), kind)).cast("double"))


def axial_mean(angle: Column, weight: Column) -> Column:
    """Weighted mean direction in degrees modulo 180 of axial angles (radians), as an aggregate."""
    s, c = F.sum(F.sin(angle * 2) * weight), F.sum(F.cos(angle * 2) * weight)
    return F.pmod(F.degrees(F.atan2(s, c)) / 2, F.lit(180.0))
