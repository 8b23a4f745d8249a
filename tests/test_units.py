"""Meaning of operators on small hand-made rows: files, components, streams, rasters."""

import math

from pyspark.sql import functions as F

from bobbin.operators import compare, graph, pixels
from bobbin.plans.qc import qc_report
from bobbin.sources import dst
from bobbin.streaming import jobs

STITCHES = "design_id long, seq long, cmd string, x_u long, y_u long"


def test_components_of_a_long_chain_and_a_lone_node(spark):
    n = 200
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    links = spark.range(n - 1).select(((F.col("id") * 7 + 3) % n).alias("u"), ((F.col("id") * 7 + 10) % n).alias("v"))
    got = {r.node: r.root for r in graph.components(nodes, links).collect()}
    assert got[n] == n and {got[i] for i in range(n)} == {0}
    assert graph.components(nodes.limit(0), links.limit(0)).count() == 0


def test_diagonal_pixels_join_only_in_the_eight_connected_form(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 1, 5), (1, 1, 0, 4), (2, 0, 0, 5)], "image_id long, y int, x int, label int")
    roots = lambda eight: {(r.image_id, r.y, r.x): (r.root_y, r.root_x) for r in pixels.pixel_components(px, eight).collect()}
    assert roots(True)[1, 1, 1] == (0, 0) and roots(False)[1, 1, 1] == (1, 1) and roots(True)[2, 0, 0] == (0, 0)


def test_far_moves_are_walked_and_trims_take_three_jumps(spark):
    df = spark.createDataFrame([(1, 0, "stitch", 300, -10), (1, 1, "trim", 301, -10), (1, 2, "color", 301, -10), (1, 3, "stitch", 301, -5)], STITCHES)
    recs = [(r.kind, r.dx, r.dy) for r in dst.to_dst_records(df).orderBy("seq", "part").collect()]
    assert recs == [("jump", 121, -10), ("jump", 121, 0), ("stitch", 58, 0), ("jump", 0, 0), ("jump", 1, 0), ("jump", 0, 0), ("color", 0, 0), ("stitch", 0, 5)]
    exp = [(r.kind, r.dx, r.dy) for r in dst.to_exp_records(df).orderBy("seq", "part").collect()]
    assert exp == [("stitch", 127, -10), ("stitch", 127, 0), ("stitch", 46, 0), ("trim", 0, 0), ("jump", 1, 0), ("color", 0, 0), ("stitch", 0, 5)]


def test_files_read_back_every_delta(spark, tmp_path):
    moves = spark.range(-121, 122).select(F.lit(7).cast("long").alias("design_id"), (F.col("id") + 121).alias("seq"), F.lit("stitch").alias("cmd"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("long").alias("x_u"), F.when(F.col("id") % 2 == 0, 0).otherwise(-F.col("id")).cast("long").alias("y_u"))
    [row] = dst.dst_files(moves).collect()
    assert len(row.content) == 512 + 3 * (243 + 1) and bytes(row.content[-3:]) == b"\x00\x00\xf3"
    (tmp_path / "a.dst").write_bytes(bytes(row.content))
    (tmp_path / "empty.dst").write_bytes(b"")
    got = dst.read_dst_corpus(spark, str(tmp_path)).orderBy("rec").collect()
    want = moves.orderBy("seq").collect()
    assert [(r.x_u, r.y_u, r.label) for r in got] == [(r.x_u, r.y_u, "7") for r in want]


def test_combining_one_design_leaves_it_alone(spark):
    df = spark.createDataFrame([(1, 0, "stitch", 0, 0), (1, 1, "end", 0, 0)], STITCHES).withColumn("g", F.lit(0))
    assert [r.cmd for r in compare.combine_designs(df, "g").orderBy("pos").collect()] == ["stitch", "end"]
    two = df.unionByName(df.withColumn("design_id", F.lit(2).cast("long")))
    assert [r.cmd for r in compare.combine_designs(two, "g").orderBy("pos").collect()] == ["stitch", "trim", "color", "stitch"]


def test_jobs_are_remembered_between_batches(spark, tmp_path):
    src, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    schema = "event_id long, ts timestamp, content_key string, state string"

    def arrive(rows):
        spark.sql("select 1").count()
        spark.createDataFrame(rows, "event_id long, content_key string, state string").selectExpr("event_id", "timestamp_seconds(event_id) as ts", "content_key", "state").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.dedupe(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()

    arrive([(1, "a", "done"), (2, "b", "error")])
    arrive([(3, "a", "done"), (4, "b", "done"), (5, "b", "done")])
    got = {r.event_id: (r.job_id, r.runs) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (4, False)}


def test_reports_cover_newly_arrived_designs_once(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for design in (1, 2):
        rows = [(design, i, "stitch", 10 * i, 0) for i in range(40)]
        spark.createDataFrame(rows, STITCHES).coalesce(1).write.mode("append").parquet(src)
        jobs.incremental_qc(spark, src, out, log, qc_report).awaitTermination()
    assert sorted(r.design_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_chart_is_whole_and_its_colors_stand_for_all_threads(spark):
    from bobbin.operators import catalogue as K
    from bobbin.views import view

    sf = "/root/testdata/sf0.01"
    t, s = view(spark, sf, "v_threads"), view(spark, sf, "v_shapes")
    chart = [(x.thread_idx, x.r, x.g, x.b) for x in t.collect()]
    assert len(chart) == view(spark, sf, "part").count()
    weight = {(x.r, x.g, x.b): x["count"] for x in s.groupBy("r", "g", "b").count().collect()}
    far = lambda c, h: sum((p - q) ** 2 for p, q in zip(c, h[1:], strict=True))
    want = {c: min((far(c, h), h[0]) for h in chart) for c in weight}
    assert {(x.r, x.g, x.b): (x.d2, x.thread_idx) for x in K.nearest_thread_rgb(s, t).collect()} == want


def lab(rgb):
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    rows = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    xyz = [sum(m * v for m, v in zip(row, lin, strict=True)) / w for row, w in zip(rows, (0.95047, 1.0, 1.08883), strict=True)]
    f = [t ** (1 / 3) if t > 216 / 24389 else (t * 24389 / 27 + 16) / 116 for t in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def ciede2000(p, q):
    (l1, a1, b1), (l2, a2, b2) = p, q
    c7 = ((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2) ** 7
    g = 0.5 * (1 - math.sqrt(c7 / (c7 + 25**7)))
    c1, c2 = math.hypot(a1 * (1 + g), b1), math.hypot(a2 * (1 + g), b2)
    h1, h2 = (math.degrees(math.atan2(b, a * (1 + g))) % 360 if a or b else 0.0 for a, b in ((a1, b1), (a2, b2)))
    dh = 0 if c1 * c2 == 0 else (h2 - h1 + 180) % 360 - 180 if abs(h2 - h1) != 180 else h2 - h1
    if c1 * c2 == 0:
        hm = h1 + h2
    else:
        hm = (h1 + h2) / 2 if abs(h1 - h2) <= 180 else (h1 + h2 + (360 if h1 + h2 < 360 else -360)) / 2
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda d: math.cos(math.radians(d))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.2 * cos(4 * hm - 63)
    dl = (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / math.sqrt(20 + (lm - 50) ** 2))
    dc, dk = (c2 - c1) / (1 + 0.045 * cm), 2 * math.sqrt(c1 * c2) * math.sin(math.radians(dh / 2)) / (1 + 0.015 * cm * t)
    rt = -2 * math.sqrt(cm**7 / (cm**7 + 25**7)) * math.sin(math.radians(60 * math.exp(-(((hm - 275) / 25) ** 2))))
    return math.sqrt(max(0.0, dl * dl + dc * dc + dk * dk + rt * dc * dk))


def test_ciede2000_of_published_pairs():
    # pairs of Sharma, Wu and Dalal (2005)
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)]
    assert all(abs(ciede2000(p, q) - want) < 1e-4 for p, q, want in pairs)


def test_palette_selection_equals_brute_force(spark):
    from bobbin.operators import catalogue as K

    colors = [(10 * k % 256, 37 * k % 256, 91 * k % 256, k % 5 + 1) for k in range(1, 30)]
    chart = [(k, 53 * k % 256, 17 * k % 256, 7 * k % 256) for k in range(1, 41)] + [(k + 100, 53 * k % 256, 17 * k % 256, 7 * k % 256) for k in range(1, 41)]
    de = {(c, h[0]): round(ciede2000(lab(c[:3]), lab(h[1:])), 6) for c in colors for h in chart}
    floor = {c: min(de[c, h[0]] for h in chart) for c in colors}
    for k, extra in ((3, 0), (6, 3), (30, 3)):
        chosen, near = [], dict.fromkeys(colors, 1e9)
        while len(chosen) < k:
            cost, best = min((round(sum(c[3] * min(near[c], de[c, h[0]]) for c in colors), 3), h[0]) for h in chart if h[0] not in chosen)
            if chosen and (max(near[c] - floor[c] for c in colors) <= 4.5 or cost >= round(sum(c[3] * near[c] for c in colors), 3)):
                break
            chosen.append(best)
            near = {c: min(near[c], de[c, best]) for c in colors}
        for _ in range(extra):
            worst = max(((near[c] - floor[c], floor[c], *c[:3], c) for c in colors if near[c] - floor[c] > 4.5), default=None)
            if worst is None or worst[1] > 2.25:
                break
            chosen.append(min((de[worst[5], h[0]], h[0]) for h in chart)[1])
            near = {c: min(near[c], de[c, chosen[-1]]) for c in colors}
        df = spark.createDataFrame(colors, "r int, g int, b int, weight int")
        assert K.select_palette(df, spark.createDataFrame(chart, "thread_idx int, r int, g int, b int"), k, extra) == chosen


def test_licence_names_with_versions_and_restrictions(spark):
    from bobbin.functions.text import license_id

    said = {
        "CC-BY-SA 4.0": "CC-BY-SA-4.0", "labelled CC-BY-NC-SA4 .0": "CC-BY-NC-4.0", "CC-BY-NC-SA 2.5": "CC-BY-NC-SA-2.5", "GPLv3": "GPL-3.0", "this is public domain": "CC0", "a NonCommercial font": "CC-BY-NC-4.0", "OFL-1.1": "OFL-1.1",
        "CC BY 3.0": "CC-BY-3.0", "CC BY-ND 2.5": "CC-BY-ND-2.5", "CC-BY-NC-ND 3.0": "CC-BY-NC-ND-3.0", "CC BY": "CC-BY-4.0", "made at home": "SEE-LICENSE-FILE", "": "SEE-LICENSE-FILE", "NoDerivs": "CC-BY-ND-4.0",
    }
    df = spark.createDataFrame(list(said.items()) + [(None, "SEE-LICENSE-FILE")], "text string, want string")
    assert [r for r in df.withColumn("got", license_id(F.col("text"))).collect() if r.got != r.want] == []


def test_glyphs_that_sew_nothing_are_unsupported(spark):
    from bobbin.operators import glyphs as G

    g = spark.createDataFrame([(1, "A", 10, 1, None, 300, None), (1, "b", 10, 0, None, None, None), (1, "C", 10, 0, 2.5, None, 80)], "font_id long, ch string, adv int, cols int, run_len_mm double, col_height_u int, run_height_u int")
    t = spark.createDataFrame([(1, 1, "a bc Zz"), (2, 1, "AaC c")], "text_id long, font_id long, text string")
    assert {r.text_id: r.unsupported for r in G.unsupported_chars(t, g).collect()} == {1: "bZz"}
    f = spark.createDataFrame([(1, "f", "ACA"), (2, "g", "q")], "font_id long, key string, name string")
    assert {r.font_id: r.sample for r in G.name_sample(f, g).collect()} == {1: "ACA", 2: "?"}


def test_ties_go_at_both_ends_and_phases_join_the_one_before(spark):
    from bobbin.operators import technique as T

    a, b = (0, 0), (3, 0)
    pts = [a, b, a, b, a, b, a, b, (10, 0), (20, 5), (30, 0), (31, 0), (30, 0), (31, 0), (30, 0)]
    df = spark.createDataFrame([(1, k, "stitch", *p) for k, p in enumerate(pts)], STITCHES)
    assert [r.seq for r in T.strip_ties(df).orderBy("seq").collect()] == [8, 9, 10]
    walk = [(10 * k, 0) for k in range(9)] + [(80 + 20 * (k % 2), 3 * k) for k in range(1, 20)]
    rows = T.phases(spark.createDataFrame([(1, k, "stitch", *p) for k, p in enumerate(walk)], STITCHES)).orderBy("phase").collect()
    assert [r.label for r in rows][0] == "R" and sum(r.steps for r in rows) == len(walk) - 1 and all(r.steps >= 5 for r in rows[1:])


def test_text_sources_read_files(spark, tmp_path):
    from bobbin.sources import text as R

    (tmp_path / "a.csv").write_text("block,run,trim,jump,x_mm,y_mm\n0,0,True,0,1.5,2\n0,1,no,0,3,4\n")
    (tmp_path / "b.csv").write_text("block,cmd,x_mm,y_mm\n0,stop,1,2\n1,stitch,3,4\n")
    (tmp_path / "c.json").write_text('{"id":"x","label":"X","threads":[["10","Sky",[1,2,3]],["11","Sea",[4,5,6]]]}')
    (tmp_path / "s.json").write_text('{"_captured":"2026","d1 @ 80mm/hat":{"score":88,"grade":"B","findings":["a:warn"],"metrics":{"m":1.5}}}')
    at = lambda n: f"file://{tmp_path}/{n}"
    assert [(r.trim, r.x_mm) for r in R.read_stitch_csv(spark, at("a.csv")).collect()] == [(True, 1.5), (False, 3.0)]
    assert [r.trim for r in R.read_stitch_csv(spark, at("b.csv")).collect()] == [True, False]
    assert [(r.brand_id, r.idx, r.number, r.r, r.b) for r in R.read_thread_charts(spark, at("c.json")).collect()] == [("x", 0, "10", 1, 3), ("x", 1, "11", 4, 6)]
    got = R.read_scorecards(spark, at("s.json")).collect()
    assert [(r.key, r.score, r.grade, r.findings, r.metrics) for r in got] == [("d1 @ 80mm/hat", 88, "B", ["a:warn"], {"m": 1.5})]
