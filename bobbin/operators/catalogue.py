"""Thread charts, garments, hoops, fonts, submissions and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import INCH_MM, delta_e2000, rgb_to_lab

#: Rows above which a chart is not broadcast but joined by distinct colour blocks.
CHART_ROWS = 20_000


def _small(df: DataFrame, most: int = CHART_ROWS) -> DataFrame:
    """A lookup table, broadcast only after its size is checked."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hoop_fit(sizes: DataFrame, hoops: DataFrame) -> DataFrame:
    straight = (F.col("w") <= F.col("width_mm")) & (F.col("h") <= F.col("height_mm"))
    turned = (F.col("h") <= F.col("width_mm")) & (F.col("w") <= F.col("height_mm"))
    return sizes.crossJoin(_small(hoops)).withColumn("fit", F.when(straight, "fits").when(turned, "rotated").otherwise("exceeds"))


def suggest_hoop(sizes: DataFrame, hoops: DataFrame) -> DataFrame:
    """The first hoop in list order that fits either way, else the largest."""
    f = hoop_fit(sizes, hoops).groupBy("design_id").agg(F.min_by("hoop_id", F.when(F.col("fit") != "exceeds", F.col("ord"))).alias("first"), F.max_by("hoop_id", F.col("width_mm") * F.col("height_mm")).alias("largest"))
    return f.select("design_id", F.coalesce("first", "largest").alias("hoop_id"))


def fabric_for_garment(garments: DataFrame, fabrics: DataFrame, default: str) -> DataFrame:
    known = fabrics.select("fabric_id", "trim_at_mm")
    d = known.where(F.col("fabric_id") == default).select(F.col("fabric_id").alias("d_fabric"), F.col("trim_at_mm").alias("d_trim"))
    return garments.join(_small(known), "fabric_id", "left").crossJoin(_small(d)).select("garment_id", F.when(F.col("trim_at_mm").isNull(), F.col("d_fabric")).otherwise(F.col("fabric_id")).alias("fabric_id"), F.coalesce("trim_at_mm", "d_trim").alias("trim_at_mm"))


def fixture_matrix(designs: DataFrame, variants: DataFrame) -> DataFrame:
    return designs.crossJoin(_small(variants))


def fit_scale(sizes: DataFrame, garments: DataFrame) -> DataFrame:
    return sizes.crossJoin(_small(garments)).withColumn("scale", F.least(F.col("width_in") * INCH_MM / F.col("w"), F.col("height_in") * INCH_MM / F.col("h")))


def chart_colors(threads: DataFrame) -> DataFrame:
    """The chart's distinct colours, each with its lowest thread: threads of one colour are as near, so no other can be nearest."""
    return threads.groupBy("r", "g", "b").agg(F.min("thread_idx").alias("thread_idx"))


def by_color(found: DataFrame, threads: DataFrame) -> DataFrame:
    """What was found for the lowest thread of each colour (thread_idx), for every thread of the chart."""
    low = chart_colors(threads).join(found, "thread_idx").withColumnsRenamed({**{c: f"__{c}" for c in "rgb"}, "thread_idx": "__low"})
    same = F.lit(True)
    for c in "rgb":
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return threads.select("thread_idx", "r", "g", "b").join(_small(low), same).drop("r", "g", "b", "__r", "__g", "__b", "__low")


def nearest_thread_rgb(colors: DataFrame, threads: DataFrame) -> DataFrame:
    """For each distinct colour (r, g, b) the chart's nearest thread by squared RGB distance, lowest index on ties."""
    t = chart_colors(threads).select("thread_idx", *[F.col(c).alias(f"t{c}") for c in "rgb"])
    d2 = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "rgb"), F.lit(0))
    return colors.select("r", "g", "b").distinct().crossJoin(_small(t)).groupBy("r", "g", "b").agg(F.min(F.struct(d2.alias("d2"), "thread_idx")).alias("m")).select("r", "g", "b", "m.thread_idx", "m.d2")


def with_lab(df: DataFrame, prefix: str = "") -> DataFrame:
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return df.withColumns({f"{prefix}{n}": c for n, c in zip(("L", "A", "B"), lab, strict=True)})


def nearest_thread_lab(colors: DataFrame, threads: DataFrame) -> DataFrame:
    """As nearest_thread_rgb by CIEDE2000. Distances are rounded to 1e-6 before ties are told."""
    t = with_lab(chart_colors(threads), "lab_").select("thread_idx", *[F.col(f"lab_{c}").alias(f"t{c}") for c in "LAB"])
    c = with_lab(colors.select("r", "g", "b").distinct(), "lab_")
    de = F.round(delta_e2000(tuple(F.col(f"lab_{x}") for x in "LAB"), tuple(F.col(f"t{x}") for x in "LAB")), 6)
    return c.crossJoin(_small(t)).groupBy("r", "g", "b").agg(F.min(F.struct(de.alias("delta_e"), "thread_idx")).alias("m")).select("r", "g", "b", "m.thread_idx", "m.delta_e")


def snap_palette(shapes: DataFrame, threads: DataFrame) -> DataFrame:
    """Each shape's nearest thread by CIEDE2000 and its label in the palette that is left: colours on one thread merge."""
    spool = nearest_thread_lab(shapes, threads).select("r", "g", "b", "thread_idx")
    used = spool.select("thread_idx").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("thread_idx")) - 1).cast("long"))
    return shapes.drop("thread_idx").join(spool, ["r", "g", "b"]).join(used, "thread_idx").select("shape_id", "thread_idx", "label")


def _against(colors: DataFrame, chart: DataFrame) -> DataFrame:
    """Every colour (r, g, b and more) with every thread of the chart, and delta_e (CIEDE2000, rounded to 1e-6)."""
    t = with_lab(chart, "lab_").select("thread_idx", *[F.col(f"lab_{c}").alias(f"t{c}") for c in "LAB"])
    de = F.round(delta_e2000(tuple(F.col(f"lab_{x}") for x in "LAB"), tuple(F.col(f"t{x}") for x in "LAB")), 6)
    return with_lab(colors, "lab_").crossJoin(_small(t)).withColumn("delta_e", de).drop("lab_L", "lab_A", "lab_B", "tL", "tA", "tB")


def palette_costs(colors: DataFrame, threads: DataFrame) -> DataFrame:
    """CIEDE2000 of every colour to every thread, with the colour's own floor."""
    return _against(colors, threads).withColumn("floor", F.min("delta_e").over(Window.partitionBy("r", "g", "b")))


#: How far from its own best a colour may stay, and how near its best must be to ask for one more thread.
NEAR_ENOUGH, WORTH_MORE, EXTRA = 4.5, 2.25, 3


def select_palette(colors: DataFrame, threads: DataFrame, k: int, extra: int = EXTRA) -> list[int]:
    """Greedy k-medoids by CIEDE2000: each round adds the thread that lowers the weighted total cost most, lowest index on ties.

    `colors` has r, g, b and weight, one row a colour. Rounds end when every colour lies within NEAR_ENOUGH of its floor, when
    nothing improves, or at k threads; then up to `extra` more serve the colour of the greatest excess, while its floor is
    WORTH_MORE or less. The chart is its distinct colours, each by its lowest thread. What the rounds keep is
    the colours with their distance to the nearest thread chosen: a round is one aggregate over colours times chart.
    """
    from .graph import checkpointed

    costs = checkpointed(palette_costs(colors, chart_colors(threads)))
    state = checkpointed(costs.groupBy("r", "g", "b").agg(F.first("weight").alias("weight"), F.first("floor").alias("floor")).withColumn("near", F.lit(1e9)))
    chosen: list[int] = []

    def add(thread: int) -> DataFrame:
        own = costs.where(F.col("thread_idx") == thread).select("r", "g", "b", "delta_e")
        chosen.append(thread)
        return checkpointed(state.join(own, ["r", "g", "b"]).withColumn("near", F.least("near", "delta_e")).drop("delta_e"))

    while len(chosen) < k:
        cost = F.round(F.sum(F.col("weight") * F.least("near", "delta_e")), 3).alias("cost")
        open_ = costs.where(~F.col("thread_idx").isin(chosen)) if chosen else costs
        best = open_.drop("weight", "floor").join(state, ["r", "g", "b"]).groupBy("thread_idx").agg(cost).agg(F.min(F.struct("cost", "thread_idx")).alias("m")).first()["m"]
        now = state.agg(F.round(F.sum(F.col("weight") * F.col("near")), 3).alias("c"), F.max(F.col("near") - F.col("floor")).alias("x")).first()
        if best is None or (chosen and (now["x"] <= NEAR_ENOUGH or best["cost"] >= now["c"])):
            break
        state = add(best["thread_idx"])
    for _ in range(extra):
        worst = state.where((F.col("near") - F.col("floor")) > NEAR_ENOUGH).agg(F.max(F.struct((F.col("near") - F.col("floor")).alias("x"), "floor", "r", "g", "b")).alias("m")).first()["m"]
        if worst is None or worst["floor"] > WORTH_MORE:
            break
        at = (F.col("r") == worst["r"]) & (F.col("g") == worst["g"]) & (F.col("b") == worst["b"])
        state = add(costs.where(at).agg(F.min(F.struct("delta_e", "thread_idx")).getField("thread_idx")).first()[0])
    return chosen


def swap_costs(costs: DataFrame, chosen: list[int]) -> DataFrame:
    """place, thread_idx, cost: the weighted total (rounded to 1e-6) if that thread took the place of a chosen one, for every such pair.

    `costs` has r, g, b, weight, thread_idx, delta_e, every colour with every thread. A colour keeps its nearest and second chosen thread, so a swap
    changes only the colours whose nearest goes: one aggregate by thread and nearest serves all pairs."""
    own = F.create_map(*[x for k, c in enumerate(chosen) for x in (F.lit(c), F.lit(k))])
    held = F.array_sort(F.collect_list(F.struct("delta_e", own[F.col("thread_idx")].alias("place"))))
    near = costs.where(F.col("thread_idx").isin(chosen)).groupBy("r", "g", "b").agg(held.alias("held"))
    second = F.try_element_at("held", F.lit(2)).getField("delta_e")
    state = near.select("r", "g", "b", F.col("held")[0]["delta_e"].alias("d1"), F.col("held")[0]["place"].alias("near"), second.alias("d2"))
    met = costs.where(~F.col("thread_idx").isin(chosen)).select("r", "g", "b", "weight", "thread_idx", "delta_e").join(state, ["r", "g", "b"])
    stays, goes = F.least("d1", "delta_e"), F.when(F.col("d2").isNull(), F.col("delta_e")).otherwise(F.least("d2", "delta_e"))
    by_near = met.groupBy("thread_idx", "near").agg(F.sum(F.col("weight") * stays).alias("stays"), F.sum(F.col("weight") * (goes - stays)).alias("more"))
    each = by_near.groupBy("thread_idx").agg(F.sum("stays").alias("stays"), F.map_from_entries(F.collect_list(F.struct("near", "more"))).alias("more"))
    out = each.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))))
    return out.select("place", "thread_idx", F.round(F.col("stays") + F.coalesce(F.try_element_at("more", F.col("place")), F.lit(0.0)), 6).alias("cost"))


def swap_palette(colors: DataFrame, threads: DataFrame, chosen: list[int]) -> tuple[list[int], float]:
    """The chosen threads after swaps, and their weighted total cost: each round makes the one that lowers the total most (on ties the first place, then
    the lowest thread), until none does. `chosen` are lowest threads of their colours, as select_palette() gives them."""
    from .graph import checkpointed, forget

    costs = checkpointed(palette_costs(colors, chart_colors(threads)))
    chosen = list(chosen)
    near = costs.where(F.col("thread_idx").isin(chosen)).groupBy("r", "g", "b").agg((F.min("delta_e") * F.first("weight")).alias("c"))
    now = near.agg(F.round(F.sum("c"), 6)).first()[0] or 0.0
    while chosen:
        best = swap_costs(costs, chosen).agg(F.min(F.struct("cost", "place", "thread_idx")).alias("m")).first()["m"]
        if best is None or best["cost"] >= now:
            break
        chosen[best["place"]], now = best["thread_idx"], best["cost"]
    forget(costs)
    return chosen, now


def filter_threads(threads: DataFrame, text: str) -> DataFrame:
    """Threads whose name or number contains the text, whatever its case; a blank one passes all."""
    q = text.strip().lower()
    return threads.where(F.lower("name").contains(q) | F.lower("number").contains(q)) if q else threads


def brand_slug(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def parse_palette_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """`R G B name code` lines: number, name and channels; comments, headers and channels over 255 go.

    The last token is the code if it has a digit; a line with a code alone is named by it.
    """
    m = lambda k: F.regexp_extract(line, r"^\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})\s*(.*?)\s*$", k)
    rows = lines.where(F.col(line).rlike(r"^\s*\d{1,3}\s+\d{1,3}\s+\d{1,3}(\s|$)")).select("*", *[m(k).cast("int").alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))], m(4).alias("__rest"))
    last = F.regexp_extract("__rest", r"(\S*\d\S*)$", 1)
    name = F.trim(F.regexp_replace("__rest", r"\S*\d\S*$", ""))
    rows = rows.where((F.col("r") <= 255) & (F.col("g") <= 255) & (F.col("b") <= 255)).withColumn("number", last).withColumn("name", F.when(name == "", last).otherwise(name))
    return rows.drop("__rest")


def build_brand_catalogue(threads: DataFrame, least: int = 10, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Slug and thread count of each brand outside the exclusions; brands under `least` rows fail when `strict` reads them (ok = false)."""
    g = threads.groupBy("brand_id").agg(F.count("*").alias("threads")).withColumn("slug", brand_slug(F.col("brand_id")))
    g = g.where(~F.col("slug").isin(*excluded)) if excluded else g
    return g.withColumn("ok", (F.col("threads") >= least) & (F.count("*").over(Window.partitionBy("slug")) == 1))


# ---- scorecards of two runs


def finding_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("run_key", "finding").agg(F.count("*").alias("n"))


def findings_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset difference of findings of the keys in both runs: appeared, resolved or counted otherwise."""
    shared = base.select("run_key").intersect(new.select("run_key"))
    a, b = (finding_counts(d).join(shared, "run_key", "left_semi") for d in (base, new))
    j = a.withColumnRenamed("n", "before").join(b.withColumnRenamed("n", "after"), ["run_key", "finding"], "full_outer").na.fill(0, ["before", "after"]).where("before <> after")
    kind = F.when(F.col("before") == 0, "appeared").when(F.col("after") == 0, "resolved").otherwise("count")
    return j.select("run_key", "finding", "before", "after", kind.alias("change"), (F.col("before") == 0).__and__(F.col("finding").endswith(":block")).alias("new_block"))


def scorecard_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of either run: new, missing or shared."""
    a, b = (d.select("run_key").distinct().withColumn(n, F.lit(1)) for d, n in ((base, "a"), (new, "b")))
    return a.join(b, "run_key", "full_outer").select("run_key", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").otherwise("shared").alias("state"))


def metric_deltas(base: DataFrame, new: DataFrame, noise: float = 0.05) -> DataFrame:
    """Mean metrics of the shared keys that moved by the noise floor or more, relative to the old one."""
    a, b = (d.groupBy("run_key").agg(F.avg("metric").alias(n)) for d, n in ((base, "old"), (new, "new")))
    scale = F.when(F.col("old") != 0, F.abs("old")).otherwise(F.greatest(F.abs("new"), F.lit(1e-9)))
    return a.join(b, "run_key").withColumn("relative", (F.col("new") - F.col("old")) / scale).where(F.abs("relative") >= noise)


def regression_gate(base: DataFrame, new: DataFrame, noise: float = 0.05) -> DataFrame:
    """One row a key that changed: its state, whether a block appeared, drift, and the verdict."""
    keys = scorecard_diff(base, new)
    diff = findings_diff(base, new).groupBy("run_key").agg(F.count("*").alias("changes"), F.bool_or("new_block").alias("new_block"))
    drift = metric_deltas(base, new, noise).select("run_key", F.lit(True).alias("drift"))
    j = keys.join(diff, "run_key", "left").join(drift, "run_key", "left").select("run_key", "state", F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), F.coalesce("new_block", F.lit(False)).alias("new_block"), F.coalesce("drift", F.lit(False)).alias("drift"))
    return j.withColumn("verdict", F.when((F.col("state") == "missing") | F.col("new_block"), "fail").when((F.col("state") == "new") | (F.col("changes") > 0) | F.col("drift"), "report").otherwise("same"))


def finding_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("run_key").agg(F.array_join(F.array_sort(F.collect_list("finding")), "|").alias("findings"))


# ---- submissions


def dedupe_submissions(df: DataFrame) -> DataFrame:
    """What each request does, by key and time: a repeat of a key that hasn't failed returns the earlier job; after an error it runs anew."""
    w = Window.partitionBy("content_key").orderBy("ts", "event_id")
    era = F.coalesce(F.sum((F.col("state") == "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = df.withColumn("era", era)
    we = Window.partitionBy("content_key", "era").orderBy("ts", "event_id")
    return e.select("event_id", "content_key", F.first("event_id").over(we).alias("job_id"), (F.row_number().over(we) == 1).alias("runs"))


def job_state_counts(df: DataFrame) -> DataFrame:
    """Jobs (keys) by their latest state."""
    last = df.groupBy("content_key").agg(F.max(F.struct("ts", "event_id", "state")).alias("m"))
    return last.groupBy(F.col("m.state").alias("state")).agg(F.count("*").alias("jobs"))


def content_key(payload: Column, config: Column) -> Column:
    """Hash of the payload's hash and the options in key order; `config` is a map."""
    canon = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))
    return F.sha2(F.concat_ws("|", F.sha2(payload, 256), canon), 256)


#: Options that edit a generation without changing it.
EDIT_KEYS = ("deleted", "overrides", "merges", "order")


def generation_key(payload: Column, config: Column) -> Column:
    return content_key(payload, F.map_filter(config, lambda k, v: ~k.isin(*EDIT_KEYS)))
