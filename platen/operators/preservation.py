"""Whether a treatment preserved the original: metrics, warnings and assessment of (original, processed) raster pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.operators.components import components
from platen.operators.edges import auto_thresholds, canny, canny_lines
from platen.operators.histogram import otsu, otsu_threshold
from platen.operators.metrics import _variance, as_lines, share
from platen.operators.stencil import gaussian, gaussian_kernel, isolated_lines, laplacian, line_pixels, median_denoise, scanlines, smoothed_lines
from platen.sources.rasters import KEYS, clip8, dimensions
from platen.sources.store import cut, spread

IMPULSE_REFERENCE = 0.005


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixel by pixel: v0 of a, v1 of b."""
    return a.select(*KEYS, F.col("v").alias("v0")).join(b.select(*KEYS, F.col("v").alias("v1")).hint("merge"), KEYS)


def with_original(px: DataFrame, treat: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`align` of px and a treatment that changes v pixel by pixel: the original rides along with its pixel, so no join is needed."""
    return treat(px.withColumn("v0", F.col("v"))).select(*KEYS, "v0", F.col("v").alias("v1"))


def match_size(px: DataFrame, dims: DataFrame) -> DataFrame:
    """px resampled to dims (image_id, height, width) by area: source pixels weigh by how much of the target cell they cover.

    Each source pixel names the few target cells that it overlaps, so the overlap join is an equi-join.
    """
    own = dimensions(px).toDF("image_id", "h", "w")
    # rasters look small to the planner, which knows their texts' size: what is held in memory is the row an image
    both = px.join(own.join(dims, "image_id").hint("shuffle_hash"), "image_id")

    def cells(place: str, size: str, goal: str):
        lo, hi = F.expr(f"{place} * {goal} div {size}"), F.expr(f"(({place} + 1) * {goal} - 1) div {size}")
        overlap = lambda t: (F.least((F.col(place) + 1) * F.col(goal), (t + 1) * F.col(size)) - F.greatest(F.col(place) * F.col(goal), t * F.col(size))).cast("double")
        return F.transform(F.sequence(lo, hi), lambda t: F.struct(t.cast("int").alias("t"), overlap(t).alias("o")))

    rows = both.withColumn("cy", F.explode(cells("y", "h", "height"))).withColumn("cx", F.explode(cells("x", "w", "width")))
    weight = F.col("cy.o") * F.col("cx.o")
    return rows.groupBy("image_id", F.col("cy.t").alias("y"), F.col("cx.t").alias("x")).agg(clip8(F.round(F.sum(weight * F.col("v")) / F.sum(weight), 6)).alias("v"))


def similarity(pair: DataFrame) -> DataFrame:
    """structure_similarity, changed_ratio (differences above 3) and mean_change."""
    d = F.abs(F.col("v0") - F.col("v1"))
    return pair.groupBy("image_id").agg((1 - F.avg(d) / 255).alias("structure_similarity"), share(d > 3).alias("changed_ratio"), F.avg(d).alias("mean_change"))


def clipping_change(pair: DataFrame) -> DataFrame:
    """New clipping, dark, bright and in total; none for an output that is nearly binary."""
    more = lambda test: F.greatest(F.lit(0.0), share(test("v1")) - share(test("v0")))
    extreme = share((F.col("v1") <= 10) | (F.col("v1") >= 245))
    g = pair.groupBy("image_id").agg(more(lambda c: F.col(c) <= 5).alias("d"), more(lambda c: F.col(c) >= 250).alias("b"), (extreme > 0.9).alias("binary_output"))
    zero = lambda e: F.when(F.col("binary_output"), 0.0).otherwise(e)
    return g.select("image_id", "binary_output", zero(F.col("d")).alias("new_dark_clipped_ratio"), zero(F.col("b")).alias("new_bright_clipped_ratio"), zero(F.col("d") + F.col("b")).alias("total_new_clipping"))


def with_reference(pair: DataFrame) -> DataFrame:
    """Adds ref: v0, or its median where at least IMPULSE_REFERENCE of an image's pixels are isolated impulses."""
    rows = isolated_lines(scanlines(pair).withColumn("__v", F.col("__row.v0")), "__v")
    all_ = Window.partitionBy("image_id")
    ratio = F.sum(_ones("__lone")).over(all_) / F.sum(F.size("__lone")).over(all_)
    each = rows.withColumn("isolated_impulse_ratio", ratio).select("image_id", "y", "isolated_impulse_ratio", "__med", F.posexplode("__row").alias("__i", "__s"))
    med = F.get("__med", F.col("__i"))
    rest = [F.col(f"__s.{c}").alias(c) for c in pair.columns if c not in KEYS]
    return each.select("image_id", "y", "__s.x", *rest, "isolated_impulse_ratio", F.when(F.col("isolated_impulse_ratio") >= IMPULSE_REFERENCE, med).otherwise(F.col("__s.v0")).alias("ref"))


def _ones(line: str) -> Column:
    return F.aggregate(line, F.lit(0), lambda s, a: s + a)


def isolated_impulse_ratio(rows: DataFrame) -> DataFrame:
    """image_id, isolated_impulse_ratio of scanlines (image_id, y, v: array): the share of isolated impulses."""
    return isolated_lines(rows).groupBy("image_id").agg((F.sum(_ones("__lone")) / F.sum(F.size("v"))).alias("isolated_impulse_ratio"))


def smoothing_ratio(pair: DataFrame, ref: str = "v0") -> DataFrame:
    two = laplacian(laplacian(median_denoise(median_denoise(pair, 3, ref, "__a"), 3, "v1", "__b"), "__a", "la"), "__b", "lb")
    g = two.groupBy("image_id").agg(F.var_pop("la").alias("a"), F.var_pop("lb").alias("b"))
    return g.select("image_id", F.when(F.col("a") < 1e-6, 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("b") / F.col("a")))).alias("smoothing_ratio"))


def ink_metrics(pair: DataFrame, ref: str = "v0") -> DataFrame:
    """ink_retention and ink_inflation_ratio against the original's Otsu threshold; 1 unless the output is nearly binary."""
    t = otsu_threshold(pair.select(*KEYS, F.col("v0").alias("v")))
    ink = lambda c: share(F.col(c) < F.col("t"))
    extreme = share((F.col("v1") <= 10) | (F.col("v1") >= 245))
    g = pair.join(t.hint("shuffle_hash"), "image_id").groupBy("image_id").agg(ink(ref).alias("r"), ink("v0").alias("o"), ink("v1").alias("p"), (extreme > 0.9).alias("binary"))
    off = ~F.col("binary") | (F.col("r") <= 1e-6) | (F.col("o") <= 1e-6)
    ratio = lambda c: F.when(off, 1.0).otherwise(F.least(F.lit(5.0), F.col("p") / F.col(c)))
    return g.select("image_id", ratio("r").alias("ink_retention"), ratio("o").alias("ink_inflation_ratio"))


def _stretched(pair: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("image_id")
    e = pair.select(*KEYS, F.col(value).alias("v")).withColumns({"lo": F.min("v").over(w), "hi": F.max("v").over(w)})
    return e.select(*KEYS, F.when(F.col("hi") > F.col("lo"), clip8((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))).otherwise(0).alias("v"))


def _stacked(*rasters: DataFrame) -> DataFrame:
    """Rasters under ids of their own (image_id * 4 + place), so that one pass treats them all."""
    out = None
    for k, r in enumerate(rasters):
        one = r.select((F.col("image_id") * 4 + k).alias("image_id"), "y", "x", "v")
        out = one if out is None else out.unionByName(one)
    return out.repartition("image_id")


def edge_metrics(pair: DataFrame, ref: str = "v0") -> DataFrame:
    """edge_retention (edges of the stretched reference that lie within one pixel of the processed image's) and edge_inflation."""
    found = cut(canny(auto_thresholds(_stacked(_stretched(pair, ref), _stretched(pair, "v1"), pair.select(*KEYS, F.col("v0").alias("v")))), "lo", "hi"))
    return _edge_metrics(found, pair.select("image_id").distinct())


def _edge_metrics(found: DataFrame, images: DataFrame) -> DataFrame:
    """`edge_metrics` of the edge pixels of stacked rasters (reference, processed, original). Lines of edges, not pixels, meet each other."""
    of = lambda k: found.where(F.pmod("image_id", F.lit(4)) == k).select(F.expr("image_id div 4").alias("image_id"), "y", "x")
    rows = of(1).groupBy("image_id", "y").agg(F.collect_set("x").alias("xs")).select("image_id", F.explode(F.array(*[F.col("y") + d for d in (-1, 0, 1)])).alias("y"), "xs").groupBy("image_id", "y").agg(F.flatten(F.collect_list("xs")).alias("xs"))
    wide = rows.select("image_id", "y", F.array_distinct(F.flatten(F.transform("xs", lambda x: F.array(x - 1, x, x + 1)))).alias("wide"))
    own = of(0).groupBy("image_id", "y").agg(F.collect_set("x").alias("own"))
    hits = F.coalesce(F.size(F.array_intersect("own", "wide")), F.lit(0))
    kept = own.join(wide.hint("merge"), ["image_id", "y"], "left").groupBy("image_id").agg((F.sum(F.when(F.col("wide").isNull(), 0).otherwise(hits)) / F.sum(F.size("own"))).alias("edge_retention"))
    count = lambda k, c: of(k).groupBy("image_id").agg(F.count("*").alias(c))
    out = images.join(kept, "image_id", "left").join(count(2, "n0"), "image_id", "left").join(count(1, "n1"), "image_id", "left").fillna(0, ["n0", "n1"]).fillna(1.0, ["edge_retention"])
    inflation = F.when(F.col("n0") > 0, F.col("n1") / F.col("n0")).when(F.col("n1") == 0, 1.0).otherwise(F.col("n1").cast("double"))
    return out.select("image_id", "edge_retention", inflation.alias("edge_inflation"))


def component_retention(pair: DataFrame, ref: str = "v0", least: int = 3, most: int = 5000) -> DataFrame:
    return _component_retention(gaussian(_stacked(_stretched(pair, ref), _stretched(pair, "v1")), 3), pair.select("image_id").distinct(), least, most)


def _component_retention(both: DataFrame, images: DataFrame, least: int = 3, most: int = 5000) -> DataFrame:
    """`component_retention` of the pixels (KEYS, g) of stacked, blurred rasters (reference, processed)."""
    ink = otsu(both.select(*KEYS, F.floor(F.round("g", 6) + 0.5).cast("int").alias("v")), inverse=True).where("v > 0")
    parts = components(ink).where(F.col("area").between(least, most)).select(F.expr("image_id div 4").alias("image_id"), F.pmod("image_id", F.lit(4)).alias("k"))
    g = parts.groupBy("image_id").agg(F.sum((F.col("k") == 0).cast("int")).alias("n0"), F.sum((F.col("k") == 1).cast("int")).alias("n1"))
    out = images.join(g, "image_id", "left")
    return out.select("image_id", F.when(F.coalesce("n0", F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("n1") / F.col("n0"))).alias("component_retention"))


#: Metric, direction, medium code and limit, high code and limit (none: null).
WARNINGS = (
    ("edge_retention", "below", "edge_loss", 0.75, "major_edge_loss", 0.55),
    ("component_retention", "below", "component_loss", 0.70, "major_component_loss", 0.50),
    ("structure_similarity", "below", "structural_change", 0.75, "major_structural_change", 0.55),
    ("edge_inflation", "above", "edge_inflation", 1.60, "major_edge_inflation", 2.20),
    ("total_new_clipping", "above", "clipping", 0.02, "major_clipping", 0.10),
    ("smoothing_ratio", "below", "smoothing", 0.50, "major_smoothing", 0.25),
    ("ink_retention", "below", "ink_loss", 0.80, "major_ink_loss", 0.60),
    ("ink_inflation_ratio", "above", "ink_inflation", 1.80, None, None),
)


def warnings(m: DataFrame) -> DataFrame:
    """m with warnings, an array of (code, severity) in the order of WARNINGS."""
    found = []
    for metric, side, code, limit, major, far in WARNINGS:
        over = (lambda x, c=metric: F.col(c) < x) if side == "below" else (lambda x, c=metric: F.col(c) > x)
        pick = F.when(over(far), F.struct(F.lit(major).alias("code"), F.lit("high").alias("severity"))).when(over(limit), F.struct(F.lit(code).alias("code"), F.lit("medium").alias("severity"))) if major else F.when(over(limit), F.struct(F.lit(code).alias("code"), F.lit("medium").alias("severity")))
        found.append(pick)
    return m.withColumn("warnings", F.filter(F.array(*found), lambda w: w.isNotNull()))


def assess(m: DataFrame) -> DataFrame:
    high = F.exists("warnings", lambda w: w["severity"] == "high")
    return m.withColumn("status", F.when(high, "high_risk").when(F.size("warnings") > 0, "caution").otherwise("acceptable"))


def verify_preservation(original: DataFrame, processed: DataFrame) -> DataFrame:
    """The whole report, a row for each image."""
    return verify_pairs(align(original, processed))


def verify_pairs(pair: DataFrame) -> DataFrame:
    """`verify_preservation` of pixels that are beside each other already (KEYS, v0, v1)."""
    rows = scanlines(spread(pair.select(*KEYS, "v0", "v1"), "image_id"))
    return verify_lines(rows.select("image_id", "y", *[F.col(f"__row.{c}").alias(c) for c in ("v0", "v1")]))


def verify_lines(rows: DataFrame) -> DataFrame:
    """`verify_preservation` of lines that are beside each other already (image_id, y, arrays v0 and v1). What is dealt out and kept are lines."""
    whole = rows.select("image_id", "y", *[F.col(c).cast("array<int>").alias(c) for c in ("v0", "v1")])
    rows = isolated_lines(spread(whole, "image_id"), "v0")
    all_ = Window.partitionBy("image_id")
    lone = F.sum(_ones("__lone")).over(all_) / F.sum(F.size("__lone")).over(all_)
    rows = rows.withColumn("__r", lone).select("image_id", "y", "v0", "v1", F.when(F.col("__r") >= IMPULSE_REFERENCE, F.col("__med")).otherwise(F.col("v0")).alias("ref"))
    for c in ("ref", "v1"):
        rows = rows.withColumns({"__lo": F.min(F.array_min(c)).over(all_), "__hi": F.max(F.array_max(c)).over(all_)})
        wide = F.transform(c, lambda v: F.when(F.col("__hi") > F.col("__lo"), clip8((v - F.col("__lo")) * 255.0 / (F.col("__hi") - F.col("__lo")))).otherwise(0))
        rows = rows.withColumn(f"s_{c}", wide).drop("__lo", "__hi")
    rows = cut(rows)
    images = cut(rows.select("image_id").distinct())
    pair = rows.select("image_id", "y", "v1", "ref", F.posexplode_outer("v0").alias("x", "v0")).select(*KEYS, "v0", F.get("v1", F.col("x")).alias("v1"), F.get("ref", F.col("x")).alias("ref"))
    out = similarity(pair).drop("changed_ratio", "mean_change")
    lap = smoothed_lines(spread(rows.select("image_id", "y", "ref", "v1"), "image_id"), ("ref", "v1"))
    each = lap.select("image_id", "__lap1", F.posexplode_outer("__lap0").alias("x", "a")).select("image_id", F.col("a").cast("long").alias("a"), F.get("__lap1", F.col("x")).cast("long").alias("b"))
    sums = each.groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(e).alias(name) for c in "ab" for name, e in ((f"{c}1", F.col(c)), (f"{c}2", F.col(c) * F.col(c)))])
    variance = lambda c: _variance(*[F.col(k).cast("decimal(38,0)") for k in ("n", f"{c}1", f"{c}2")])
    smooth = sums.select("image_id", variance("a").alias("a"), variance("b").alias("b")).select("image_id", F.when(F.col("a") < 1e-6, 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("b") / F.col("a")))).alias("smoothing_ratio"))
    stack = lambda *cols: spread(rows.select("image_id", "y", F.posexplode(F.array(*cols)).alias("__k", "v")).select((F.col("image_id") * 4 + F.col("__k")).alias("image_id"), "y", "v"), "image_id")
    edges = cut(canny_lines(stack("s_ref", "s_v1", "v0")))
    kernel = gaussian_kernel(3)
    down = lambda line, at: sum(F.get(line(d), at) * kernel[d + 1] for d in (-1, 0, 1))
    blurred = line_pixels(stack("s_ref", "s_v1"), 1, "reflect101", "g", lambda line, i: sum(down(line, i + j) * kernel[j] for j in range(3)))
    for part in (clipping_change(pair), smooth, ink_metrics(pair, "ref"), _edge_metrics(edges, images), _component_retention(blurred, images)):
        out = out.join(part, "image_id")
    return assess(warnings(out))
