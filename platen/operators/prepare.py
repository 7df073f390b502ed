"""Page preparation: boundary candidates and evidence, skew, deskew gate, safe crop and the checks afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.functions.scalars import is_convex, norm_angle, order_corners, quad_area
from platen.operators.components import labelled_runs
from platen.operators.edges import auto_thresholds, canny, median_thresholds
from platen.operators.geometry import (
    _sampled,
    extremes,
    geometry_scores,
    hist_distance,
    hough_segments,
    line_confidence,
    line_families,
    min_area_angle,
    page_segments,
    plausible_quads,
    quad_candidates,
    rank_boundary,
    rectify,
    rotate,
    rotation_grid,
    skew_stats,
    touched_sides,
    unique_lines,
)
from platen.operators.histogram import clahe, otsu, to_gray
from platen.operators.metrics import as_lines
from platen.operators.stencil import gaussian, morph_close
from platen.sources.intake import read_rasters
from platen.sources.rasters import KEYS, dimensions
from platen.sources.store import cut


def region_quads(px: DataFrame, top: int = 48) -> DataFrame:
    """image_id, candidate, corners, fit, height, width: extreme points of the largest bright components of each closed image."""
    lines = cut(labelled_runs(morph_close(otsu(px)).where("v > 0")))
    ends = lines.select("image_id", "comp", "y", F.explode(F.array("s", "e")).alias("x"))
    plus, minus = F.struct(F.col("x") + F.col("y"), "x", "y"), F.struct(F.col("y") - F.col("x"), "x", "y")
    area = lines.groupBy("image_id", "comp").agg(F.sum(F.col("e") - F.col("s") + 1).alias("area"))
    q = ends.groupBy("image_id", "comp").agg(F.min(plus).alias("tl"), F.min(minus).alias("tr"), F.max(plus).alias("br"), F.max(minus).alias("bl")).join(area.hint("merge"), ["image_id", "comp"])
    corner = lambda c: F.struct(F.col(f"{c}.x").cast("double").alias("x"), F.col(f"{c}.y").cast("double").alias("y"))
    q = q.withColumn("corners", F.array(*[corner(c) for c in ("tl", "tr", "br", "bl")]))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "comp"))
    q = q.withColumn("k", order).where(F.col("k") <= top)
    fit = F.least(F.lit(1.0), F.coalesce(F.try_divide(quad_area(F.col("corners")), F.col("area").cast("double")), F.lit(0.0)))
    return q.select("image_id", F.col("k").alias("candidate"), "corners", fit.alias("fit")).join(dimensions(px), "image_id")


def ring_spans(quads: DataFrame, band: str) -> DataFrame:
    """quads (image_id, candidate, corners, `band`: a column of pixels) by side and row: side, its first end a and extent dx, dy, y, x0, x1, a span that holds the row's pixels within the band of the side."""
    c = F.col("corners")
    side = F.array(*[F.struct(F.lit(i).alias("side"), c[i].alias("a"), c[(i + 1) % 4].alias("b")) for i in range(4)])
    each = quads.select("image_id", "candidate", "corners", band, F.explode(side).alias("s")).select("image_id", "candidate", "corners", band, "s.*")
    r, dx, dy = F.col(band), F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    low, high = F.floor(F.least("a.y", "b.y") - r).cast("int"), F.ceil(F.greatest("a.y", "b.y") + r).cast("int")
    rows = each.withColumns({"dx": dx, "dy": dy, "y": F.explode(F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), high)))})
    # the strip about the line meets a row in a span, and the side's ends bound it
    middle = F.col("a.x") + (F.col("y") - F.col("a.y")) * F.try_divide(F.col("dx"), F.col("dy"))
    reach = r * F.try_divide(F.hypot("dx", "dy"), F.abs("dy"))
    x0 = F.greatest(F.least("a.x", "b.x") - r, F.coalesce(middle - reach, F.lit(-1e9)))
    x1 = F.least(F.greatest("a.x", "b.x") + r, F.coalesce(middle + reach, F.lit(1e9)))
    spans = rows.select("image_id", "candidate", "corners", band, "side", "a", "dx", "dy", "y", F.greatest(F.lit(0), F.floor(x0).cast("int")).alias("x0"), F.ceil(x1).cast("int").alias("x1"))
    return spans.where("x0 <= x1")


def ring_pixels(px: DataFrame, quads: DataFrame, band: str) -> DataFrame:
    """image_id, candidate, inside, v of the pixels beside a side and within the band of it; near a corner a pixel may be beside two.

    Spans meet scanlines, so a join's row is a span, not a pixel.
    """
    c, flat = F.col("corners"), []
    number = lambda e: F.coalesce(e.cast("double"), F.lit(0.0))
    for i in range(4):
        a, b = c[i], c[(i + 1) % 4]
        flat += [number(a["x"]).alias(f"ax{i}"), number(a["y"]).alias(f"ay{i}"), number(b["x"] - a["x"]).alias(f"dx{i}"), number(b["y"] - a["y"]).alias(f"dy{i}")]
    # corners become plain columns before the join, so that what is done for each pixel is short
    spans = ring_spans(quads, band).select("image_id", "candidate", number(F.col(band)).alias("r"), number(F.col("a.x")).alias("ax"), number(F.col("a.y")).alias("ay"), number(F.col("dx")).alias("dx"), number(F.col("dy")).alias("dy"), "y", "x0", "x1", *flat)
    near = spans.join(as_lines(px).hint("merge"), ["image_id", "y"]).withColumn("x1", F.least(F.col("x1"), F.size("v") - 1)).where("x0 <= x1 AND dx * dx + dy * dy > 0")
    each = near.withColumn("x", F.explode(F.sequence("x0", "x1")))
    across = "dx{0} * (y - ay{0}) - dy{0} * (x - ax{0})"
    beside = "(x - ax) * dx + (y - ay) * dy BETWEEN 0 AND dx * dx + dy * dy AND pow(dx * (y - ay) - dy * (x - ax), 2) <= r * r * (dx * dx + dy * dy)"
    inside = " AND ".join(f"{across.format(i)} >= 0" for i in range(4))
    return each.where(beside).select("image_id", "candidate", F.expr(inside).alias("inside"), F.get("v", F.col("x")).alias("v"))


def border_contrast(px: DataFrame, quads: DataFrame, band: float | None = 2.5, least: int = 100) -> DataFrame:
    """quads (image_id, candidate, corners) with border_contrast: half the distance of the histograms within `band` pixels inside and outside of the sides, 0 where a ring is smaller than `least`.

    Without a band it follows the image's size: half of 1.2 % of the shortest side, of 5 pixels at least.
    """
    if band is None:
        size = F.greatest(F.lit(5), F.floor(F.least("height", "width") * 0.012 + 0.5).cast("int"))
        sized = quads.drop("height", "width").join(dimensions(px), "image_id").withColumn("__band", (size + (size % 2 == 0).cast("int")) / 2)
    else:
        sized = quads.withColumn("__band", F.lit(float(band)))
    ring = ring_pixels(px, sized.select("image_id", "candidate", "corners", "__band"), "__band").select(F.struct("image_id", "candidate").alias("image_id"), "inside", F.expr("v div 8").alias("bin"))
    h = ring.groupBy("image_id", "inside", "bin").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("image_id", "inside")))
    side = lambda flag: h.where((F.col("inside") == flag) & (F.col("all") >= least)).select("image_id", "bin", (F.col("n") / F.col("all")).alias("p"))
    both = side(True).select("image_id").distinct().join(side(False).select("image_id").distinct(), "image_id")
    score = hist_distance(side(True), side(False)).join(both, "image_id").select("image_id.image_id", "image_id.candidate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("chi2") / 2)).alias("border_contrast"))
    return quads.join(score, ["image_id", "candidate"], "left").fillna(0.0, ["border_contrast"])


def line_quads(px: DataFrame, step: float = 1.0) -> DataFrame:
    """image_id, candidate, corners, support, height, width: quadrilaterals of the outer lines of two families at a right angle, for images with four lines.

    Edges of the smoothed, contrast-limited image, with thresholds from its median, vote for lines; votes, least length and gap follow the
    image's size. Of each family the first and the last few lines about the image's middle make the sides.
    """
    dims = dimensions(px)
    smooth = gaussian(px, 5).select(*KEYS, F.floor(F.round("g", 6) + 0.5).cast("int").alias("v"))
    edges = canny(median_thresholds(cut(clahe(cut(smooth), 2.0)), 0.55, 1.45, 20, 30), "lo", "hi", gradient=True)
    diagonal = F.hypot("width", "height")
    part = lambda least, e: F.greatest(F.lit(least), F.floor(e).cast("int"))
    limits = dims.select("image_id", part(40, F.least("height", "width") * 0.06).alias("votes_"), part(40, diagonal * 0.14).alias("length_"), part(10, diagonal * 0.035).alias("gap_"))
    segments = cut(page_segments(cut(edges).join(limits.hint("shuffle_hash"), "image_id"), step, "votes_", "length_", "gap_"))
    enough = segments.groupBy("image_id").count().where("count >= 4")
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    named = segments.join(enough, "image_id", "left_semi").join(dims, "image_id").withColumn("id", F.struct("x1", "y1", "x2", "y2")).withColumn("angle", norm_angle(F.degrees(F.atan2(dy, dx))))
    # the normal that points right, or down where it is upright
    nx, ny = -dy / F.col("length"), dx / F.col("length")
    turn = F.when((nx < -1e-6) | ((F.abs(nx) <= 1e-6) & (ny < 0)), -1.0).otherwise(1.0)
    l = F.struct((turn * nx).alias("nx"), (turn * ny).alias("ny"), (turn * (nx * F.col("x1") + ny * F.col("y1"))).alias("d"))
    lines = line_families(named).withColumn("l", l).withColumns({"diagonal": diagonal, "offset": F.col("l.nx") * F.col("width") / 2 + F.col("l.ny") * F.col("height") / 2 - F.col("l.d")})
    sides = extremes(unique_lines(lines.select("image_id", "id", "family", "length", "l", "offset", "diagonal")))
    # corners are written before they are put in order and tested: those expressions name them so often that a plan would hold them hundreds of times
    quads = cut(quad_candidates(cut(sides))).select("image_id", order_corners(F.col("corners")).alias("corners"), "support", F.to_json("ids").alias("ids"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("ids"))
    return cut(quads.withColumn("candidate", number).drop("ids")).join(dims, "image_id")


def lines_boundary(px: DataFrame, accept: float = 0.68, least_ring: int = 100) -> DataFrame:
    """image_id, candidate, score, detected, corners, area_ratio of the best plausible quadrilateral of lines of each image that has one."""
    plausible = cut(plausible_quads(line_quads(px)).where("reject IS NULL")).withColumn("frame_contacts", touched_sides(F.col("corners"))).where("frame_contacts < 3")
    q = cut(line_confidence(geometry_scores(plausible.withColumn("fit", F.lit(0.0)))))
    best = rank_boundary(border_contrast(px, q, None, least_ring), accept)
    return best.join(q.select("image_id", "candidate", "corners", "area_ratio"), ["image_id", "candidate"])


def detect_boundary(px: DataFrame, accept: float = 0.68, least_ring: int = 100, band: float | None = 2.5, lines: bool = False, min_side: int = 0) -> DataFrame:
    """image_id, candidate, score, detected, corners, area_ratio, detector of the best plausible candidate of each image that has one.

    Bright regions come first. With `lines`, images that these don't settle go on to the line detector, and the better of both scores
    counts. Images with a side below `min_side` have no candidate.
    """
    if min_side:
        large = cut(dimensions(px).where((F.col("height") >= min_side) & (F.col("width") >= min_side)))
        px = px.join(large, "image_id", "left_semi")
    q = cut(geometry_scores(plausible_quads(region_quads(px)).where("reject IS NULL")))
    best = rank_boundary(border_contrast(px, q, band, least_ring), accept)
    best = best.join(q.select("image_id", "candidate", "corners", "area_ratio"), ["image_id", "candidate"]).withColumn("detector", F.lit("region"))
    if not lines:
        return best
    best = cut(best)
    left = px.join(best.where("detected").select("image_id"), "image_id", "left_anti")
    both = best.unionByName(lines_boundary(left, accept, least_ring).withColumn("detector", F.lit("lines")))
    names = [c for c in best.columns if c != "image_id"]
    top = F.max_by(F.struct(*names), F.struct(F.col("score"), F.col("detector") == "region")).alias("b")
    return cut(both).groupBy("image_id").agg(top).select("image_id", "b.*").select(*best.columns)


def edge_support(edges: DataFrame, quads: DataFrame, samples: int = 20) -> DataFrame:
    """image_id, support: 0.7 of the mean and 0.3 of the least share of sampled points of a side that lie within one pixel of an edge."""
    c = F.col("corners")
    side = F.array(*[F.struct(F.lit(i).alias("side"), c[i].alias("a"), c[(i + 1) % 4].alias("b")) for i in range(4)])
    pts = quads.select("image_id", F.explode(side).alias("s")).select("image_id", "s.*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    t = F.col("k") / (samples - 1)
    at = lambda axis: F.floor(F.col(f"a.{axis}") + t * (F.col(f"b.{axis}") - F.col(f"a.{axis}")) + 0.5).cast("int")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    wide = edges.select("image_id", "y", "x", step.alias("o")).select("image_id", (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).distinct().withColumn("hit", F.lit(1))
    hits = pts.select("image_id", "side", at("y").alias("y"), at("x").alias("x")).join(wide.hint("merge"), KEYS, "left").groupBy("image_id", "side").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("s"))
    return hits.groupBy("image_id").agg((0.7 * F.avg("s") + 0.3 * F.min("s")).alias("support"))


def estimate_skew(px: DataFrame, threshold: int = 5, min_length: float = 3.0, max_gap: int = 2) -> DataFrame:
    """image_id, angle, confidence: median angle of near-horizontal lines, or of the smallest rectangle (confidence 0.5) where there are under three."""
    edges = cut(canny(auto_thresholds(px), "lo", "hi"))
    lines = hough_segments(edges, 1.0, threshold, min_length, max_gap).where("abs(angle) <= 35").groupBy("image_id").agg(F.percentile("angle", 0.5).alias("a"), F.count("*").alias("n"))
    box = min_area_angle(edges).select("image_id", F.when(F.col("angle") > 45, F.col("angle") - 90).otherwise(F.col("angle")).alias("b"))
    few = F.coalesce("n", F.lit(0)) < 3
    out = px.select("image_id").distinct().join(lines, "image_id", "left").join(box, "image_id", "left")
    return out.select("image_id", F.when(few, F.coalesce("b", F.lit(0.0))).otherwise(F.col("a")).alias("angle"), F.when(few, F.when(F.col("b").isNull(), 0.0).otherwise(0.5)).otherwise(F.least(F.lit(1.0), F.col("n") / 20)).alias("confidence"))


def skew_audit(px: DataFrame, angles: tuple[float, ...] = (-10.0, -5.0, -2.0, 2.0, 5.0, 10.0), most_error: float = 0.75, **how) -> DataFrame:
    """image_id, turned, angle, confidence, error, within: what estimate_skew finds in each image turned by known angles; the estimate of a page turned by a is -a.

    All angles go in one pass, as images of their own.
    """
    turns = dict(enumerate(angles))
    ids = px.select("image_id").distinct().select("image_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in turns.items()])).alias("t"))
    ids = ids.select((F.col("image_id") * len(turns) + F.col("t.i")).alias("key"), "image_id", F.col("t.a").alias("turned"))
    each = px.join(ids, "image_id").select(F.col("key").alias("image_id"), "y", "x", "v").repartition("image_id")
    pages = cut(rotate(each, "turned", angles=ids.select(F.col("key").alias("image_id"), "turned")))
    found = estimate_skew(pages, **how).withColumnRenamed("image_id", "key").join(ids, "key")
    error = F.abs(F.col("angle") + F.col("turned"))
    return found.select("image_id", "turned", "angle", "confidence", error.alias("error"), (error <= most_error).alias("within"))


def skew_confidence(stats: DataFrame) -> DataFrame:
    """stats (lines, raw_lines, dispersion) with confidence: 0.35 n / 16, 0.30 agreement, 0.35 steadiness; 0 under three lines."""
    unit = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    score = 0.35 * unit(F.col("lines") / 16) + 0.30 * unit(F.col("lines") / F.greatest("raw_lines", F.lit(1))) + 0.35 * unit(1 - F.col("dispersion") / 5)
    return stats.withColumn("confidence", F.when(F.col("raw_lines") < 3, 0.0).otherwise(score))


def page_lines(px: DataFrame) -> DataFrame:
    """Segments of pages, at half degrees: edges of the smoothed, contrast-limited page, thresholds from its median, and limits from its width."""
    smooth = gaussian(px, 5).select(*KEYS, F.floor(F.round("g", 6) + 0.5).cast("int").alias("v"))
    edges = canny(median_thresholds(cut(clahe(cut(smooth))), 0.60, 1.40, 30, 30), "lo", "hi", gradient=True)
    part = lambda least, share: F.greatest(F.lit(least), F.floor(F.col("width") * share).cast("int"))
    limits = dimensions(px).select("image_id", part(35, 0.045).alias("votes_"), part(40, 0.12).alias("length_"), part(8, 0.025).alias("gap_"))
    return page_segments(cut(edges).join(limits.hint("shuffle_hash"), "image_id"), 0.5, "votes_", "length_", "gap_")


def detect_skew(px: DataFrame, min_side: int = 80, threshold: int | None = None, min_length: float = 3.0, max_gap: int = 2) -> DataFrame:
    """image_id, angle, confidence, lines, dispersion from near-horizontal lines of the contrast-limited image; all 0 for images with a side below `min_side`.

    Limits follow the image's width (see page_lines). With a threshold, every edge pixel votes for every angle, and the limits given hold:
    for images far below page size.
    """
    dims = dimensions(px)
    large = px.join(dims.where((F.col("height") >= min_side) & (F.col("width") >= min_side)), "image_id", "left_semi")
    found = page_lines(large) if threshold is None else hough_segments(canny(clahe(large), 50, 150), 0.5, threshold, min_length, max_gap)
    raw = cut(found.where("abs(angle) <= 45"))
    n = raw.groupBy("image_id").agg(F.count("*").alias("raw_lines"))
    s = skew_confidence(skew_stats(raw).join(n, "image_id"))
    out = dims.select("image_id").join(s, "image_id", "left").fillna(0)
    measured = lambda c: F.when(F.col("confidence") > 0, F.col(c)).otherwise(0)
    return out.select("image_id", measured("angle").alias("angle"), "confidence", measured("lines").alias("lines"), measured("dispersion").alias("dispersion"))


def deskew_gate(skew: DataFrame) -> DataFrame:
    """skew (angle, confidence) with action: apply, or why not."""
    a = F.abs("angle")
    return skew.withColumn("action", F.when(F.col("confidence") < 0.70, "skip_confidence").when(a < 0.5, "skip_small").when(a > 45, "skip_large").otherwise("apply"))


def skew_recommendation(m: DataFrame) -> DataFrame:
    return m.where((F.abs("skew_angle") >= 0.75) & (F.col("skew_confidence") >= 0.5)).select("image_id", F.lit("deskew").alias("operation_id"), F.col("skew_angle").alias("parameter"))


def safe_crop(mask: DataFrame) -> DataFrame:
    """image_id, x, y, w, h, retention of the largest rectangle whose top and bottom rows mirror each other and that lies all in the mask (one span in each row)."""
    spans = mask.groupBy("image_id", "y").agg(F.min("x").alias("l"), F.max("x").alias("r"))
    frame = spans.groupBy("image_id").agg((F.max("y") + F.min("y")).alias("both"), F.sum(F.col("r") - F.col("l") + 1).alias("area"))
    half = spans.join(frame, "image_id").withColumn("k", F.least(F.col("y"), F.col("both") - F.col("y")))
    rows = half.groupBy("image_id", "k").agg(F.max("l").alias("l"), F.min("r").alias("r"), F.max("both").alias("both"), F.first("area").alias("area"))
    inner = Window.partitionBy("image_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rect = rows.withColumns({"l": F.max("l").over(inner), "r": F.min("r").over(inner)}).where("r > l")
    size = (F.col("r") - F.col("l") + 1) * (F.col("both") - 2 * F.col("k") + 1)
    best = rect.withColumn("size", size).groupBy("image_id").agg(F.min_by(F.struct("k", "l", "r", "both", "size", "area"), F.struct(-F.col("size"), "k")).alias("b"))
    return best.select("image_id", F.col("b.l").alias("x"), F.col("b.k").alias("y"), (F.col("b.r") - F.col("b.l") + 1).alias("w"), (F.col("b.both") - 2 * F.col("b.k") + 1).alias("h"), (F.col("b.size") / F.col("b.area")).alias("retention"))


def verify_preparation(p: DataFrame) -> DataFrame:
    """p (prepared, confidence, area_ratio, width, height, convex, retention or null without a crop, residual, residual_confidence) with status."""
    skew = F.when(F.col("residual_confidence") == 0, "unknown").when(F.abs("residual") <= 0.75, "good").when(F.abs("residual") <= 2, "caution").otherwise("reject")
    boundary = (F.col("confidence") >= 0.68) & (F.col("area_ratio") > 0) & (F.col("area_ratio") <= 1)
    perspective = (F.col("width") >= 40) & (F.col("height") >= 40) & F.col("convex")
    crop = F.coalesce(F.col("retention") >= 0.95, F.lit(True))
    hard = ~(F.coalesce(boundary, F.lit(False)) & F.coalesce(perspective, F.lit(False)) & crop)
    return p.withColumn("skew_status", skew).withColumn("status", F.when(~F.col("prepared") | hard | (F.col("skew_status") == "reject"), "reject").when(F.col("skew_status").isin("caution", "unknown"), "caution").otherwise("accept"))


def deskew(pages: DataFrame, gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, crops): pages whose action in `gated` (angle, action) is apply are turned by their angle on a canvas that holds all of
    them, filled with the median of their border; the others stay. crops: safe_crop of the turned ones, which reports and cuts nothing, as in the reference.
    """
    turn = gated.where("action = 'apply'").select("image_id", F.radians(F.col("angle").cast("double")).alias("a"))
    d = dimensions(pages).join(turn, "image_id").withColumn("band", F.greatest(F.lit(3), F.bround(F.least("height", "width") * 0.02).cast("int")))
    sides = [F.col("y") < F.col("band"), F.col("y") >= F.col("height") - F.col("band"), F.col("x") < F.col("band"), F.col("x") >= F.col("width") - F.col("band")]
    each = pages.join(d.hint("shuffle_hash"), "image_id").select("image_id", "v", F.explode(F.filter(F.array(*[F.when(b, i) for i, b in enumerate(sides)]), lambda b: b.isNotNull())))
    fill = each.groupBy("image_id").agg(F.bround(F.percentile("v", 0.5)).cast("int").alias("fill"))
    grid = rotation_grid(d.join(fill, "image_id"))
    inside = F.col("sx").between(-0.5, F.col("width") - 0.5) & F.col("sy").between(-0.5, F.col("height") - 0.5)
    crops = safe_crop(grid.where(inside).select(*KEYS))
    turned = _sampled(grid, pages, "fill").select(*KEYS, F.col("v").cast("int").alias("v"))
    return pages.join(turn, "image_id", "left_anti").select(*KEYS, F.col("v").cast("int").alias("v")).unionByName(turned), crops


def prepare(px: DataFrame, least_ring: int = 100, accept: float = 0.68, least_side: int = 40, band: float | None = None, lines: bool = True, min_side: int = 80, **skew_limits) -> tuple[DataFrame, DataFrame]:
    """(pages, log): rectified and deskewed rasters of the images whose boundary is detected, and a step log of every image with its check's status.

    `min_side` and `skew_limits` go to detect_boundary and detect_skew; the defaults are those of pages.
    """
    found = cut(detect_boundary(px, accept, least_ring, band, lines, min_side))
    good = found.where("detected")
    flat = cut(rectify(px.join(good.select("image_id"), "image_id", "left_semi"), good.select("image_id", order_corners(F.col("corners")).alias("corners")), least_side))
    skew = cut(deskew_gate(detect_skew(flat, min_side, **skew_limits)))
    pages, crops = deskew(flat, skew)
    pages = cut(pages)
    left = detect_skew(pages, min_side, **skew_limits).select("image_id", F.col("angle").alias("residual"), F.col("confidence").alias("residual_confidence"))
    sound = found.select("image_id", "detected", "score", F.col("score").alias("confidence"), "area_ratio", is_convex(order_corners(F.col("corners"))).alias("convex"))
    safe = crops.where("retention >= 0.95").select("image_id", "retention")
    all_ = px.select("image_id").distinct().join(sound, "image_id", "left").join(dimensions(flat), "image_id", "left").join(skew.select("image_id", "angle", "action"), "image_id", "left").join(safe, "image_id", "left").join(left, "image_id", "left")
    log = verify_preparation(all_.withColumn("prepared", F.col("width").isNotNull()))
    return pages, log.select("image_id", F.coalesce("detected", F.lit(False)).alias("boundary"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("action", F.lit("stopped")).alias("deskew"), "angle", F.col("retention").isNotNull().alias("crop_safe"), "residual", F.when(~F.col("prepared"), "stopped").otherwise(F.col("status")).alias("status"))


def document_pipeline(px: DataFrame, treat: Callable[[DataFrame], DataFrame], **limits) -> DataFrame:
    """`treat` (a row an image, with final) of the pages that pass the checks; the other images have final stopped (no page) or review_required. Limits as in prepare."""
    pages, log = prepare(px, **limits)
    log = cut(log)
    out = treat(pages.join(log.where("status = 'accept'").select("image_id"), "image_id", "left_semi"))
    rest = log.where("status <> 'accept'").select("image_id", F.when(F.col("status") == "stopped", "stopped").otherwise("review_required").alias("final"))
    return out.unionByName(rest, allowMissingColumns=True)


def process_files(spark: SparkSession, path: str, treat: Callable[[DataFrame], DataFrame], **limits) -> DataFrame:
    """original_name, image_id, reject_code, and document_pipeline's columns for every image file under `path`: gate, gray, preparation, treatment, decision.

    A file that the gate rejects has final `rejected`. Limits as in prepare.
    """
    records, bands = read_rasters(spark, path)
    done = document_pipeline(cut(to_gray(bands).repartition("image_id")), treat, **limits)
    out = records.select("image_id", "original_name", "reject_code").join(done, "image_id", "left")
    return out.withColumn("final", F.when(F.col("reject_code").isNotNull(), "rejected").otherwise(F.col("final")))
