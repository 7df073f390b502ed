"""Drawn pages: boundary cascade, voting from coarse to fine, rings by spans, bands, running extremes."""

import math

import pytest
from pyspark.sql import functions as F

from platen.operators import geometry, metrics, prepare, stencil
from platen.operators.edges import canny
from platen.sources import rasters
from platen.sources.store import cut

PX = "image_id long, y int, x int, v int"


def drawn(spark, height, width, rule, image_id=1):
    """An image from an SQL rule of y and x."""
    px = spark.range(height).select(F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return px.repartition(4, "y").select(F.lit(image_id).cast("long").alias("image_id"), "y", "x", F.expr(rule).cast("int").alias("v"))


@pytest.mark.parametrize("border", ["reflect101", "replicate", "ignore"])
@pytest.mark.parametrize("r", [1, 2, 5])
def test_bands_change_nothing(spark, border, r):
    """Over several bands, rows around are those of the whole image, and no window is larger than a band with its halo."""
    for height in (1, 2, 3, 8, 19, 24):
        rows = spark.createDataFrame([(i, y, [y * 7 + i, y]) for i in (1, 2) for y in range(height)], "image_id long, y int, v array<int>")
        key = lambda d: sorted((x["image_id"], x["y"], str(x["__near"])) for x in d.collect())
        whole = key(stencil.around(rows, F.col("v"), r, border))
        assert key(stencil.around(rows, F.col("v"), r, border, band=8)) == whole
        assert key(stencil.around(rows, F.col("v"), r, border, band=3)) == whole


def test_running_extremes_match_the_square(spark):
    px = drawn(spark, 23, 31, "(y * 37 + x * 91 + y * x * 5) % 256")
    grid = {(r["y"], r["x"]): r["v"] for r in px.collect()}
    for k, shape in ((3, "rect"), (5, "rect"), (15, "rect"), (5, "ellipse"), (7, "ellipse")):
        halves = stencil._halves(k, shape)
        for f, pick in ((stencil.erode, min), (stencil.dilate, max)):
            got = {(r["y"], r["x"]): r["v"] for r in f(px, k, shape).collect()}
            for (y, x), v in got.items():
                assert v == pick(grid[y + d - k // 2, x + e] for d, half in enumerate(halves) for e in range(-half, half + 1) if (y + d - k // 2, x + e) in grid)


def test_median_network(spark):
    px = drawn(spark, 17, 13, "(y * 53 + x * 29 + (y * x) % 7 * 41) % 256")
    grid = {(r["y"], r["x"]): r["v"] for r in px.collect()}
    for k in (3, 5):
        for r in stencil.median_denoise(px, k).collect():
            around = sorted(grid[min(16, max(0, r["y"] + i)), min(12, max(0, r["x"] + j))] for i in range(-(k // 2), k // 2 + 1) for j in range(-(k // 2), k // 2 + 1))
            assert r["v"] == around[k * k // 2]


def test_illumination_of_sizes_together(spark):
    """Images of several sizes in one plan have what each has alone."""
    sizes = ((20, 30), (120, 150), (130, 95))
    each = [drawn(spark, h, w, "least(255, 60 + x + y div 2)", i) for i, (h, w) in enumerate(sizes)]
    together = {r["image_id"]: r["illumination_variation"] for r in metrics.illumination(each[0].union(each[1]).union(each[2])).collect()}
    for i, ((h, w), px) in enumerate(zip(sizes, each, strict=True)):
        kernel = stencil.gaussian_kernel(0, max(90, min(h, w)) / 30)
        g = stencil.convolve(px, kernel).groupBy("image_id").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("s")).first()
        assert together[i] == pytest.approx(g["s"] / g["m"], rel=1e-9)


def ruled(spark, degrees):
    """A page of 700 x 1000 with six dark lines 4 pixels thick and 700 long, turned about its middle."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    along, across = f"({c} * (x - 500) + {s} * (y - 350))", f"({c} * (y - 350) - {s} * (x - 500))"
    return drawn(spark, 700, 1000, f"case when abs({along}) <= 350 and pmod({across} + 170, 60) < 4 and {across} between -171 and 136 then 0 else 255 end")


@pytest.mark.parametrize("degrees", [5.0, -12.0, 0.0])
def test_skew_of_a_ruled_page(spark, degrees):
    r = prepare.detect_skew(cut(ruled(spark, degrees))).first()
    assert r["lines"] >= 3 and r["confidence"] > 0 and abs(r["angle"] - degrees) <= 0.5


def test_small_pages_have_no_skew(spark):
    assert prepare.detect_skew(drawn(spark, 79, 200, "case when y % 10 = 0 then 0 else 255 end")).first()["confidence"] == 0


def test_votes_from_coarse_to_fine_lose_no_line(spark):
    """On a page of 700 x 1000, few of the full vote's rows are voted, and each line of the full vote has a segment of the same direction and place."""
    edges = cut(canny(cut(ruled(spark, 5.0)), 50, 150, gradient=True))
    coarse = cut(geometry.coarse_votes(edges))
    fine = geometry.fine_votes(coarse, 0.5, 45)
    assert coarse.count() + fine.count() < 0.1 * 360 * edges.count()
    full = [r for r in geometry.hough_segments(edges, 0.5, 45, 120, 25).collect() if r["length"] > 300]
    some = [r for r in geometry.page_segments(edges, 0.5, 45, 120, 25).collect()]
    middle = lambda r: ((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2)

    def beside(a, b):
        (x, y), t = middle(a), math.radians(b["angle"])
        return abs((y - b["y1"]) * math.cos(t) - (x - b["x1"]) * math.sin(t)) <= 4 and abs(a["angle"] - b["angle"]) <= 1

    found = sum(any(beside(a, b) for b in some) for a in full)
    assert len(full) >= 6 and found >= 0.9 * len(full)


def scene(spark, ground):
    """A sheet with corners (60, 40), (260, 55), (250, 215), (50, 195) on a ground given as SQL."""
    corners = [(60, 40), (260, 55), (250, 215), (50, 195)]
    inside = " and ".join(f"{b[0] - a[0]} * (y - {a[1]}) - {b[1] - a[1]} * (x - {a[0]}) >= 0" for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
    return corners, drawn(spark, 250, 320, f"case when {inside} then 150 else {ground} end")


@pytest.mark.parametrize("ground,detector", [("45", "region"), ("case when x < 160 then 45 else 245 end", "lines")])
def test_cascade_of_detectors(spark, ground, detector):
    corners, px = scene(spark, ground)
    r = prepare.detect_boundary(cut(px), band=None, lines=True, min_side=80).first()
    assert r["detected"] and r["detector"] == detector
    assert all(math.hypot(c["x"] - x, c["y"] - y) <= 3 for c, (x, y) in zip(r["corners"], corners, strict=True))


def test_flat_and_small_images_have_no_boundary(spark):
    flat = drawn(spark, 120, 160, "220")
    assert prepare.detect_boundary(flat, band=None, lines=True, min_side=80).where("detected").count() == 0
    _, px = scene(spark, "45")
    assert prepare.detect_boundary(px.where("y < 60"), band=None, lines=True, min_side=80).count() == 0


def test_ring_by_spans_is_the_ring(spark):
    corners, px = scene(spark, "45")
    quad = spark.createDataFrame([(1, 1, [{"x": float(x), "y": float(y)} for x, y in corners])], "image_id long, candidate int, corners array<struct<x:double,y:double>>").withColumn("r", F.lit(3.5))
    got = {}
    for r in prepare.ring_pixels(px, quad, "r").groupBy("inside", "v").count().collect():
        got[r["inside"], r["v"]] = r["count"]
    want = {}
    sides = list(zip(corners, corners[1:] + corners[:1], strict=True))
    for y in range(250):
        for x in range(320):
            cross = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in sides]
            inside = all(c >= 0 for c in cross)
            for (a, b), c in zip(sides, cross, strict=True):
                dx, dy = b[0] - a[0], b[1] - a[1]
                if 0 <= (x - a[0]) * dx + (y - a[1]) * dy <= dx * dx + dy * dy and c * c <= 3.5**2 * (dx * dx + dy * dy):
                    key = (inside, 150 if inside else 45)
                    want[key] = want.get(key, 0) + 1
    assert got == want
    assert prepare.ring_spans(quad, "r").count() < 700


def test_drawn_pages_are_as_described(spark):
    items = spark.createDataFrame([(0, "ab cd"), (1, "x" * 900), (3, None), (9, "")], "item_id long, text string")
    px = rasters.page_raster(items)
    dims = {r["image_id"]: (r["height"], r["width"]) for r in rasters.dimensions(px).collect()}
    frames = {r["image_id"]: r for r in rasters.page_frames(items).collect()}
    assert dims == {i: (f["height"], f["width"]) for i, f in frames.items()}
    dark = {r["image_id"]: r["n"] for r in px.where("v = 30").groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert dark[0] == 4 * rasters.CELL * rasters.INK and 9 not in dark and 3 not in dark
    assert abs(dark[1] - 900 * rasters.CELL * rasters.INK) < 0.02 * dark[1]  # whole, though longer than a page
