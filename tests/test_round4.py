"""Findings of round 4."""

import math

import pytest
from pyspark.sql import functions as F

from platen.operators import edges, geometry, histogram, prepare, stencil
from platen.operators.metrics import as_lines
from platen.sources import rasters

PX = "image_id long, y int, x int, v int"


def tables_by_hand(v: dict, height: int, width: int, clip: float, grid: int) -> dict:
    th, tw = math.ceil(height / grid), math.ceil(width / grid)
    my, mx = (height - 1) // th, (width - 1) // tw
    held: dict = {}
    for (y, x), value in v.items():
        held.setdefault((y // th, x // tw), []).append(value)

    def entry(tile, value):
        some = held[tile]
        limit = max(1, math.floor(clip * len(some) / 256))
        kept = {u: min(some.count(u), limit) for u in set(some)}
        total = sum(n for u, n in kept.items() if u <= value) + (value + 1) * (len(some) - sum(kept.values())) / 256
        return min(255, math.floor(round(total * 255 / len(some), 6) + 0.5))

    out = {}
    for (y, x), value in v.items():
        fy, fx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
        py, q = fy - math.floor(fy), fx - math.floor(fx)
        at = lambda d, e: entry((max(0, min(my, math.floor(fy) + d)), max(0, min(mx, math.floor(fx) + e))), value)  # noqa: B023, E731
        total = (1 - py) * (1 - q) * at(0, 0) + (1 - py) * q * at(0, 1) + py * (1 - q) * at(1, 0) + py * q * at(1, 1)
        out[y, x] = math.floor(round(total, 6) + 0.5)
    return out


def test_clahe_counts_bits_of_tiles(spark):
    """Tables with and without clipped counts, of lines and of pixels; no pixel goes through a tile's values."""
    for height, width, clip, grid in ((41, 37, 2.0, 2), (9, 8, 1.5, 8), (5, 70, 40.0, 3)):
        rows = [(i, y, x, (i * 31 + y * y * 17 + x * x * 7 + y * x % 3 * 60) % 256) for i in range(2) for y in range(height) for x in range(width)]
        lines = as_lines(spark.createDataFrame(rows, PX))
        got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in histogram.clahe_pixels(lines, clip, grid).collect()}
        assert got == {(r["image_id"], r["y"], r["x"]): r["v"] for r in stencil.line_values(histogram.clahe_lines(lines, clip, grid)).collect()}
        for i in range(2):
            want = tables_by_hand({(y, x): v for j, y, x, v in rows if j == i}, height, width, clip, grid)
            assert {k[1:]: v for k, v in got.items() if k[0] == i} == want
    text = histogram.clahe_pixels(lines).groupBy("image_id").agg(F.sum("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(v" not in text and text.count("aggregate(h") == 1


def test_skew_of_pages_with_few_words(spark):
    """Strips across several lines of text had more votes than the lines themselves, and a segment took its angle from votes elsewhere in its cell."""
    items = [
        (50, "Thtion that onnt anedre thwhst erha thnd atealy st haedth anstanat shblest the, heeati.\nEdnd, er and thontionat."),
        (112, "Eranshwh esenea thenhe a thlyble thedonwh the ththen nd a onen be erwh thstble anble.\nTo is of th heor and ndennd."),
    ]
    px = rasters.page_raster(spark.createDataFrame(items, "item_id long, text string")).checkpoint()
    got = {r["image_id"]: r for r in prepare.detect_skew(px).collect()}
    for image, drawn in ((50, math.degrees(math.atan2(35, 999))), (112, 0.0)):
        assert got[image]["confidence"] >= 0.7 and abs(got[image]["angle"] - drawn) <= 0.75


def test_votes_keep_the_own_normal(spark):
    """A pixel whose neighbouring coarse cells are both stronger still votes for its own angle."""
    rows = [(1, 10, 10, j, r, w, w) for j, r, w in ((30, 1, 4), (29, 1, 3), (31, 1, 3))] + [(1, 20 + k, 10, j, 1, 3, 3) for k in range(4) for j in (29, 31)]
    coarse = spark.createDataFrame(rows, "image_id long, y int, x int, j int, rho int, w int, n int").drop("n")
    theta = {r["theta"] for r in geometry.fine_votes(coarse, 0.5, 1).where("y = 10").collect()}
    assert 180 in theta


def test_edges_carry_no_squares(spark, monkeypatch):
    """Pixels were gathered into lines twice, and each carried the nine values around it."""
    seen = []

    class Enough(Exception):
        pass

    def held(kept):
        seen.append(kept._jdf.queryExecution().optimizedPlan().toString())
        raise Enough

    monkeypatch.setattr(edges, "_held", held)
    px = spark.createDataFrame([(1, y, x, (y * 37 + x * 91) % 256) for y in range(8) for x in range(8)], PX)
    with pytest.raises(Enough):
        edges.canny(px, 50, 150)
    assert seen[0].count("collect_list(struct(") == 1
