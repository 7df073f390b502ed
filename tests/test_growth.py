"""Plans of queries over pixels: what is sorted, joined or dealt out must not be pixels."""

import math
import random
import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from platen.operators import components, edges, geometry, histogram, metrics, preservation, registry, stencil
from platen.operators.metrics import as_lines

from conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a17_clipping_gamma", "a17_clipping_binary", "j1_a16_a23_similarity"])
def test_pairs_of_pixelwise_treatments_are_not_joined(spark, name):
    assert "Join" not in plan(entry.queries()[name](spark, SF))


def test_ink_sorts_no_pixels(spark):
    assert "SortMergeJoin" not in plan(entry.queries()["a20_ink"](spark, SF))


def test_with_original_is_align(spark):
    px = spark.createDataFrame([(i, y, x, (i * 31 + y * 17 + x * 7) % 256) for i in range(3) for y in range(4) for x in range(5)], "image_id long, y int, x int, v int")
    treat = lambda p: histogram.global_threshold(p, 100)
    key = lambda df: sorted(map(tuple, df.select("image_id", "y", "x", "v0", "v1").collect()))
    assert key(preservation.with_original(px, treat)) == key(preservation.align(px, treat(px)))


@pytest.mark.parametrize("name", ["p6_normalize", "h2_otsu", "h1_equalize", "a22_border_value"])
def test_tables_of_images_meet_pixels_without_sorting_them(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "SortMergeJoin" not in text and ("Window" not in text or name in ("h1_equalize", "h2_otsu"))


@pytest.mark.parametrize("name", ["k2_laplacian", "k6_erode", "k6_dilate", "k7_open", "k7_close", "k7_top_hat", "a19_isolated_impulse"])
def test_lines_are_not_collected_from_pixels(spark, name):
    """Lines come from the texts, in one order for the whole chain."""
    text = plan(entry.queries()[name](spark, SF))
    assert "ObjectHashAggregate" not in text and text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [image_id") == 1


def test_chains_in_bands_are_chains_of_whole_images(spark, monkeypatch):
    px = spark.createDataFrame([(i, y, x, (i * 37 + y * y * 11 + x * 29 + (y * x) % 5 * 60) % 256) for i in range(2) for y in range(23) for x in range(6)], "image_id long, y int, x int, v int")
    lines = px.groupBy("image_id", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("v"))
    key = lambda df: sorted(map(tuple, df.select("image_id", "y", "x", "v").collect()))
    lone = lambda df: sorted((r["image_id"], r["y"], tuple(r["__med"]), tuple(r["__lone"])) for r in df.collect())
    steps = (stencil.ERODE, stencil.DILATE)
    whole = [key(stencil.line_values(stencil.extreme_lines(lines, steps, 5, s))) for s in ("rect", "ellipse")] + [lone(stencil.isolated_lines(lines))]
    one_by_one = [key(stencil.dilate(stencil.erode(px, 5, s), 5, s)) for s in ("rect", "ellipse")]
    assert whole[:2] == one_by_one
    monkeypatch.setattr(stencil.banded, "__defaults__", (("image_id",), 4))
    assert whole == [key(stencil.line_values(stencil.extreme_lines(lines, steps, 5, s))) for s in ("rect", "ellipse")] + [lone(stencil.isolated_lines(lines))]


@pytest.mark.parametrize("name", ["h3_clahe", "h3_clahe_text", "h4_faded_text"])
def test_tiles_hold_only_values_that_they_have(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "sequence(0, 255" not in text and "Window" not in text and text.count("Exchange") <= text.count("FileScan")


def test_pixels_of_pages_are_never_sent(spark):
    """The planner takes drawn pages for as small as their texts, so it sent all their pixels through the driver."""
    text = plan(entry.queries()["s12_bounded_thumbnail"](spark, SF))
    assert "ShuffledHashJoin" in text and text.count("BroadcastExchange") <= 1


@pytest.mark.parametrize("name", ["k10_non_local_means", "k10_non_local_means_small"])
def test_offsets_of_non_local_means_are_not_rows(spark, name):
    """Every offset of the search window was a line of its own, dealt and ordered in windows."""
    text = plan(entry.queries()[name](spark, SF))
    assert "Window" not in text and "Join" not in text and "MapInArrow" in text


def test_non_local_means_in_bands(spark, monkeypatch):
    px = spark.createDataFrame([(i, y, x, (i * 37 + y * y * 11 + x * 29 + (y * x) % 5 * 60) % 256) for i in range(3) for y in range(23 - i) for x in range(6)], "image_id long, y int, x int, v int")
    key = lambda: sorted(map(tuple, stencil.non_local_means(px, 60.0, 3, 5).select("image_id", "y", "x", "v").collect()))
    whole = key()
    monkeypatch.setattr(stencil, "MEANS_BAND", 4)
    assert key() == whole and len(whole) == 66 * 6
    v = {(r["image_id"], r["y"], r["x"]): r["v"] for r in px.collect()}

    def mirror(i, n):
        i %= 2 * (n - 1)
        return i if i < n else 2 * (n - 1) - i

    def one(i, y, x, h):
        at = lambda y, x: v[i, mirror(y, h), mirror(x, 6)]
        total = weights = 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                near = [(mirror(y + a, h), mirror(x + b, 6)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
                k = math.exp(-sum((at(p + dy, q + dx) - at(p, q)) ** 2 for p, q in near) / 9 / 3600)
                total, weights = total + k * at(y + dy, x + dx), weights + k
        return math.floor(round(total / weights, 6) + 0.5)

    assert all(value == one(i, y, x, 23 - i) for i, y, x, value in whole)


def test_candidates_do_not_meet_their_originals_as_pixels(spark):
    text = plan(entry.queries()["e3_candidate_changes"](spark, SF))
    assert not re.search(r"Join \[[^\]]*\bx#", text) and not re.search(r"Join \[[^\]]*\by#", text)


@pytest.mark.parametrize("case", registry.CANDIDATES[6:11] + registry.CANDIDATES[-4:] + (("", "", "global_threshold", {"threshold": 100}),), ids=lambda c: f"{c[1]}{c[2]}")
def test_treatments_of_lines_are_those_of_pixels(spark, case):
    _, _, operation, parameters = case
    px = spark.createDataFrame([(i, y, x, (i * 37 + y * y * 11 + x * 29 + (y * x) % 5 * 60) % 256) for i in range(2) for y in range(9) for x in range(6)], "image_id long, y int, x int, v int")
    lines = registry._beside(as_lines(px), operation, **parameters)
    got = sorted(map(tuple, stencil.line_values(lines.select("image_id", "y", "v")).collect()))
    assert got == sorted(map(tuple, registry.apply_operation(px, operation, **parameters).select("image_id", "y", "x", "v").collect()))
    assert sorted(map(tuple, stencil.line_values(lines.select("image_id", "y", F.col("v0").alias("v"))).collect())) == sorted(map(tuple, px.collect()))


def segments_by_brute_force(points, step, threshold, min_length, max_gap):
    angles, votes, cells, out = [math.radians(i * step) for i in range(round(180 / step))], {}, {}, []
    rho = lambda p, a: math.floor(round(p[0] * math.cos(a) + p[1] * math.sin(a), 6) + 0.5)
    for i, a in enumerate(angles):
        for p in points:
            votes[i, rho(p, a)] = votes.get((i, rho(p, a)), 0) + 1
    for p in points:
        own = [(i, rho(p, a)) for i, a in enumerate(angles) if votes[i, rho(p, a)] >= threshold]
        if own:
            ties = [c for c in own if votes[c] == max(votes[o] for o in own)]
            a = angles[ties[(len(ties) - 1) // 2][0]]
            cells.setdefault(ties[(len(ties) - 1) // 2], []).append((round(p[1] * math.cos(a) - p[0] * math.sin(a), 6), *p))
    for (i, _), line in cells.items():
        parts = []
        for q in sorted(line):
            if not parts or q[0] - parts[-1][-1][0] > max_gap:
                parts.append([])
            parts[-1].append(q)
        for part in parts:
            (_, x1, y1), (_, x2, y2) = part[0], part[-1]
            if round(math.hypot(x2 - x1, y2 - y1), 6) >= min_length:
                out.append((x1, y1, x2, y2, round(math.hypot(x2 - x1, y2 - y1), 6), step * i - 90, len(part)))
    return out


def test_votes_are_counted_where_they_are_cast(spark, monkeypatch):
    """Each pixel's 180 or 360 votes were rows that went through windows."""
    images = {i: sorted({((i * 7 + k * k * 3) % 13, (k * 5 + i) % 11) for k in range(18)} | {(k, (k * (i + 1)) // 3 % 11) for k in range(12)}) for i in (3, 4, 8, -2)}
    edges = spark.createDataFrame([(i, y, x) for i, points in images.items() for x, y in points], "image_id long, y int, x int")
    want = sorted((i, *s) for i, points in images.items() for s in segments_by_brute_force(points, 1.0, 4, 2.0, 2))
    got = lambda: sorted(map(tuple, geometry.hough_segments(edges, 1.0, 4, 2.0, 2).collect()))
    assert got() == want and len(want) == 8
    monkeypatch.setattr(geometry, "TOGETHER", 1)
    assert got() == want
    text = plan(geometry.hough_segments(edges))
    assert "Window" not in text and text.count("Exchange") == 1


def test_extreme_lines_are_dealt_out_once(spark):
    """Both sides come from one dealing into all of the session's partitions, which Spark doesn't join into few large ones."""
    text = plan(entry.queries()["w7_extreme_lines"](spark, SF))
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 1 and "Union" not in text
    lines = spark.createDataFrame([(1, i, "p", float(i % 3)) for i in range(9)] + [(2, 7, "p", 1.0)], "image_id long, id int, family string, offset double")
    got = sorted((r["image_id"], r["side"], r["id"]) for r in geometry.extremes(lines).collect())
    assert got == sorted([(1, "low", i) for i in (0, 3, 6, 1)] + [(1, "high", i) for i in (2, 5, 8, 1)] + [(2, "low", 7), (2, "high", 7)])


def test_results_at_their_end_are_not_dealt_out_by_null(spark, monkeypatch):
    """Long chains among many results without a parent: every round deals all rows evenly, and finished ones meet nothing."""
    from platen.sources import intake

    chain = [(i, i - 1 if i else None) for i in range(20)]
    rows = spark.createDataFrame(chain + [(i, None) for i in range(100, 2100)], "result_id long, parent_result_id long")
    seen, cut = [], intake.cut
    monkeypatch.setattr(intake, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    for name, value in (("adaptive.coalescePartitions.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        got = sorted(map(tuple, intake.lineage_closure(rows).collect()))
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
    assert got == sorted([(i, 0, i) for i in range(20)] + [(i, i, 0) for i in range(100, 2100)])
    assert len(seen) > 3
    for one in seen[1:]:
        sizes = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("name", ["s12_thumbnail", "p11_crop"])
def test_texts_are_dealt_into_all_partitions(spark, name):
    """Spark would join partitions by the size of texts, which a task turns into far larger pixels."""
    text = plan(entry.queries()[name](spark, SF))
    assert "REPARTITION_BY_NUM" in text and "REPARTITION_BY_COL" not in text and text.count("Exchange hashpartitioning") == 1


def test_components_in_bands(spark, monkeypatch):
    """Runs are labelled where their band is; only what crosses from band to band is joined, and small images need no join."""
    draw = random.Random(2)
    px = [(i, y, x) for i in range(4) for y in range(23) for x in range(17) if draw.random() < (0.2, 0.4, 0.6, 1)[i]]
    mask, want = spark.createDataFrame(px, "image_id long, y int, x int"), set()
    left = set(px)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            i, y, x = todo.pop()
            part.add((i, y, x))
            near = {(i, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        want.add(frozenset(part))

    def parts(runs):
        found = {}
        for r in runs.collect():
            found.setdefault(r["comp"], set()).update((r["image_id"], r["y"], x) for x in range(r["s"], r["e"] + 1))
        return set(map(frozenset, found.values()))

    assert parts(components.labelled_runs(mask, 4)) == want
    monkeypatch.setattr(components, "spread_minimum", lambda edges: pytest.fail("no component crosses a band"))
    assert parts(components.labelled_runs(mask)) == want


def test_edges_and_reports_of_lines_are_those_of_pixels(spark):
    """Edges, and a whole report whose metrics are held against those of pixels."""
    px = spark.createDataFrame([(i, y, x, (i * 31 + y * y * 17 + x * x * 7 + (200 if (x > 6) ^ (y > 4) else 0)) % 256) for i in range(3) for y in range(11) for x in range(13)], "image_id long, y int, x int, v int")
    key = lambda df: sorted(map(tuple, df.select("image_id", "y", "x").collect()))
    assert key(edges.canny_lines(as_lines(px))) == key(edges.canny(edges.auto_thresholds(px), "lo", "hi")) != []
    pair = preservation.with_original(px, lambda p: histogram.gamma_correct(p, 1.35))
    report = {r["image_id"]: r for r in preservation.verify_pairs(pair).collect()}
    ref = preservation.with_reference(pair).checkpoint()
    for part in (preservation.similarity(pair), preservation.clipping_change(pair), preservation.smoothing_ratio(ref, "ref"), preservation.edge_metrics(ref, "ref"), preservation.component_retention(ref, "ref"), preservation.ink_metrics(ref, "ref")):
        for r in part.collect():
            for c in set(part.columns) & set(report[r["image_id"]].asDict()):
                assert r[c] == pytest.approx(report[r["image_id"]][c], abs=1e-9)
    assert len(report) == 3


def test_smart_pipeline_tries_treatments_on_lines(spark, monkeypatch):
    """Edges are counted from lines as from pixels, and reports get lines: what is kept of a treated raster is a row a line."""
    px = spark.createDataFrame([(i, y, x, (i * 31 + y * y * 17 + x * x * 7) % 256) for i in range(3) for y in range(9) for x in range(10)], "image_id long, y int, x int, v int")
    density = lambda df: {r["image_id"]: r["edge_density"] for r in df.collect()}
    assert density(metrics.edge_density_lines(as_lines(px))) == density(metrics.edge_density(px))
    seen = []

    class Enough(Exception):
        pass

    def report(rows):
        seen.append(rows.columns)
        raise Enough

    monkeypatch.setattr(registry, "verify_lines", report, raising=False)
    with pytest.raises(Enough):
        registry.smart_pipeline(px)
    assert seen == [["image_id", "y", "v0", "v1"]]
