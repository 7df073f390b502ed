from platen.operators import prepare


def test_gate_and_checks(spark):
    rows = [(1, 5.0, 0.9), (2, 0.2, 0.9), (3, 60.0, 0.9), (4, 5.0, 0.5)]
    got = {r["image_id"]: r["action"] for r in prepare.deskew_gate(spark.createDataFrame(rows, "image_id long, angle double, confidence double")).collect()}
    assert got == {1: "apply", 2: "skip_small", 3: "skip_large", 4: "skip_confidence"}
    schema = "image_id long, prepared boolean, confidence double, area_ratio double, width int, height int, convex boolean, retention double, residual double, residual_confidence double"
    good = (True, 0.9, 0.6, 100, 100, True, None, 0.1, 0.8)
    rows = [(1, *good), (2, False, *good[1:]), (3, *good[:6], 0.9, 0.1, 0.8), (4, *good[:7], 1.5, 0.8), (5, *good[:7], 3.0, 0.8), (6, *good[:7], 9.0, 0.0)]
    got = {r["image_id"]: r["status"] for r in prepare.verify_preparation(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "accept", 2: "reject", 3: "reject", 4: "caution", 5: "reject", 6: "caution"}


def test_safe_crop_of_a_diamond(spark):
    rows = [(1, y, x) for y in range(9) for x in range(abs(y - 4), 9 - abs(y - 4))]
    r = prepare.safe_crop(spark.createDataFrame(rows, "image_id long, y int, x int")).first()
    assert (r["x"], r["y"], r["w"], r["h"]) == (2, 2, 5, 5)


def test_boundary_of_a_bright_page(spark):
    inside = lambda y, x: 8 <= x <= 52 and 6 <= y <= 34
    px = spark.createDataFrame([(1, y, x, 235 if inside(y, x) else 45) for y in range(42) for x in range(60)], "image_id long, y int, x int, v int")
    r = prepare.detect_boundary(px, 0.68, 50).first()
    assert r["detected"] and [(c["x"], c["y"]) for c in r["corners"]] == [(8, 6), (52, 6), (52, 34), (8, 34)]
    flat = spark.createDataFrame([(1, y, x, 220) for y in range(20) for x in range(20)], "image_id long, y int, x int, v int")
    assert prepare.detect_boundary(flat).where("detected").count() == 0


def test_pages_are_turned_where_the_gate_says_apply(spark):
    line = lambda y, x: abs(y - 30 - 0.1 * (x - 40)) < 1
    rows = [(i, y, x, 20 if line(y, x) else 220) for i in (1, 2) for y in range(61) for x in range(81)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    gated = spark.createDataFrame([(1, 5.710593, "apply"), (2, 5.710593, "skip_confidence")], "image_id long, angle double, action string")
    pages, crops = prepare.deskew(px, gated)
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in pages.collect()}
    assert {k: v for k, v in got.items() if k[0] == 2} == {tuple(r[:3]): r[3] for r in rows if r[0] == 2}
    dark = {y for (i, y, x), v in got.items() if i == 1 and v < 100}
    assert len(dark) <= 3 and max(k[1] for k in got if k[0] == 1) > 60
    assert min(v for (i, y, x), v in got.items() if i == 1 and y < 20) >= 219  # the border's median fills the new corners
    assert [r["image_id"] for r in crops.collect()] == [1] and 0 < crops.first()["retention"] < 1


def test_each_image_ends_in_one_row(spark):
    inside = lambda y, x: 8 <= x <= 52 and 6 <= y <= 34
    rows = [(1, y, x, 235 if inside(y, x) else 45) for y in range(42) for x in range(60)] + [(2, y, x, 220) for y in range(20) for x in range(20)]
    seen = []

    def treat(px):
        seen.append({r["image_id"] for r in px.select("image_id").distinct().collect()})
        return px.select("image_id").distinct().selectExpr("image_id", "'treated' as final")

    got = prepare.document_pipeline(spark.createDataFrame(rows, "image_id long, y int, x int, v int"), treat, least_ring=50, least_side=2, band=2.5, lines=False, min_side=4, threshold=5).collect()
    # the page is under 40 pixels high, so its check rejects it (and by default it is not rectified at all); the flat image has no boundary
    assert {r["image_id"]: r["final"] for r in got} == {1: "review_required", 2: "stopped"} and len(got) == 2 and seen == [set()]


def test_all_operation_cases_are_evaluated(spark):
    from platen.operators.registry import evaluate_operations

    px = spark.createDataFrame([(1, y, x, (y * 37 + x * 91) % 256) for y in range(8) for x in range(8)], "image_id long, y int, x int, v int")
    got = [(r["operation_id"], r["label"]) for r in evaluate_operations(px).select("operation_id", "label").collect()]
    assert len(got) == len(set(got)) == 20 and {"block_size_51__c_15", "kernel_size_5", "amount_0.75", "threshold_160", "clip_limit_2.5"} <= {g[1] for g in got}
