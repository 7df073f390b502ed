import json
import struct
import zlib

from pyspark.sql import functions as F

from platen.operators.prepare import process_files
from platen.operators.rules import enhancement_loop
from platen.plans.pages import TINY
from platen.sources.intake import list_corpus, mint_id, read_manifest, read_rasters, scan_images, unpack, write_images, write_manifest, write_report, write_results
from platen.streaming.flows import stream_attempts, stream_decision_counts, stream_ingest

ATTEMPTS = "image_id long, priority int, operation_id string, eligible boolean, decision string"


def png(rows):
    """A gray PNG of the rows."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_scan_and_list(spark, tmp_path):
    (tmp_path / "b.PNG").write_bytes(png([[0, 10, 20], [30, 40, 255]]))
    (tmp_path / "a.png").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in list_corpus(spark, str(tmp_path)).collect()] == ["a.png", "b.PNG"]
    images = scan_images(spark, f"{tmp_path}/*.[pP][nN][gG]")
    assert sorted(r["height"] for r in images.collect()) == [-1, 2]
    assert [r["c"][0] for r in unpack(images).orderBy("y", "x").collect()] == [0, 10, 20, 30, 40, 255]


def test_sinks(spark, tmp_path):
    px = spark.createDataFrame([("r1", 1, 0, 0, 5)], "result_id string, image_id long, y int, x int, v int")
    write_results(px, str(tmp_path / "results"))
    write_results(px.replace("r1", "r2"), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2
    write_manifest(spark.createDataFrame([("r1", "s")], "result_id string, parent string"), str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m")).union(spark.createDataFrame([("[broken",)], "value string"))
    assert [r["manifest"]["parent"] for r in read_manifest(text, "value", "result_id string, parent string").where("manifest.result_id IS NOT NULL").collect()] == ["s"]
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"result_id": "r1", "parent": "s"}
    write_report(px, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["v"] == "5"
    ids = mint_id(spark.createDataFrame([("same",), ("same",)], "name string")).collect()
    assert len({r["image_id"] for r in ids}) == 2 and all(len(r["image_id"]) == 32 for r in ids)


def test_decision_counts_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, status string"
    source = str(tmp_path / "in")
    counts = stream_decision_counts(spark.readStream.schema(schema).parquet(source) if spark.range(0).selectExpr("timestamp'2024-01-01' as ts", "'a' as status").write.parquet(source) is None else None)
    query = counts.writeStream.format("memory").queryName("decision_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in (["2024-01-01 00:10:00", "2024-01-01 00:20:00"], ["2024-01-01 03:00:00"], ["2024-01-01 00:30:00", "2024-01-01 05:00:00"], ["2024-01-01 07:00:00"]):
        spark.createDataFrame([(t, "accepted") for t in rows], "t string, status string").selectExpr("cast(t as timestamp) ts", "status").coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    query.stop()
    got = {str(r["start"]): r["count"] for r in spark.sql("SELECT * FROM decision_counts").collect()}
    assert got["2024-01-01 00:00:00"] == 2 and got["2024-01-01 03:00:00"] == 1


def test_ledger_equals_the_batch_loop(spark, tmp_path):
    rows = [(1, i, f"op{i % 5}", True, "rejected_no_benefit") for i in range(6)] + [(2, 0, "a", True, "accepted"), (2, 1, "b", True, "accepted"), (3, 0, "a", False, "accepted")]
    table = spark.createDataFrame(rows, ATTEMPTS)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_attempts(spark.readStream.schema(ATTEMPTS).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((r["image_id"], r["priority"], r["step_status"]) for r in rows)
    assert key(spark.sql("SELECT * FROM ledger").collect()) == key(enhancement_loop(table).collect())


def test_ingest_each_once(spark, tmp_path):
    schema = "image_id long, original_name string, byte_size long, width int, height int, depth int, text string"
    rows = [(1, "a.png", 10, 5, 5, 8, "dark " * 40), (2, "b.exe", 10, 5, 5, 8, "x"), (3, "c.jpg", 10, -1, 5, 8, "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = stream_ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "d"), str(tmp_path / "r"))
        query.awaitTermination()
    assert {r["reject_code"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"UNSUPPORTED_FILE_TYPE", "UNREADABLE_IMAGE"}
    found = spark.read.parquet(str(tmp_path / "d")).collect()
    assert found and {r["image_id"] for r in found} == {1} and len({r["code"] for r in found}) == len(found)


def test_state_of_the_ledger_ends(spark, tmp_path):
    """After an hour without attempts an image's state is gone: its operations aren't known any more, and the state store shrinks."""
    shape = "image_id long, priority int, operation_id string, eligible boolean, decision string, ts timestamp"
    query = None
    seen, kept = [], []
    for hour, images in ((0, (1, 2, 3)), (1, (2,)), (5, (4,)), (6, (1, 4))):
        rows = [(i, 1, "clahe", True, "rejected", hour) for i in images]
        part = spark.createDataFrame(rows, "image_id long, priority int, operation_id string, eligible boolean, decision string, hour int")
        part.selectExpr("image_id", "priority", "operation_id", "eligible", "decision", f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {hour}, 0, 0) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = stream_attempts(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), ts="ts").writeStream.format("memory").queryName("ending").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        seen.append(sorted((r["image_id"], r["step_status"]) for r in spark.sql("SELECT * FROM ending").collect())[:])
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    query.stop()
    assert seen[0] == [(1, "rejected"), (2, "rejected"), (3, "rejected")]
    assert (2, "skipped") in seen[1]
    assert seen[3].count((1, "rejected")) == 2 and (4, "skipped") in seen[3]  # 1 begins anew, 4 is still known
    assert kept[2] < 4 and kept[3] <= 2


def test_files_from_gate_to_decision(spark, tmp_path):
    """A bright sheet, an empty ground, a file that is no image, one that is too large and one that isn't allowed; limits for small pictures."""
    (tmp_path / "sheet.png").write_bytes(png([[230 if 4 <= x < 20 and 4 <= y < 18 else 20 for x in range(24)] for y in range(22)]))
    (tmp_path / "dark.png").write_bytes(png([[20] * 24] * 22))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "broken.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "huge.png").write_bytes(b"\0" * (20 * 1024 * 1024 + 1))
    taken = lambda px: px.select("image_id").distinct().withColumn("final", F.lit("accepted"))
    rows = process_files(spark, str(tmp_path), taken, **TINY).collect()
    found = {r["original_name"]: (r["reject_code"], r["final"]) for r in rows}
    assert len(rows) == len(found) == 5
    assert found["broken.png"] == ("UNREADABLE_IMAGE", "rejected") and found["notes.txt"] == ("UNSUPPORTED_FILE_TYPE", "rejected") and found["huge.png"] == ("FILE_TOO_LARGE", "rejected")
    assert found["dark.png"] == (None, "stopped")
    assert found["sheet.png"][0] is None and found["sheet.png"][1] in ("accepted", "review_required")


def test_bands_of_files(spark, tmp_path):
    """Colour files keep their three bands, gray ones have them equal, and an empty folder has no rows."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rgb = b"".join(b"\0" + bytes([v, 0, 255, 10, v, 13]) for v in (0, 92))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rgb)) + chunk(b"IEND", b""))
    (tmp_path / "g.png").write_bytes(png([[0, 10, 92]]))
    records, bands = read_rasters(spark, str(tmp_path))
    names = {r["image_id"]: (r["original_name"], r["height"], r["width"], r["reject_code"]) for r in records.collect()}
    assert sorted(names.values()) == [("c.png", 2, 2, None), ("g.png", 1, 3, None)]
    got = {(names[r["image_id"]][0], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in bands.collect()}
    assert got == {("c.png", 0, 0): (0, 0, 255), ("c.png", 0, 1): (10, 0, 13), ("c.png", 1, 0): (92, 0, 255), ("c.png", 1, 1): (10, 92, 13), **{("g.png", 0, x): (v,) * 3 for x, v in enumerate((0, 10, 92))}}
    (tmp_path / "none").mkdir()
    records, bands = read_rasters(spark, str(tmp_path / "none"))
    assert records.count() == 0 and bands.count() == 0
