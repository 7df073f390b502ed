"""Intake of image records: gate, manifests, look-ups and lineage; files in and out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.functions.scalars import get_extension
from platen.sources.store import cut, uri_of

MAX_BYTES, MAX_PIXELS = 20 * 1024 * 1024, 30_000_000


def ingest_gate(images: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """images (original_name, byte_size, width, height, depth) with reject_code, null for those that pass; the first rule that applies counts."""
    name = F.col("original_name")
    rules = [
        ("NO_FILE", name.isNull()),
        ("EMPTY_FILENAME", name == ""),
        ("UNSUPPORTED_FILE_TYPE", ~get_extension(name).isin(*extensions)),
        ("FILE_TOO_LARGE", F.col("byte_size") > MAX_BYTES),
        ("UNREADABLE_IMAGE", F.coalesce(F.col("width") < 1, F.lit(True))),
        ("UNSUPPORTED_IMAGE_DEPTH", F.col("depth") != 8),
        ("IMAGE_DIMENSIONS_TOO_LARGE", F.col("width").cast("long") * F.col("height") > MAX_PIXELS),
    ]
    code = F.lit(None).cast("string")
    for rule, test in reversed(rules):
        code = F.when(test, rule).otherwise(code)
    return images.withColumn("reject_code", code)


def split_gate(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a gated table."""
    return images.where("reject_code IS NULL").drop("reject_code"), images.where("reject_code IS NOT NULL")


def mint_id(df: DataFrame, *cols: str) -> DataFrame:
    """df with image_id: 32 hex digits, random, or from `cols` if they are given."""
    ident = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 32) if cols else F.translate(F.uuid(), "-", "")
    return df.withColumn("image_id", ident)


def read_manifest(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Rows whose JSON is an object of `schema`, as struct `manifest`; malformed ones are missing."""
    return df.withColumn("manifest", F.from_json(col, schema, {"mode": "PERMISSIVE"})).where("manifest IS NOT NULL")


def resolve(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (id) with status FOUND, NOT_FOUND or INVALID_ID."""
    hit = known.select("id").distinct().withColumn("__hit", F.lit(True))
    return wanted.join(hit, "id", "left").withColumn("status", F.when(F.col("id").isNull(), "INVALID_ID").when(F.col("__hit").isNull(), "NOT_FOUND").otherwise("FOUND")).drop("__hit")


def check_lineage(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests (request_id, image_id, source_result_id) with status of the result that they start from."""
    r = results.select(F.col("result_id").alias("source_result_id"), "source_image_id", "kind")
    status = F.when(F.col("source_result_id").isNull(), "OK").when(F.col("kind").isNull(), "NOT_FOUND").when(F.col("source_image_id") != F.col("image_id"), "MISMATCH").when(F.col("kind") != "manual_approved", "INVALID_KIND").otherwise("OK")
    return requests.join(r, "source_result_id", "left").withColumn("status", status)


def lineage_closure(results: DataFrame) -> DataFrame:
    """result_id, root, depth of every result, by doubling: each round a result's jump is twice as far up its chain.

    Results that are at their end ask for nothing and are dealt out by their own id, not all of them by the null that they would ask for.
    """
    now = cut(results.select("result_id", F.col("parent_result_id").alias("up"), F.when(F.col("parent_result_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent_result_id", "result_id").alias("root")))
    # a chain has fewer links than there are results, so it is at its end after so many doublings
    for left in range(now.count().bit_length() + 1, -1, -1):
        if now.where("up IS NOT NULL").isEmpty():
            break
        if not left:
            raise ValueError(f"results descend from themselves: {sorted(str(r['result_id']) for r in now.where('up IS NOT NULL').limit(5).collect())}")
        far = now.select(F.col("result_id").alias("far"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("root2"))
        asks = now.withColumn("ask", F.coalesce("up", "result_id"))
        moved = asks.join(far, F.col("up").isNotNull() & (F.col("ask") == F.col("far")), "left")
        now = cut(moved.select("result_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")))
    return now.select("result_id", "root", "depth")


def scan_images(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """path, height, width, channels, depth (bits a band) and data (bands) of the files under `path` and its folders, with Spark's image source.

    What can't be decoded has height -1. Files of more than `most_bytes` are left out by their listing, so they aren't read.
    """
    files = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    if most_bytes is not None:
        files = files.where(F.col("_metadata.file_size") <= most_bytes)
    i = F.col("image")
    # the three lowest bits of the mode say how wide a band is
    depth = F.when(i["mode"] >= 0, F.element_at(F.array(*[F.lit(b) for b in (8, 8, 16, 16, 32, 32, 64, 16)]), i["mode"].bitwiseAND(7) + 1))
    return files.select(F.col("_metadata.file_path").alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), depth.alias("depth"), i["data"].alias("data"))


def unpack_lines(images: DataFrame) -> DataFrame:
    """The other columns of `images`, y and c (array) of every line of the decoded images: the bands of its pixels in turn (BGR or BGRA order).

    A line is cut from the bands as a whole and read as text of one character a byte, so a byte costs the same however large its image is.
    """
    size = F.col("width") * F.col("channels")
    line = lambda y: F.struct(y.alias("y"), F.decode(F.substring(F.col("data"), y * size + 1, size), "ISO-8859-1").alias("t"))
    good = images.where("height > 0")
    cut_ = good.withColumn("line", F.transform(F.sequence(F.lit(0), F.col("height") - 1), line)).drop("data")
    each = cut_.select(*[c for c in cut_.columns if c != "line"], F.explode("line").alias("line"))
    return each.select(*[c for c in each.columns if c != "line"], F.col("line.y").alias("y"), F.transform(F.split("line.t", ""), lambda c: F.ascii(c)).alias("c"))


def unpack(images: DataFrame) -> DataFrame:
    """path, y, x and the bands of every decoded pixel as array c (BGR order)."""
    lines = unpack_lines(images.select("path", "height", "width", "channels", "data"))
    n = F.col("channels")
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.slice("c", x * n + 1, n))
    return lines.select("path", "y", F.posexplode(pixels).alias("x", "c"))


def read_rasters(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> tuple[DataFrame, DataFrame]:
    """(records, bands): every file under `path`, gated, and the pixels (image_id, y, x, b, g, r) of those that pass.

    Records: image_id, path, original_name, byte_size, height, width, depth, reject_code. Ids number the files by path, so a folder read
    again has the same ids as long as its files and the session's partitions are the same. Gray files have three equal bands; alpha is left out, as in
    to_gray. A file is decoded once; files over the size limit aren't opened.
    """
    meta = F.col("_metadata")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(meta["file_path"].alias("path"), meta["file_name"].alias("original_name"), meta["file_size"].alias("byte_size"))
    files = cut(files.orderBy("path").select(F.monotonically_increasing_id().alias("image_id"), "path", "original_name", "byte_size"))
    named = files.where(get_extension(F.col("original_name")).isin(*extensions)).select("image_id", "path")
    # decoded lines are no wider than a pixel's bands; a page is dealt out by its lines when they are unpacked
    images = cut(scan_images(spark, path, MAX_BYTES).join(named, "path"))
    gated = cut(ingest_gate(files.join(images.select("image_id", "height", "width", "channels", "depth"), "image_id", "left")))
    passed = gated.where("reject_code IS NULL").select("image_id")
    lines = unpack_lines(images.select("image_id", "height", "width", "channels", "data").join(passed, "image_id", "left_semi"))
    n = F.col("channels")
    band = lambda x, k: F.get(F.col("c"), x * n + F.least(F.lit(k), n - 1))
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.struct(band(x, 0).alias("b"), F.when(n < 3, band(x, 0)).otherwise(band(x, 1)).alias("g"), F.when(n < 3, band(x, 0)).otherwise(band(x, 2)).alias("r")))
    return gated.drop("channels"), lines.select("image_id", "y", F.posexplode(pixels).alias("x", "p")).select("image_id", "y", "x", "p.*")


def _written(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """(image_id, path) of the rasters (image_id, width, values), written as gray PNG files; a task that runs again writes the same files."""
    system, root = fs.FileSystem.from_uri(uri)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    for batch in batches:
        ids, paths = batch.column("image_id"), []
        for i, width in enumerate(batch.column("width").to_pylist()):
            lines = batch.column("v")[i].values.to_numpy().view(np.uint8).reshape(-1, width)
            body = np.concatenate((np.zeros((len(lines), 1), np.uint8), lines), axis=1).tobytes()
            head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
            with system.open_output_stream(f"{root}/{ids[i]}.png") as out:
                out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
            paths.append(f"{uri}/{ids[i]}.png")
        yield pa.RecordBatch.from_arrays([ids, pa.array(paths, pa.string())], names=["image_id", "path"])


def write_images(px: DataFrame, folder: str) -> DataFrame:
    """Writes every raster of `px` under `folder` as <image_id>.png, losslessly, and returns image_id and path of each.

    One image, of MAX_PIXELS bytes at most, is one row where it is written.
    """
    spark = px.sparkSession
    uri = uri_of(spark, folder)
    system, root = fs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    values = lambda s: F.transform(F.sort_array(s), lambda p: p["v"])
    lines = px.groupBy("image_id", "y").agg(values(F.collect_list(F.struct("x", F.when(F.col("v") > 127, F.col("v") - 256).otherwise(F.col("v")).cast("tinyint").alias("v")))).alias("v"))
    pages = lines.groupBy("image_id").agg(F.max(F.size("v")).alias("width"), F.flatten(values(F.collect_list(F.struct("y", "v")))).alias("v"))
    return cut(pages.mapInArrow(lambda batches: _written(batches, uri), "image_id long, path string"))


def list_corpus(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """path and length of the files with one of the suffixes, in order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where(get_extension(F.col("path")).isin(*extensions)).orderBy("path")


def write_results(px: DataFrame, path: str) -> None:
    """Adds result rasters; one that is there already is never touched, since results have ids of their own."""
    px.write.mode("append").partitionBy("result_id").parquet(path)


def write_manifest(results: DataFrame, path: str, rasters: str | None = None) -> None:
    """Adds one JSON line for each result (result_id, source_image_id, parent_result_id, ...; null where it has no parent).

    If that fails, the rasters that write_results has put under `rasters` for these results are removed again.
    """
    try:
        results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
    except Exception:
        if rasters:
            spark = results.sparkSession
            for r in results.select("result_id").distinct().toLocalIterator():
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{rasters}/result_id={r['result_id']}")
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        raise


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)
