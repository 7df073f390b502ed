"""Raster corpora as pixel tables: (image_id, y, x, v), v in 0..255.

A text raster writes a text's code points, modulo 256, in rows of WIDTH and fills the last row with spaces; a vector raster
writes a vector as a square, scaled from its own least to its own greatest component. Pixels of an image share a
partition, so windows and groups by image need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.sources.store import spread

WIDTH = 32
KEYS = ["image_id", "y", "x"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_raster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Whole texts; null and empty ones have no raster. A text is far smaller than its pixels, so texts are dealt into all partitions and none are joined into larger ones."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull() & (text != "")).select(F.col(id_col).cast("long").alias("image_id"), F.concat(text, F.expr(f"repeat(' ', pmod(-length({text_col}), {width}))")).alias("t"))
    chars = spread(rows, "image_id").select("image_id", F.posexplode(F.split("t", "", -1)).alias("p", "c")).where("c <> ''")
    return chars.select("image_id", F.expr(f"cast(p div {width} as int)").alias("y"), F.expr(f"cast(p % {width} as int)").alias("x"), (F.ascii("c") % 256).alias("v"))


#: The conditions of the audit corpus, by image_id % 8, as integer arithmetic on v, x, y and image_id.
CONDITIONS = {
    1: "v * 2 div 5",
    2: "least(255, v + 130)",
    3: "100 + v div 8",
    4: "least(255, greatest(0, (v - 60) * 3))",
    5: "least(255, v + 3 * x)",
    6: "case when (image_id * 31 + y * 17 + x * 7) % 97 = 0 then case when (y + x) % 2 = 0 then 0 else 255 end else v end",
    7: "255 - v",
}


def conditioned(px: DataFrame) -> DataFrame:
    """Every image in the condition that its id gives it; remainder 0 stays as it is."""
    cases = " ".join(f"when {k} then {e}" for k, e in CONDITIONS.items())
    return px.withColumn("v", F.expr(f"cast(case pmod(image_id, 8) {cases} else v end as int)"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, by_image: bool = False) -> DataFrame:
    """The conditioned text rasters as scanlines: image_id, y, v (array); no pixel becomes a row. With `by_image` an image's lines
    share a partition, as the pixels of `text_raster` do, so that texts are all that is dealt out."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull() & (text != "")).select(F.col(id_col).cast("long").alias("image_id"), F.concat(text, F.expr(f"repeat(' ', pmod(-length({text_col}), {width}))")).alias("t"))
    # dealt out for parsing only; what looks at neighbours deals lines out by image and band
    codes = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(["image_id"] if by_image else [])).select("image_id", F.transform(F.split("t", ""), lambda c: F.ascii(c) % 256).alias("c"))
    lines = codes.select("image_id", "c", F.explode(F.sequence(F.lit(0), F.expr(f"cast(size(c) div {width} as int) - 1"))).alias("y"))
    v = F.slice("c", F.col("y") * width + 1, width)
    cases = " ".join(f"when {k} then transform(v, (v, x) -> cast({e} as int))" for k, e in CONDITIONS.items())
    return lines.select("image_id", "y", v.alias("v")).withColumn("v", F.expr(f"case pmod(image_id, 8) {cases} else v end"))


def vector_raster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 8) -> DataFrame:
    """Whole vectors; constant ones are 0 everywhere. Null vectors have no raster."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("image_id"), F.transform(vector_col, lambda e: e.cast("double")).alias("e"))
    rows = rows.withColumns({"lo": F.array_min("e"), "hi": F.array_max("e")}).repartition("image_id")
    px = rows.select("image_id", "lo", "hi", F.posexplode("e").alias("p", "c"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor(255 * (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5)).otherwise(0)
    return px.select("image_id", F.expr(f"cast(p div {width} as int)").alias("y"), F.expr(f"cast(p % {width} as int)").alias("x"), v.cast("int").alias("v"))


def vector_lines(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 8) -> DataFrame:
    """`vector_raster` as scanlines: image_id, y, v (array), those of an image in one partition."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("image_id"), F.transform(vector_col, lambda e: e.cast("double")).alias("e"))
    rows = rows.withColumns({"lo": F.array_min("e"), "hi": F.array_max("e")}).repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    v = F.transform("e", lambda c: F.when(F.col("hi") > F.col("lo"), F.floor(255 * (c - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5)).otherwise(0).cast("int"))
    lines = rows.where(F.size("e") > 0).select("image_id", v.alias("v")).select("image_id", "v", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(v) - 1) div {width} as int)"))).alias("y"))
    return lines.select("image_id", "y", F.slice("v", F.col("y") * width + 1, width).alias("v"))


def colour(px: DataFrame) -> DataFrame:
    """Bands (b, g, r) of a gray raster, by fixed multiples."""
    return px.select(*KEYS, *[(F.col("v") * k % 256).alias(n) for n, k in (("b", 3), ("g", 5), ("r", 7))])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditioned text rasters of all documents."""
    return conditioned(text_raster(read(spark, sf_dir, "documents")))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`corpus` as scanlines."""
    return text_lines(read(spark, sf_dir, "documents"))


def corpus_image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`corpus` as scanlines, those of an image in one partition."""
    return text_lines(read(spark, sf_dir, "documents"), by_image=True)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector rasters of all embeddings."""
    return vector_raster(read(spark, sf_dir, "embeddings"))


def vector_corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`vectors` as scanlines."""
    return vector_lines(read(spark, sf_dir, "embeddings"))


#: Drawn pages. Directions (cosine and sine in thousandths) by image_id % 7; half the page's width, its margin, lines of text and characters in pixels.
TILTS = ((1000, 0), (999, 35), (998, -70), (995, 105), (999, -35), (998, 70), (995, -105))
PAGE_HALF, PAGE_LEAST, MARGIN, LINE, INK, CELL, COLUMNS = 110, 60, 11, 12, 5, 6, 33
#: Kinds by image_id % 4: a page on a dark ground, one on a ground whose right half is brighter than the page, one on a shaded ground, no page.
DARK, SPLIT, SHADED, BLANK = range(4)


def page_frames(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """image_id, text, kind, c, s (direction), half (half the page's height), height, width of a page for each text. The page grows with its text."""
    image, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    tilt = F.get(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in TILTS]), F.pmod(image, F.lit(7)).cast("int"))
    half = F.greatest(F.lit(PAGE_LEAST), F.lit(MARGIN + 1) + LINE // 2 * F.ceil(F.length(text) / COLUMNS)).cast("int")
    d = items.select(image.alias("image_id"), text.alias("text"), F.pmod(image, F.lit(4)).cast("int").alias("kind"), tilt["c"].alias("c"), tilt["s"].alias("s"), half.alias("half"))
    return d.withColumns({"height": F.expr(f"cast(2 * half + 60 + (2 * abs(s) * {PAGE_HALF}) div 1000 as int)"), "width": F.expr(f"cast({2 * PAGE_HALF + 80} + (2 * abs(s) * half) div 1000 as int)")})


def page_raster(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A drawn page for each text, whole: a tilted sheet about the middle of its ground, with the text's characters as dark cells in lines of COLUMNS. All in whole numbers."""
    # few rows become many, so their number says how to deal them, not their size
    f = page_frames(items, id_col, text_col).repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    px = f.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    px = px.withColumns({"u": F.expr("c * (2 * x - width + 1) + s * (2 * y - height + 1)"), "w": F.expr("c * (2 * y - height + 1) - s * (2 * x - width + 1)")})
    return px.select(*KEYS, F.expr(PAGE_VALUE.format(u="u", w="w", div="div")).cast("int").alias("v"))


#: Value of a pixel; {u} and {w}, its place along and across the page's lines in half thousandths of a pixel, from the middle of the page.
PAGE_VALUE = f"""case when kind = {BLANK} then 220
when abs({{u}}) > {2000 * PAGE_HALF} or abs({{w}}) > 2000 * half then case kind when {SPLIT} then case when 2 * x < width then 45 else 245 end when {SHADED} then 40 + x {{div}} 8 else 45 end
when {{u}} + {2000 * (PAGE_HALF - MARGIN)} >= 0 and {{u}} + {2000 * (PAGE_HALF - MARGIN)} < {2000 * CELL * COLUMNS} and {{w}} + 2000 * (half - {MARGIN + 1}) >= 0
  and ({{w}} + 2000 * (half - {MARGIN + 1})) % {2000 * LINE} < {2000 * INK}
  and substring(text, cast((({{w}} + 2000 * (half - {MARGIN + 1})) {{div}} {2000 * LINE}) * {COLUMNS} + ({{u}} + {2000 * (PAGE_HALF - MARGIN)}) {{div}} {2000 * CELL} + 1 as int), 1) > ' ' then 30
when kind = {SPLIT} then 150 else 235 end"""


def page_truth(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """page_frames with angle (degrees) and corners (top left, top right, bottom right, bottom left) of each page as drawn."""
    f = page_frames(items, id_col, text_col).where(F.col("kind") != BLANK)
    at = lambda a, b: F.struct(((F.col("width") - 1) / 2 + (F.col("c") * a - F.col("s") * b) / 1000).alias("x"), ((F.col("height") - 1) / 2 + (F.col("s") * a + F.col("c") * b) / 1000).alias("y"))
    h = F.col("half")
    corners = F.array(at(F.lit(-PAGE_HALF), -h), at(F.lit(PAGE_HALF), -h), at(F.lit(PAGE_HALF), h), at(F.lit(-PAGE_HALF), h))
    return f.withColumns({"angle": F.degrees(F.atan2(F.col("s").cast("double"), F.col("c").cast("double"))), "corners": corners})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn pages of all benchmark items."""
    return page_raster(read(spark, sf_dir, "benchmark"))


def dimensions(px: DataFrame) -> DataFrame:
    """image_id, height, width."""
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def clip8(e: Column) -> Column:
    """Rounded half up and held in 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e + 0.5))).cast("int")


def trunc8(e: Column) -> Column:
    """Cut down and held in 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e))).cast("int")
