"""Visual-quality metrics of rasters, a row for each image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.operators.components import components
from platen.operators.edges import auto_thresholds, canny, canny_lines
from platen.operators.histogram import otsu
from platen.operators.stencil import _index, erode, gaussian, laplacian_lines, median_lines, scanlines


def share(test) -> F.Column:
    return F.avg(test.cast("int"))


def tone(px: DataFrame) -> DataFrame:
    """brightness, contrast, dynamic_range, dark_clipped_ratio, bright_clipped_ratio, from the counts of an image's values."""
    h = px.groupBy("image_id", "v").agg(F.count("*").alias("k"))
    k, v = F.col("k"), F.col("v").cast("long")
    whole = lambda e: F.sum(e).cast("decimal(38,0)")
    p = F.percentile("v", F.array(F.lit(0.05), F.lit(0.95)), F.col("k"))
    part = lambda test: (F.sum(F.when(test, k).otherwise(0)) / F.sum(k))
    g = h.groupBy("image_id").agg((F.sum(k * v) / F.sum(k)).alias("brightness"), F.sqrt(_variance(whole(k), whole(k * v), whole(k * v * v))).alias("contrast"), p.alias("p"), part(v <= 5).alias("dark_clipped_ratio"), part(v >= 250).alias("bright_clipped_ratio"))
    return g.withColumn("dynamic_range", F.col("p")[1] - F.col("p")[0]).drop("p")


def _variance(n, s1, s2) -> F.Column:
    """Population variance from exact integer sums; one division, so every engine has the same value."""
    return (n * s2 - s1 * s1).cast("double") / (n.cast("double") * n)


def sharpness_lines(rows: DataFrame) -> DataFrame:
    """image_id, sharpness of scanlines (image_id, y, v): variance of the Laplacian, from sums that combine as pixels are made."""
    lap = F.col("lap").cast("long")
    g = laplacian_lines(rows).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(lap).alias("s1"), F.sum(lap * lap).alias("s2"))
    return g.select("image_id", _variance(*[F.col(c).cast("decimal(38,0)") for c in ("n", "s1", "s2")]).alias("sharpness"))


def sharpness(px: DataFrame) -> DataFrame:
    return sharpness_lines(as_lines(px))


def as_lines(px: DataFrame) -> DataFrame:
    """A raster as scanlines: image_id, y, v (array)."""
    return scanlines(px.select("image_id", "y", "x", "v")).select("image_id", "y", F.transform("__row", lambda s: s["v"]).alias("v"))


def noise_lines(rows: DataFrame) -> DataFrame:
    """image_id, noise, noise_p90, affected_ratio, impulse_ratio of scanlines: what a 3 x 3 median takes away. Only residuals become rows, and their counts are grouped."""
    each = median_lines(rows).select("image_id", F.abs(F.col("v") - F.col("med")).alias("d")).groupBy("image_id", "d").agg(F.count("*").alias("k"))
    ratio = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0)) / F.sum("k")
    return each.groupBy("image_id").agg((F.sum(F.col("d") * F.col("k")) / F.sum("k")).alias("noise"), F.percentile("d", 0.9, F.col("k")).alias("noise_p90"), ratio(F.col("d") >= 5).alias("affected_ratio"), ratio(F.col("d") >= 100).alias("impulse_ratio"))


def noise(px: DataFrame) -> DataFrame:
    return noise_lines(as_lines(px))


def along_lines(line: F.Column, weights: F.Column) -> F.Column:
    """The convolution of an array with an array of weights (odd in number, a column of its own), mirrored at both ends."""
    r = F.expr("cast((size(__w) - 1) div 2 as int)")
    n = F.size(line)
    outside = lambda a, b: F.transform(F.sequence(a, b), lambda i: F.get(line, _index(i, n, "reflect101")))
    whole = F.concat(outside(-r, F.lit(-1)), line, outside(n, n + r - 1))
    at = lambda i: F.aggregate(F.zip_with(F.slice(whole, i + 1, F.size(weights)), weights, lambda a, w: a * w), F.lit(0.0), lambda s, a: s + a)
    return F.transform(line, lambda _, i: at(i))


def illumination(px: DataFrame) -> DataFrame:
    return illumination_lines(as_lines(px))


def illumination_lines(rows: DataFrame) -> DataFrame:
    """image_id, illumination_variation of scanlines (image_id, y, v: array): variation of the blurred image. sigma is max(shortest side / 30, 3).

    Each image carries its own weights as an array, so images of all sizes go through one plan: lines are blurred, turned into
    columns, and these are blurred.
    """
    sigma = F.greatest(F.lit(90), F.least(F.count("*"), F.max(F.size("v")))) / 30
    own = rows.groupBy("image_id").agg(sigma.alias("sigma")).withColumn("r", F.expr("cast((floor(6 * sigma + 1.5) + 1 - floor(6 * sigma + 1.5) % 2) div 2 as int)"))
    own = own.withColumn("raw", F.transform(F.sequence(-F.col("r"), F.col("r")), lambda i: F.exp(-(i * i) / (2 * F.col("sigma") * F.col("sigma")))))
    own = own.select("image_id", F.transform("raw", lambda w: w / F.aggregate("raw", F.lit(0.0), lambda s, a: s + a)).alias("__w"))
    w = F.col("__w")
    level = rows.join(own, "image_id").select("image_id", "y", along_lines(F.col("v"), w).alias("v"))
    columns = level.select("image_id", "y", F.posexplode("v").alias("x", "v")).groupBy("image_id", "x").agg(F.sort_array(F.collect_list(F.struct("y", "v"))).alias("c"))
    out = columns.join(own, "image_id").withColumn("c", F.col("c.v")).select("image_id", F.explode(along_lines(F.col("c"), w)).alias("g"))
    g = out.groupBy("image_id").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("s"))
    return g.select("image_id", F.when(F.col("m") <= 1e-6, 0.0).otherwise(F.col("s") / F.col("m")).alias("illumination_variation"))


def bleed_through(px: DataFrame, ksize: int = 31) -> DataFrame:
    d = F.round(F.abs(F.col("v") - F.col("g")), 9)
    g = gaussian(px, ksize).withColumn("d", d).groupBy("image_id").agg(share((F.col("d") >= 4) & (F.col("d") <= 18)).alias("weak_structure_ratio"), share(F.col("d") > 18).alias("strong_structure_ratio"))
    return g.withColumn("weak_to_strong_ratio", F.col("weak_structure_ratio") / F.greatest("strong_structure_ratio", F.lit(1e-6)))


def edge_density(px: DataFrame) -> DataFrame:
    edges = canny(auto_thresholds(px), "lo", "hi").groupBy("image_id").agg(F.count("*").alias("e"))
    size = px.groupBy("image_id").agg(F.count("*").alias("n"))
    return size.join(edges, "image_id", "left").select("image_id", (F.coalesce("e", F.lit(0)) / F.col("n")).alias("edge_density"))


def edge_density_lines(rows: DataFrame) -> DataFrame:
    """`edge_density` of scanlines (image_id, y, v: array)."""
    edges = canny_lines(rows).groupBy("image_id").agg(F.count("*").alias("e"))
    size = rows.groupBy("image_id").agg(F.sum(F.size("v")).alias("n"))
    return size.join(edges, "image_id", "left").select("image_id", (F.coalesce("e", F.lit(0)) / F.col("n")).alias("edge_density"))


def structural(px: DataFrame) -> DataFrame:
    """Ink components of the blurred, thresholded image: counts, areas, foreground and thin ratios."""
    smooth = gaussian(px, 3).select("image_id", "y", "x", F.floor(F.round("g", 6) + 0.5).cast("int").alias("v"))
    ink = otsu(smooth, inverse=True)
    parts = components(ink.where("v > 0")).groupBy("image_id").agg(F.count("*").alias("component_count"), share(F.col("area") <= 6).alias("small_component_ratio"), F.avg("area").alias("mean_component_area"), F.percentile("area", 0.5).alias("median_component_area"))
    thin = erode(ink, 3, out="core").groupBy("image_id").agg(share(F.col("v") > 0).alias("foreground_ratio"), F.sum((F.col("v") > 0).cast("int")).alias("fg"), F.sum((F.col("core") > 0).cast("int")).alias("core"))
    thin = thin.select("image_id", "foreground_ratio", F.when(F.col("fg") > 0, 1 - F.col("core") / F.col("fg")).otherwise(0.0).alias("thin_structure_ratio"))
    zero = {c: 0 for c in ("component_count", "small_component_ratio", "mean_component_area", "median_component_area")}
    return thin.join(parts, "image_id", "left").fillna(zero)


def all_metrics(px: DataFrame, heavy: bool = True) -> DataFrame:
    """Every metric in one wide row an image. Each part is grouped by image_id, by which px is partitioned."""
    px = px.repartition("image_id")
    out = tone(px)
    for part in (sharpness, noise, illumination, *((edge_density, structural, bleed_through) if heavy else ())):
        out = out.join(part(px), "image_id")
    return out
