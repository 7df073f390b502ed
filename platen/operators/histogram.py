"""Histogram operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.operators.stencil import scanlines
from platen.sources.rasters import KEYS, clip8, trunc8


def histogram(px: DataFrame, *by: str) -> DataFrame:
    return px.groupBy("image_id", *by, "v").agg(F.count("*").alias("n"))


def apply_lut(px: DataFrame, lut: DataFrame) -> DataFrame:
    """px with v replaced through lut (image_id, v, out); a value without an entry stays. An image's table is one array, so pixels are neither dealt nor sorted by value."""
    entries = lut.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "out"))).alias("__m"))
    table = entries.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.try_element_at("__m", i)).alias("__lut"))
    return px.join(table.hint("shuffle_hash"), "image_id", "left").select(*KEYS, F.coalesce(F.get("__lut", F.col("v")), F.col("v")).alias("v"))


def hist_equalize(px: DataFrame) -> DataFrame:
    """Look-up table from the cumulative histogram; an image of one value stays as it is."""
    up = Window.partitionBy("image_id").orderBy("v")
    all_ = Window.partitionBy("image_id")
    cum = histogram(px).withColumn("c", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumns({"total": F.sum("n").over(all_), "low": F.min("c").over(all_)})
    out = F.when(F.col("total") == F.col("low"), F.col("v")).otherwise(clip8((F.col("c") - F.col("low")) / (F.col("total") - F.col("low")) * 255))
    return apply_lut(px, cum.select("image_id", "v", out.alias("out")))


def otsu_threshold(px: DataFrame, value: str = "v") -> DataFrame:
    """image_id, t: the least threshold of the greatest between-class variance (classes v <= t and v > t)."""
    up = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("image_id")
    h = px.groupBy("image_id", F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    h = h.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("v")).over(up), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("v")).over(all_)})
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    score = F.when(w1 > 0, F.round(F.col("w0") * w1 * gap * gap, 3)).otherwise(-1.0)
    return h.withColumn("score", score).groupBy("image_id").agg(F.min_by("v", F.struct(-F.col("score"), "v")).alias("t"))


def otsu(px: DataFrame, inverse: bool = False) -> DataFrame:
    on, off = (0, 255) if inverse else (255, 0)
    return px.join(otsu_threshold(px).hint("shuffle_hash"), "image_id").select(*KEYS, F.when(F.col("v") > F.col("t"), on).otherwise(off).alias("v"))


def _tiled(rows: DataFrame, clip_limit: float, tile_grid_size: int) -> DataFrame:
    """Scanlines (image_id, y, v: array, ...) with what `_equalized` reads: their place among their image's tiles, and the image's tables.

    A tile keeps a bit for each value that it has, in four words (bits), how many values lie below each word (base), and the running sums of the
    values' clipped counts, from 0 on (cum). So it takes little more room than its pixels, and an entry of its table is found by counting bits,
    not by going through its values.
    """
    dims = rows.groupBy("image_id").agg((F.max("y") + 1).alias("height"), F.max(F.size("v")).alias("width"))
    th, tw = (F.ceil(F.col(d) / tile_grid_size).cast("int") for d in ("height", "width"))
    last = lambda d, t: F.floor((F.col(d) - 1) / F.col(t)).cast("int")
    dims = dims.select("image_id", th.alias("th"), tw.alias("tw"), "height", "width").select("image_id", "th", "tw", last("height", "th").alias("my"), last("width", "tw").alias("mx"))
    sized = rows.join(dims.hint("shuffle_hash"), "image_id")
    keys = ["image_id", "ty", "tx"]
    each = sized.select("image_id", F.expr("cast(y div th as int)").alias("ty"), "tw", F.posexplode("v").alias("x", "v"))
    hist = each.groupBy("image_id", "ty", F.expr("cast(x div tw as int)").alias("tx"), "v").agg(F.count("*").cast("int").alias("n"))
    words = [F.coalesce(F.bit_or(F.when(F.expr("v div 64") == w, F.expr("shiftleft(1L, v % 64)"))), F.lit(0).cast("long")) for w in range(4)]
    limit = F.greatest(F.lit(1.0), F.floor(F.lit(float(clip_limit)) * F.sum("n") / 256)).cast("int")
    tiles = hist.groupBy(*keys).agg(F.sum("n").cast("int").alias("area"), limit.alias("limit"), F.array(*words).alias("bits"), F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"))
    sums = F.aggregate("h", F.array(F.lit(0)), lambda s, e: F.concat(s, F.array(F.element_at(s, -1) + F.least(e["n"], F.col("limit")))))
    # of a small tile each value counts once
    tiles = tiles.withColumn("cum", F.when(F.col("limit") == 1, F.sequence(F.lit(0), F.size("h"))).otherwise(sums))
    below = [F.lit(0)]
    for w in range(3):
        below.append(below[-1] + F.bit_count(F.get("bits", F.lit(w))))
    one = F.struct("ty", "tx", F.col("area").cast("double").alias("area"), ((F.col("area") - F.element_at("cum", -1)) / 256).alias("more"), "bits", F.array(*below).alias("base"), "cum")
    # an image's tiles are one row, at most tile_grid_size ** 2 of them; a pixel lies between the middles of four
    tiles = tiles.groupBy("image_id").agg(F.sort_array(F.collect_list(one)).alias("tiles"))
    at = sized.join(tiles.hint("merge"), "image_id")
    at = at.withColumn("fy", (F.col("y") + 0.5) / F.col("th") - 0.5).withColumn("py", F.col("fy") - F.floor("fy"))
    return at.withColumns({f"r{d}": _held(F.floor("fy") + d, "my") * (F.col("mx") + 1) for d in (0, 1)})


def _held(e: Column, most: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(most), e.cast("int")))


def _whole(e: Column) -> Column:
    """e rounded to 6 places, then half up to a whole number; plain arithmetic, since rounding by decimals costs more than all else that a pixel needs."""
    return F.floor(F.floor(e * 1000000 + 0.5) / 1000000 + 0.5)


def _place(x: Column) -> Column:
    """Columns of tiles on both sides of the place x of a line of `_tiled`, and how far it is between their middles."""
    f = (x + 0.5) / F.col("tw") - 0.5
    return F.struct(_held(F.floor(f), "mx").alias("a"), _held(F.floor(f) + 1, "mx").alias("b"), (f - F.floor(f)).alias("q"))


def _equalized(v: Column, c: Column) -> Column:
    """What v becomes at place c of a line of `_tiled`."""
    word = F.floor(v / 64).cast("int")
    below = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - v % 64)

    def entry(row: str, side: str) -> Column:
        t = F.get("tiles", F.col(row) + c[side])
        total = F.get(t["cum"], F.get(t["base"], word) + F.bit_count(F.get(t["bits"], word).bitwiseAND(below))) + (v + 1) * t["more"]
        return F.least(F.lit(255.0), _whole(total * 255 / t["area"]))

    py, q = F.col("py"), c["q"]
    total = (1 - py) * (1 - q) * entry("r0", "a") + (1 - py) * q * entry("r0", "b") + py * (1 - q) * entry("r1", "a") + py * q * entry("r1", "b")
    return F.greatest(F.lit(0), F.least(F.lit(255), _whole(total))).cast("int")


def clahe_lines(rows: DataFrame, clip_limit: float = 1.5, tile_grid_size: int = 8) -> DataFrame:
    """Contrast-limited equalisation of scanlines (image_id, y, v: array; other columns pass through): clipped histograms of grid tiles, bilinear between the
    four nearest tiles' tables. Lines, not pixels, meet their image's tiles."""
    rest = [c for c in rows.columns if c not in ("image_id", "y", "v")]
    at = _tiled(rows, clip_limit, tile_grid_size).withColumn("__c", F.transform("v", lambda _, x: _place(x)))
    return at.select("image_id", "y", F.transform("v", lambda v, x: _equalized(v, F.get("__c", x))).alias("v"), *rest)


def clahe_pixels(rows: DataFrame, clip_limit: float = 1.5, tile_grid_size: int = 8) -> DataFrame:
    """`clahe_lines` as pixels (KEYS, v), which are worked out in compiled code."""
    at = _tiled(rows.select("image_id", "y", "v"), clip_limit, tile_grid_size)
    each = at.select(*[c for c in at.columns if c != "v"], F.posexplode_outer("v").alias("x", "v")).withColumn("c", _place(F.col("x")))
    return each.select(*KEYS, _equalized(F.col("v"), F.col("c")).alias("v"))


def clahe(px: DataFrame, clip_limit: float = 1.5, tile_grid_size: int = 8) -> DataFrame:
    """`clahe_lines` of pixels."""
    rows = scanlines(px.select(*KEYS, "v")).select("image_id", "y", F.transform("__row", lambda s: s["v"]).alias("v"))
    return clahe_pixels(rows, clip_limit, tile_grid_size)


def gamma_correct(px: DataFrame, gamma: float = 1.0) -> DataFrame:
    """v through ((v/255)^gamma) * 255, cut down."""
    if gamma <= 0:
        raise ValueError("gamma has to be above 0")
    return px.withColumn("v", _gamma(F.col("v"), gamma))


def gamma_lines(rows: DataFrame, gamma: float = 1.0) -> DataFrame:
    """`gamma_correct` of scanlines (image_id, y, v: array)."""
    if gamma <= 0:
        raise ValueError("gamma has to be above 0")
    return rows.withColumn("v", F.transform("v", lambda v: _gamma(v, gamma)))


def _gamma(v: Column, gamma: float) -> Column:
    return trunc8(F.round(F.pow(v / 255, F.lit(float(gamma))) * 255, 9))


def faded_text(px: DataFrame, clip_limit: float = 1.4, gamma: float = 0.95) -> DataFrame:
    return clahe(gamma_correct(px, gamma), clip_limit)


def faded_text_pixels(rows: DataFrame, clip_limit: float = 1.4, gamma: float = 0.95) -> DataFrame:
    """`faded_text` of scanlines (image_id, y, v: array), as pixels."""
    return clahe_pixels(gamma_lines(rows, gamma), clip_limit)


def faded_text_lines(rows: DataFrame, clip_limit: float = 1.4, gamma: float = 0.95) -> DataFrame:
    """`faded_text` of scanlines (image_id, y, v: array)."""
    return clahe_lines(rows.withColumn("v", F.transform("v", lambda v: _gamma(v, gamma))), clip_limit)


def intensity_adjust(px: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    if alpha <= 0 or not -100 <= beta <= 100:
        raise ValueError("alpha has to be above 0 and beta in -100..100")
    return px.withColumn("v", _intensity(F.col("v"), alpha, beta))


def intensity_lines(rows: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """`intensity_adjust` of scanlines (image_id, y, v: array)."""
    if alpha <= 0 or not -100 <= beta <= 100:
        raise ValueError("alpha has to be above 0 and beta in -100..100")
    return rows.withColumn("v", F.transform("v", lambda v: _intensity(v, alpha, beta)))


def _intensity(v: Column, alpha: float, beta: float) -> Column:
    return clip8(F.abs(F.round(v * alpha + beta, 9)))


def global_threshold(px: DataFrame, threshold: int = 127) -> DataFrame:
    if not 0 <= threshold <= 255:
        raise ValueError("threshold has to be in 0..255")
    return px.withColumn("v", F.when(F.col("v") > threshold, 255).otherwise(0))


def threshold_lines(rows: DataFrame, threshold: int = 127) -> DataFrame:
    """`global_threshold` of scanlines (image_id, y, v: array)."""
    if not 0 <= threshold <= 255:
        raise ValueError("threshold has to be in 0..255")
    return rows.withColumn("v", F.transform("v", lambda v: F.when(v > threshold, 255).otherwise(0)))


def normalize(px: DataFrame) -> DataFrame:
    """Each image stretched to 0..255; a flat one becomes 0."""
    ext = px.groupBy("image_id").agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    out = F.when(F.col("__hi") > F.col("__lo"), clip8((F.col("v") - F.col("__lo")) * 255.0 / (F.col("__hi") - F.col("__lo")))).otherwise(0)
    return px.join(ext.hint("shuffle_hash"), "image_id").withColumn("v", out).select(*px.columns)


def to_gray(bands: DataFrame) -> DataFrame:
    """Luma of (b, g, r); an alpha band is left out."""
    return bands.select(*KEYS, F.floor(F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), 6) + 0.5).cast("int").alias("v"))


#: sRGB to CIE XYZ (D65 white), and the white point that scales X and Z.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
_WHITE = (0.950456, 1.0, 1.088754)


def _lab(b, g, r) -> tuple:
    """L in 0..255, a and b of CIE LAB of 8-bit sRGB bands."""
    linear = lambda c: F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255 / 12.92)
    rgb = [linear(c) for c in (r, g, b)]
    x, y, z = (sum(k * c for k, c in zip(row, rgb, strict=True)) / w for row, w in zip(_XYZ, _WHITE, strict=True))
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return clip8(F.round(light * 255 / 100, 6)), clip8(F.round(500 * (root(x) - root(y)) + 128, 6)), clip8(F.round(200 * (root(y) - root(z)) + 128, 6))


def _bgr(light, a, b) -> tuple:
    """8-bit bands of LAB as _lab gives it."""
    level = light * 100 / 255
    fy = F.when(level > 7.9996, (level + 16) / 116).otherwise(7.787 * (level / 903.3) + 16 / 116)
    y = F.when(level > 7.9996, F.pow(fy, F.lit(3.0))).otherwise(level / 903.3)
    cube = lambda f: F.when(f > 0.206893, F.pow(f, F.lit(3.0))).otherwise((f - 16 / 116) / 7.787)
    xyz = (cube(fy + (a - 128) / 500) * _WHITE[0], y, cube(fy - (b - 128) / 200) * _WHITE[2])
    rgb = [sum(k * c for k, c in zip(row, xyz, strict=True)) for row in _RGB]
    shown = lambda c: F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)
    red, green, blue = (clip8(F.round(shown(c) * 255, 6)) for c in rgb)
    return blue, green, red


def on_luminance(bands: DataFrame, treat: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """bands (KEYS, b, g, r; other columns, an alpha band for one, pass through) with the lightness of LAB treated as a raster of its own.

    `treat` takes and returns rows (KEYS, v). A treatment that changes the size has no place here.
    """
    light, a, b = _lab(F.col("b"), F.col("g"), F.col("r"))
    rest = [c for c in bands.columns if c not in (*KEYS, "b", "g", "r")]
    lab = bands.select(*KEYS, *rest, light.alias("__l"), a.alias("__a"), b.alias("__b"))
    treated = treat(lab.select(*KEYS, F.col("__l").alias("v"))).select(*KEYS, F.col("v").alias("__l"))
    blue, green, red = _bgr(F.col("__l"), F.col("__a"), F.col("__b"))
    return lab.drop("__l").join(treated, KEYS).select(*KEYS, blue.alias("b"), green.alias("g"), red.alias("r"), *rest)
