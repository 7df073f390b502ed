"""Neighbourhood operators.

A scanline is one row (image_id, y, array of values), so an image has as many rows as lines, not pixels. Neighbours along x are
places in the array, padded at both ends, and neighbours along y come from a window over a band of the image's lines; a raster that
is partitioned by image takes no further shuffle, and pixels become rows again only where a caller needs them, in compiled code.
Borders: reflect101 (the edge pixel is the mirror), replicate, or ignore (null outside). Images are full rectangles from (0, 0) on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.groups import dealt, starts, whole_groups
from platen.sources.rasters import KEYS, clip8, trunc8


#: Rows of a band.
BAND = 1024


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("int")


def _index(i: Column, n: Column, border: str) -> Column:
    """The place in 0..n-1 that stands for place i; outside stays outside where borders are ignored."""
    if border == "reflect101":
        m = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
        i = F.when(n == 1, 0).when(m < n, m).otherwise(2 * (n - 1) - m)
    elif border == "replicate":
        i = F.greatest(F.lit(0), F.least(n - 1, i))
    return i.cast("int")


def padded(line: Column, r: int, border: str) -> Column:
    """An array with r places more at both ends."""
    n = F.size(line)
    part = lambda a, b: F.transform(F.sequence(a, b), lambda i: F.get(line, _index(i, n, border)))
    return F.concat(part(F.lit(-r), F.lit(-1)), line, part(n, n + r - 1)) if r else line


def around(rows: DataFrame, line: Column, r: int, border: str, by: tuple[str, ...] = ("image_id",), band: int = BAND) -> DataFrame:
    """rows (by, y from 0 on, ...) with __near: `line` of the 2 r + 1 rows around each, in order (null where there is none).

    An image is cut into bands of `band` rows. The r rows on both sides of a band go along with it and are dropped afterwards, so
    no window holds more than band + 2 r rows, however high the image.
    """
    return unbanded(near(banded(rows, r, by, band).withColumn("__v0", line), "__v0", r, border, by).drop("__v0"))


def banded(rows: DataFrame, halo: int, by: tuple[str, ...] = ("image_id",), band: int = BAND) -> DataFrame:
    """rows in bands (__b) of `band` rows and the `halo` rows on both sides, which serve a chain of `near` that reaches as far in all."""
    y = F.col("y")
    rows = rows.withColumn("__b", F.explode(F.sequence(_div(F.greatest(y - halo, F.lit(0)), band), _div(y + halo, band))))
    # a band whose last row is below the halo's end holds the image's last row
    all_ = Window.partitionBy(*by, "__b").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"__h": F.max("y").over(all_) + 1, "__t": F.greatest(F.lit(0), F.col("__b") * band - halo), "__own": F.col("__b") == _div(y, band)})


def near(rows: DataFrame, line: str, r: int, border: str, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Banded rows with __near: the array `line` of the 2 r + 1 rows around each, in order. All steps of a chain share one dealing and one order of rows.

    Rows of the halo lack neighbours, so what they get is no result; it reaches no row of the band while the chain stays within the halo.
    """
    y = F.col("y")
    rows = rows.withColumn("__w", F.collect_list(line).over(Window.partitionBy(*by, "__b").orderBy("y").rowsBetween(-r, r)))
    first = F.greatest(F.col("__t"), y - r)
    at = lambda d: F.get("__w", (_index(y + d, F.col("__h"), border) - first).cast("int"))
    held = (lambda d: at(d)) if border == "ignore" else (lambda d: F.coalesce(at(d), F.col(line)))
    return rows.withColumn("__near", F.array(*[held(d) for d in range(-r, r + 1)])).drop("__w")


def unbanded(rows: DataFrame) -> DataFrame:
    """The rows of the bands themselves."""
    return rows.where("__own").drop("__b", "__h", "__t", "__own")


def scanlines(px: DataFrame) -> DataFrame:
    """image_id, y, __row: the line's pixels (x and the other columns) in order of x."""
    rest = [c for c in px.columns if c not in ("image_id", "y", "x")]
    return px.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *rest))).alias("__row"))


def _each(rows: DataFrame, px: DataFrame, out: str, of: Callable[[Column], Column]) -> DataFrame:
    """Pixels of scanlines with `out`, of(i) of the pixel at place i."""
    rest = [c for c in px.columns if c not in (*KEYS, out)]
    one = rows.select("*", F.posexplode("__row").alias("__i", "__s"))
    return one.select("image_id", "y", "__s.x", *[F.col(f"__s.{c}").alias(c) for c in rest], of(F.col("__i")).alias(out))


def _stencil(px: DataFrame, r: int, border: str, value: str, out: str, of: Callable[[Callable[[int], Column], Column], Column]) -> DataFrame:
    """Adds `out`: of(line, i), where line(d) is the padded line d below and its place i + r is the pixel's own."""
    rows = scanlines(px).withColumn("__v", F.transform("__row", lambda s: s[value]))
    none = F.array_repeat(F.get("__v", F.lit(-1)), F.size("__v") + 2 * r)
    rows = around(rows, padded(F.col("__v"), r, border), r, border)
    line = (lambda d: F.coalesce(F.col("__near")[d + r], none)) if border == "ignore" else (lambda d: F.col("__near")[d + r])
    return _each(rows.withColumns({f"__l{d + r}": line(d) for d in range(-r, r + 1)}).drop("__near"), px, out, lambda i: of(lambda d: F.col(f"__l{d + r}"), i))


def neighbours(px: DataFrame, r: int = 1, border: str = "reflect101", value: str = "v", out: str = "n") -> DataFrame:
    """Adds `out`: the (2r+1)^2 values around each pixel, row by row."""
    return _stencil(px, r, border, value, out, lambda line, i: F.concat(*[F.slice(line(d), i + 1, 2 * r + 1) for d in range(-r, r + 1)]))


def gaussian_kernel(ksize: int = 0, sigma: float = 0.0) -> list[float]:
    """Weights; sigma from the size, or the size from sigma, where one isn't given."""
    if ksize <= 0:
        ksize = math.floor(6 * sigma + 1 + 0.5) | 1
    if sigma <= 0:
        sigma = 0.3 * ((ksize - 1) / 2 - 1) + 0.8
    w = [math.exp(-((i - (ksize - 1) / 2) ** 2) / (2 * sigma**2)) for i in range(ksize)]
    return [x / sum(w) for x in w]


def blurred_lines(rows: DataFrame, line: str, kernel: list[float], border: str, out: str, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """rows (by, y, array `line`, ...) with array `out`: the separable convolution with `kernel` along both axes."""
    r = len(kernel) // 2
    weights = F.array(*[F.lit(w) for w in kernel])
    weighed = lambda part: F.aggregate(F.zip_with(part, weights, lambda a, w: a * w), F.lit(0.0), lambda s, a: s + a)
    rows = rows.withColumn("__p", padded(F.col(line), r, border)).withColumn("__p", F.transform(line, lambda _, i: weighed(F.slice("__p", i + 1, 2 * r + 1))))
    rows = around(rows, F.col("__p"), r, border, by)
    pairs = F.arrays_zip(F.col("__near").alias("l"), weights.alias("w"))
    total = F.aggregate(pairs, F.transform("__p", lambda _: F.lit(0.0)), lambda s, p: F.zip_with(s, p["l"], lambda a, b: a + b * p["w"]))
    return rows.withColumn(out, total).drop("__near", "__p")


def convolve(px: DataFrame, kernel: list[float], border: str = "reflect101", value: str = "v", out: str = "g") -> DataFrame:
    """Adds `out`: the separable convolution with `kernel` along both axes. A small one is written out for each pixel, so that it is compiled."""
    if len(kernel) <= 5:
        r = len(kernel) // 2
        down = lambda line, at: sum(F.get(line(d), at) * kernel[d + r] for d in range(-r, r + 1))
        return _stencil(px, r, border, value, out, lambda line, i: sum(down(line, i + j) * kernel[j] for j in range(2 * r + 1)))
    rows = scanlines(px).withColumn("__v", F.transform("__row", lambda s: s[value]))
    return _each(blurred_lines(rows, "__v", kernel, border, "__g"), px, out, lambda i: F.get("__g", i))


def gaussian(px: DataFrame, ksize: int = 0, sigma: float = 0.0, border: str = "reflect101", value: str = "v", out: str = "g") -> DataFrame:
    return convolve(px, gaussian_kernel(ksize, sigma), border, value, out)


def _laplace(line, i: Column) -> Column:
    at = lambda d, k: F.get(line(d), i + k)
    return at(-1, 1) + at(0, 0) + at(0, 2) + at(1, 1) - 4 * at(0, 1)


def laplacian(px: DataFrame, value: str = "v", out: str = "lap") -> DataFrame:
    return _stencil(px, 1, "reflect101", value, out, _laplace)


def _middle(line, i: Column, r: int) -> Column:
    """Median of the square. Of 3 x 3 by compare and exchange: the middle of the greatest low, the middle middle and the least high of three sorted columns."""
    k = 2 * r + 1
    if k != 3:
        return F.get(F.sort_array(F.concat(*[F.slice(line(d), i + 1, k) for d in range(-r, r + 1)])), F.lit(k * k // 2))
    three = lambda a, b, c: (F.least(a, b, c), a + b + c - F.least(a, b, c) - F.greatest(a, b, c), F.greatest(a, b, c))
    columns = [three(*[F.get(line(d), i + j) for d in (-1, 0, 1)]) for j in range(3)]
    low, middle, high = zip(*columns, strict=True)
    return three(F.greatest(*low), three(*middle)[1], F.least(*high))[1]


def median_denoise(px: DataFrame, kernel_size: int = 3, value: str = "v", out: str = "v") -> DataFrame:
    """Median of the square neighbourhood, borders replicated."""
    r = kernel_size // 2
    return _stencil(px, r, "replicate", value, out, lambda line, i: _middle(line, i, r))


def line_pixels(rows: DataFrame, r: int, border: str, out: str, of) -> DataFrame:
    """Pixels (KEYS, v) of scanlines (image_id, y, v: array) with `out`, of(line, i) as in _stencil; made for what is grouped at once."""
    near = around(rows, padded(F.col("v"), r, border), r, border)
    near = near.select("image_id", "y", *[F.get("__near", F.lit(d + r)).alias(f"__l{d + r}") for d in range(-r, r + 1)], F.posexplode("v").alias("x", "v"))
    return near.select(*KEYS, "v", of(lambda d: F.col(f"__l{d + r}"), F.col("x")).alias(out))


def laplacian_lines(rows: DataFrame) -> DataFrame:
    """Pixels of scanlines with lap."""
    return line_pixels(rows, 1, "reflect101", "lap", _laplace)


def median_lines(rows: DataFrame, kernel_size: int = 3) -> DataFrame:
    """Pixels of scanlines with med."""
    r = kernel_size // 2
    return line_pixels(rows, r, "replicate", "med", lambda line, i: _middle(line, i, r))


def sharpen(px: DataFrame, amount: float = 0.5, sigma: float = 1.0) -> DataFrame:
    return gaussian(px, 0, sigma).withColumn("v", clip8((1 + amount) * F.col("v") - amount * F.col("g"))).drop("g")


def adaptive_threshold(px: DataFrame, block_size: int = 35, c: float = 11) -> DataFrame:
    g = gaussian(px, block_size, 0.0, "replicate")
    return g.withColumn("v", F.when(F.col("v") > F.floor(F.col("g") + 0.5) - c, 255).otherwise(0)).drop("g")


def _halves(k: int, shape: str) -> list[int]:
    """How far the element of size k reaches to both sides, for each of its rows."""
    r = k // 2
    if shape == "rect" or not r:
        return [r] * (2 * r + 1)
    return [math.floor(r * math.sqrt((r * r - dy * dy) / (r * r)) + 0.5) for dy in range(-r, r + 1)]


def _running(line: Column, half: int, pick) -> Column:
    """The extreme of the places up to `half` to both sides; spans double until they suffice, so a place costs as many steps as half has bits."""
    if not half:
        return line
    n, k, width = F.size(line), 2 * half + 1, 1
    none = F.array_repeat(F.get(line, F.lit(-1)), half)
    best = F.concat(none, line, none)
    while width < k:
        step = min(width, k - width)
        best = F.zip_with(best, F.slice(best, step + 1, n + 2 * half), lambda a, b: pick(a, b))
        width += step
    return F.slice(best, 1, n)


#: Steps of a chain of extremes.
ERODE, DILATE = F.least, F.greatest


def _pairwise(pick: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """pick of two arrays, place by place."""
    return lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y))


def extreme_lines(rows: DataFrame, steps: tuple, k: int = 3, shape: str = "rect", value: str = "v", out: str = "v") -> DataFrame:
    """Scanlines (image_id, y, array `value`, ...) with array `out`, after `steps` (ERODE, DILATE) one upon the other.

    Extremes run along x, then along y: once where all rows of the element reach as far, else over the element's rows. Lines stay
    lines between steps, so a chain deals and orders an image's lines once.
    """
    r, halves = k // 2, _halves(k, shape)
    rows = banded(rows, r * len(steps)).withColumn("__e", F.col(value))
    for pick in steps:
        if len(set(halves)) == 1:
            rows = near(rows.withColumn("__e", _running(F.col("__e"), halves[0], pick)), "__e", r, "ignore")
            lines = F.col("__near")
        else:
            rows = near(rows, "__e", r, "ignore")
            lines = F.array(*[_running(F.get("__near", F.lit(d)), halves[d], pick) for d in range(2 * r + 1)])
        rows = rows.withColumn("__f", F.filter(lines, lambda one: one.isNotNull()))
        rows = rows.withColumn("__e", F.aggregate("__f", F.get("__f", F.lit(0)), _pairwise(pick))).drop("__near", "__f")
    return unbanded(rows).withColumn(out, F.col("__e")).drop("__e")


def _extreme(px: DataFrame, steps: tuple, k: int, shape: str, value: str, out: str) -> DataFrame:
    rows = scanlines(px).withColumn("__v", F.col(f"__row.{value}"))
    return _each(extreme_lines(rows, steps, k, shape, "__v", "__o"), px, out, lambda i: F.get("__o", i)) if steps else px.withColumn(out, F.col(value))


def line_values(rows: DataFrame) -> DataFrame:
    """Pixels (KEYS, v) of scanlines (image_id, y, v: array, not empty).

    Of the inner form Spark would work out each array once more, below, to see whether it is empty.
    """
    return rows.select("image_id", "y", F.posexplode_outer("v").alias("x", "v"))


def erode(px: DataFrame, k: int = 3, shape: str = "rect", iterations: int = 1, value: str = "v", out: str = "v") -> DataFrame:
    return _extreme(px, (ERODE,) * iterations, k, shape, value, out)


def dilate(px: DataFrame, k: int = 3, shape: str = "rect", iterations: int = 1, value: str = "v", out: str = "v") -> DataFrame:
    return _extreme(px, (DILATE,) * iterations, k, shape, value, out)


def morph_open(px: DataFrame, kernel_size: int = 3, shape: str = "rect") -> DataFrame:
    return _extreme(px, (ERODE, DILATE), kernel_size, shape, "v", "v")


def morph_close(px: DataFrame, kernel_size: int = 3, shape: str = "rect") -> DataFrame:
    return _extreme(px, (DILATE, ERODE), kernel_size, shape, "v", "v")


def top_hat(px: DataFrame, kernel_size: int = 3) -> DataFrame:
    """What opening takes away. The opened value rides along with the pixel, so no join is needed."""
    opened = _extreme(px, (ERODE, DILATE), kernel_size, "ellipse", "v", "__o")
    return opened.withColumn("v", F.greatest(F.lit(0), F.col("v") - F.col("__o"))).drop("__o")


def top_hat_lines(rows: DataFrame, kernel_size: int = 3) -> DataFrame:
    """`top_hat` of scanlines (image_id, y, v: array)."""
    opened = extreme_lines(rows, (ERODE, DILATE), kernel_size, "ellipse", "v", "__o")
    return opened.withColumn("v", F.zip_with("v", "__o", lambda a, b: F.greatest(F.lit(0), a - b))).drop("__o")


def open_lines(rows: DataFrame, kernel_size: int = 3, shape: str = "rect") -> DataFrame:
    """`morph_open` of scanlines (image_id, y, v: array)."""
    return extreme_lines(rows, (ERODE, DILATE), kernel_size, shape)


def close_lines(rows: DataFrame, kernel_size: int = 3, shape: str = "rect") -> DataFrame:
    """`morph_close` of scanlines (image_id, y, v: array)."""
    return extreme_lines(rows, (DILATE, ERODE), kernel_size, shape)


def black_hat_lines(rows: DataFrame, kernel_size: int = 5) -> DataFrame:
    """`black_hat` of scanlines (image_id, y, v: array)."""
    closed = extreme_lines(rows, (DILATE, ERODE), kernel_size, "ellipse", "v", "__o")
    return closed.withColumn("v", F.zip_with("v", "__o", lambda a, b: F.greatest(F.lit(0), b - a))).drop("__o")


def black_hat(px: DataFrame, kernel_size: int = 5) -> DataFrame:
    """What closing adds."""
    closed = _extreme(px, (DILATE, ERODE), kernel_size, "ellipse", "v", "__o")
    return closed.withColumn("v", F.greatest(F.lit(0), F.col("__o") - F.col("v"))).drop("__o")


def _median_array(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Rows with __near of 3 padded lines and array `out`: the 3 x 3 median as in _middle, but each step an array, so that nothing is worked out twice for a place."""
    least, greatest, plus, minus = (_pairwise(f) for f in (F.least, F.greatest, lambda a, b: a + b, lambda a, b: a - b))
    three = [F.get("__near", F.lit(d)) for d in range(3)]
    fold = lambda f: f(f(three[0], three[1]), three[2])
    rows = rows.withColumns({"__lo": fold(least), "__hi": fold(greatest), "__sum": fold(plus)}).withColumn("__mid", minus(minus(F.col("__sum"), F.col("__lo")), F.col("__hi")))
    of = lambda c, f: F.transform(value, lambda _, i: f(*[F.get(c, i + j) for j in range(3)]))
    middle = lambda a, b, c: F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    rows = rows.withColumns({"__a": of("__lo", F.greatest), "__b2": of("__mid", middle), "__c": of("__hi", F.least)})
    ab = least(F.col("__a"), F.col("__b2"))
    return rows.withColumn(out, greatest(ab, least(greatest(F.col("__a"), F.col("__b2")), F.col("__c")))).drop("__lo", "__hi", "__sum", "__mid", "__a", "__b2", "__c")


def isolated_lines(rows: DataFrame, value: str = "v", out: str = "__lone", median: str = "__med") -> DataFrame:
    """Scanlines with arrays `median` (3 x 3) and `out`: 1 where a pixel is 100 or more from its median and none around it is."""
    rows = near(banded(rows, 2).withColumn("__p", padded(F.col(value), 1, "replicate")), "__p", 1, "replicate")
    at = lambda d: F.get("__near", F.lit(d + 1))
    rows = _median_array(rows, value, median).withColumn("__i", F.zip_with(value, median, lambda a, b: (F.abs(a - b) >= 100).cast("int"))).drop("__near", "__p")
    rows = near(rows.withColumn("__p", padded(F.col("__i"), 1, "reflect101")), "__p", 1, "reflect101")
    # impulses in the three lines, column by column, less the pixel's own
    rows = rows.withColumn("__c", F.zip_with(F.zip_with(at(-1), at(0), lambda a, b: a + b), at(1), lambda a, b: a + b))
    lone = F.transform("__i", lambda own, i: ((own == 1) & (F.get("__c", i) + F.get("__c", i + 1) + F.get("__c", i + 2) == 1)).cast("int"))
    return unbanded(rows.withColumn(out, lone).drop("__near", "__p", "__c", "__i"))


def smoothed_lines(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Scanlines (image_id, y, arrays) with __lap0, __lap1, ...: the Laplacian of the 3 x 3 median of each of `values`, in one dealing and order of the lines."""
    rows = banded(rows, 2)
    for k, value in enumerate(values):
        rows = near(rows.withColumn("__p", padded(F.col(value), 1, "replicate")), "__p", 1, "replicate")
        rows = _median_array(rows, value, f"__m{k}").drop("__near", "__p")
    for k in range(len(values)):
        rows = near(rows.withColumn("__p", padded(F.col(f"__m{k}"), 1, "reflect101")), "__p", 1, "reflect101")
        line = lambda d: F.get("__near", F.lit(d + 1))
        rows = rows.withColumn(f"__lap{k}", F.transform(f"__m{k}", lambda _, i: _laplace(line, i))).drop("__near", "__p")
    return unbanded(rows.drop(*[f"__m{k}" for k in range(len(values))]))


def bilateral(px: DataFrame, diameter: int = 5, sigma_color: float = 25.0, sigma_space: float = 25.0) -> DataFrame:
    """Mean weighted by distance in place and in value over a disc."""
    r = diameter // 2
    n = neighbours(px, r, "reflect101", "v", "__n")
    terms = []
    for i, (dy, dx) in enumerate((dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)):
        if dy * dy + dx * dx <= r * r:
            d = F.col("__n")[i] - F.col("v")
            terms.append((F.exp(-F.lit((dy * dy + dx * dx) / (2 * sigma_space**2)) - d * d / F.lit(2 * sigma_color**2)), F.col("__n")[i]))
    return n.withColumn("v", clip8(sum(w * v for w, v in terms) / sum(w for w, _ in terms))).drop("__n")


#: Rows of a band that non-local means holds as one array, and how many values of small images go through together.
MEANS_BAND, TOGETHER = 256, 1 << 17


def _places(first: int, count: int, top: int, n: int) -> np.ndarray:
    """Where `count` places from `first` on are found in an array that begins at `top`, mirrored (reflect101) in 0..n-1."""
    i = np.arange(first, first + count) % max(2 * (n - 1), 1)
    return np.where(i < n, i, 2 * (n - 1) - i) - top


def _means(v: np.ndarray, top: int, height: int, first: int, last: int, strength: float, t: int, r: int) -> np.ndarray:
    """Non-local means of the rows first..last of images of one size; v (images, rows from `top` on, width) holds the rows that these need."""
    width, side = v.shape[2], 2 * t + 1
    # rows whose differences the templates need, and the values that these meet
    low, high = max(0, first - t), min(height - 1, last + t)
    own = v[:, low - top : high + 1 - top]
    wide = v[:, _places(low - r, high - low + 1 + 2 * r, top, height)][:, :, _places(-r, width + 2 * r, 0, width)]
    over, down = _places(-t, width + 2 * t, 0, width), _places(first - t, last - first + 1 + 2 * t, low, height)
    n = last - first + 1
    total, weights = np.zeros((len(v), n, width)), np.zeros((len(v), n, width))
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            w = wide[:, dy : dy + own.shape[1], dx : dx + width]
            d = (w - own) ** 2
            d = d[:, :, over]
            d = sum(d[:, :, j : j + width] for j in range(side)) * (1.0 / side)
            d = d[:, down]
            d = sum(d[:, j : j + n] for j in range(side)) * (1.0 / side)
            k = np.exp(-d / (strength * strength))
            total += w[:, first - low : first - low + n] * k
            weights += k
    return np.clip(np.floor(np.round(total / weights, 6) + 0.5), 0, 255)


def non_local_means_lines(rows: DataFrame, strength: float = 5.0, template_window_size: int = 7, search_window_size: int = 21) -> DataFrame:
    """Scanlines (image_id, y, v) after `non_local_means`. Bands of lines go through arrays, an offset after the other; images of one small size go together."""
    t, r = template_window_size // 2, search_window_size // 2
    halo, band = t + r, MEANS_BAND
    y = F.col("y")
    cut = rows.select("image_id", "y", F.col("v").cast("array<int>").alias("v"), F.explode(F.sequence(_div(F.greatest(y - halo, F.lit(0)), band), _div(y + halo, band))).alias("b"))

    def treat(batches):
        for table in whole_groups(batches, ("image_id", "b")):
            begin = starts(table, ("image_id", "b"))
            end = [*begin[1:].tolist(), table.num_rows]
            ids, ys, bs = (table.column(c).to_numpy() for c in ("image_id", "y", "b"))
            lines = table.column("v").combine_chunks()
            lines = pa.concat_arrays(lines.chunks) if isinstance(lines, pa.ChunkedArray) else lines
            offsets = lines.offsets.to_numpy()
            values = lines.values.to_numpy()
            alike: dict[tuple, list[int]] = {}
            for i, e in zip(begin.tolist(), end, strict=True):
                top, bottom, b = int(ys[i]), int(ys[e - 1]), int(bs[i])
                if bottom < b * band:
                    continue  # only lines of the band before: an image ends there
                widths = np.diff(offsets[i : e + 1])
                # what a shorter line lacks is unknown, and so is all that it reaches
                alike.setdefault((e - i, int(widths.max()), top, bottom, b, i if (widths != widths[0]).any() else -1), []).append(i)
            for (n, width, top, bottom, b, _), group in alike.items():
                first, last = b * band, min(bottom, (b + 1) * band - 1)
                several = max(1, TOGETHER // max(1, n * width))
                for at in range(0, len(group), several):
                    some = group[at : at + several]
                    widths = np.concatenate([np.diff(offsets[i : i + n + 1]) for i in some])
                    v = np.full((len(some) * n, width), np.nan)
                    v[np.arange(width) < widths[:, None]] = np.concatenate([values[offsets[i] : offsets[i + n]] for i in some])
                    # where lines below are missing, the image ends; else its end is out of reach
                    out = _means(v.reshape(len(some), n, width), top, bottom + 1, first, last, float(strength), t, r)
                    rows_ = last - first + 1
                    kept = widths.reshape(len(some), n)[:, first - top : last + 1 - top].ravel()
                    flat = out.reshape(-1, width)[np.arange(width) < kept[:, None]]
                    new = pa.array(flat, mask=np.isnan(flat)).cast(pa.int32())
                    ends = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], rows_)), pa.array(np.tile(np.arange(first, last + 1, dtype=np.int32), len(some))), pa.ListArray.from_arrays(ends, new)], ["image_id", "y", "v"])

    return dealt(cut, ("image_id", "b"), ("y",)).mapInArrow(treat, "image_id long, y int, v array<int>")


def non_local_means(px: DataFrame, strength: float = 5.0, template_window_size: int = 7, search_window_size: int = 21) -> DataFrame:
    """Weighted mean over a search window; weights fall with the mean squared difference of the templates around."""
    rows = scanlines(px.select(*KEYS, "v")).select("image_id", "y", F.transform("__row", lambda s: s["v"]).alias("v"))
    return line_values(non_local_means_lines(rows, strength, template_window_size, search_window_size))


def illumination_normalize(px: DataFrame, kernel_size: int = 51, strength: float = 0.65) -> DataFrame:
    g = gaussian(px, kernel_size).withColumn("__m", F.avg("g").over(Window.partitionBy("image_id")))
    flat = F.col("v") / F.greatest(F.col("g"), F.lit(1.0)) * F.col("__m")
    return g.withColumn("v", trunc8(F.round((1 - strength) * F.col("v") + strength * flat, 9))).drop("g", "__m")


def background_suppress(px: DataFrame, kernel_size: int = 31, strength: float = 0.45) -> DataFrame:
    return gaussian(px, kernel_size).withColumn("v", trunc8(F.round(F.col("v") - (F.col("v") - F.col("g")) * strength, 9))).drop("g")


def weak_structure_suppress(px: DataFrame, kernel_size: int = 31, threshold: float = 12.0, strength: float = 0.35) -> DataFrame:
    g = gaussian(px, kernel_size)
    d = F.round(F.col("v") - F.col("g"), 9)
    return g.withColumn("v", F.when(F.abs(d) <= threshold, trunc8(F.round(F.col("v") - d * strength, 9))).otherwise(F.col("v"))).drop("g")
