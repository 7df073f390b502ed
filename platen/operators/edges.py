"""Canny edges: Sobel gradients, thinning along the gradient, double threshold with hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.operators.components import labelled_runs
from platen.operators.stencil import banded, line_values, near, neighbours, padded, unbanded
from platen.sources.rasters import KEYS
from platen.sources.store import cut


def gradients(px: DataFrame, value: str = "v") -> DataFrame:
    """Adds gx and gy (Sobel), mag (L1 of them) and sector: 0 along x, 1 diagonal down, 2 along y, 3 diagonal up."""
    n = F.col("__n")
    gx = (n[2] + 2 * n[5] + n[8]) - (n[0] + 2 * n[3] + n[6])
    gy = (n[6] + 2 * n[7] + n[8]) - (n[0] + 2 * n[1] + n[2])
    out = neighbours(px, 1, "replicate", value, "__n").withColumns({"gx": gx, "gy": gy}).drop("__n")
    return out.withColumns({"mag": F.abs("gx") + F.abs("gy"), "sector": _sector()})


def _sector():
    ax, ay = F.abs("gx"), F.abs("gy")
    # tan 22.5 degrees = 0.41421356
    return F.when(ay <= ax * 0.41421356, 0).when(ax <= ay * 0.41421356, 2).when(F.col("gx") * F.col("gy") > 0, 1).otherwise(3)


def canny(px: DataFrame, low, high, value: str = "v", gradient: bool = False) -> DataFrame:
    """image_id, y, x of edge pixels (with `gradient` also gx, gy). Thresholds are numbers or names of columns of px that hold one for each image; weak pixels
    stay if 8-connected to a strong one. Pixels are gathered into lines once, and lines stay lines up to the peaks."""
    lo, hi = (F.first(t) if isinstance(t, str) else F.lit(float(t)) for t in (low, high))
    rows = px.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.col(value).alias("v")))).alias("__row"), lo.alias("lo"), hi.alias("hi"))
    kept = _peaks(rows.select("image_id", "y", "lo", "hi", F.transform("__row", lambda s: s["v"]).alias("v")), gradient)
    kept = cut(kept) if gradient else kept
    good = _held(kept.select(*KEYS, "strong"))
    if gradient:
        return kept.join(good.hint("merge"), ["image_id", "y"]).where("x BETWEEN s AND e").select(*KEYS, "gx", "gy")
    return good.select("image_id", "y", F.explode(F.sequence("s", "e")).alias("x"))


def _held(kept: DataFrame) -> DataFrame:
    """Runs of the peaks (KEYS, strong) that are 8-connected to a strong one."""
    lines = labelled_runs(kept)
    inside = lines.where("strong").select("comp").distinct()
    return lines.join(inside.hint("merge"), "comp", "left_semi")


def canny_lines(rows: DataFrame) -> DataFrame:
    """image_id, y, x of the edge pixels of scanlines (image_id, y, v: array), with the thresholds of `auto_thresholds`: `canny`, for which lines
    stay lines up to the peaks. Lines that are dealt out by image are dealt out no more."""
    rows = rows.join(_auto(line_values(rows)).hint("shuffle_hash"), "image_id")
    return _held(_peaks(rows)).select("image_id", "y", F.explode(F.sequence("s", "e")).alias("x"))


def _peaks(rows: DataFrame, gradient: bool = False) -> DataFrame:
    """KEYS, strong (with `gradient` also gx, gy) of the pixels of scanlines (image_id, y, lo, hi, v: array) that are above lo and thinned along the gradient."""
    rows = near(banded(rows, 2).withColumn("__p", padded(F.col("v"), 1, "replicate")), "__p", 1, "replicate")
    up, own, down = (F.get("__near", F.lit(d)) for d in range(3))
    at = lambda line, i, k: F.get(line, i + k)
    gx = F.transform("v", lambda _, i: at(up, i, 2) + 2 * at(own, i, 2) + at(down, i, 2) - at(up, i, 0) - 2 * at(own, i, 0) - at(down, i, 0))
    gy = F.transform("v", lambda _, i: at(down, i, 0) + 2 * at(down, i, 1) + at(down, i, 2) - at(up, i, 0) - 2 * at(up, i, 1) - at(up, i, 2))
    rows = rows.withColumns({"__gx": gx, "__gy": gy}).drop("__near", "__p").withColumn("__mag", F.zip_with("__gx", "__gy", lambda a, b: F.abs(a) + F.abs(b)))
    rows = unbanded(near(rows, "__mag", 1, "ignore"))
    each = rows.select("image_id", "y", "lo", "hi", "__gx", "__gy", *[F.get("__near", F.lit(d)).alias(f"__l{d}") for d in range(3)], F.posexplode_outer("__mag").alias("x", "mag"))
    each = each.withColumns({"gx": F.get("__gx", F.col("x")), "gy": F.get("__gy", F.col("x"))})
    m = lambda d, k: F.coalesce(F.get(f"__l{d + 1}", F.col("x") + k), F.lit(0))
    peak = F.lit(False)
    for sector, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        peak = peak | ((_sector() == sector) & (F.col("mag") > m(-dy, -dx)) & (F.col("mag") >= m(dy, dx)))
    slope = ["gx", "gy"] if gradient else []
    return each.where((F.col("mag") > F.col("lo")) & peak).select(*KEYS, *slope, (F.col("mag") > F.col("hi")).alias("strong"))


def median_thresholds(px: DataFrame, low: float, high: float, least: int, apart: int) -> DataFrame:
    """px with lo and hi: `low` times each image's median but `least` at least, and `high` times it but `apart` above lo at least, up to 255."""
    med = px.groupBy("image_id").agg(F.percentile("v", 0.5).alias("m"))
    lo = F.floor(F.greatest(F.lit(float(least)), low * F.col("m")))
    hi = F.floor(F.least(F.lit(255.0), F.greatest(F.col("lo") + apart, high * F.col("m"))))
    return px.join(med.withColumn("lo", lo).withColumn("hi", hi).drop("m").hint("shuffle_hash"), "image_id")


def auto_thresholds(px: DataFrame) -> DataFrame:
    """px with lo and hi from each image's median: 0.66 and 1.33 times it, or 50 and 150 where these are equal."""
    return px.join(_auto(px).hint("shuffle_hash"), "image_id")


def _auto(px: DataFrame) -> DataFrame:
    """image_id, lo, hi."""
    med = px.groupBy("image_id").agg(F.percentile("v", 0.5).alias("m"))
    lo, hi = F.floor(F.greatest(F.lit(0.0), 0.66 * F.col("m"))), F.floor(F.least(F.lit(255.0), 1.33 * F.col("m")))
    low, high = F.when(lo == hi, 50).otherwise(lo), F.when(lo == hi, 150).otherwise(hi)
    return med.select("image_id", low.alias("lo"), high.alias("hi"))
