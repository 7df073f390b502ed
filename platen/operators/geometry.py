"""Lines, quadrilaterals, rotation and rectification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.groups import dealt, whole_groups
from platen.functions.scalars import angle_distance, area_score, is_convex, quad_angles, quad_area, quad_sides
from platen.sources.rasters import KEYS, clip8, dimensions
from platen.sources.store import cut, spread


def _number(value: float | str) -> F.Column:
    """A number, or a column of that name."""
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _directions(step: float) -> tuple[F.Column, F.Column]:
    """Cosines and sines of the angles [0, 180) at `step`, as arrays."""
    angles = [math.radians(i * step) for i in range(round(180 / step))]
    return F.array(*[F.lit(math.cos(a)) for a in angles]), F.array(*[F.lit(math.sin(a)) for a in angles])


def _segments(votes: DataFrame, theta_step: float, threshold: float | str, min_length: float | str, max_gap: float | str, wide: bool = False) -> DataFrame:
    """Segments of votes (KEYS, theta, rho, along, columns named as limits). A pixel counts for one cell only, of those with enough votes the
    one with most (of ties the middle angle), so a thick or slanted line is one line; along a cell, pixels closer than the gap form a segment.

    With `wide`, a cell goes along with the stronger one beside it, since a slanted line of pixels changes between two; the angle of a segment is then that
    of its own pixels, since pixels elsewhere along the cell, of other lines of a text, may have had a say in which cell it is.
    """
    cell = ["image_id", "theta", "rho"]
    limits = [c for c in (threshold, min_length, max_gap) if isinstance(c, str)]
    line = Window.partitionBy(*cell).orderBy("along", "x", "y")
    if wide:
        votes = cut(votes)
        up = Window.partitionBy("image_id", "theta").orderBy("rho")
        beside = lambda move, d: F.when(move("rho").over(up) == F.col("rho") + d, move("n").over(up)).otherwise(0)
        cells = votes.groupBy(*cell).agg(F.count("*").alias("n")).withColumns({"after": beside(F.lead, 1), "before": beside(F.lag, -1)})
        first = F.when(F.col("before") > F.col("after"), F.col("rho") - 1).otherwise(F.col("rho"))
        cells = cells.select(*cell, (F.col("n") + F.greatest("before", "after")).alias("n"), first.alias("first"))
        strong = votes.join(cells.hint("merge"), cell).where(F.col("n") >= _number(threshold)).drop("rho").withColumnRenamed("first", "rho")
    else:
        strong = votes.withColumn("n", F.count("*").over(Window.partitionBy(*cell))).where(F.col("n") >= _number(threshold))
    # at most one entry for each angle, so the array is short
    each = strong.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("theta", "rho", "along", "n"))).alias("c"), *[F.first(c).alias(c) for c in limits])
    best = F.filter("c", lambda e: e["n"] == F.array_max(F.transform("c", lambda o: o["n"])))
    own = each.withColumn("c", best).select(*KEYS, *limits, F.get("c", F.expr("(size(c) - 1) div 2").cast("int")).alias("c")).select(*KEYS, *limits, "c.theta", "c.rho", "c.along")
    gaps = own.withColumn("new", (F.coalesce(F.col("along") - F.lag("along").over(line), F.lit(0.0)) > _number(max_gap)).cast("int"))
    parts = gaps.withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.struct("along", "x", "y")
    out = parts.groupBy(*cell, "part").agg(F.min(end).alias("a"), F.max(end).alias("b"), F.count("*").alias("votes"), *_sums(), *[F.first(c).alias(c) for c in limits])
    length = F.round(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")), 6)
    angle = _fitted() if wide else F.lit(theta_step) * F.col("theta") - 90
    return out.withColumn("length", length).where(F.col("length") >= _number(min_length)).select("image_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "length", angle.alias("angle"), "votes")


def _sums() -> list[F.Column]:
    """Sums of the places of a group's pixels, exact."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    return [F.sum(e).alias(n) for n, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))]


def _fitted() -> F.Column:
    """Degrees in (-90, 90] of the line that lies nearest to the pixels of `_sums`."""
    whole = lambda e: e.cast("decimal(38,0)")
    central = lambda a, b, ab: (whole(F.col("votes")) * F.col(ab) - whole(F.col(a)) * F.col(b)).cast("double")
    turned = F.degrees(F.atan2(2 * central("sx", "sy", "sxy"), central("sx", "sx", "sxx") - central("sy", "sy", "syy"))) / 2
    return F.when(turned == -90, 90.0).otherwise(turned)


def _place(theta: F.Column, c: F.Column, s: F.Column) -> tuple[F.Column, F.Column]:
    """(rho, along): a pixel's place across and along a line whose normal has the angle at place theta of c and s."""
    cos, sin = F.get(c, theta), F.get(s, theta)
    return F.round(F.col("x") * cos + F.col("y") * sin, 6), F.round(F.col("y") * cos - F.col("x") * sin, 6)


#: Edge pixels of small images that vote together.
TOGETHER = 1 << 15


def _voted(image: np.ndarray, x: np.ndarray, y: np.ndarray, theta_step: float, threshold: int, min_length: float, max_gap: float) -> dict[str, np.ndarray]:
    """Segments of the edge pixels of whole images, image by image. Angles are gone through one after the other, so pixels are held, not votes."""
    new = np.r_[True, image[1:] != image[:-1]]
    number, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    angles = [math.radians(i * theta_step) for i in range(round(180 / theta_step))]

    def cells(a: float) -> tuple[np.ndarray, np.ndarray]:
        """Each pixel's cell across the angle, and how many pixels share it."""
        rho = np.floor(np.round(x * math.cos(a) + y * math.sin(a), 6) + 0.5).astype(np.int64)
        low = np.minimum.reduceat(rho, begin)
        span = np.maximum.reduceat(rho, begin) - low + 1
        place = (np.cumsum(span) - span - low)[number] + rho
        return rho, np.bincount(place)[place]

    # how many votes a pixel's best cell has and how many angles tie there; then the middle one of these
    most, ties = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in angles:
        n = cells(a)[1]
        ties = np.where(n > most, 1, ties + (n == most))
        most = np.maximum(most, n)
    theta, rho, seen = np.full(len(x), -1), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i, a in enumerate(angles):
        r, n = cells(a)
        best = n == most
        own = best & (seen == (ties - 1) // 2)
        theta[own], rho[own] = i, r[own]
        seen += best
    good = most >= threshold
    number, image, x, y, theta, rho = number[good], image[good], x[good], y[good], theta[good], rho[good]
    cos, sin = (np.array([f(a) for a in angles])[theta] for f in (math.cos, math.sin))
    along = np.round(y * cos - x * sin, 6)
    order = np.lexsort((y, x, along, rho, theta, number))
    number, image, x, y, theta, rho, along = number[order], image[order], x[order], y[order], theta[order], rho[order], along[order]
    part = np.ones(len(x), bool)
    part[1:] = (number[1:] != number[:-1]) | (theta[1:] != theta[:-1]) | (rho[1:] != rho[:-1]) | (along[1:] - along[:-1] > max_gap)
    first = np.flatnonzero(part)
    last = np.r_[first[1:], len(x)] - 1
    length = np.round(np.hypot(x[last] - x[first], y[last] - y[first]), 6)
    long = length >= min_length
    a, b = first[long], last[long]
    return {"image_id": image[a], "x1": x[a], "y1": y[a], "x2": x[b], "y2": y[b], "length": length[long], "angle": theta_step * theta[a] - 90, "votes": b - a + 1}


def hough_segments(edges: DataFrame, theta_step: float = 1.0, threshold: int = 5, min_length: float = 3, max_gap: int = 2) -> DataFrame:
    """image_id, x1, y1, x2, y2, length, angle, votes: deterministic Hough transform, in which every edge pixel votes for every angle.

    A pixel counts for one cell only, of those with enough votes the one with most (of ties the middle angle); along a cell, pixels closer
    than the gap form a segment. Pixels are dealt out by image, votes are counted where they are cast; `page_segments` votes for far less.
    """

    def treat(batches):
        held, n = [], 0
        for table in (t for b in (whole_groups(batches, ("image_id",)), [None]) for t in b):
            if table is not None:
                held.append(table)
                n += table.num_rows
            if held and (table is None or n >= TOGETHER):
                image, y, x = (pa.concat_tables(held).column(c).to_numpy() for c in KEYS)
                found = _voted(image, x.astype(np.int64), y.astype(np.int64), theta_step, threshold, min_length, max_gap)
                yield pa.RecordBatch.from_pydict(found, pa.schema([(c, pa.int64() if c in ("image_id", "votes") else pa.float64() if c in ("length", "angle") else pa.int32()) for c in found]))
                held, n = [], 0

    return dealt(edges.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), ("image_id",), ("y", "x")).mapInArrow(treat, "image_id long, x1 int, y1 int, x2 int, y2 int, length double, angle double, votes long")


#: Of page_segments: degrees between coarse angles, to how many of them on both sides of its gradient a pixel votes, pixels of a coarse cell
#: across its lines, the part of the votes that a coarse cell needs, and how many of its coarse cells a pixel keeps.
COARSE, SIDES, ACROSS, PART, KEPT = 3, 3, 8, 3, 2


def coarse_votes(edges: DataFrame, limits: tuple[str, ...] = ()) -> DataFrame:
    """KEYS, limits, j, rho, w: the coarse cells that edge pixels (KEYS, gx, gy) vote for, with angles near the normal that their gradient gives, and how near."""
    n = 180 // COARSE
    c, s = _directions(COARSE)
    normal = F.floor(F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))) / COARSE + 0.5).cast("int")
    votes = edges.select(*KEYS, *limits, normal.alias("o"), F.explode(F.sequence(F.lit(-SIDES), F.lit(SIDES))).alias("d"))
    votes = votes.select(*KEYS, *limits, F.pmod(F.col("o") + F.col("d"), F.lit(n)).cast("int").alias("j"), (SIDES + 1 - F.abs("d")).alias("w"))
    return votes.select(*KEYS, *limits, "j", "w", F.floor(_place(F.col("j"), c, s)[0] / ACROSS).cast("int").alias("rho"))


def fine_votes(coarse: DataFrame, theta_step: float, threshold: float | str, limits: tuple[str, ...] = ()) -> DataFrame:
    """KEYS, limits, theta, rho, along: votes for the fine angles of the strongest coarse cells of each pixel; cells with too few votes are out.

    A line of `threshold` votes may cross PART coarse cells, so one of them has that part of its votes. Cells are compared by how well
    their pixels' gradients agree with them, since a strip across text holds many pixels that belong to other lines. The cell of a pixel's own
    normal stays in any case: strips across several lines of text may have more votes on both sides of it.
    """
    cell = Window.partitionBy("image_id", "j", "rho")
    strong = coarse.withColumns({"n": F.count("*").over(cell), "all": F.sum("w").over(cell)}).where(PART * F.col("n") >= _number(threshold))
    own = F.sort_array(F.collect_list(F.when(F.col("w") == SIDES + 1, F.struct(-F.col("all"), "j"))))
    best = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("all"), "j"))), 1, KEPT)
    each = strong.groupBy(*KEYS).agg(F.concat(best, own).alias("top"), *[F.first(c).alias(c) for c in limits])
    fine = round(COARSE / theta_step)
    c, s = _directions(theta_step)
    # one angle more on both sides: a line on the border of two coarse cells is stronger in the next angle's
    reach = F.sequence(F.lit(-(fine // 2) - 1), F.lit(fine // 2 + 1))
    theta = F.transform("top", lambda t: F.transform(reach, lambda d: F.pmod(t["j"] * fine + d, F.lit(round(180 / theta_step))).cast("int")))
    votes = each.select(*KEYS, *limits, F.explode(F.array_distinct(F.flatten(theta))).alias("theta"))
    rho, along = _place(F.col("theta"), c, s)
    return votes.select(*KEYS, *limits, "theta", F.floor(rho + 0.5).cast("int").alias("rho"), along.alias("along"))


def page_segments(edges: DataFrame, theta_step: float = 1.0, threshold: float | str = 40, min_length: float | str = 40, max_gap: float | str = 10) -> DataFrame:
    """Segments as of hough_segments, from edge pixels with gradients (KEYS, gx, gy) by votes from coarse to fine.

    A pixel votes for 2 SIDES + 1 coarse angles about its normal, and for the fine angles of its best coarse cells, so votes are
    some 20 a pixel, not 180 or 360. Limits are numbers or names of columns of `edges`, so that each image can have its own.
    """
    limits = tuple(dict.fromkeys(c for c in (threshold, min_length, max_gap) if isinstance(c, str)))
    return _segments(fine_votes(coarse_votes(edges, limits), theta_step, threshold, limits), theta_step, threshold, min_length, max_gap, wide=True)


def skew_stats(segments: DataFrame) -> DataFrame:
    """image_id, angle, dispersion, lines: length-weighted mean of the angles near the median, within max(1, min(6, 2.5 MAD or 1.5))."""
    s = segments.select("image_id", F.col("angle").cast("double").alias("angle"), F.col("length").cast("double").alias("length"))
    med = s.groupBy("image_id").agg(F.percentile("angle", 0.5).alias("med"))
    off = s.join(med, "image_id").select("image_id", "med", "length", (F.col("angle") - F.col("med")).alias("off"))
    mad = off.groupBy("image_id").agg(F.percentile(F.abs("off"), 0.5).alias("mad"))
    allowed = F.greatest(F.lit(1.0), F.least(F.lit(6.0), F.when(F.col("mad") > 0, 2.5 * F.col("mad")).otherwise(1.5)))
    kept = off.join(mad, "image_id").where(F.round(F.abs("off"), 9) <= F.round(allowed, 9))
    # offsets from the median are small, so their squares don't cancel
    w = F.col("length")
    g = kept.groupBy("image_id").agg(F.first("med").alias("med"), F.sum(w).alias("w"), F.sum(w * F.col("off")).alias("wo"), F.sum(w * F.col("off") * F.col("off")).alias("woo"), F.count("*").alias("lines"))
    mean = F.col("wo") / F.col("w")
    return g.select("image_id", (F.col("med") + mean).alias("angle"), F.sqrt(F.greatest(F.col("woo") / F.col("w") - mean * mean, F.lit(0.0))).alias("dispersion"), "lines")


def line_families(segments: DataFrame, bins: int = 36) -> DataFrame:
    """segments with family: primary or secondary (90 degrees away), within 20 degrees of the image's heaviest direction by length."""
    width = 180 / bins
    b = segments.withColumn("bin", F.floor((F.col("angle") + 90) / width) % bins)
    top = b.groupBy("image_id", "bin").agg(F.sum("length").alias("w")).groupBy("image_id").agg(F.min_by("bin", F.struct(-F.round("w", 6), "bin")).alias("top"))
    main = b.join(top, "image_id").withColumn("main", (F.col("top") + 0.5) * width - 90)
    d = angle_distance(F.col("angle"), F.col("main"))
    return main.withColumn("family", F.when(d <= 20, "primary").when(90 - d <= 20, "secondary")).where("family IS NOT NULL").drop("bin", "top")


def extremes(lines: DataFrame, per_side: int = 4) -> DataFrame:
    """The first and the last few offsets of each family (side low or high). Lines are dealt out once, for both sides."""
    key = Window.partitionBy("image_id", "family")
    up, down = F.row_number().over(key.orderBy("offset", "id")), F.row_number().over(key.orderBy(F.desc("offset"), "id"))
    e = spread(lines, "image_id").withColumns({"up": up, "down": down})
    side = lambda c, name: F.when(F.col(c) <= per_side, F.lit(name))
    return e.withColumn("side", F.explode(F.array_compact(F.array(side("up", "low"), side("down", "high"))))).drop("up", "down")


def unique_lines(lines: DataFrame, share: float = 0.015) -> DataFrame:
    """lines (image_id, family, offset, id, diagonal) less those that lie within `share` of the diagonal after the line before them in their family."""
    key = Window.partitionBy("image_id", "family").orderBy("offset", "id")
    gap = F.col("offset") - F.lag("offset").over(key)
    return lines.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > share * F.col("diagonal"))).drop("__gap")


def quad_candidates(lines: DataFrame) -> DataFrame:
    """image_id, ids (of the four sides), corners, support (mean length): every low and high line of one family with every low and high line of the other.

    lines: image_id, id, family (primary or secondary), side (low or high, a few of each an image, see `extremes`), length and l (normal
    form nx, ny, d). Sides that are one line, and parallel sides, make no candidate.
    """
    pick = lambda family, side, name: lines.where((F.col("family") == family) & (F.col("side") == side)).select("image_id", F.struct("id", "length", "l").alias(name))
    four = pick("primary", "low", "a").join(pick("primary", "high", "b"), "image_id").where("a.id <> b.id").join(pick("secondary", "low", "c"), "image_id").join(pick("secondary", "high", "d"), "image_id").where("c.id <> d.id")
    for i, (p, q) in enumerate((("a", "c"), ("a", "d"), ("b", "d"), ("b", "c"))):
        four = intersect(four.withColumns({"__p": F.col(f"{p}.l"), "__q": F.col(f"{q}.l")}), "__p", "__q").withColumn(f"p{i}", F.struct(F.col("ix").alias("x"), F.col("iy").alias("y"))).drop("ix", "iy")
    whole = F.lit(True)
    for i in range(4):
        whole = whole & F.col(f"p{i}.x").isNotNull()
    ids = F.array(*[F.col(f"{n}.id") for n in "abcd"])
    return four.where(whole).select("image_id", ids.alias("ids"), F.array(*[F.col(f"p{i}") for i in range(4)]).alias("corners"), (sum(F.col(f"{n}.length") for n in "abcd") / 4).alias("support"))


def intersect(df: DataFrame, a: str, b: str) -> DataFrame:
    """ix, iy of the lines in normal form (structs a, b of nx, ny, d: nx x + ny y = d); null where they are parallel."""
    det = F.col(f"{a}.nx") * F.col(f"{b}.ny") - F.col(f"{b}.nx") * F.col(f"{a}.ny")
    safe = F.when(F.abs(det) > 1e-9, det)
    ix = (F.col(f"{a}.d") * F.col(f"{b}.ny") - F.col(f"{b}.d") * F.col(f"{a}.ny")) / safe
    iy = (F.col(f"{a}.nx") * F.col(f"{b}.d") - F.col(f"{b}.nx") * F.col(f"{a}.d")) / safe
    return df.withColumns({"ix": ix, "iy": iy})


def plausible_quads(q: DataFrame) -> DataFrame:
    """q (corners, height, width) with area_ratio, reject (null: plausible) and frame_contacts (corners within 4 % of the frame)."""
    c = F.col("corners")
    area = quad_area(c) / (F.col("height") * F.col("width"))
    inside = ~F.exists(c, lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > F.col("width") - 1) | (p["y"] > F.col("height") - 1))
    shortest = F.array_min(quad_sides(c)) >= 0.08 * F.hypot("width", "height")
    angles = F.forall(quad_angles(c), lambda a: a.between(25, 155))
    reject = F.when(~inside, "outside").when(~is_convex(c), "not_convex").when(~area.between(0.18, 0.98), "area").when(~shortest, "side").when(~F.coalesce(angles, F.lit(False)), "angle")
    mx, my = 0.04 * F.col("width"), 0.04 * F.col("height")
    touch = F.size(F.filter(c, lambda p: (p["x"] <= mx) | (p["y"] <= my) | (p["x"] >= F.col("width") - 1 - mx) | (p["y"] >= F.col("height") - 1 - my)))
    return q.withColumns({"area_ratio": area, "reject": reject, "frame_contacts": touch})


def touched_sides(c: F.Column, share: float = 0.04) -> F.Column:
    """How many sides of the frame (columns height, width) corners come within `share` of."""
    mx, my = share * F.col("width"), share * F.col("height")
    tests = (lambda p: p["x"] <= mx, lambda p: p["x"] >= F.col("width") - 1 - mx, lambda p: p["y"] <= my, lambda p: p["y"] >= F.col("height") - 1 - my)
    return sum(F.exists(c, t).cast("int") for t in tests)


def geometry_scores(q: DataFrame) -> DataFrame:
    """Adds angle_score (1 - mean error / 65), balance (root of the side ratios) and confidence (0.35 area, 0.30 angle, 0.20 fit, 0.15 balance)."""
    c = F.col("corners")
    s = quad_sides(c)
    err = F.aggregate(quad_angles(c), F.lit(0.0), lambda n, a: n + F.abs(a - 90)) / 4
    ratio = lambda i, j: F.least(s[i], s[j]) / F.greatest(s[i], s[j], F.lit(1e-9))
    out = q.withColumns({"angle_score": F.greatest(F.lit(0.0), 1 - err / 65), "balance": F.sqrt(ratio(0, 2) * ratio(1, 3))})
    return out.withColumn("confidence", 0.35 * area_score(F.col("area_ratio")) + 0.30 * F.col("angle_score") + 0.20 * F.col("fit") + 0.15 * F.col("balance"))


def line_confidence(q: DataFrame) -> DataFrame:
    """q (area_ratio, angle_score, balance, support, height, width) with confidence of a quadrilateral of lines: 0.30 area, 0.35 angle, 0.20 balance, 0.15 line support."""
    support = F.least(F.lit(1.0), F.col("support") / F.hypot("width", "height"))
    return q.withColumn("confidence", 0.30 * area_score(F.col("area_ratio")) + 0.35 * F.col("angle_score") + 0.20 * F.col("balance") + 0.15 * support)


def rank_boundary(q: DataFrame, accept: float = 0.68) -> DataFrame:
    """The best candidate of each image by 0.62 confidence + 0.38 border contrast (less where it touches the frame), and whether it is accepted."""
    score = (0.62 * F.col("confidence") + 0.38 * F.col("border_contrast")) * F.when(F.col("frame_contacts") > 0, 0.78).otherwise(1.0)
    best = q.withColumn("score", F.round(score, 6)).groupBy("image_id").agg(F.min_by(F.struct("candidate", "score"), F.struct(-F.col("score"), "candidate")).alias("b"))
    return best.select("image_id", "b.candidate", "b.score", (F.col("b.score") >= accept).alias("detected"))


def border_value(px: DataFrame, share: float = 0.02) -> DataFrame:
    """image_id, fill: median of the border bands; pixels of two bands count twice."""
    d = px.join(dimensions(px).hint("shuffle_hash"), "image_id")
    my, mx = F.greatest(F.lit(1), F.floor(F.col("height") * share)), F.greatest(F.lit(1), F.floor(F.col("width") * share))
    bands = [F.col("y") < my, F.col("y") >= F.col("height") - my, F.col("x") < mx, F.col("x") >= F.col("width") - mx]
    # counts of the few values of an image, not its pixels, go to the median
    each = d.select("image_id", "v", sum(F.when(b, 1).otherwise(0) for b in bands).alias("k")).where("k > 0").groupBy("image_id", "v").agg(F.sum("k").alias("k"))
    return each.groupBy("image_id").agg(F.percentile("v", 0.5, F.col("k")).alias("fill"))


def _cubic(t):
    """Weight of a pixel `t` away, for cubic interpolation with a = -0.75."""
    t = F.abs(t)
    near, far = (1.25 * t - 2.25) * t * t + 1, ((-0.75 * t + 3.75) * t - 6) * t + 3
    return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)


def _sampled(grid: DataFrame, px: DataFrame, fill, cubic: bool = False) -> DataFrame:
    """grid (KEYS, sx, sy: where the source is read) with v by bilinear (or cubic) weights; places outside take `fill`, a number or a column of grid."""
    linear = lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))
    weight, reach = (_cubic, (-1, 0, 1, 2)) if cubic else (linear, (0, 1))
    at = lambda axis, k: (F.floor(axis) + k).cast("int")
    corner = lambda a, b: F.struct(at("sy", a).alias("y"), at("sx", b).alias("x"), (weight(F.col("sy") - at("sy", a)) * weight(F.col("sx") - at("sx", b))).alias("w"))
    kept = [fill] if isinstance(fill, str) else []
    all_ = grid.select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox"), *kept, F.explode(F.array(*[corner(a, b) for a in reach for b in reach])).alias("c"))
    all_ = all_.select("image_id", "oy", "ox", *kept, "c.*").where("abs(w) > 1e-9")
    near = all_.join(px.select(*KEYS, "v").hint("merge"), KEYS, "left").withColumn("v", F.coalesce("v", F.col(fill) if kept else F.lit(fill)))
    return near.groupBy("image_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(clip8(F.round(F.sum(F.col("w") * F.col("v")), 6)).alias("v"))


def rotation_grid(dims: DataFrame, whole: bool = False) -> DataFrame:
    """Where each pixel of the turned images is read: dims (image_id, height, width, a: radians, other columns kept) by output pixel with sx, sy.

    The canvas holds all of the image; its sides are cut down to whole pixels (`whole`) or rounded up.
    """
    c, s = F.cos("a"), F.sin("a")
    fit = (lambda e: F.floor(F.round(e, 6))) if whole else (lambda e: F.ceil(F.round(e, 6)))
    size = lambda one, other: fit(F.col(one) * F.abs(s) + F.col(other) * F.abs(c)).cast("int")
    grid = dims.withColumns({"w": size("height", "width"), "h": size("width", "height")})
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    dx, dy = F.col("x") - (F.col("w") - 1) / 2, F.col("y") - (F.col("h") - 1) / 2
    return grid.withColumns({"sx": F.round(c * dx - s * dy + (F.col("width") - 1) / 2, 6), "sy": F.round(s * dx + c * dy + (F.col("height") - 1) / 2, 6)})


def rotate(px: DataFrame, angle: float | str = 0.0, fill: int = 255, cubic: bool = False, angles: DataFrame | None = None) -> DataFrame:
    """Each image turned by `angle` degrees about its centre on a canvas that holds all of it; `angle` may be a column of `angles` (image_id, ...).

    Bilinear on a canvas rounded up, or `cubic` on one cut down. What lies outside the image is `fill`. Images without an angle stay out.
    """
    d = dimensions(px)
    d = d.join(angles.select("image_id", F.radians(F.col(angle).cast("double")).alias("a")), "image_id").where("a IS NOT NULL") if angles is not None else d.withColumn("a", F.lit(math.radians(angle)))
    return _sampled(rotation_grid(d, cubic), px, fill, cubic)


def rectify(px: DataFrame, quads: DataFrame, least: int = 40) -> DataFrame:
    """Each image's quadrilateral (image_id, corners in order) drawn as an upright rectangle of its longest sides, bilinear; none if a side of that is below `least`.

    The map from the unit square to the corners is the closed form of the projective transform.
    """
    c = F.col("corners")
    s = quad_sides(c)
    size = lambda i, j: F.greatest(F.lit(2), F.ceil(F.round(F.greatest(s[i], s[j]), 6)).cast("int"))
    q = quads.withColumns({"w": size(0, 2), "h": size(1, 3)}).where((F.col("w") >= least) & (F.col("h") >= least))
    x, y = [c[i]["x"].cast("double") for i in range(4)], [c[i]["y"].cast("double") for i in range(4)]
    q = q.withColumns({"dx1": x[1] - x[2], "dx2": x[3] - x[2], "dx3": x[0] - x[1] + x[2] - x[3], "dy1": y[1] - y[2], "dy2": y[3] - y[2], "dy3": y[0] - y[1] + y[2] - y[3]})
    det = F.col("dx1") * F.col("dy2") - F.col("dx2") * F.col("dy1")
    q = q.withColumns({"g": F.try_divide(F.col("dx3") * F.col("dy2") - F.col("dx2") * F.col("dy3"), det), "k": F.try_divide(F.col("dx1") * F.col("dy3") - F.col("dx3") * F.col("dy1"), det)}).where("g IS NOT NULL")
    grid = q.withColumn("oy", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("ox", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    u, v = F.col("ox") / (F.col("w") - 1), F.col("oy") / (F.col("h") - 1)
    z = F.col("g") * u + F.col("k") * v + 1
    sx = ((x[1] - x[0] + F.col("g") * x[1]) * u + (x[3] - x[0] + F.col("k") * x[3]) * v + x[0]) / z
    sy = ((y[1] - y[0] + F.col("g") * y[1]) * u + (y[3] - y[0] + F.col("k") * y[3]) * v + y[0]) / z
    d = dimensions(px)
    grid = grid.join(d, "image_id").select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), F.round(F.greatest(F.lit(0.0), F.least(F.col("width") - 1.0, sx)), 6).alias("sx"), F.round(F.greatest(F.lit(0.0), F.least(F.col("height") - 1.0, sy)), 6).alias("sy"))
    return _sampled(grid, px, 0)


def min_area_angle(points: DataFrame, step: float = 0.5) -> DataFrame:
    """image_id, angle, area of the smallest rectangle around the points, over angles of [0, 90) at `step`."""
    table = [(i, math.cos(math.radians(i * step)), math.sin(math.radians(i * step))) for i in range(round(90 / step))]
    angles = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(s).alias("s")) for i, c, s in table])
    # only the ends of a row can bound the rectangle, so rows become two points before they meet the angles
    ends = points.groupBy("image_id", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("image_id", "y", F.explode(F.array("a", "b")).alias("x"))
    r = ends.select("image_id", "y", "x", F.explode(angles).alias("t")).select("image_id", F.col("t.i").alias("i"), (F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s")).alias("u"), (F.col("y") * F.col("t.c") - F.col("x") * F.col("t.s")).alias("w"))
    area = F.round((F.max("u") - F.min("u")) * (F.max("w") - F.min("w")), 6)
    return r.groupBy("image_id", "i").agg(area.alias("area")).groupBy("image_id").agg(F.min_by(F.struct((F.col("i") * step).alias("angle"), "area"), F.struct("area", "i")).alias("b")).select("image_id", "b.*")


def cell_means(px: DataFrame, k: int = 4) -> DataFrame:
    """Means of k x k cells."""
    return px.groupBy("image_id", F.expr(f"y div {k}").cast("int").alias("y"), F.expr(f"x div {k}").cast("int").alias("x")).agg(clip8(F.round(F.avg("v"), 6)).alias("v"))


def line_report(segments: DataFrame, within: float = 20.0) -> DataFrame:
    """image_id, lines, level (lines within `within` degrees of level) and weighted_angle, their mean angle weighted by length; null where there are none."""
    level = F.abs("angle") <= within
    weight = F.sum(F.when(level, F.col("length")))
    return segments.groupBy("image_id").agg(F.count("*").alias("lines"), F.count_if(level).alias("level"), F.when(weight > 0, F.sum(F.when(level, F.col("length") * F.col("angle"))) / weight).alias("weighted_angle"))


def thumbnail(px: DataFrame, most_width: int = 720, most_height: int = 960) -> DataFrame:
    """Each image within the bounds, by area averages; scale is min(1, most_width / width, most_height / height), so smaller images stay as they are. Sides are rounded half to even."""
    from platen.operators.preservation import match_size

    d = dimensions(px)
    scale = F.least(F.lit(1.0), most_width / F.col("width"), most_height / F.col("height"))
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * scale).cast("int"))
    return match_size(px, d.select("image_id", side("height").alias("height"), side("width").alias("width")))


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = px.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def hist_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, chi2: sum of 2 (p - q)^2 / (p + q) over the bins of two histograms (image_id, bin, p)."""
    both = a.withColumnRenamed("p", "p0").join(b.withColumnRenamed("p", "p1"), ["image_id", "bin"], "full_outer").fillna(0.0, ["p0", "p1"])
    return both.groupBy("image_id").agg(F.sum(F.try_divide(2 * (F.col("p0") - F.col("p1")) * (F.col("p0") - F.col("p1")), F.col("p0") + F.col("p1"))).alias("chi2"))
