"""Queries of page preparation, with their SQL where it is short."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.operators import prepare as P
from platen.operators.edges import auto_thresholds, canny
from platen.operators.geometry import min_area_angle, thumbnail
from platen.operators.histogram import to_gray
from platen.operators.registry import smart_pipeline
from platen.plans import measure as Q
from platen.plans import sql as S
from platen.sources import rasters as R
from platen.sources.intake import read_rasters, write_images
from platen.sources.store import cut, new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
V, read = R.vectors, R.read


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


SKEW = "SELECT o_orderkey AS image_id, (o_custkey % 1000) / 10.0::DOUBLE - 50 AS angle, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, CAST(o_custkey % 20 AS BIGINT) AS lines, CAST(o_custkey % 20 + o_orderkey % 5 AS BIGINT) AS raw_lines, (o_orderkey % 70) / 10.0::DOUBLE AS dispersion FROM orders"
skew = lambda spark, d: read(spark, d, "orders").selectExpr("o_orderkey as image_id", "(o_custkey % 1000) / 10D - 50 as angle", "(o_orderkey % 100) / 100D as confidence", "o_custkey % 20 as lines", "o_custkey % 20 + o_orderkey % 5 as raw_lines", "(o_orderkey % 70) / 10D as dispersion")
query("g12_deskew_gate", f"WITH s AS ({SKEW}) SELECT image_id, CASE WHEN confidence < 0.7 THEN 'skip_confidence' WHEN abs(angle) < 0.5 THEN 'skip_small' WHEN abs(angle) > 45 THEN 'skip_large' ELSE 'apply' END AS action FROM s")(lambda spark, d: P.deskew_gate(skew(spark, d)).select("image_id", "action"))
query("d6c_skew_recommendation", f"WITH s AS ({SKEW}) SELECT image_id, 'deskew' AS operation_id, angle AS parameter FROM s WHERE abs(angle) >= 0.75 AND confidence >= 0.5")(lambda spark, d: P.skew_recommendation(skew(spark, d).withColumnsRenamed({"angle": "skew_angle", "confidence": "skew_confidence"})))
query("g8_skew_confidence", f"WITH s AS ({SKEW}) SELECT image_id, round(CASE WHEN raw_lines < 3 THEN 0 ELSE 0.35::DOUBLE * least(1, lines / 16) + 0.30::DOUBLE * least(1, lines / greatest(raw_lines, 1)) + 0.35::DOUBLE * greatest(0, least(1, 1 - dispersion / 5)) END, 6) AS confidence FROM s")(lambda spark, d: P.skew_confidence(skew(spark, d)).select("image_id", F.round("confidence", 6).alias("confidence")))
PREP = "SELECT l_orderkey * 10 + l_linenumber AS image_id, l_partkey % 20 <> 0 AS prepared, 0.6::DOUBLE + (l_suppkey % 40) / 100.0::DOUBLE AS confidence, (l_partkey % 110) / 100.0::DOUBLE AS area_ratio, CAST(30 + l_partkey % 100 AS INTEGER) AS width, CAST(35 + l_suppkey % 100 AS INTEGER) AS height, l_orderkey % 9 <> 0 AS convex, CASE WHEN l_linenumber > 2 THEN 0.9::DOUBLE + (l_partkey % 10) / 100.0::DOUBLE END AS retention, (l_suppkey % 60) / 20.0::DOUBLE - 1 AS residual, CASE WHEN l_orderkey % 6 = 0 THEN 0.0::DOUBLE ELSE 0.8 END AS residual_confidence FROM lineitem"


def prepared(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("platen_lines")
    return spark.sql(PREP.replace("FROM lineitem", "FROM platen_lines"))


query("d16_verify_preparation", f"WITH p AS ({PREP}), s AS (SELECT *, CASE WHEN residual_confidence = 0 THEN 'unknown' WHEN abs(residual) <= 0.75 THEN 'good' WHEN abs(residual) <= 2 THEN 'caution' ELSE 'reject' END AS skew_status FROM p) SELECT image_id, skew_status, CASE WHEN NOT prepared OR confidence < 0.68 OR NOT (area_ratio > 0 AND area_ratio <= 1) OR width < 40 OR height < 40 OR NOT convex OR retention < 0.95 OR skew_status = 'reject' THEN 'reject' WHEN skew_status IN ('caution', 'unknown') THEN 'caution' ELSE 'accept' END AS status FROM s")(
    lambda spark, d: P.verify_preparation(prepared(spark, d)).select("image_id", "skew_status", "status")
)
query("g13_safe_crop", f"WITH {S.VECTOR}, sp AS (SELECT image_id, y, min(x) AS l, max(x) AS r FROM px WHERE v > 60 GROUP BY ALL), fr AS (SELECT image_id, max(y) + min(y) AS bo, sum(r - l + 1) AS area FROM sp GROUP BY 1), k AS (SELECT image_id, least(y, bo - y) AS k, max(l) AS l, min(r) AS r, any_value(bo) AS bo, any_value(area) AS area FROM sp JOIN fr USING (image_id) GROUP BY ALL), n AS (SELECT a.image_id, a.k, any_value(a.bo) AS bo, any_value(a.area) AS area, max(b.l) AS l, min(b.r) AS r FROM k a JOIN k b ON a.image_id = b.image_id AND b.k >= a.k GROUP BY a.image_id, a.k) SELECT image_id, CAST(max((r - l + 1) * (bo - 2 * k + 1)) AS BIGINT) AS size FROM n WHERE r > l GROUP BY image_id".replace("GROUP BY ALL), n AS", "GROUP BY image_id, least(y, bo - y)), n AS"))(
    lambda spark, d: P.safe_crop(V(spark, d).where("v > 60")).select("image_id", (F.col("w") * F.col("h")).cast("long").alias("size"))
)
query("g2_region_quads")(lambda spark, d: P.region_quads(V(spark, d)).select("image_id", "candidate", F.round("fit", 4).alias("fit")))
query("a27_detect_boundary")(lambda spark, d: P.detect_boundary(V(spark, d), 0.5, 4).select("image_id", "score", "detected"))
query("g7_estimate_skew")(lambda spark, d: P.estimate_skew(V(spark, d), 4))
query("g8_detect_skew")(lambda spark, d: P.detect_skew(V(spark, d), 4, 4, 3.0, 2))
query("e4_skew_audit")(lambda spark, d: P.skew_audit(V(spark, d), threshold=4))


def support(spark, d):
    px = V(spark, d)
    quads = px.select("image_id").distinct().withColumn("corners", F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 7D, 'y', 0D), named_struct('x', 7D, 'y', 7D), named_struct('x', 0D, 'y', 7D))"))
    return P.edge_support(canny(auto_thresholds(px), "lo", "hi"), quads)


E5_SQL = f"""WITH RECURSIVE {S.VECTOR}, {Q.AUTO}, {Q.canny_sql('pt', 'lo', 'hi', 'lo,hi')}, im AS (SELECT DISTINCT image_id FROM px), sd(side, ax, ay, bx, "by") AS (VALUES (0, 0, 0, 7, 0), (1, 7, 0, 7, 7), (2, 7, 7, 0, 7), (3, 0, 7, 0, 0)),
sp AS (SELECT image_id, side, CAST(floor(ax + (k / 19.0::DOUBLE) * (bx - ax) + 0.5) AS INTEGER) AS x, CAST(floor(ay + (k / 19.0::DOUBLE) * ("by" - ay) + 0.5) AS INTEGER) AS y FROM im, sd, (SELECT unnest(range(20)) AS k)),
wd AS (SELECT DISTINCT e.image_id, e.y + i AS y, e.x + j AS x, 1 AS hit FROM edges e, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)), ht AS (SELECT sp.image_id, side, avg(coalesce(hit, 0)) AS s FROM sp LEFT JOIN wd USING (image_id, y, x) GROUP BY ALL)
SELECT image_id, round(0.7::DOUBLE * avg(s) + 0.3::DOUBLE * min(s), 6) AS support FROM ht GROUP BY image_id"""
query("e5_edge_support", E5_SQL)(lambda spark, d: Q.rounded(support(spark, d), support=6))
#: Limits for rasters of 8 x 8 pixels.
TINY = {"least_ring": 4, "accept": 0.5, "least_side": 2, "band": 2.5, "lines": False, "min_side": 4, "threshold": 5}
query("d15_prepare")(lambda spark, d: P.prepare(V(spark, d), **TINY)[1])
query("d17_document_pipeline")(lambda spark, d: P.document_pipeline(V(spark, d), smart_pipeline, **TINY))


# Drawn pages: what was drawn says what has to be found, so the SQL of these queries knows nothing of how.
def drawn(spark, d):
    """The drawn pages, once."""
    return cut(R.pages(spark, d))


def truth(spark, d):
    return R.page_truth(read(spark, d, "benchmark")).select("image_id", F.col("angle").alias("drawn"), F.col("corners").alias("true"))


def boundary_pages(spark, d):
    """Each page that was drawn, the detector that found it, and whether its corners lie within 3 pixels of the drawn ones."""
    found = P.detect_boundary(drawn(spark, d), band=None, lines=True, min_side=80)
    both = found.join(truth(spark, d), "image_id", "left")
    far = F.array_max(F.zip_with("corners", "true", lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))
    return both.select("image_id", "detector", "detected", F.coalesce(far <= 3, F.lit(False)).alias("near"))


query("g5_boundary_pages", f"WITH {S.FRAMES} SELECT image_id, CASE WHEN kind = {R.SPLIT} THEN 'lines' ELSE 'region' END AS detector, true AS detected, true AS near FROM fr WHERE kind <> {R.BLANK}")(boundary_pages)


def skew_pages(spark, d):
    """Whether each page's skew is found with the confidence that deskewing asks for, and lies within 0.75 degrees of the drawn one."""
    found = P.detect_skew(drawn(spark, d)).join(truth(spark, d), "image_id", "left")
    return found.select("image_id", (F.col("confidence") >= 0.7).alias("found"), F.coalesce(F.abs(F.col("angle") - F.col("drawn")) <= 0.75, F.lit(False)).alias("near"))


query("g8_skew_pages", f"WITH {S.FRAMES} SELECT image_id, kind <> {R.BLANK} AS found, kind <> {R.BLANK} AS near FROM fr")(skew_pages)


def border_pages(spark, d):
    quads = truth(spark, d).select("image_id", F.lit(1).alias("candidate"), F.col("true").alias("corners"))
    return P.border_contrast(drawn(spark, d), quads, None).select("image_id", F.round("border_contrast", 6).alias("border_contrast"))


_AT = lambda a, b: f"(width - 1) / 2.0::DOUBLE + (c * ({a}) - s * ({b})) / 1000.0::DOUBLE, (height - 1) / 2.0::DOUBLE + (s * ({a}) + c * ({b})) / 1000.0::DOUBLE"
_CORNERS = [_AT(a, b) for a, b in ((-R.PAGE_HALF, "-half"), (R.PAGE_HALF, "-half"), (R.PAGE_HALF, "half"), (-R.PAGE_HALF, "half"))]
_SIDES = " UNION ALL ".join(f"SELECT image_id, {i} AS side, height, width, {', '.join(f'{v} AS {n}' for v, n in zip(_CORNERS[i].split(', ') + _CORNERS[(i + 1) % 4].split(', '), ('ax', 'ay', 'bx', 'y2'), strict=True))} FROM fr WHERE kind <> {R.BLANK}" for i in range(4))
A27_SQL = f"""WITH {S.PAGES}, sd0 AS ({_SIDES}),
sd AS (SELECT image_id, side, ax, ay, bx - ax AS dx, y2 - ay AS dy, greatest(5, CAST(floor(least(height, width) * 0.012::DOUBLE + 0.5) AS INTEGER)) AS z FROM sd0),
p4 AS (SELECT p.*, s.side, s.dx * (p.y - s.ay) - s.dy * (p.x - s.ax) AS a, (p.x - s.ax) * s.dx + (p.y - s.ay) * s.dy AS t, s.dx * s.dx + s.dy * s.dy AS l, (z + CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END) / 2.0::DOUBLE AS r FROM px p JOIN sd s USING (image_id)),
pi AS (SELECT *, min(a) OVER (PARTITION BY image_id, y, x) >= 0 AS inside FROM p4),
h AS (SELECT image_id, inside, v // 8 AS bin, count(*) AS n FROM pi WHERE t BETWEEN 0 AND l AND a * a <= r * r * l GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id, inside) AS p, sum(n) OVER (PARTITION BY image_id, inside) AS total FROM h),
b AS (SELECT i.image_id, i.bin, i.p, i.total FROM q i WHERE i.inside), o AS (SELECT image_id, bin, p, total FROM q WHERE NOT inside),
d AS (SELECT coalesce(b.image_id, o.image_id) AS image_id, sum(2 * pow(coalesce(b.p, 0) - coalesce(o.p, 0), 2) / (coalesce(b.p, 0) + coalesce(o.p, 0))) AS chi FROM b FULL JOIN o ON b.image_id = o.image_id AND b.bin = o.bin GROUP BY 1)
SELECT image_id, round(greatest(0, least(1, chi / 2)), 6) AS border_contrast FROM d"""
query("a27_border_pages", A27_SQL)(border_pages)
query("d15_prepare_pages")(lambda spark, d: P.prepare(drawn(spark, d))[1].select("image_id", "boundary", "deskew", "status"))


def angle_pages(spark, d):
    """Whether the smallest rectangle about each sheet (but those on a half-bright ground) has the drawn direction within half a degree, and the drawn area within 2 %."""
    f = R.page_frames(read(spark, d, "benchmark")).where(F.col("kind").isin(R.DARK, R.SHADED)).select("image_id", "half")
    sheet = drawn(spark, d).where("v >= 200").join(f.select("image_id"), "image_id", "left_semi")
    found = min_area_angle(sheet).join(truth(spark, d), "image_id").join(f, "image_id")
    turned = F.pmod(F.col("angle") - F.col("drawn"), F.lit(90.0))
    area = F.lit(4.0 * R.PAGE_HALF) * F.col("half")
    return found.select("image_id", (F.least(turned, 90 - turned) <= 0.5).alias("near"), (F.abs(F.col("area") / area - 1) <= 0.02).alias("same_area"))


query("a28_angle_pages", f"WITH {S.FRAMES} SELECT image_id, true AS near, true AS same_area FROM fr WHERE kind IN ({R.DARK}, {R.SHADED})")(angle_pages)


# Files: the drawn pages are written as images and read back.
def pages_as_files(spark, d):
    """Digest of every drawn page after the round trip through image files, and what the gate says of its file."""
    folder = new_folder(spark, "images")
    write_images(drawn(spark, d), folder)
    records, bands = read_rasters(spark, folder)
    own = records.select("image_id", F.regexp_extract("original_name", r"^(-?\d+)\.png$", 1).cast("long").alias("page"), "height", "width", F.coalesce("reject_code", F.lit("accepted")).alias("gate"))
    return Q.digest(to_gray(bands)).join(own, "image_id").drop("image_id").withColumnRenamed("page", "image_id")


query("s1_s7_image_files", f"WITH {S.PAGES}, out AS (SELECT * FROM px), dg AS ({Q.DIGEST}) SELECT dg.*, height, width, 'accepted' AS gate FROM dg JOIN fr USING (image_id)")(pages_as_files)
#: A bound that the drawn pages exceed in one side or both.
THUMB = (120, 160)
S12_SQL = f"""WITH {S.PAGES}, sc AS (SELECT image_id, height AS h, width AS w, least(1.0::DOUBLE, {THUMB[0]} / width::DOUBLE, {THUMB[1]} / height::DOUBLE) AS k FROM fr),
gl AS (SELECT *, CAST(greatest(1, round_even(h * k, 0)) AS INTEGER) AS th, CAST(greatest(1, round_even(w * k, 0)) AS INTEGER) AS tw FROM sc),
cy AS (SELECT p.*, h, w, th, tw, unnest(range(p.y * th // h, ((p.y + 1) * th - 1) // h + 1)) AS ty FROM px p JOIN gl USING (image_id)),
ov AS (SELECT *, unnest(range(x * tw // w, ((x + 1) * tw - 1) // w + 1)) AS tx FROM cy),
wt AS (SELECT image_id, ty AS y, tx AS x, v, (least((y + 1) * th, (ty + 1) * h) - greatest(y * th, ty * h)) * (least((x + 1) * tw, (tx + 1) * w) - greatest(x * tw, tx * w)) AS o FROM ov),
out AS (SELECT image_id, y, x, {Q.clip8('round(sum(o::DOUBLE * v) / sum(o), 6)')} AS v FROM wt GROUP BY ALL) {Q.DIGEST}"""
query("s12_bounded_thumbnail", S12_SQL)(lambda spark, d: Q.digest(thumbnail(drawn(spark, d), *THUMB)))
