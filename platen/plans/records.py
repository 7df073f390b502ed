"""Queries of records, geometry, lineage and evaluation, with their SQL. Segments, quadrilaterals and requests derive from the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from platen.functions import scalars as C
from platen.operators import geometry as G
from platen.operators import registry as O
from platen.operators import rules as D
from platen.plans import measure as Q
from platen.plans import sql as S
from platen.sources import rasters as R
from platen.sources.intake import check_lineage, ingest_gate, lineage_closure, read_manifest, resolve

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T, V, read = R.corpus, R.vectors, R.read


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# intake
IMAGES = "SELECT page_id AS image_id, url AS original_name, CASE WHEN page_id % 13 = 5 THEN -1 ELSE length(html) % 9000 + 1 END AS width, length(url) * 100 AS height, CASE WHEN page_id % 11 = 3 THEN 16 ELSE 8 END AS depth, CASE WHEN page_id % 17 = 2 THEN CAST(30000000 AS BIGINT) ELSE CAST(length(html) AS BIGINT) END AS byte_size FROM pages"


def images(spark, d):
    read(spark, d, "pages").createOrReplaceTempView("platen_pages")
    return spark.sql(IMAGES.replace("FROM pages", "FROM platen_pages"))


query("s4_ingest_gate", f"WITH i AS ({IMAGES}) SELECT image_id, CASE WHEN original_name = '' THEN 'EMPTY_FILENAME' WHEN regexp_extract(lower(string_split(replace(original_name, chr(92), '/'), '/')[-1]), '\\.([^.]*)$', 1) NOT IN ('825', 'jpg', 'jpeg', 'png', '') THEN 'UNSUPPORTED_FILE_TYPE' WHEN byte_size > 20971520 THEN 'FILE_TOO_LARGE' WHEN width < 1 THEN 'UNREADABLE_IMAGE' WHEN depth <> 8 THEN 'UNSUPPORTED_IMAGE_DEPTH' WHEN CAST(width AS BIGINT) * height > 30000000 THEN 'IMAGE_DIMENSIONS_TOO_LARGE' END AS reject_code FROM i")(
    lambda spark, d: ingest_gate(images(spark, d), ("825", "jpg", "jpeg", "png", "")).select("image_id", "reject_code")
)
query("s9_manifest_read", """SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events WHERE props IS NOT NULL""")(lambda spark, d: read_manifest(read(spark, d, "events"), "props", "k long").select("event_id", F.col("manifest.k").alias("k")))
query("s10_resolve", "SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN 'INVALID_ID' WHEN c_custkey IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM (SELECT o_orderkey, o_custkey + o_orderkey % 3 * 700 AS o_custkey FROM orders) o LEFT JOIN customer ON c_custkey = o_custkey")(
    lambda spark, d: resolve(read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 3 * 700).alias("id")), read(spark, d, "customer").select(F.col("c_custkey").alias("id"))).select("o_orderkey", "status")
)
query("p7_names", "SELECT page_id, string_split(replace(url, chr(92), '/'), '/')[-1] AS name, lower(regexp_extract(string_split(replace(url, chr(92), '/'), '/')[-1], '\\.([^.]*)$', 1)) AS extension FROM pages")(lambda spark, d: read(spark, d, "pages").select("page_id", C.display_filename(F.col("url")).alias("name"), C.get_extension(F.col("url")).alias("extension")))
query("p8_resource_ids", "SELECT page_id, regexp_matches(substr(md5(url), 1, CAST(28 + page_id % 5 AS INTEGER)), '^[0-9a-fA-F]{32}$') AS valid FROM pages")(lambda spark, d: read(spark, d, "pages").select("page_id", C.is_valid_resource_id(F.expr("substr(md5(url), 1, cast(28 + page_id % 5 as int))")).alias("valid")))
query("p9_parameter_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'default' ELSE translate('clip_limit_' || l_linenumber || '__grid-size_' || l_suppkey, ' .-', '___') END AS label FROM lineitem")(
    lambda spark, d: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.parameter_label(F.expr("if(l_linenumber = 3, map(), map('grid-size', cast(l_suppkey as string), 'clip_limit', cast(l_linenumber as string)))")).alias("label"))
)
query("p10_metric_value", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0) AS v FROM events")(lambda spark, d: read(spark, d, "events").select("event_id", C.metric_value(F.expr("if(event_id % 3 = 0, event_type, cast(event_id as string))")).alias("v")))
query("f1_valid_images", f"WITH i AS ({IMAGES}) SELECT image_id FROM i WHERE width > 0 AND height > 0 AND depth = 8")(lambda spark, d: images(spark, d).where("width > 0 AND height > 0 AND depth = 8").select("image_id"))

# lineage: an order's parent is the customer's order before it
RESULTS = "SELECT o_orderkey AS result_id, o_custkey AS source_image_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_result_id, CASE WHEN o_orderkey % 7 = 0 THEN 'smart' ELSE 'manual_approved' END AS kind FROM orders"


def results(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("platen_orders")
    return spark.sql(RESULTS.replace("FROM orders", "FROM platen_orders"))


query("j7_check_lineage", f"WITH r AS ({RESULTS}), q AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_linenumber = 2 THEN l_orderkey + 100000000 ELSE l_orderkey END AS source_result_id, l_linenumber AS ln FROM lineitem), p AS (SELECT q.*, o_custkey + CASE WHEN ln = 3 THEN 1 ELSE 0 END AS image_id FROM q JOIN orders ON o_orderkey = source_result_id % 100000000) SELECT request_id, CASE WHEN r.result_id IS NULL THEN 'NOT_FOUND' WHEN r.source_image_id <> p.image_id THEN 'MISMATCH' WHEN r.kind <> 'manual_approved' THEN 'INVALID_KIND' ELSE 'OK' END AS status FROM p LEFT JOIN r ON r.result_id = p.source_result_id")(
    lambda spark, d: check_lineage(
        read(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as request_id", "if(l_linenumber = 2, l_orderkey + 100000000, l_orderkey) as source_result_id", "l_orderkey", "l_linenumber")
        .join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").selectExpr("request_id", "source_result_id", "o_custkey + if(l_linenumber = 3, 1, 0) as image_id"),
        results(spark, d),
    ).select("request_id", "status")
)
query("j8_lineage_closure", f"WITH RECURSIVE r AS ({RESULTS}), c AS (SELECT result_id, result_id AS root, CAST(0 AS BIGINT) AS depth FROM r WHERE parent_result_id IS NULL UNION ALL SELECT r.result_id, c.root, c.depth + 1 FROM r JOIN c ON r.parent_result_id = c.result_id) SELECT * FROM c")(lambda spark, d: lineage_closure(results(spark, d)))

# segments and lines
SEGMENTS = "SELECT l_orderkey AS image_id, l_linenumber AS id, l_partkey % 100 AS x1, l_suppkey % 100 AS y1, l_partkey % 100 + 5 + l_orderkey % 60 AS x2, l_suppkey % 100 + (l_partkey * 7 + l_linenumber * 13) % 21 - 10 AS y2 FROM lineitem"
LEN = "round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6)"


def segments(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("platen_lines")
    s = spark.sql(SEGMENTS.replace("FROM lineitem", "FROM platen_lines"))
    a = C.segment_angle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return s.withColumns({"length": F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6), "angle": F.round(a, 6)})


SG = f"sg AS (SELECT *, {LEN} AS length, round(degrees(atan2(y2 - y1, x2 - x1)), 6) AS angle FROM ({SEGMENTS}))"
query("p12_angles", f"WITH {SG} SELECT image_id, id, angle, round(least((angle + 90 - 30) % 180, 180 - (angle + 90 - 30) % 180), 4) AS off FROM (SELECT image_id, id, angle FROM sg)".replace("(angle + 90 - 30) % 180", "abs(angle - 60) % 180"))(lambda spark, d: segments(spark, d).select("image_id", "id", "angle", F.round(C.angle_distance(F.col("angle"), F.lit(60.0)), 4).alias("off")))
query("f4_keep_segments", f"WITH {SG} SELECT image_id, id FROM sg WHERE length >= 12 AND abs(angle) <= 35")(lambda spark, d: segments(spark, d).where("length >= 12 AND abs(angle) <= 35").select("image_id", "id"))
query("a24_skew_stats", f"""WITH {SG}, md AS (SELECT image_id, quantile_cont(angle, 0.5) AS med FROM sg GROUP BY 1), dv AS (SELECT sg.*, med, abs(angle - med) AS dev FROM sg JOIN md USING (image_id)), ma AS (SELECT image_id, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY 1),
kp AS (SELECT dv.* FROM dv JOIN ma USING (image_id) WHERE round(dev, 9) <= round(greatest(1, least(6, CASE WHEN mad > 0 THEN 2.5 * mad ELSE 1.5 END)), 9)), mn AS (SELECT image_id, sum(length * angle) / sum(length) AS mean FROM kp GROUP BY 1)
SELECT image_id, round(any_value(mean), 6) AS angle, round(sqrt(sum(length * pow(angle - mean, 2)) / sum(length)), 6) AS dispersion, count(*) AS lines FROM kp JOIN mn USING (image_id) GROUP BY image_id""")(lambda spark, d: Q.rounded(G.skew_stats(segments(spark, d)), angle=6, dispersion=6))
query("g9_line_families", f"""WITH {SG}, b AS (SELECT *, CAST(floor((angle + 90) / 5.0) AS BIGINT) % 36 AS bin FROM sg), w AS (SELECT image_id, bin, sum(length) AS w FROM b GROUP BY ALL), t AS (SELECT image_id, arg_min(bin, (-round(w, 6), bin)) AS top FROM w GROUP BY 1),
f AS (SELECT b.image_id, b.id, (top + 0.5) * 5 - 90 AS main, abs(angle - ((top + 0.5) * 5 - 90)) % 180 AS d0 FROM b JOIN t USING (image_id)) SELECT image_id, id, CASE WHEN least(d0, 180 - d0) <= 20 THEN 'primary' ELSE 'secondary' END AS family FROM f WHERE least(d0, 180 - d0) <= 20 OR 90 - least(d0, 180 - d0) <= 20""")(lambda spark, d: G.line_families(segments(spark, d)).select("image_id", "id", "family"))
OFFSETS = "SELECT image_id, id, 'p' AS family, CAST(y1 AS DOUBLE) AS \"offset\" FROM sg"
query("w7_extreme_lines", f"WITH {SG}, o AS ({OFFSETS}), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY \"offset\", id) AS u, row_number() OVER (PARTITION BY image_id ORDER BY \"offset\" DESC, id) AS w FROM o) SELECT image_id, id, 'low' AS side FROM r WHERE u <= 4 UNION ALL SELECT image_id, id, 'high' FROM r WHERE w <= 4")(
    lambda spark, d: G.extremes(segments(spark, d).select("image_id", "id", F.lit("p").alias("family"), F.col("y1").cast("double").alias("offset"))).select("image_id", "id", "side")
)
query("w6_line_report", f"WITH {SG} SELECT image_id, id, length FROM sg ORDER BY length DESC, image_id, id LIMIT 30")(lambda spark, d: segments(spark, d).orderBy(F.desc("length"), "image_id", "id").limit(30).select("image_id", "id", "length"))
query("w6_weighted_angle", f"WITH {SG} SELECT image_id, count(*) AS lines, count(*) FILTER (abs(angle) <= 20) AS level, round(sum(length * angle) FILTER (abs(angle) <= 20) / sum(length) FILTER (abs(angle) <= 20), 6) AS weighted_angle FROM sg GROUP BY image_id")(lambda spark, d: Q.rounded(G.line_report(segments(spark, d)), weighted_angle=6))
query("w2_longest_per_image", f"WITH {SG} SELECT image_id, id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY length DESC, id) AS k FROM sg) WHERE k <= 2")(lambda spark, d: segments(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("length"), "id"))).where("k <= 2").select("image_id", "id"))
query("w3_best_per_image", f"WITH {SG} SELECT image_id, arg_min(id, (-length, id)) AS id FROM sg GROUP BY image_id")(lambda spark, d: segments(spark, d).groupBy("image_id").agg(F.min_by("id", F.struct(-F.col("length"), "id")).alias("id")))
query("w4_first_occurrence", "SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY l_partkey")(lambda spark, d: read(spark, d, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))).where("k = 1").select("l_partkey", "l_orderkey"))
NORMAL = "struct_pack(nx := CAST(-(y2 - y1) AS DOUBLE), ny := CAST(x2 - x1 AS DOUBLE), d := CAST(-(y2 - y1) * x1 + (x2 - x1) * y1 AS DOUBLE))"
query("p13_j11_intersections", f"WITH {SG}, n AS (SELECT image_id, id, {NORMAL} AS l FROM sg), p AS (SELECT a.image_id, a.id AS a, b.id AS b, a.l AS p, b.l AS q FROM n a JOIN n b ON a.image_id = b.image_id AND a.id < b.id), e AS (SELECT *, p.nx * q.ny - q.nx * p.ny AS det FROM p) SELECT image_id, a, b, CASE WHEN abs(det) > 1e-9 THEN (p.d * q.ny - q.d * p.ny) / det END AS ix, CASE WHEN abs(det) > 1e-9 THEN (p.nx * q.d - q.nx * p.d) / det END AS iy FROM e")(
    lambda spark, d: _intersections(segments(spark, d))
)


def _intersections(s):
    line = F.struct((-(F.col("y2") - F.col("y1"))).cast("double").alias("nx"), (F.col("x2") - F.col("x1")).cast("double").alias("ny"), (-(F.col("y2") - F.col("y1")) * F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("y1")).cast("double").alias("d"))
    n = s.select("image_id", "id", line.alias("l"))
    both = n.select("image_id", F.col("id").alias("a"), F.col("l").alias("p")).join(n.select("image_id", F.col("id").alias("b"), F.col("l").alias("q")), "image_id").where("a < b")
    return G.intersect(both, "p", "q").select("image_id", "a", "b", "ix", "iy")


#: A number of its own for each line, since line items repeat theirs.
UID = "id * 1000000000000 + x1 * 1000000000 + y1 * 1000000 + x2 * 1000 + y2 + 20"


def sides(spark, d):
    """Two lines of each side an image at most, from the line items: families by line number, offsets by their first point."""
    s = segments(spark, d)
    line = F.struct((-(F.col("y2") - F.col("y1"))).cast("double").alias("nx"), (F.col("x2") - F.col("x1")).cast("double").alias("ny"), (-(F.col("y2") - F.col("y1")) * F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("y1")).cast("double").alias("d"))
    family = F.when(F.col("id") % 2 == 0, "primary").otherwise("secondary")
    return G.extremes(s.select("image_id", F.expr(UID).alias("id"), "length", line.alias("l"), family.alias("family"), F.col("y1").cast("double").alias("offset")), 2)


SIDES = f"""{SG}, n AS (SELECT image_id, {UID} AS id, length, CASE WHEN id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS family, CAST(y1 AS DOUBLE) AS "offset", {NORMAL} AS l FROM sg),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, family ORDER BY "offset", id) AS u, row_number() OVER (PARTITION BY image_id, family ORDER BY "offset" DESC, id) AS w FROM n), e AS MATERIALIZED (SELECT *, 'low' AS side FROM r WHERE u <= 2 UNION ALL SELECT *, 'high' FROM r WHERE w <= 2),
q AS (SELECT a.image_id, a.id AS a, b.id AS b, c.id AS c, d.id AS d, (a.length + b.length + c.length + d.length) / 4 AS support, a.l.nx * c.l.ny - c.l.nx * a.l.ny AS t0, a.l.d * c.l.ny - c.l.d * a.l.ny AS x0, a.l.nx * d.l.ny - d.l.nx * a.l.ny AS t1, b.l.nx * d.l.ny - d.l.nx * b.l.ny AS t2, b.l.nx * c.l.ny - c.l.nx * b.l.ny AS t3
FROM e a JOIN e b ON a.image_id = b.image_id AND a.family = 'primary' AND b.family = 'primary' AND a.side = 'low' AND b.side = 'high' AND a.id <> b.id JOIN e c ON c.image_id = a.image_id AND c.family = 'secondary' AND c.side = 'low' JOIN e d ON d.image_id = a.image_id AND d.family = 'secondary' AND d.side = 'high' AND c.id <> d.id)"""
query("j11_quad_candidates", f"WITH {SIDES} SELECT image_id, a, b, c, d, support, x0 / t0 AS x FROM q WHERE abs(t0) > 1e-9 AND abs(t1) > 1e-9 AND abs(t2) > 1e-9 AND abs(t3) > 1e-9")(
    lambda spark, d: G.quad_candidates(sides(spark, d)).select("image_id", *[F.col("ids")[i].alias(n) for i, n in enumerate("abcd")], "support", F.col("corners")[0]["x"].alias("x"))
)
query("g9_unique_lines", f"WITH {SG}, o AS (SELECT image_id, id, CASE WHEN id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS family, CAST(y1 AS DOUBLE) AS \"offset\" FROM sg), g AS (SELECT *, \"offset\" - lag(\"offset\") OVER (PARTITION BY image_id, family ORDER BY \"offset\", id) AS gap FROM o) SELECT image_id, id, family FROM g WHERE gap IS NULL OR gap > 0.015::DOUBLE * 800")(
    lambda spark, d: G.unique_lines(segments(spark, d).select("image_id", "id", F.when(F.col("id") % 2 == 0, "primary").otherwise("secondary").alias("family"), F.col("y1").cast("double").alias("offset"), F.lit(800.0).alias("diagonal"))).select("image_id", "id", "family")
)


# quadrilaterals of a 100 x 100 frame
QX = ["o_custkey % 30", "99 - o_orderkey % 26", "97 - o_custkey % 33", "o_orderkey % 22 - o_custkey % 3"]
QY = ["o_orderkey % 28", "o_custkey % 31", "98 - o_orderkey % 19", "99 - o_custkey % 45"]


def quads(spark, d):
    corners = ", ".join(f"named_struct('x', cast({x} as double), 'y', cast({y} as double))" for x, y in zip(QX, QY, strict=True))
    return read(spark, d, "orders").selectExpr("o_orderkey as image_id", f"array({corners}) as corners", "100 as height", "100 as width")


_P = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}, CAST({y} AS DOUBLE) AS y{i}" for i, (x, y) in enumerate(zip(QX, QY, strict=True)))
_SIDE = [f"sqrt(pow(x{(i + 1) % 4} - x{i}, 2) + pow(y{(i + 1) % 4} - y{i}, 2))" for i in range(4)]


def _ang(i: int) -> str:
    a, b = (i + 3) % 4, (i + 1) % 4
    return f"CASE WHEN s{a} * s{i} > 0 THEN degrees(acos(greatest(-1, least(1, ((x{a} - x{i}) * (x{b} - x{i}) + (y{a} - y{i}) * (y{b} - y{i})) / (s{a} * s{i}))))) END"


_TURN = [f"(x{(i + 1) % 4} - x{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4}) - (y{(i + 1) % 4} - y{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4})" for i in range(4)]
_AREA = " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4))
QUADS = f"""q0 AS (SELECT o_orderkey AS image_id, {_P} FROM orders), q1 AS (SELECT *, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_SIDE))}, abs({_AREA}) / 2 / 10000 AS ar FROM q0),
q2 AS (SELECT *, {', '.join(f'{_ang(i)} AS g{i}' for i in range(4))}, least({', '.join(_TURN)}) * greatest({', '.join(_TURN)}) > 0 AS convex FROM q1),
q AS (SELECT *, CASE WHEN {' OR '.join(f'x{i} < 0 OR y{i} < 0 OR x{i} > 99 OR y{i} > 99' for i in range(4))} THEN 'outside' WHEN NOT convex THEN 'not_convex' WHEN NOT ar BETWEEN 0.18 AND 0.98 THEN 'area' WHEN least(s0, s1, s2, s3) < 0.08 * sqrt(20000) THEN 'side' WHEN NOT ({' AND '.join(f'g{i} BETWEEN 25 AND 155' for i in range(4))}) THEN 'angle' END AS reject,
{' + '.join(f'CASE WHEN x{i} <= 4 OR y{i} <= 4 OR x{i} >= 95 OR y{i} >= 95 THEN 1 ELSE 0 END' for i in range(4))} AS frame_contacts,
greatest(0, 1 - ({' + '.join(f'abs(g{i} - 90)' for i in range(4))}) / 4 / 65) AS angle_score, sqrt(least(s0, s2) / greatest(s0, s2, 1e-9) * (least(s1, s3) / greatest(s1, s3, 1e-9))) AS balance,
greatest(0, least(1, CASE WHEN ar <= 0.7 THEN (ar - 0.18) / 0.52 ELSE (0.98 - ar) / 0.28 END)) AS area_score FROM q2)"""
query("p14_quad_geometry", f"WITH {QUADS} SELECT image_id, round(s0, 4) AS s0, round(s1, 4) AS s1, round(s2, 4) AS s2, round(s3, 4) AS s3, round(g0, 3) AS g0, round(g1, 3) AS g1, round(g2, 3) AS g2, round(g3, 3) AS g3 FROM q")(
    lambda spark, d: quads(spark, d).select("image_id", *[F.round(C.quad_sides(F.col("corners"))[i], 4).alias(f"s{i}") for i in range(4)], *[F.round(C.quad_angles(F.col("corners"))[i], 3).alias(f"g{i}") for i in range(4)])
)
query("p15_area_score", f"WITH {QUADS} SELECT image_id, round(area_score, 7) AS area_score FROM q")(lambda spark, d: quads(spark, d).select("image_id", F.round(C.area_score(C.quad_area(F.col("corners")) / 10000), 7).alias("area_score")))
query("f5_f6_plausible_quads", f"WITH {QUADS} SELECT image_id, round(ar, 7) AS area_ratio, reject, frame_contacts FROM q")(lambda spark, d: Q.rounded(G.plausible_quads(quads(spark, d)).select("image_id", "area_ratio", "reject", "frame_contacts"), area_ratio=7))
scored = lambda spark, d: G.geometry_scores(G.plausible_quads(quads(spark, d)).where("reject IS NULL").withColumn("fit", F.expr("(image_id % 100) / 100D")))
CONF = "0.35 * area_score + 0.30 * angle_score + 0.20 * ((image_id % 100) / 100.0::DOUBLE) + 0.15 * balance"
query("g3_g4_scores", f"WITH {QUADS} SELECT image_id, round(angle_score, 4) AS angle_score, round(balance, 4) AS balance, round({CONF}, 4) AS confidence FROM q WHERE reject IS NULL")(lambda spark, d: Q.rounded(scored(spark, d).select("image_id", "angle_score", "balance", "confidence"), angle_score=4, balance=4, confidence=4))
query("g5_rank_boundary", f"WITH {QUADS}, k AS (SELECT image_id // 5 AS g, image_id AS candidate, round((0.62 * ({CONF}) + 0.38 * ((image_id * 7 % 50) / 50.0::DOUBLE)) * CASE WHEN frame_contacts > 0 THEN 0.78 ELSE 1 END, 6) AS score FROM q WHERE reject IS NULL) SELECT g AS image_id, arg_min(candidate, (-score, candidate)) AS candidate, max(score) AS score, max(score) >= 0.68 AS detected FROM k GROUP BY g")(
    lambda spark, d: G.rank_boundary(scored(spark, d).withColumns({"candidate": F.col("image_id"), "border_contrast": F.expr("(image_id * 7 % 50) / 50D"), "image_id": F.expr("image_id div 5")}))
)
query("g1_order_corners", f"WITH {QUADS}, e AS (SELECT image_id, unnest([struct_pack(x := x2, y := y2), struct_pack(x := x0, y := y0), struct_pack(x := x3, y := y3), struct_pack(x := x1, y := y1)]) AS c FROM q) SELECT image_id, CAST(min(c.x + c.y) AS DOUBLE) AS tl, CAST(min(c.y - c.x) AS DOUBLE) AS tr, CAST(max(c.x + c.y) AS DOUBLE) AS br, CAST(max(c.y - c.x) AS DOUBLE) AS bl FROM e GROUP BY image_id")(
    lambda spark, d: quads(spark, d).select("image_id", C.order_corners(F.shuffle("corners", 7)).alias("c")).selectExpr("image_id", "c[0].x + c[0].y as tl", "c[1].y - c[1].x as tr", "c[2].x + c[2].y as br", "c[3].y - c[3].x as bl")
)

# rasters
query("s12_thumbnail", f"WITH {S.TEXT}, out AS (SELECT image_id, y // 4 AS y, x // 4 AS x, {Q.clip8('round(avg(v), 6)')} AS v FROM px GROUP BY ALL) {Q.DIGEST}")(lambda spark, d: Q.digest(G.cell_means(T(spark, d))))
query("p11_crop", f"WITH {S.TEXT}, out AS (SELECT image_id, y - 1 AS y, x - 4 AS x, v FROM px WHERE x BETWEEN 4 AND 23 AND y BETWEEN 1 AND 10) {Q.DIGEST}")(lambda spark, d: Q.digest(G.crop(T(spark, d), 4, 1, 20, 10)))
query("a22_border_value", f"WITH {S.TEXT}, e AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1), b AS (SELECT p.*, h, w, greatest(1, floor(h * 0.02)) AS my, greatest(1, floor(w * 0.02)) AS mx FROM px p JOIN e USING (image_id)), u AS (SELECT image_id, v FROM b WHERE y < my UNION ALL SELECT image_id, v FROM b WHERE y >= h - my UNION ALL SELECT image_id, v FROM b WHERE x < mx UNION ALL SELECT image_id, v FROM b WHERE x >= w - mx) SELECT image_id, quantile_cont(v, 0.5) AS fill FROM u GROUP BY image_id")(lambda spark, d: G.border_value(T(spark, d)))
query("a28_min_area_angle", f"WITH {S.VECTOR}, pt AS (SELECT image_id, y, x FROM px WHERE v > 127), t AS (SELECT CAST(unnest(range(180)) AS INTEGER) AS i), r AS (SELECT image_id, i, x * cos(radians(i * 0.5)) + y * sin(radians(i * 0.5)) AS u, y * cos(radians(i * 0.5)) - x * sin(radians(i * 0.5)) AS w FROM pt, t), a AS (SELECT image_id, i, round((max(u) - min(u)) * (max(w) - min(w)), 6) AS area FROM r GROUP BY ALL) SELECT image_id, round(min(area), 4) AS area FROM a GROUP BY image_id")(
    lambda spark, d: Q.rounded(G.min_area_angle(V(spark, d).where("v > 127")).select("image_id", "area"), area=4)
)
query("j13_hist_distance", f"WITH {S.TEXT}, h AS (SELECT image_id, v // 8 AS bin, count(*) FILTER (x < 16) AS a, count(*) FILTER (x >= 16) AS b FROM px GROUP BY ALL), n AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY image_id), 0) AS p, b / nullif(sum(b) OVER (PARTITION BY image_id), 0) AS q FROM h) SELECT image_id, round(sum(CASE WHEN p + q > 0 THEN 2 * (p - q) * (p - q) / (p + q) END), 4) AS chi2 FROM n GROUP BY image_id")(
    lambda spark, d: Q.rounded(_halves(T(spark, d)), chi2=4)
)


def _halves(px):
    def side(test):
        h = px.where(test).groupBy("image_id", F.expr("v div 8").alias("bin")).agg(F.count("*").alias("n"))
        return h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))).drop("n")

    return G.hist_distance(side("x < 16"), side("x >= 16"))


SAMPLE = """gr AS (SELECT {keys}, sx, sy FROM {grid}), fo AS (SELECT image_id, y AS oy, x AS ox, CAST(floor(sy) AS INTEGER) + a AS y, CAST(floor(sx) AS INTEGER) + b AS x, (CASE a WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE b WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM gr, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b)),
out AS (SELECT f.image_id, f.oy AS y, f.ox AS x, """ + Q.clip8("round(sum(f.w * coalesce(p.v, {fill})), 6)") + """ AS v FROM fo f LEFT JOIN px p ON p.image_id = f.image_id AND p.y = f.y AND p.x = f.x WHERE f.w > 1e-9 GROUP BY f.image_id, f.oy, f.ox)"""
_C, _S = "cos(radians(5.0::DOUBLE))", "sin(radians(5.0::DOUBLE))"
query("g10_rotate", f"WITH {S.VECTOR}, dm AS (SELECT image_id, 8 AS h, 8 AS w, CAST(ceil(round(8 * {_S} + 8 * {_C}, 6)) AS INTEGER) AS n FROM px GROUP BY image_id), rg AS (SELECT image_id, n, unnest(range(n)) AS y FROM dm), rh AS (SELECT image_id, n, y, unnest(range(n)) AS x FROM rg), gg AS (SELECT image_id, y, x, round({_C} * (x - (n - 1) / 2.0::DOUBLE) - {_S} * (y - (n - 1) / 2.0::DOUBLE) + 3.5, 6) AS sx, round({_S} * (x - (n - 1) / 2.0::DOUBLE) + {_C} * (y - (n - 1) / 2.0::DOUBLE) + 3.5, 6) AS sy FROM rh), {SAMPLE.format(keys='image_id, y, x', grid='gg', fill=255)} {Q.DIGEST}")(
    lambda spark, d: Q.digest(G.rotate(V(spark, d), 5.0))
)
query("g11_rectify")(lambda spark, d: Q.digest(G.rectify(V(spark, d), V(spark, d).select("image_id").distinct().withColumn("corners", F.expr("array(named_struct('x', 1D, 'y', 0D), named_struct('x', 6D + image_id % 2, 'y', 1D), named_struct('x', 7D, 'y', 6D), named_struct('x', 0D, 'y', 5D + image_id % 3))")), 2)))
HOUGH = """ed AS (SELECT image_id, y, x FROM px WHERE v > 200), th AS (SELECT CAST(i AS INTEGER) AS i, cos(radians(i * 5.0::DOUBLE)) AS c, sin(radians(i * 5.0::DOUBLE)) AS s FROM (SELECT unnest(range(36)) AS i)),
vo AS (SELECT image_id, y, x, i AS theta, CAST(floor(round(x * c + y * s, 6) + 0.5) AS INTEGER) AS rho, round(y * c - x * s, 6) AS along FROM ed, th), ce AS (SELECT *, count(*) OVER (PARTITION BY image_id, theta, rho) AS n FROM vo), st AS (SELECT *, max(n) OVER (PARTITION BY image_id, y, x) AS top FROM ce WHERE n >= 4),
pk AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY theta) AS k, count(*) OVER (PARTITION BY image_id, y, x) AS m FROM st WHERE n = top), ow AS (SELECT * FROM pk WHERE k - 1 = (m - 1) // 2),
ga AS (SELECT *, CASE WHEN along - lag(along) OVER w > 1 THEN 1 ELSE 0 END AS new FROM ow WINDOW w AS (PARTITION BY image_id, theta, rho ORDER BY along, x, y)), pa AS (SELECT *, sum(new) OVER (PARTITION BY image_id, theta, rho ORDER BY along, x, y ROWS UNBOUNDED PRECEDING) AS part FROM ga),
sg AS (SELECT image_id, theta * 5.0::DOUBLE - 90 AS angle, arg_min(x, (along, x, y)) AS x1, arg_min(y, (along, x, y)) AS y1, arg_max(x, (along, x, y)) AS x2, arg_max(y, (along, x, y)) AS y2, count(*) AS votes FROM pa GROUP BY image_id, theta, rho, part)
SELECT image_id, x1, y1, x2, y2, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS length, angle, votes FROM sg WHERE round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) >= 3"""
query("g6_hough_segments", f"WITH {S.VECTOR}, {HOUGH}")(lambda spark, d: G.hough_segments(V(spark, d).where("v > 200").select(*R.KEYS), 5.0, 4, 3, 1))

# decisions on records
BEFORE = "SELECT l_orderkey * 10 + l_linenumber AS image_id, CASE l_linenumber % 6 WHEN 0 THEN 'gamma_correct' WHEN 1 THEN 'clahe' WHEN 2 THEN 'sharpen' WHEN 3 THEN 'median_denoise' WHEN 4 THEN 'illumination_normalize' ELSE 'deskew' END AS operation_id, CAST(l_partkey % 256 AS DOUBLE) AS before_brightness, CAST((l_partkey + l_suppkey) % 256 AS DOUBLE) AS after_brightness, CAST(l_suppkey % 60 AS DOUBLE) AS before_contrast, CAST((l_suppkey * 3) % 60 AS DOUBLE) AS after_contrast, CAST(l_orderkey % 500 AS DOUBLE) AS before_sharpness, CAST((l_orderkey * 7) % 500 AS DOUBLE) AS after_sharpness, CAST(l_partkey % 30 AS DOUBLE) AS before_noise, CAST(l_suppkey % 30 AS DOUBLE) AS after_noise, CAST(l_partkey % 40 AS DOUBLE) / 100 AS before_illumination_variation, CAST(l_suppkey % 40 AS DOUBLE) / 100 AS after_illumination_variation FROM lineitem"


def before_after(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("platen_lines")
    return spark.sql(BEFORE.replace("FROM lineitem", "FROM platen_lines"))


_OFF = "greatest(85 - {0}_brightness, {0}_brightness - 200, 0)"
query("d9_j9_benefit", f"WITH b AS ({BEFORE}), g AS (SELECT image_id, operation_id, round(CASE operation_id WHEN 'gamma_correct' THEN {_OFF.format('before')} - {_OFF.format('after')} WHEN 'clahe' THEN after_contrast - before_contrast WHEN 'sharpen' THEN after_sharpness - before_sharpness WHEN 'median_denoise' THEN before_noise - after_noise WHEN 'illumination_normalize' THEN before_illumination_variation - after_illumination_variation END, 6) AS gain, round(CASE operation_id WHEN 'gamma_correct' THEN 1 WHEN 'clahe' THEN 1 WHEN 'sharpen' THEN before_sharpness * 0.02 WHEN 'median_denoise' THEN 0.5 WHEN 'illumination_normalize' THEN 0.01 END, 6) AS required FROM b) SELECT *, coalesce(gain >= required, false) AS passed FROM g")(
    lambda spark, d: D.benefit(before_after(spark, d)).select("image_id", "operation_id", "gain", "required", "passed")
)
CAND = "SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS priority, CASE l_partkey % 4 WHEN 0 THEN 'gamma_correct' WHEN 1 THEN 'clahe' WHEN 2 THEN 'sharpen' ELSE 'illumination_normalize' END AS operation_id, l_suppkey % 9 <> 0 AS eligible, l_partkey % 11 <> 0 AS executed, l_partkey % 13 <> 0 AS same_size, l_suppkey % 3 <> 0 AS passed, CASE l_suppkey % 5 WHEN 0 THEN 'high_risk' WHEN 1 THEN 'caution' WHEN 2 THEN NULL ELSE 'acceptable' END AS status, CASE WHEN l_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS level FROM lineitem"
DEC = "CASE WHEN NOT executed THEN 'rejected_execution_failed' WHEN NOT same_size THEN 'rejected_dimension_change' WHEN NOT passed THEN 'rejected_no_benefit' WHEN status IS NULL THEN 'rejected_verification_failed' WHEN status = 'high_risk' THEN 'rejected_high_risk' WHEN status = 'caution' AND level = 'high' THEN 'rejected_sensitive' WHEN status = 'caution' THEN 'accepted_with_caution' ELSE 'accepted' END"


def candidates(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("platen_lines")
    return D.candidate_decision(spark.sql(CAND.replace("FROM lineitem", "FROM platen_lines")))


query("d10_candidate_decision", f"WITH c AS ({CAND}) SELECT image_id, priority, {DEC} AS decision FROM c")(lambda spark, d: candidates(spark, d).select("image_id", "priority", "decision"))
LOOP = f"""c AS ({CAND}), d AS (SELECT *, {DEC} AS decision, row_number() OVER (PARTITION BY image_id, operation_id ORDER BY priority) = 1 AS fresh FROM c), a AS (SELECT *, coalesce(sum(CASE WHEN fresh AND eligible THEN 1 ELSE 0 END) OVER w, 0) AS tries FROM d WINDOW w AS (PARTITION BY image_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, coalesce(sum(CASE WHEN fresh AND eligible AND starts_with(decision, 'accepted') AND tries < 4 THEN 1 ELSE 0 END) OVER w, 0) AS done FROM a WINDOW w AS (PARTITION BY image_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT image_id, priority, operation_id, decision, CASE WHEN NOT fresh THEN 'skipped' WHEN NOT eligible THEN 'deferred' WHEN done >= 1 OR tries >= 4 THEN 'deferred' ELSE decision END AS step_status FROM e)"""
query("d11_w5_enhancement_loop", f"WITH {LOOP} SELECT image_id, priority, step_status FROM l")(lambda spark, d: D.enhancement_loop(candidates(spark, d)).select("image_id", "priority", "step_status"))


def finals(spark, d):
    s = D.enhancement_loop(candidates(spark, d))
    n = lambda test: F.sum(test.cast("int"))
    g = s.groupBy("image_id").agg(F.count("*").alias("recommendations"), n(F.col("step_status").startswith("accepted")).alias("accepted"), n(F.col("step_status") == "accepted_with_caution").alias("cautions"), n(F.col("step_status").startswith("rejected")).alias("rejected"), n(F.col("step_status") == "deferred").alias("deferred"))
    return D.final_decision(g.withColumns({"limit_hit": F.col("rejected") >= 4, "binarized": F.lit(0), "verified": F.col("image_id") % 10 != 0}))


FINAL = f"""{LOOP}, g AS (SELECT image_id, sum(CASE WHEN starts_with(step_status, 'accepted') THEN 1 ELSE 0 END) AS ac, sum(CASE WHEN step_status = 'accepted_with_caution' THEN 1 ELSE 0 END) AS ca, sum(CASE WHEN starts_with(step_status, 'rejected') THEN 1 ELSE 0 END) AS re, sum(CASE WHEN step_status = 'deferred' THEN 1 ELSE 0 END) AS de FROM l GROUP BY 1),
fd AS (SELECT image_id, CASE WHEN ac > 0 THEN CASE WHEN image_id % 10 = 0 THEN 'review_required' WHEN ca > 0 THEN 'accepted_with_caution' ELSE 'accepted' END WHEN re >= 4 THEN 'review_required' WHEN re > 0 THEN 'unchanged_due_to_risk' WHEN de > 0 THEN 'review_required' ELSE 'no_treatment' END AS final FROM g)"""
query("d13_final_decision", f"WITH {FINAL} SELECT image_id, final FROM fd")(lambda spark, d: finals(spark, d).select("image_id", "final"))
query("a25_decision_counts", f"WITH {FINAL} SELECT final, count(*) AS n FROM fd GROUP BY final")(lambda spark, d: finals(spark, d).groupBy("final").agg(F.count("*").alias("n")))
AUDIT = """l2 AS (SELECT *, starts_with(step_status, 'accepted') AS ac, starts_with(step_status, 'rejected') AS re, max(CASE WHEN starts_with(step_status, 'accepted') THEN priority END) OVER (PARTITION BY image_id) AS last_at FROM l), v AS (
SELECT image_id, 'more_than_one_accepted' AS violation FROM l2 GROUP BY image_id HAVING count(*) FILTER (ac) > 1 UNION ALL SELECT image_id, 'more_than_four_attempts' FROM l2 GROUP BY image_id HAVING count(*) FILTER (ac OR re) > 4
UNION ALL SELECT image_id, 'operation_repeated' FROM l2 WHERE ac OR re GROUP BY image_id HAVING count(*) > count(DISTINCT operation_id) UNION ALL SELECT image_id, 'attempt_after_acceptance' FROM l2 GROUP BY image_id HAVING count(*) FILTER (re AND priority > last_at) > 0)"""
query("e2_audit", f"WITH {LOOP}, {AUDIT}, n AS (SELECT violation, count(*) AS n FROM v GROUP BY violation), k(violation) AS (VALUES ('more_than_one_accepted'), ('more_than_four_attempts'), ('operation_repeated'), ('attempt_after_acceptance')) SELECT violation, coalesce(n, 0) AS images, (SELECT count(DISTINCT image_id) FROM l) AS audited FROM k LEFT JOIN n USING (violation)")(lambda spark, d: D.audit(D.enhancement_loop(candidates(spark, d))))
query("u3_deferred", f"WITH c AS ({CAND}) SELECT DISTINCT image_id, operation_id FROM c EXCEPT SELECT image_id, operation_id FROM c WHERE eligible")(lambda spark, d: candidates(spark, d).select("image_id", "operation_id").distinct().join(candidates(spark, d).where("eligible"), ["image_id", "operation_id"], "left_anti"))
query("u2_code_overlap", f"WITH c AS ({CAND}) SELECT image_id, CAST(bool_or(operation_id IN ('clahe', 'sharpen')) AS BOOLEAN) AS hit FROM c GROUP BY image_id")(lambda spark, d: candidates(spark, d).groupBy("image_id").agg(F.arrays_overlap(F.collect_set("operation_id"), F.array(F.lit("clahe"), F.lit("sharpen"))).alias("hit")))
query("u1_union_candidates", f"WITH c AS ({CAND}) SELECT image_id, count(*) AS n FROM (SELECT image_id FROM c WHERE eligible UNION ALL SELECT image_id FROM c WHERE passed) GROUP BY image_id")(lambda spark, d: candidates(spark, d).where("eligible").select("image_id").unionByName(candidates(spark, d).where("passed").select("image_id")).groupBy("image_id").agg(F.count("*").alias("n")))

# registry
#: Requests with every parameter of the catalogue, unknown operations and parameters, and values on both sides of every limit.
NAMED = ", ".join(f"({i}, '{op}', '{name}')" for i, (op, name, *_) in enumerate([*O.PARAMETERS, ("no_such_operation", "angle"), ("clahe", "no_such_parameter"), ("otsu_threshold", "threshold")]))
COUNT = len(O.PARAMETERS) + 3
REQ = f"SELECT o_orderkey AS request_id, r.operation_id, r.parameter, CASE o_custkey % 4 WHEN 0 THEN o_custkey % 300 - 120 WHEN 1 THEN o_custkey % 21 ELSE (o_custkey % 50) / 10.0D - 1 END AS value FROM orders JOIN (VALUES {NAMED}) r(k, operation_id, parameter) ON o_orderkey % {COUNT} = r.k"
REQ_SQL = REQ.replace("10.0D", "10.0::DOUBLE")
#: The limits, written out.
LIMITS = """CASE operation_id || '.' || parameter WHEN 'clahe.clip_limit' THEN value > 0 WHEN 'clahe.tile_grid_size' THEN value >= 2 WHEN 'median_denoise.kernel_size' THEN value >= 3 AND value % 2 = 1 WHEN 'sharpen.amount' THEN value BETWEEN 0 AND 2 WHEN 'sharpen.sigma' THEN value > 0 AND value <= 5 WHEN 'global_threshold.threshold' THEN value BETWEEN 0 AND 255
WHEN 'adaptive_threshold.block_size' THEN value >= 3 AND value % 2 = 1 WHEN 'adaptive_threshold.c' THEN true WHEN 'morphological_opening.kernel_size' THEN value >= 3 AND value % 2 = 1 WHEN 'morphological_closing.kernel_size' THEN value >= 3 AND value % 2 = 1 WHEN 'bilateral_denoise.diameter' THEN value > 0 WHEN 'bilateral_denoise.sigma_color' THEN value > 0 WHEN 'bilateral_denoise.sigma_space' THEN value > 0
WHEN 'non_local_means_denoise.strength' THEN value > 0 WHEN 'non_local_means_denoise.template_window_size' THEN value >= 3 AND value % 2 = 1 WHEN 'non_local_means_denoise.search_window_size' THEN value >= 3 AND value % 2 = 1 WHEN 'illumination_normalize.kernel_size' THEN value >= 15 AND value % 2 = 1 WHEN 'illumination_normalize.strength' THEN value > 0 AND value <= 1 WHEN 'gamma_correct.gamma' THEN value > 0
WHEN 'intensity_adjust.alpha' THEN value > 0 WHEN 'intensity_adjust.beta' THEN value BETWEEN -100 AND 100 WHEN 'faded_text_enhance.clip_limit' THEN value > 0 WHEN 'faded_text_enhance.gamma' THEN value > 0 WHEN 'background_suppress.kernel_size' THEN value >= 15 AND value % 2 = 1 WHEN 'background_suppress.strength' THEN value > 0 AND value <= 1 WHEN 'weak_structure_suppress.kernel_size' THEN value >= 15 AND value % 2 = 1
WHEN 'weak_structure_suppress.threshold' THEN value > 0 WHEN 'weak_structure_suppress.strength' THEN value > 0 AND value <= 1 WHEN 'morphological_top_hat.kernel_size' THEN value >= 3 AND value % 2 = 1 WHEN 'morphological_black_hat.kernel_size' THEN value >= 3 AND value % 2 = 1 WHEN 'deskew.angle' THEN value BETWEEN -45 AND 45 ELSE false END"""
SIDE = "CASE WHEN operation_id IN ('clahe', 'gamma_correct', 'illumination_normalize', 'median_denoise', 'sharpen') THEN 'automatic' WHEN operation_id = 'intensity_adjust' THEN 'free' ELSE 'manual' END"


def requests(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("platen_orders")
    return spark.sql(REQ.replace("FROM orders", "FROM platen_orders")).withColumn("value", F.col("value").cast("double"))


query("j6_resolve_operations", f"WITH r AS ({REQ_SQL}) SELECT request_id, CASE WHEN operation_id = 'no_such_operation' THEN 'UNKNOWN_OPERATION' ELSE 'OK' END AS status FROM r")(lambda spark, d: O.resolve_operations(requests(spark, d)).select("request_id", "status"))
query("f2_validate_parameters", f"WITH r AS ({REQ_SQL}) SELECT request_id, {LIMITS} AS valid FROM r")(lambda spark, d: O.validate_parameters(requests(spark, d)).select("request_id", "valid"))
query("r1_d18_operations", f"WITH r AS ({REQ_SQL}) SELECT operation_id, {SIDE} AS side, 1 AS most_accepted, 4 AS most_attempts, count(*) AS n FROM r WHERE operation_id <> 'no_such_operation' GROUP BY ALL")(lambda spark, d: O.policy(spark).join(requests(spark, d), "operation_id").groupBy("operation_id", "side", "most_accepted", "most_attempts").agg(F.count("*").alias("n")))
query("r3_parameter_steps", f"WITH r AS ({REQ_SQL}), c(operation_id, parameter, base, step) AS (VALUES {', '.join(f"('{op}', '{name}', {float(base)}::DOUBLE, {float(step)}::DOUBLE)" for op, name, base, _, _, step, _ in O.PARAMETERS)}) SELECT request_id, base + step * floor(value / 3) AS stepped FROM r JOIN c USING (operation_id, parameter)")(
    lambda spark, d: requests(spark, d).join(O.parameter_catalog(spark), ["operation_id", "parameter"]).select("request_id", (F.col("default") + F.col("step") * F.floor(F.col("value") / 3)).alias("stepped"))
)
query("j10_parameter_sweep", f"WITH {S.VECTOR}, g AS (SELECT * FROM (VALUES (0.65::DOUBLE), (0.85::DOUBLE), (1.15::DOUBLE), (1.35::DOUBLE)) t(gamma)), s AS (SELECT image_id, gamma, {Q.trunc8('round(pow(v / 255.0::DOUBLE, gamma) * 255, 9)')} AS v FROM px, g) SELECT image_id, gamma, round(avg(v), 3) AS brightness, round(stddev_pop(v), 3) AS contrast FROM s GROUP BY ALL")(
    lambda spark, d: O.sweep_gamma(V(spark, d), (0.65, 0.85, 1.15, 1.35)).groupBy("image_id", "gamma").agg(F.round(F.avg("v"), 3).alias("brightness"), F.round(F.stddev_pop("v"), 3).alias("contrast"))
)
_T = {"gamma_085": f"SELECT image_id * 8 AS image_id, y, x, {Q.trunc8('round(pow(v / 255.0::DOUBLE, 0.85::DOUBLE) * 255, 9)')} AS v FROM px", "gamma_070": f"SELECT image_id * 8 + 1, y, x, {Q.trunc8('round(pow(v / 255.0::DOUBLE, 0.7::DOUBLE) * 255, 9)')} FROM px", "intensity_weak": f"SELECT image_id * 8 + 2, y, x, {Q.clip8('abs(round(v * 1.05::DOUBLE + 5, 9))')} FROM px"}
_NINE = "(n0, n1, n2, n3, n4, n5, n6, n7, n8)"
E3_SQL = f"""WITH {S.VECTOR}, {S.around('px', 'oa', 'ignore')}, om AS (SELECT image_id, y, x, least{_NINE} AS v FROM oa), {S.around('om', 'ob', 'ignore')}, {S.around('px', 'ca', 'ignore')}, cm AS (SELECT image_id, y, x, greatest{_NINE} AS v FROM ca), {S.around('cm', 'cb', 'ignore')},
tr AS ({_T['gamma_085']} UNION ALL {_T['gamma_070']} UNION ALL {_T['intensity_weak']} UNION ALL SELECT image_id * 8 + 3, y, x, greatest{_NINE} FROM ob UNION ALL SELECT image_id * 8 + 4, y, x, least{_NINE} FROM cb)
SELECT p.image_id, ['gamma_085', 'gamma_070', 'intensity_weak', 'opening_k3', 'closing_k3'][t.image_id % 8 + 1] AS candidate, count(*) AS pixels, count(*) FILTER (abs(p.v - t.v) > 3) AS changed, CAST(sum(abs(p.v - t.v)) AS BIGINT) AS change FROM tr t JOIN px p ON p.image_id = t.image_id // 8 AND p.y = t.y AND p.x = t.x GROUP BY ALL"""
query("e3_candidate_changes", E3_SQL)(lambda spark, d: O.compare_candidates(R.vector_corpus_lines(spark, d), ("exposure", "structure"), verify=False).where(F.col("candidate").isin(*_T, "opening_k3", "closing_k3")).select("image_id", "candidate", "pixels", "changed", "change"))
query("e3_compare_candidates")(lambda spark, d: Q.rounded(O.compare_candidates(R.vector_corpus_lines(spark, d), ("structure",)), brightness=3, contrast=3, sharpness=3, noise=3, illumination_variation=4))
query("e1_operation_evaluation")(lambda spark, d: O.evaluate_operations(R.vector_corpus_lines(spark, d)))
query("d14_smart_pipeline")(lambda spark, d: O.smart_pipeline(R.conditioned(V(spark, d))))
