"""Queries of preservation, rules and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from platen.operators import metrics as M
from platen.operators import preservation as P
from platen.operators import rules as D
from platen.operators import stencil as K
from platen.operators.histogram import gamma_correct, global_threshold
from platen.operators.registry import OPERATIONS, binarization_candidates
from platen.plans import measure as Q
from platen.plans import sql as S
from platen.sources import rasters as R
from platen.sources.store import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def corpus(spark, d):
    """Vector rasters in the audit corpus's conditions."""
    return R.conditioned(R.vectors(spark, d))


CORPUS = S.VECTOR.replace("px AS MATERIALIZED", "vx AS") + f", px AS MATERIALIZED (SELECT image_id, y, x, CAST(CASE image_id % 8 {S._CASES} ELSE v END AS INTEGER) AS v FROM vx)"
METRICS = f"""{CORPUS}, tn AS ({Q.TONE}), {S.around('px', 'nb')}, sh AS ({Q.SHARP}), {S.around('px', 'nm', 'replicate')}, {Q.RESIDUAL}, nz AS ({Q.NOISE}),
{S.blurred('px', 'gl', K.gaussian_kernel(0, 3.0))}, il AS ({Q.ILLUM}), {Q.AUTO}, {Q.canny_sql('pt', 'lo', 'hi', 'lo,hi')},
ed AS (SELECT p.image_id, round(coalesce((SELECT count(*) FROM edges e WHERE e.image_id = p.image_id), 0)::DOUBLE / count(*), 4) AS edge_density FROM px p GROUP BY p.image_id),
m AS MATERIALIZED (SELECT * FROM tn JOIN sh USING (image_id) JOIN nz USING (image_id) JOIN il USING (image_id) JOIN ed USING (image_id))"""


def measured(spark, d, heavy: bool = True):
    """The metrics that rules use, rounded as they are reported."""
    px = corpus(spark, d)
    m = M.tone(px).join(M.sharpness(px), "image_id").join(M.noise(px), "image_id").join(M.illumination(px), "image_id")
    places = {"brightness": 3, "contrast": 3, "dynamic_range": 3, "dark_clipped_ratio": 4, "bright_clipped_ratio": 4, "sharpness": 3, "noise": 3, "noise_p90": 3, "affected_ratio": 4, "impulse_ratio": 4, "illumination_variation": 4}
    if heavy:
        m, places = m.join(M.edge_density(px), "image_id"), places | {"edge_density": 4}
    return cut(Q.rounded(m, **places))


DIAG = """dg AS MATERIALIZED (SELECT image_id, CASE WHEN brightness < 55 THEN 'very_dark' ELSE 'dark' END AS code, CASE WHEN brightness < 55 THEN 'high' ELSE 'medium' END AS severity FROM m WHERE brightness < 85
UNION ALL SELECT image_id, CASE WHEN brightness > 220 THEN 'very_bright' ELSE 'bright' END, CASE WHEN brightness > 220 THEN 'high' ELSE 'medium' END FROM m WHERE brightness > 200
UNION ALL SELECT image_id, CASE WHEN contrast < 20 THEN 'very_low_contrast' ELSE 'low_contrast' END, CASE WHEN contrast < 20 THEN 'high' ELSE 'medium' END FROM m WHERE contrast < 35
UNION ALL SELECT image_id, CASE WHEN sharpness < 25 THEN 'very_low_sharpness' ELSE 'low_sharpness' END, CASE WHEN sharpness < 25 THEN 'high' ELSE 'medium' END FROM m WHERE sharpness < 60
UNION ALL SELECT image_id, CASE WHEN noise > 20 OR (noise <= 12 AND impulse_ratio >= 0.012) THEN 'high_noise' ELSE 'moderate_noise' END, CASE WHEN noise > 20 OR (noise <= 12 AND impulse_ratio >= 0.012) THEN 'high' ELSE 'medium' END FROM m WHERE noise > 12 OR impulse_ratio >= 0.004
UNION ALL SELECT image_id, CASE WHEN illumination_variation > 0.18 THEN 'strong_uneven_illumination' ELSE 'uneven_illumination' END, CASE WHEN illumination_variation > 0.18 THEN 'high' ELSE 'medium' END FROM m WHERE illumination_variation > 0.10)"""
PROFILE = "pp AS (SELECT image_id, CASE WHEN edge_density >= 0.12 THEN 2 ELSE 0 END + CASE WHEN contrast < 35 THEN 1 ELSE 0 END + CASE WHEN sharpness < 60 THEN 1 ELSE 0 END + CASE WHEN dynamic_range < 60 THEN 1 ELSE 0 END AS points FROM m), pl AS (SELECT image_id, points, CASE WHEN points >= 3 THEN 'high' WHEN points >= 1 THEN 'moderate' ELSE 'low' END AS level FROM pp)"
_SEV = ", ".join(f"CASE WHEN bool_or(code = '{h}') THEN 'high' WHEN bool_or(code = '{m}') THEN 'medium' ELSE 'none' END AS {k}" for k, (m, h) in D.CONDITIONS.items())
CONDITIONS = f"""c0 AS (SELECT m.image_id, any_value(m.noise) AS nl, any_value(m.impulse_ratio) AS ir, {_SEV} FROM m LEFT JOIN dg USING (image_id) GROUP BY m.image_id),
c AS MATERIALIZED (SELECT c0.*, pl.level, c0.noise <> 'none' AND ir >= 0.012 AS impulse_noise, c0.noise <> 'none' AND NOT ir >= 0.012 AND nl > 0 AS gaussian_noise FROM c0 JOIN pl USING (image_id))"""
FULL = f"{METRICS}, {DIAG}, {PROFILE}, {CONDITIONS}"
W = "WITH RECURSIVE "

query("d1_diagnoses", f"{W}{METRICS}, {DIAG} SELECT * FROM dg")(lambda spark, d: D.diagnose(measured(spark, d, False)))
query("d1_diagnosis_counts", f"{W}{METRICS}, {DIAG} SELECT code, severity, count(*) AS n FROM dg GROUP BY ALL")(lambda spark, d: D.diagnose(measured(spark, d, False)).groupBy("code", "severity").agg(F.count("*").alias("n")))
query("a26_code_sets", f"{W}{METRICS}, {DIAG} SELECT image_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM dg GROUP BY image_id")(lambda spark, d: D.code_set(D.diagnose(measured(spark, d, False))).select("image_id", F.array_join("codes", ",").alias("codes")))
query("a12_preservation_profile", f"{W}{METRICS}, {PROFILE} SELECT image_id, points, level, concat_ws(',', CASE WHEN edge_density >= 0.12 THEN 'dense_edge_structure' END, CASE WHEN contrast < 35 THEN 'weak_contrast_details' END, CASE WHEN sharpness < 60 THEN 'weak_edge_definition' END, CASE WHEN dynamic_range < 60 THEN 'limited_dynamic_range' END) AS indicators FROM pl JOIN m USING (image_id)")(
    lambda spark, d: D.preservation_profile(measured(spark, d)).withColumn("indicators", F.array_join("indicators", ","))
)
RECORD = ["brightness", "contrast", "dynamic_range", "sharpness", "noise", "impulse_ratio", "illumination_variation", "edge_density"]
query("a11_full_record", f"{W}{METRICS}, {DIAG}, {PROFILE}, cs AS (SELECT image_id, string_agg(code || ':' || severity, ',' ORDER BY code) AS diagnoses FROM dg GROUP BY image_id) SELECT m.image_id, {', '.join(RECORD)}, points, level, coalesce(diagnoses, '') AS diagnoses FROM m JOIN pl USING (image_id) LEFT JOIN cs USING (image_id)")(
    lambda spark, d: D.analyze(measured(spark, d)).select("image_id", *RECORD, "points", "level", F.array_join(F.transform("diagnoses", lambda x: F.concat_ws(":", x["code"], x["severity"])), ",").alias("diagnoses"))
)
COLS = ["image_id", *D.CONDITIONS, "level", "impulse_noise", "gaussian_noise"]
query("d2_conditions", f"{W}{FULL} SELECT {', '.join(COLS)} FROM c")(lambda spark, d: D.conditions(measured(spark, d)).select(*COLS))


def of_conditions(name: str, f, sql: str):
    query(name, f"{W}{FULL} {sql}")(lambda spark, d: f(cut(D.conditions(measured(spark, d)))))


of_conditions("d3_conflicts", D.conflicts, """SELECT image_id, 'NOISE_SHARPNESS_CONFLICT' AS code, 'high' AS severity FROM c WHERE noise <> 'none' AND low_sharpness <> 'none'
UNION ALL SELECT image_id, 'GAUSSIAN_NOISE_MANUAL_REVIEW', 'medium' FROM c WHERE gaussian_noise UNION ALL SELECT image_id, 'ILLUMINATION_CONTRAST_ORDER', 'medium' FROM c WHERE uneven <> 'none' AND low_contrast <> 'none'
UNION ALL SELECT image_id, 'ILLUMINATION_DARKNESS_ORDER', 'medium' FROM c WHERE uneven <> 'none' AND dark <> 'none' UNION ALL SELECT image_id, 'DARK_LOW_CONTRAST_SEQUENCE', 'medium' FROM c WHERE dark <> 'none' AND low_contrast <> 'none'
UNION ALL SELECT image_id, 'BRIGHT_LOW_CONTRAST_SEQUENCE', 'medium' FROM c WHERE bright <> 'none' AND low_contrast <> 'none'""")
of_conditions("d4_blocked", D.blocked, """SELECT image_id, 'sharpen' AS operation_id, 'noise' AS rule FROM c WHERE noise <> 'none'
UNION ALL SELECT image_id, op, CASE WHEN level = 'high' THEN 'sensitivity' ELSE 'gaussian' END FROM c, (VALUES ('bilateral_denoise'), ('non_local_means_denoise')) t(op) WHERE gaussian_noise OR level = 'high'
UNION ALL SELECT image_id, op, 'sensitivity' FROM c, (VALUES ('median_denoise'), ('morphological_opening'), ('morphological_closing')) t(op) WHERE level = 'high' UNION ALL SELECT image_id, 'clahe', 'uneven' FROM c WHERE uneven <> 'none'""")
of_conditions("d5_parameters", D.parameters, "SELECT image_id, CASE WHEN level = 'high' THEN 1.2::DOUBLE WHEN low_contrast = 'high' THEN 2.0 ELSE 1.5 END AS clip_limit, CASE WHEN level = 'high' THEN 0.45::DOUBLE ELSE 0.65 END AS strength, CASE WHEN dark = 'high' THEN 0.65::DOUBLE ELSE 0.85 END AS gamma_dark, CASE WHEN bright = 'high' THEN 1.35::DOUBLE ELSE 1.15 END AS gamma_bright FROM c")
RECS = """SELECT image_id, 10 AS priority, 'illumination_normalize' AS operation_id, CASE WHEN level = 'high' THEN 0.45::DOUBLE ELSE 0.65 END AS parameter, 'enhancement' AS mode, 'medium' AS risk FROM c WHERE uneven <> 'none'
UNION ALL SELECT image_id, 20, 'gamma_correct', CASE WHEN dark = 'high' THEN 0.65 ELSE 0.85 END, 'enhancement', 'low' FROM c WHERE dark <> 'none' UNION ALL SELECT image_id, 25, 'gamma_correct', CASE WHEN bright = 'high' THEN 1.35 ELSE 1.15 END, 'enhancement', 'low' FROM c WHERE dark = 'none' AND bright <> 'none'
UNION ALL SELECT image_id, 30, 'clahe', CASE WHEN level = 'high' THEN 1.2 WHEN low_contrast = 'high' THEN 2.0 ELSE 1.5 END, 'enhancement', 'medium' FROM c WHERE low_contrast <> 'none' AND uneven = 'none'
UNION ALL SELECT image_id, 40, 'median_denoise', 3, 'enhancement', 'medium-high' FROM c WHERE impulse_noise AND level <> 'high' UNION ALL SELECT image_id, 50, 'sharpen', 0.25, 'enhancement', 'medium' FROM c WHERE low_sharpness <> 'none' AND noise = 'none' AND level <> 'high'
UNION ALL SELECT image_id, 70, 'adaptive_threshold', 35, 'binarization', 'medium-high' FROM c WHERE uneven <> 'none'"""
of_conditions("d6a_recommendations", D.recommend, RECS)
of_conditions("w1_recommendation_order", lambda c: D.recommend(c).select("image_id", "operation_id", F.row_number().over(Window.partitionBy("image_id").orderBy("priority", "operation_id")).alias("place")), f"SELECT image_id, operation_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY priority, operation_id) AS INTEGER) AS place FROM ({RECS})")
AUTOMATIC = [k for k, (_, _, side) in OPERATIONS.items() if side == "automatic"]
of_conditions("f7_eligible", lambda c: D.recommend(c).where((F.col("mode") == "enhancement") & F.col("operation_id").isin(*AUTOMATIC)).select("image_id", "priority", "operation_id"), f"SELECT image_id, priority, operation_id FROM ({RECS}) WHERE mode = 'enhancement' AND operation_id IN ('clahe', 'gamma_correct', 'illumination_normalize', 'median_denoise', 'sharpen')")


def split_auto(c):
    """Every recommendation as automatic or deferred, by semi and anti join with the allow-list."""
    recs = D.recommend(c).select("image_id", "operation_id")
    allowed = c.sparkSession.createDataFrame([(a,) for a in AUTOMATIC], "operation_id string")
    side = lambda how, name: recs.join(F.broadcast(allowed), "operation_id", how).select("image_id", "operation_id", F.lit(name).alias("side"))
    return side("left_semi", "automatic").unionByName(side("left_anti", "deferred"))


of_conditions("j12_split_auto", split_auto, f"SELECT image_id, operation_id, CASE WHEN operation_id IN ('clahe', 'gamma_correct', 'illumination_normalize', 'median_denoise', 'sharpen') THEN 'automatic' ELSE 'deferred' END AS side FROM ({RECS})")
BINARIZED = f"{S.blurred('px', 'gb', K.gaussian_kernel(35), 'replicate')}, out AS (SELECT image_id, y, x, CASE WHEN v > floor(g + 0.5) - 11 THEN 255 ELSE 0 END AS v FROM gb)"


def binarized(spark, d):
    px = cut(corpus(spark, d))
    rasters, records = binarization_candidates(px, cut(D.recommend(cut(D.conditions(measured(spark, d))))))
    return records.join(Q.digest(rasters).select("image_id", "n", "total"), "image_id").select("image_id", "operation_id", "parameter", "decision", "n", "total")


query("d12_binarization_candidates", f"{W}{FULL}, {BINARIZED}, rc AS ({RECS}), dg2 AS ({Q.DIGEST}) SELECT rc.image_id, operation_id, parameter::DOUBLE AS parameter, 'review_required' AS decision, n, total FROM rc JOIN dg2 USING (image_id) WHERE mode = 'binarization'")(binarized)
of_conditions("d6a_avoid", D.avoid, """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k) - 1 AS INTEGER) AS seq, op AS operation_id FROM (
SELECT image_id, 0 AS k, 'median_denoise' AS op FROM c WHERE impulse_noise AND level = 'high' UNION ALL SELECT image_id, 1, 'bilateral_denoise' FROM c WHERE noise <> 'none' AND NOT impulse_noise UNION ALL SELECT image_id, 2, 'non_local_means_denoise' FROM c WHERE noise <> 'none' AND NOT impulse_noise
UNION ALL SELECT image_id, 3, 'sharpen' FROM c WHERE low_sharpness <> 'none' AND (noise <> 'none' OR level = 'high') UNION ALL SELECT image_id, 4 + k, op FROM c, (VALUES (0, 'histogram_equalization'), (1, 'global_threshold'), (2, 'morphological_opening'), (3, 'morphological_closing')) t(k, op))""")
of_conditions("d6b_candidate_plan", D.candidate_plan, """SELECT image_id, CASE WHEN uneven <> 'none' THEN 10 WHEN dark <> 'none' THEN 20 ELSE 25 END AS priority, CASE WHEN uneven <> 'none' THEN 'illumination_normalize' ELSE 'gamma_correct' END AS operation_id, 'candidate' AS mode, true AS automatic FROM c WHERE uneven <> 'none' OR dark <> 'none' OR bright <> 'none'
UNION ALL SELECT image_id, 30, 'clahe', 'candidate', true FROM c WHERE low_contrast <> 'none' AND uneven = 'none' UNION ALL SELECT image_id, 40, CASE WHEN impulse_noise THEN 'median_denoise' END, CASE WHEN impulse_noise THEN 'candidate' ELSE 'manual_review' END, false FROM c WHERE noise <> 'none'
UNION ALL SELECT image_id, 50, 'sharpen', 'candidate', true FROM c WHERE low_sharpness <> 'none' AND noise = 'none'""")
of_conditions("e6_condition_report", lambda c: D.requires_treatment(c).join(c, "image_id").groupBy("requires_treatment", "level", "dark", "noise").agg(F.count("*").alias("n")), "SELECT NOT (dark = 'none' AND bright = 'none' AND low_contrast = 'none' AND low_sharpness = 'none' AND noise = 'none' AND uneven = 'none') AS requires_treatment, level, dark, noise, count(*) AS n FROM c GROUP BY ALL")

# preservation: the raster against treatments of it
PAIR = "{src}, pr AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.v AS v0, b.v AS v1 FROM px a JOIN tr b USING (image_id, y, x))"
BINARY = PAIR.format(src=f"{S.TEXT}, tr AS (SELECT image_id, y, x, CASE WHEN v > 100 THEN 255 ELSE 0 END AS v FROM px)")
GAMMA = PAIR.format(src=f"{S.TEXT}, tr AS (SELECT image_id, y, x, {Q.trunc8('round(pow(v / 255.0::DOUBLE, 1.35::DOUBLE) * 255, 9)')} AS v FROM px)")
binary = lambda spark, d: P.with_original(R.corpus(spark, d), lambda px: global_threshold(px, 100))
darker = lambda spark, d: P.with_original(R.corpus(spark, d), lambda px: gamma_correct(px, 1.35))
query("j1_a16_a23_similarity", f"WITH {GAMMA} SELECT image_id, round(1 - avg(abs(v0 - v1)) / 255, 4) AS structure_similarity, round(avg(CASE WHEN abs(v0 - v1) > 3 THEN 1 ELSE 0 END), 4) AS changed_ratio, round(avg(abs(v0 - v1)), 3) AS mean_change FROM pr GROUP BY image_id")(lambda spark, d: Q.rounded(P.similarity(darker(spark, d)), structure_similarity=4, changed_ratio=4, mean_change=3))
CLIP = "cl AS (SELECT image_id, avg(CASE WHEN v1 <= 10 OR v1 >= 245 THEN 1 ELSE 0 END) > 0.9 AS bo, greatest(0, avg(CASE WHEN v1 <= 5 THEN 1 ELSE 0 END) - avg(CASE WHEN v0 <= 5 THEN 1 ELSE 0 END)) AS d, greatest(0, avg(CASE WHEN v1 >= 250 THEN 1 ELSE 0 END) - avg(CASE WHEN v0 >= 250 THEN 1 ELSE 0 END)) AS b FROM pr GROUP BY image_id) SELECT image_id, bo AS binary_output, CASE WHEN bo THEN 0 ELSE round(d, 4) END AS new_dark_clipped_ratio, CASE WHEN bo THEN 0 ELSE round(b, 4) END AS new_bright_clipped_ratio, CASE WHEN bo THEN 0 ELSE round(d + b, 4) END AS total_new_clipping FROM cl"
for name, sql, f in (("a17_clipping_gamma", GAMMA, darker), ("a17_clipping_binary", BINARY, binary)):
    query(name, f"WITH {sql}, {CLIP}")(lambda spark, d, f=f: Q.rounded(P.clipping_change(f(spark, d)), new_dark_clipped_ratio=4, new_bright_clipped_ratio=4, total_new_clipping=4))
query("a20_ink", f"WITH {BINARY}, {S.otsu('px', 'ot')}, ik AS (SELECT image_id, avg(CASE WHEN v0 < t THEN 1 ELSE 0 END) AS o, avg(CASE WHEN v1 < t THEN 1 ELSE 0 END) AS p FROM pr JOIN ot USING (image_id) GROUP BY image_id) SELECT image_id, round(CASE WHEN o <= 1e-6 THEN 1 ELSE least(5, p / o) END, 4) AS ink_retention, round(CASE WHEN o <= 1e-6 THEN 1 ELSE least(5, p / o) END, 4) AS ink_inflation_ratio FROM ik")(lambda spark, d: Q.rounded(P.ink_metrics(binary(spark, d)), ink_retention=4, ink_inflation_ratio=4))
query("a19_isolated_impulse", f"WITH {S.TEXT}, {S.around('px', 'nm', 'replicate')}, im AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN abs(v - list_sort([n0, n1, n2, n3, n4, n5, n6, n7, n8])[5]) >= 100 THEN 1 ELSE 0 END AS v FROM nm), {S.around('im', 'ni')} SELECT image_id, round(avg(CASE WHEN v = 1 AND n0 + n1 + n2 + n3 + n5 + n6 + n7 + n8 = 0 THEN 1 ELSE 0 END), 5) AS isolated_impulse_ratio FROM ni GROUP BY image_id")(
    lambda spark, d: P.isolated_impulse_ratio(R.corpus_image_lines(spark, d)).select("image_id", F.round("isolated_impulse_ratio", 5).alias("isolated_impulse_ratio"))
)
LAPV = "list_sort([n0, n1, n2, n3, n4, n5, n6, n7, n8])[5]"
query("a18_smoothing", f"WITH {S.VECTOR}, {S.around('px', 'n1m', 'replicate')}, a0 AS MATERIALIZED (SELECT image_id, y, x, {LAPV} AS v FROM n1m), {S.around('a0', 'n2m', 'replicate')}, b0 AS MATERIALIZED (SELECT image_id, y, x, {LAPV} AS v FROM n2m), {S.around('a0', 'la')}, {S.around('b0', 'lb')}, va AS (SELECT image_id, var_pop(n1 + n3 + n5 + n7 - 4 * n4) AS a FROM la GROUP BY 1), vb AS (SELECT image_id, var_pop(n1 + n3 + n5 + n7 - 4 * n4) AS b FROM lb GROUP BY 1) SELECT image_id, round(CASE WHEN a < 1e-6 THEN 1 ELSE least(2, greatest(0, b / a)) END, 4) AS smoothing_ratio FROM va JOIN vb USING (image_id)")(
    lambda spark, d: Q.rounded(P.smoothing_ratio(K.median_denoise(R.vectors(spark, d).withColumn("v0", F.col("v")), 3, "v", "v1")), smoothing_ratio=4)
)
query("j2_match_size", f"WITH {S.VECTOR}, ov AS (SELECT p.image_id, t.t AS y, u.t AS x, p.v, greatest(0, least((p.y + 1) * 5, (t.t + 1) * 8) - greatest(p.y * 5, t.t * 8)) * greatest(0, least((p.x + 1) * 3, (u.t + 1) * 8) - greatest(p.x * 3, u.t * 8)) AS w FROM px p, (SELECT CAST(unnest(range(5)) AS INTEGER) AS t) t, (SELECT CAST(unnest(range(3)) AS INTEGER) AS t) u), out AS (SELECT image_id, y, x, {Q.clip8('round(sum(w::DOUBLE * v) / sum(w), 6)')} AS v FROM ov WHERE w > 0 GROUP BY ALL) {Q.DIGEST}")(
    lambda spark, d: Q.digest(P.match_size(R.vectors(spark, d), R.dimensions(R.vectors(spark, d)).select("image_id", F.lit(5).alias("height"), F.lit(3).alias("width"))))
)
query("a21_d7_d8_median_report")(lambda spark, d: P.verify_preservation(corpus(spark, d), K.median_denoise(corpus(spark, d))).withColumn("warnings", F.to_json("warnings")))
query("a21_d7_d8_threshold_report")(lambda spark, d: P.verify_pairs(P.with_original(corpus(spark, d), lambda px: global_threshold(px, 127))).withColumn("warnings", F.to_json("warnings")))


# Preservation metrics of pairs: every vector raster against itself in four steps of gray.
def stepped(spark, d):
    return R.vectors(spark, d).select(*R.KEYS, F.col("v").alias("v0"), (F.col("v") - F.col("v") % 64).alias("v1"))


_STRETCH = lambda c: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN {Q.clip8(f'({c} - min({c}) OVER w) * 255::DOUBLE / (max({c}) OVER w - min({c}) OVER w)')} ELSE 0 END AS v"
STACKED = f"""{S.VECTOR}, pr AS (SELECT image_id, y, x, v AS v0, v - v % 64 AS v1 FROM px),
st AS MATERIALIZED (SELECT image_id * 4 AS image_id, y, x, {_STRETCH('v0')} FROM pr WINDOW w AS (PARTITION BY image_id) UNION ALL SELECT image_id * 4 + 1, y, x, {_STRETCH('v1')} FROM pr WINDOW w AS (PARTITION BY image_id) UNION ALL SELECT image_id * 4 + 2, y, x, v0 FROM pr)"""
EDGES = f"""WITH RECURSIVE {STACKED}, {Q.AUTO.replace('px', 'st')}, {Q.canny_sql('pt', 'lo', 'hi', 'lo,hi')},
wd AS (SELECT DISTINCT e.image_id // 4 AS image_id, e.y + i AS y, e.x + j AS x FROM edges e, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE e.image_id % 4 = 1),
kp AS (SELECT e.image_id // 4 AS image_id, avg(CASE WHEN wd.y IS NULL THEN 0 ELSE 1 END) AS kept FROM edges e LEFT JOIN wd ON wd.image_id = e.image_id // 4 AND wd.y = e.y AND wd.x = e.x WHERE e.image_id % 4 = 0 GROUP BY 1),
ct AS (SELECT image_id // 4 AS image_id, count(*) FILTER (image_id % 4 = 2) AS n0, count(*) FILTER (image_id % 4 = 1) AS n1 FROM edges GROUP BY 1), im AS (SELECT DISTINCT image_id FROM px)
SELECT image_id, round(coalesce(kept, 1), 6) AS edge_retention, round(CASE WHEN coalesce(n0, 0) > 0 THEN n1::DOUBLE / n0 WHEN coalesce(n1, 0) = 0 THEN 1 ELSE n1 END, 6) AS edge_inflation FROM im LEFT JOIN kp USING (image_id) LEFT JOIN ct USING (image_id)"""
query("a13_a14_edge_metrics", EDGES)(lambda spark, d: Q.rounded(P.edge_metrics(stepped(spark, d)), edge_retention=6, edge_inflation=6))
PARTS = f"""WITH RECURSIVE {STACKED.replace(' UNION ALL SELECT image_id * 4 + 2, y, x, v0 FROM pr', '')}, {S.blurred('st', 'g3', K.gaussian_kernel(3))}, sm AS (SELECT image_id, y, x, CAST(floor(round(g, 6) + 0.5) AS INTEGER) AS v FROM g3), {S.otsu('sm', 'ot')},
mk AS (SELECT image_id, y, x FROM sm JOIN ot USING (image_id) WHERE v <= t), {S.parts('mk', 'cc')}, ar AS (SELECT image_id, comp, sum(e - s + 1) AS area FROM cc GROUP BY ALL HAVING sum(e - s + 1) BETWEEN 3 AND 5000),
ct AS (SELECT image_id // 4 AS image_id, count(*) FILTER (image_id % 4 = 0) AS n0, count(*) FILTER (image_id % 4 = 1) AS n1 FROM ar GROUP BY 1), im AS (SELECT DISTINCT image_id FROM px)
SELECT image_id, round(CASE WHEN coalesce(n0, 0) = 0 THEN 1 ELSE least(1, n1::DOUBLE / n0) END, 6) AS component_retention FROM im LEFT JOIN ct USING (image_id)"""
query("a15_component_retention", PARTS)(lambda spark, d: Q.rounded(P.component_retention(stepped(spark, d)), component_retention=6))
