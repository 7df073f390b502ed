"""Queries of sources, metrics, stencils and histograms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.operators import histogram as H
from platen.operators import metrics as M
from platen.operators import stencil as K
from platen.operators.components import components
from platen.operators.edges import canny
from platen.plans import sql as S
from platen.sources import rasters as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T, V = R.corpus, R.vectors


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def rounded(df, **places: int):
    """df with columns rounded, and nothing else changed."""
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in df.columns])


def digest(px):
    """What a treated raster looks like: pixels, sum, and sums weighted by place, for each image."""
    v = F.col("v").cast("long")
    return px.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * (F.col("x") + 1)).alias("by_x"), F.sum(v * (F.col("y") + 1)).alias("by_y"))


DIGEST = "SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x + 1)) AS BIGINT) AS by_x, CAST(sum(v * (y + 1)) AS BIGINT) AS by_y FROM out GROUP BY image_id"


def treated(name: str, corpus, f, ctes: str, out: str):
    """Registers a treatment: f over a corpus; `ctes` and `out` (a SELECT) are its SQL."""
    base = S.VECTOR if corpus in (V, R.vector_corpus_lines) else S.PAGES if corpus is R.pages else S.TEXT
    query(name, f"WITH {base}{', ' + ctes if ctes else ''}, out AS ({out}) {DIGEST}")(lambda spark, d: digest(f(corpus(spark, d))))


def clip8(e: str) -> str:
    return f"CAST(greatest(0, least(255, floor({e} + 0.5))) AS INTEGER)"


def trunc8(e: str) -> str:
    return f"CAST(greatest(0, least(255, floor({e}))) AS INTEGER)"


# sources
query("s2_text_raster", f"WITH {S.TEXT}, out AS (SELECT * FROM raw) {DIGEST}")(lambda spark, d: digest(R.text_raster(R.read(spark, d, "documents"))))
treated("s2_page_raster", R.pages, lambda px: px, "", "SELECT * FROM px")
treated("s2_vector_raster", V, lambda px: px, "", "SELECT * FROM px")
query("s6_image_record", f"WITH {S.TEXT} SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM px GROUP BY image_id")(lambda spark, d: R.dimensions(T(spark, d)))

# projections
query("p1_gray", f"WITH {S.TEXT}, out AS (SELECT image_id, y, x, CAST(floor(round(0.299 * (v * 7 % 256) + 0.587 * (v * 5 % 256) + 0.114 * (v * 3 % 256), 6) + 0.5) AS INTEGER) AS v FROM px) {DIGEST}")(lambda spark, d: digest(H.to_gray(R.colour(T(spark, d)))))
def luminance(spark, d):
    """Colour rasters whose lightness is cut at a threshold, as sums of bands."""
    out = H.on_luminance(R.colour(V(spark, d)), lambda px: H.global_threshold(px, 127))
    return out.groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("b", "g", "r")])


def lab_sql() -> str:
    """Lightness and colour of LAB, and back, as SQL."""
    lin = {c: f"CASE WHEN {e} / 255.0::DOUBLE > 0.04045 THEN pow(({e} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) ELSE {e} / 255.0::DOUBLE / 12.92 END" for c, e in (("r", "(v * 7 % 256)"), ("g", "(v * 5 % 256)"), ("b", "(v * 3 % 256)"))}
    root = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE 7.787::DOUBLE * {t} + 16.0::DOUBLE / 116 END"
    cube = lambda f: f"CASE WHEN {f} > 0.206893 THEN pow({f}, 3.0::DOUBLE) ELSE ({f} - 16.0::DOUBLE / 116) / 7.787 END"
    shown = lambda c: clip8(f"round((CASE WHEN {c} > 0.0031308 THEN 1.055::DOUBLE * pow({c}, 1.0::DOUBLE / 2.4) - 0.055 ELSE 12.92::DOUBLE * {c} END) * 255, 6)")
    return f"""li AS (SELECT image_id, {lin['r']} AS r, {lin['g']} AS g, {lin['b']} AS b FROM px),
xyz AS (SELECT image_id, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456::DOUBLE AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754::DOUBLE AS z FROM li),
lab AS (SELECT image_id, {clip8('round((CASE WHEN y > 0.008856 THEN 116.0::DOUBLE * pow(y, 1.0::DOUBLE / 3) - 16 ELSE 903.3::DOUBLE * y END) * 255 / 100, 6)')} AS l, {clip8(f"round(500.0::DOUBLE * (({root('x')}) - ({root('y')})) + 128, 6)")} AS a, {clip8(f"round(200.0::DOUBLE * (({root('y')}) - ({root('z')})) + 128, 6)")} AS b FROM xyz),
cut AS (SELECT image_id, CASE WHEN l > 127 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS l, a, b FROM lab), fy AS (SELECT *, CASE WHEN l > 7.9996 THEN (l + 16) / 116 ELSE 7.787::DOUBLE * (l / 903.3) + 16.0::DOUBLE / 116 END AS f, CASE WHEN l > 7.9996 THEN pow((l + 16) / 116, 3.0::DOUBLE) ELSE l / 903.3 END AS y FROM cut),
fx AS (SELECT *, f + (a - 128) / 500.0::DOUBLE AS p, f - (b - 128) / 200.0::DOUBLE AS q FROM fy), co AS (SELECT image_id, ({cube('p')}) * 0.950456::DOUBLE AS x, y, ({cube('q')}) * 1.088754::DOUBLE AS z FROM fx),
rgb AS (SELECT image_id, 3.240479::DOUBLE * x + (-1.537150::DOUBLE) * y + (-0.498535::DOUBLE) * z AS r, (-0.969256::DOUBLE) * x + 1.875991::DOUBLE * y + 0.041556::DOUBLE * z AS g, 0.055648::DOUBLE * x + (-0.204043::DOUBLE) * y + 1.057311::DOUBLE * z AS b FROM co)
SELECT image_id, count(*) AS n, CAST(sum({shown('b')}) AS BIGINT) AS b, CAST(sum({shown('g')}) AS BIGINT) AS g, CAST(sum({shown('r')}) AS BIGINT) AS r FROM rgb GROUP BY image_id"""


query("p2_on_luminance", f"WITH {S.VECTOR}, {lab_sql()}")(luminance)
for name, g in (("p3_gamma_dark", 0.65), ("p3_gamma_bright", 1.35)):
    treated(name, T, lambda px, g=g: H.gamma_correct(px, g), "", f"SELECT image_id, y, x, {trunc8(f'round(pow(v / 255.0::DOUBLE, {g}::DOUBLE) * 255, 9)')} AS v FROM px")
treated("p4_intensity", T, lambda px: H.intensity_adjust(px, 1.5, -40), "", f"SELECT image_id, y, x, {clip8('abs(round(v * 1.5::DOUBLE - 40, 9))')} AS v FROM px")
treated("p5_global_threshold", T, lambda px: H.global_threshold(px, 127), "", "SELECT image_id, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM px")
treated("p6_normalize", T, H.normalize, "e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id))", f"SELECT image_id, y, x, CASE WHEN hi > lo THEN {clip8('(v - lo) * 255.0::DOUBLE / (hi - lo)')} ELSE 0 END AS v FROM e")

# stencils
G1 = K.gaussian_kernel(0, 1.0)
treated("k2_laplacian", R.corpus_image_lines, lambda rows: K.laplacian_lines(rows).withColumn("v", F.abs("lap")), S.around("px", "nb"), "SELECT image_id, y, x, abs(n1 + n3 + n5 + n7 - 4 * n4) AS v FROM nb")
treated("k3_median", R.corpus_lines, lambda rows: K.median_lines(rows).select("image_id", "y", "x", F.col("med").alias("v")), S.around("px", "nb", "replicate"), "SELECT image_id, y, x, list_sort([n0, n1, n2, n3, n4, n5, n6, n7, n8])[5] AS v FROM nb")
chain = lambda *steps: lambda rows: K.line_values(K.extreme_lines(rows, steps))
for name, f, op in (("k6_erode", chain(K.ERODE), "least"), ("k6_dilate", chain(K.DILATE), "greatest")):
    treated(name, R.corpus_image_lines, f, S.around("px", "nb", "ignore"), f"SELECT image_id, y, x, {op}(n0, n1, n2, n3, n4, n5, n6, n7, n8) AS v FROM nb")
for name, f, a, b in (("k7_open", chain(K.ERODE, K.DILATE), "least", "greatest"), ("k7_close", chain(K.DILATE, K.ERODE), "greatest", "least")):
    nine = "(n0, n1, n2, n3, n4, n5, n6, n7, n8)"
    treated(name, R.corpus_image_lines, f, f"{S.around('px', 'na', 'ignore')}, mid AS (SELECT image_id, y, x, {a}{nine} AS v FROM na), {S.around('mid', 'nb', 'ignore')}", f"SELECT image_id, y, x, {b}{nine} AS v FROM nb")
cross = "(n1, n3, n4, n5, n7)"
treated("k7_top_hat", R.corpus_image_lines, lambda rows: K.line_values(K.top_hat_lines(rows)), f"{S.around('px', 'na', 'ignore')}, mid AS (SELECT image_id, y, x, v AS was, least{cross} AS v FROM na), {S.around('mid', 'nb', 'ignore', keep='was')}", f"SELECT image_id, y, x, greatest(0, was - greatest{cross}) AS v FROM nb")
query("k1_gaussian", f"WITH {S.VECTOR}, {S.blurred('px', 'gs', G1)} SELECT image_id, y, x, round(g, 4) AS g FROM gs")(lambda spark, d: K.gaussian(V(spark, d), 0, 1.0).select(*R.KEYS, F.round("g", 4).alias("g")))
treated("k4_sharpen", V, lambda px: K.sharpen(px, 0.5, 1.0), S.blurred("px", "gs", G1), f"SELECT image_id, y, x, {clip8('1.5 * v - 0.5 * g')} AS v FROM gs")
treated("k5_adaptive_threshold", V, lambda px: K.adaptive_threshold(px, 35, 11), S.blurred("px", "gs", K.gaussian_kernel(35), "replicate"), "SELECT image_id, y, x, CASE WHEN v > floor(g + 0.5) - 11 THEN 255 ELSE 0 END AS v FROM gs")
treated("k11_illumination_normalize", V, K.illumination_normalize, f"{S.blurred('px', 'gs', K.gaussian_kernel(51))}, m AS (SELECT *, avg(g) OVER (PARTITION BY image_id) AS mg FROM gs)", f"SELECT image_id, y, x, {trunc8('round((1 - 0.65::DOUBLE) * v + 0.65::DOUBLE * (v / greatest(g, 1.0) * mg), 9)')} AS v FROM m")
treated("k12_background_suppress", V, K.background_suppress, S.blurred("px", "gs", K.gaussian_kernel(31)), f"SELECT image_id, y, x, {trunc8('round(v - (v - g) * 0.45::DOUBLE, 9)')} AS v FROM gs")
treated("k13_weak_structure_suppress", V, K.weak_structure_suppress, S.blurred("px", "gs", K.gaussian_kernel(31)), f"SELECT image_id, y, x, CASE WHEN abs(round(v - g, 9)) <= 12 THEN {trunc8('round(v - round(v - g, 9) * 0.35::DOUBLE, 9)')} ELSE v END AS v FROM gs")
mirror = "CASE WHEN _ < 0 THEN -_ WHEN _ > 7 THEN 14 - _ ELSE _ END"
treated("k9_bilateral", V, K.bilateral, f"""o(d) AS (VALUES (-2), (-1), (0), (1), (2)), disc AS (SELECT a.d AS dy, b.d AS dx FROM o a, o b WHERE a.d * a.d + b.d * b.d <= 4),
pl AS (SELECT image_id, y, x, v, dy * dy + dx * dx AS dd, {mirror.replace('_', '(y + dy)')} AS ty, {mirror.replace('_', '(x + dx)')} AS tx FROM px, disc),
w AS (SELECT a.image_id, a.y, a.x, q.v AS qv, exp(-a.dd / 1250.0::DOUBLE - pow(q.v - a.v, 2) / 1250.0::DOUBLE) AS w FROM pl a JOIN px q ON q.image_id = a.image_id AND q.y = a.ty AND q.x = a.tx)""", f"SELECT image_id, y, x, {clip8('sum(w * qv) / sum(w)')} AS v FROM w GROUP BY image_id, y, x")
query("k10_non_local_means")(lambda spark, d: digest(K.line_values(K.non_local_means_lines(R.vector_corpus_lines(spark, d)))))
# The same with smaller windows, so that SQL can look at every offset.
_M7 = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"
NLM = f"""of AS (SELECT a.i AS dy, b.j AS dx, (a.i + 3) * 7 + b.j + 3 AS o FROM (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS j) b),
sh AS (SELECT image_id * 64 + o AS image_id, y, x, v AS c, {_M7('y + dy')} AS ty, {_M7('x + dx')} AS tx, image_id AS own FROM px, of),
df AS MATERIALIZED (SELECT s.image_id, s.y, s.x, q.v AS w, CAST((q.v - s.c) * (q.v - s.c) AS DOUBLE) AS v FROM sh s JOIN px q ON q.image_id = s.own AND q.y = s.ty AND q.x = s.tx), {S.blurred('df', 'tm', [1 / 3] * 3)},
wk AS (SELECT image_id // 64 AS image_id, y, x, w, exp(-greatest(g, 0) / 400.0::DOUBLE) AS k FROM tm)"""
treated("k10_non_local_means_small", R.vector_corpus_lines, lambda rows: K.line_values(K.non_local_means_lines(rows, 20.0, 3, 7)), NLM, f"SELECT image_id, y, x, {clip8('round(sum(w * k) / sum(k), 6)')} AS v FROM wk GROUP BY ALL")
element = ", ".join(f"({i - 2}, {dx})" for i, half in enumerate(K._halves(5, "ellipse")) for dx in range(-half, half + 1))
treated("k7_black_hat", V, K.black_hat, f"el(dy, dx) AS (VALUES {element}), di AS (SELECT p.image_id, p.y, p.x, any_value(p.v) AS was, max(q.v) AS v FROM px p CROSS JOIN el JOIN px q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL), cl AS (SELECT p.image_id, p.y, p.x, any_value(p.was) AS was, min(q.v) AS v FROM di p CROSS JOIN el JOIN di q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)", "SELECT image_id, y, x, greatest(0, v - was) AS v FROM cl")

# histograms
treated("h1_equalize", T, H.hist_equalize, "hn AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL), hc AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY image_id) AS tot FROM hn), hl AS (SELECT *, min(c) OVER (PARTITION BY image_id) AS low FROM hc), lut AS (SELECT image_id, v, CASE WHEN tot = low THEN v ELSE " + clip8("(c - low)::DOUBLE / (tot - low) * 255") + " END AS o FROM hl)", "SELECT image_id, y, x, o AS v FROM px JOIN lut USING (image_id, v)")
query("h2_otsu_threshold", f"WITH {S.TEXT}, {S.otsu('px', 'ot')} SELECT image_id, t FROM ot")(lambda spark, d: H.otsu_threshold(T(spark, d)))
treated("h2_otsu", T, H.otsu, S.otsu("px", "ot"), "SELECT image_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM px JOIN ot USING (image_id)")
CLAHE = """th AS (SELECT image_id, CAST(ceil((max(y) + 1) / 8.0) AS INTEGER) AS th, CAST(ceil((max(x) + 1) / 8.0) AS INTEGER) AS tw, max(y) // CAST(ceil((max(y) + 1) / 8.0) AS INTEGER) AS my, max(x) // CAST(ceil((max(x) + 1) / 8.0) AS INTEGER) AS mx FROM {src} GROUP BY image_id),
tl AS (SELECT p.*, t.th, t.tw, t.my, t.mx, p.y // t.th AS ty, p.x // t.tw AS tx FROM {src} p JOIN th t USING (image_id)),
hn AS (SELECT image_id, ty, tx, v, count(*) AS n FROM tl GROUP BY ALL), ha AS (SELECT image_id, ty, tx, sum(n) AS area FROM hn GROUP BY ALL),
hk AS (SELECT h.*, a.area, least(h.n, greatest(1, floor({clip}::DOUBLE * a.area / 256))) AS kept FROM hn h JOIN ha a USING (image_id, ty, tx)),
hx AS (SELECT image_id, ty, tx, any_value(area) AS area, sum(n - kept)::DOUBLE / 256 AS more FROM hk GROUP BY ALL),
hf AS (SELECT x.image_id, x.ty, x.tx, b.v, x.area, coalesce(k.kept, 0) + x.more AS h FROM hx x CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS v) b LEFT JOIN hk k ON k.image_id = x.image_id AND k.ty = x.ty AND k.tx = x.tx AND k.v = b.v),
lut AS (SELECT image_id, ty, tx, v, least(255, floor(round(sum(h) OVER (PARTITION BY image_id, ty, tx ORDER BY v) * 255 / area, 6) + 0.5)) AS o FROM hf),
pf AS (SELECT *, (y + 0.5::DOUBLE) / th - 0.5 AS fy, (x + 0.5::DOUBLE) / tw - 0.5 AS fx FROM tl),
four AS (SELECT image_id, y, x, v, greatest(0, least(my, CAST(floor(fy) AS INTEGER) + a)) AS ty, greatest(0, least(mx, CAST(floor(fx) AS INTEGER) + b)) AS tx,
  (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w FROM pf, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b))"""
CLAHE_OUT = f"SELECT f.image_id, f.y, f.x, {clip8('round(sum(f.w * l.o), 6)')} AS v FROM four f JOIN lut l USING (image_id, ty, tx, v) GROUP BY f.image_id, f.y, f.x"
treated("h3_clahe", R.vector_corpus_lines, H.clahe_pixels, CLAHE.format(src="px", clip=1.5), CLAHE_OUT)
treated("h3_clahe_text", R.corpus_image_lines, lambda rows: H.clahe_pixels(rows, 2.0), CLAHE.format(src="px", clip=2.0), CLAHE_OUT)
treated("h4_faded_text", R.vector_corpus_lines, H.faded_text_pixels, f"gm AS (SELECT image_id, y, x, {trunc8('round(pow(v / 255.0::DOUBLE, 0.95::DOUBLE) * 255, 9)')} AS v FROM px), " + CLAHE.format(src="gm", clip=1.4), CLAHE_OUT)

# metrics
TONE = "SELECT image_id, round(avg(v), 3) AS brightness, round(stddev_pop(v), 3) AS contrast, round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 3) AS dynamic_range, round(avg(CASE WHEN v <= 5 THEN 1 ELSE 0 END), 4) AS dark_clipped_ratio, round(avg(CASE WHEN v >= 250 THEN 1 ELSE 0 END), 4) AS bright_clipped_ratio FROM px GROUP BY image_id"
query("a1_a2_a3_a8_tone", f"WITH {S.TEXT} {TONE}")(lambda spark, d: rounded(M.tone(T(spark, d)), brightness=3, contrast=3, dynamic_range=3, dark_clipped_ratio=4, bright_clipped_ratio=4))
#: Variance from exact sums, so that both engines divide the same numbers.
EXACT = "CAST(count(*) * sum(l::HUGEINT * l) - sum(l)::HUGEINT * sum(l) AS DOUBLE) / (count(*)::DOUBLE * count(*))"
LAP = "(SELECT image_id, n1 + n3 + n5 + n7 - 4 * n4 AS l FROM nb)"
SHARP = f"SELECT image_id, round({EXACT}, 3) AS sharpness FROM {LAP} GROUP BY image_id"
query("a4_sharpness", f"WITH {S.TEXT}, {S.around('px', 'nb')} SELECT image_id, {EXACT} AS sharpness FROM {LAP} GROUP BY image_id")(lambda spark, d: M.sharpness_lines(R.corpus_lines(spark, d)))
NOISE = "SELECT image_id, round(avg(d), 3) AS noise, round(quantile_cont(d, 0.9), 3) AS noise_p90, round(avg(CASE WHEN d >= 5 THEN 1 ELSE 0 END), 4) AS affected_ratio, round(avg(CASE WHEN d >= 100 THEN 1 ELSE 0 END), 4) AS impulse_ratio FROM rs GROUP BY image_id"
RESIDUAL = "rs AS (SELECT image_id, y, x, v, abs(v - list_sort([n0, n1, n2, n3, n4, n5, n6, n7, n8])[5]) AS d FROM nm)"
query("a5_noise", f"WITH {S.TEXT}, {S.around('px', 'nm', 'replicate')}, {RESIDUAL} SELECT image_id, sum(d)::DOUBLE / count(*) AS noise, round(quantile_cont(d, 0.9), 6) AS noise_p90, count(*) FILTER (d >= 5)::DOUBLE / count(*) AS affected_ratio, count(*) FILTER (d >= 100)::DOUBLE / count(*) AS impulse_ratio FROM rs GROUP BY image_id")(lambda spark, d: rounded(M.noise_lines(R.corpus_lines(spark, d)), noise_p90=6))
ILLUM = "SELECT image_id, round(CASE WHEN avg(g) <= 1e-6 THEN 0 ELSE stddev_pop(g) / avg(g) END, 4) AS illumination_variation FROM gl GROUP BY image_id"
query("a6_illumination", f"WITH {S.VECTOR}, {S.blurred('px', 'gl', K.gaussian_kernel(0, 3.0))} {ILLUM}")(lambda spark, d: rounded(M.illumination(V(spark, d)), illumination_variation=4))
BLEED = "SELECT image_id, round(avg(CASE WHEN d BETWEEN 4 AND 18 THEN 1 ELSE 0 END), 4) AS weak_structure_ratio, round(avg(CASE WHEN d > 18 THEN 1 ELSE 0 END), 4) AS strong_structure_ratio, round(avg(CASE WHEN d BETWEEN 4 AND 18 THEN 1 ELSE 0 END) / greatest(avg(CASE WHEN d > 18 THEN 1 ELSE 0 END), 1e-6), 4) AS weak_to_strong_ratio FROM bd GROUP BY image_id"
query("a9_bleed_through", f"WITH {S.VECTOR}, {S.blurred('px', 'gb', K.gaussian_kernel(31))}, bd AS (SELECT *, round(abs(v - g), 9) AS d FROM gb) {BLEED}")(lambda spark, d: rounded(M.bleed_through(V(spark, d)), weak_structure_ratio=4, strong_structure_ratio=4, weak_to_strong_ratio=4))
C1 = "SELECT image_id, count(*) AS n, CAST(sum(area) AS BIGINT) AS total, CAST(max(area) AS BIGINT) AS largest, min(min_y) AS top, max(max_y) AS bottom FROM (SELECT image_id, comp, sum(e - s + 1) AS area, min(y) AS min_y, max(y) AS max_y FROM cc GROUP BY ALL) GROUP BY image_id"
query("c1_components", f"WITH RECURSIVE {S.VECTOR}, mk AS (SELECT * FROM px WHERE v > 127), {S.parts('mk', 'cc')} {C1}")(
    lambda spark, d: components(V(spark, d).where("v > 127")).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("area").alias("total"), F.max("area").alias("largest"), F.min("min_y").alias("top"), F.max("max_y").alias("bottom"))
)
CANNY = f"""{S.around('{src}', 'ng', 'replicate', keep='{keep}')},
gr AS (SELECT image_id, y, x, {{keep}}, (n2 + 2 * n5 + n8) - (n0 + 2 * n3 + n6) AS gx, (n6 + 2 * n7 + n8) - (n0 + 2 * n1 + n2) AS gy FROM ng),
gm AS (SELECT *, abs(gx) + abs(gy) AS mag, CASE WHEN abs(gy) <= abs(gx) * 0.41421356 THEN 0 WHEN abs(gx) <= abs(gy) * 0.41421356 THEN 2 WHEN gx * gy > 0 THEN 1 ELSE 3 END AS sector FROM gr),
{S.around('gm', 'nm9', 'ignore', 'mag', 'mag,sector,{keep}')},
ck AS MATERIALIZED (SELECT image_id, y, x, mag > {{hi}} AS strong FROM nm9 WHERE mag > {{lo}} AND CASE sector WHEN 0 THEN mag > coalesce(n3, 0) AND mag >= coalesce(n5, 0) WHEN 1 THEN mag > coalesce(n0, 0) AND mag >= coalesce(n8, 0) WHEN 2 THEN mag > coalesce(n1, 0) AND mag >= coalesce(n7, 0) ELSE mag > coalesce(n2, 0) AND mag >= coalesce(n6, 0) END),
{S.parts('ck', 'cc')},
good AS (SELECT DISTINCT comp FROM cc JOIN ck USING (image_id, y) WHERE x BETWEEN s AND e AND strong),
edges AS MATERIALIZED (SELECT image_id, y, unnest(range(s, e + 1)) AS x FROM cc WHERE comp IN (SELECT comp FROM good))"""


def canny_sql(src: str, lo: str, hi: str, keep: str = "v") -> str:
    return CANNY.replace("{src}", src).replace("{keep}", keep).replace("{lo}", lo).replace("{hi}", hi)


query("k8_canny", f"WITH RECURSIVE {S.VECTOR}, {canny_sql('px', '100', '250')} SELECT image_id, count(*) AS n, CAST(sum(x + 1) AS BIGINT) AS by_x, CAST(sum(y + 1) AS BIGINT) AS by_y FROM edges GROUP BY image_id")(
    lambda spark, d: canny(V(spark, d), 100, 250).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("x") + 1).alias("by_x"), F.sum(F.col("y") + 1).alias("by_y"))
)
AUTO = "md AS (SELECT image_id, greatest(0, floor(0.66 * quantile_cont(v, 0.5))) AS l0, least(255, floor(1.33 * quantile_cont(v, 0.5))) AS h0 FROM px GROUP BY image_id), pt AS (SELECT px.*, CASE WHEN l0 = h0 THEN 50 ELSE l0 END AS lo, CASE WHEN l0 = h0 THEN 150 ELSE h0 END AS hi FROM px JOIN md USING (image_id))"
query("a7_edge_density", f"WITH RECURSIVE {S.VECTOR}, {AUTO}, {canny_sql('pt', 'lo', 'hi', 'lo,hi')}, ec AS (SELECT image_id, count(*) AS e FROM edges GROUP BY image_id) SELECT p.image_id, round(coalesce(any_value(ec.e), 0)::DOUBLE / count(*), 4) AS edge_density FROM px p LEFT JOIN ec USING (image_id) GROUP BY p.image_id")(
    lambda spark, d: rounded(M.edge_density(V(spark, d)), edge_density=4)
)
STRUCT = f"""{S.blurred('px', 'g3', K.gaussian_kernel(3))}, sm AS (SELECT image_id, y, x, CAST(floor(round(g, 6) + 0.5) AS INTEGER) AS v FROM g3), {S.otsu('sm', 'ot')},
ik AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN v > t THEN 0 ELSE 255 END AS v FROM sm JOIN ot USING (image_id)), mk AS (SELECT * FROM ik WHERE v > 0), {S.parts('mk', 'cc')},
ar AS (SELECT image_id, comp, sum(e - s + 1) AS area FROM cc GROUP BY ALL), {S.around('ik', 'ni', 'ignore')},
th AS (SELECT image_id, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS fgr, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS fg, sum(CASE WHEN least(n0, n1, n2, n3, n4, n5, n6, n7, n8) > 0 THEN 1 ELSE 0 END) AS core FROM ni GROUP BY image_id)
SELECT th.image_id, count(ar.area) AS component_count, round(coalesce(avg(CASE WHEN area <= 6 THEN 1 WHEN area > 6 THEN 0 END), 0), 4) AS small_component_ratio, round(coalesce(avg(area), 0), 3) AS mean_component_area, round(coalesce(quantile_cont(area, 0.5), 0), 3) AS median_component_area,
round(any_value(fgr), 4) AS foreground_ratio, round(CASE WHEN any_value(fg) > 0 THEN 1 - any_value(core)::DOUBLE / any_value(fg) ELSE 0 END, 4) AS thin_structure_ratio FROM th LEFT JOIN ar USING (image_id) GROUP BY th.image_id"""
query("a10_structural", f"WITH RECURSIVE {S.VECTOR}, {STRUCT}")(lambda spark, d: rounded(M.structural(V(spark, d)), small_component_ratio=4, mean_component_area=3, median_component_area=3, foreground_ratio=4, thin_structure_ratio=4))
