"""The named treatments, their parameters, and jobs over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.operators import geometry, histogram, metrics, rules, stencil
from platen.operators.preservation import verify_lines, verify_preservation
from platen.sources.rasters import trunc8
from platen.sources.store import cut

#: Fixed values, id: (function, risk, side). Sides: automatic (may be applied without a user), manual (is shown and never applied by itself), free.
OPERATIONS: dict[str, tuple[Callable, str, str]] = {
    "clahe": (histogram.clahe, "medium", "automatic"),
    "histogram_equalization": (histogram.hist_equalize, "high", "manual"),
    "median_denoise": (stencil.median_denoise, "medium-high", "automatic"),
    "sharpen": (stencil.sharpen, "medium", "automatic"),
    "global_threshold": (histogram.global_threshold, "high", "manual"),
    "otsu_threshold": (histogram.otsu, "medium-high", "manual"),
    "adaptive_threshold": (stencil.adaptive_threshold, "medium-high", "manual"),
    "morphological_opening": (stencil.morph_open, "high", "manual"),
    "morphological_closing": (stencil.morph_close, "high", "manual"),
    "bilateral_denoise": (stencil.bilateral, "medium", "manual"),
    "non_local_means_denoise": (stencil.non_local_means, "medium", "manual"),
    "illumination_normalize": (stencil.illumination_normalize, "medium", "automatic"),
    "gamma_correct": (histogram.gamma_correct, "low", "automatic"),
    "intensity_adjust": (histogram.intensity_adjust, "medium", "free"),
    "faded_text_enhance": (histogram.faded_text, "medium", "manual"),
    "background_suppress": (stencil.background_suppress, "medium-high", "manual"),
    "weak_structure_suppress": (stencil.weak_structure_suppress, "high", "manual"),
    "morphological_top_hat": (stencil.top_hat, "high", "manual"),
    "morphological_black_hat": (stencil.black_hat, "high", "manual"),
    "deskew": (geometry.rotate, "medium", "manual"),
}
#: Operation, parameter, default, least, most (None: no limit), step, odd. A least of 0 and `above` leave 0 out.
PARAMETERS: tuple[tuple[str, str, float, float | None, float | None, float, str], ...] = (
    ("clahe", "clip_limit", 1.5, 0, None, 0.1, "above"),
    ("clahe", "tile_grid_size", 8, 2, None, 1, ""),
    ("median_denoise", "kernel_size", 3, 3, None, 2, "odd"),
    ("sharpen", "amount", 0.5, 0, 2, 0.05, ""),
    ("sharpen", "sigma", 1.0, 0, 5, 0.1, "above"),
    ("global_threshold", "threshold", 127, 0, 255, 1, ""),
    ("adaptive_threshold", "block_size", 35, 3, None, 2, "odd"),
    ("adaptive_threshold", "c", 11, None, None, 1, ""),
    ("morphological_opening", "kernel_size", 3, 3, None, 2, "odd"),
    ("morphological_closing", "kernel_size", 3, 3, None, 2, "odd"),
    ("bilateral_denoise", "diameter", 5, 0, None, 2, "above"),
    ("bilateral_denoise", "sigma_color", 25, 0, None, 1, "above"),
    ("bilateral_denoise", "sigma_space", 25, 0, None, 1, "above"),
    ("non_local_means_denoise", "strength", 5, 0, None, 1, "above"),
    ("non_local_means_denoise", "template_window_size", 7, 3, None, 2, "odd"),
    ("non_local_means_denoise", "search_window_size", 21, 3, None, 2, "odd"),
    ("illumination_normalize", "kernel_size", 51, 15, None, 2, "odd"),
    ("illumination_normalize", "strength", 0.65, 0, 1, 0.05, "above"),
    ("gamma_correct", "gamma", 1.0, 0, None, 0.05, "above"),
    ("intensity_adjust", "alpha", 1.0, 0, None, 0.05, "above"),
    ("intensity_adjust", "beta", 0, -100, 100, 1, ""),
    ("faded_text_enhance", "clip_limit", 1.4, 0, None, 0.1, "above"),
    ("faded_text_enhance", "gamma", 0.95, 0, None, 0.05, "above"),
    ("background_suppress", "kernel_size", 31, 15, None, 2, "odd"),
    ("background_suppress", "strength", 0.45, 0, 1, 0.05, "above"),
    ("weak_structure_suppress", "kernel_size", 31, 15, None, 2, "odd"),
    ("weak_structure_suppress", "threshold", 12, 0, None, 1, "above"),
    ("weak_structure_suppress", "strength", 0.35, 0, 1, 0.05, "above"),
    ("morphological_top_hat", "kernel_size", 3, 3, None, 2, "odd"),
    ("morphological_black_hat", "kernel_size", 5, 3, None, 2, "odd"),
    ("deskew", "angle", 0, -45, 45, 0.1, ""),
)
#: Accepted steps and attempts of one run at most.
MOST_ACCEPTED, MOST_ATTEMPTS = 1, 4


def operations(spark: SparkSession) -> DataFrame:
    """The registry as a table of fixed size; the functions themselves are not in it."""
    return spark.createDataFrame([(k, risk, side) for k, (_, risk, side) in OPERATIONS.items()], "operation_id string, risk string, side string")


def parameter_catalog(spark: SparkSession) -> DataFrame:
    """operation_id, parameter, default, least, most, step, above (least itself is out), odd."""
    limit = lambda x: None if x is None else float(x)
    rows = [(op, name, float(value), limit(lo), limit(hi), float(step), rule == "above", rule == "odd") for op, name, value, lo, hi, step, rule in PARAMETERS]
    return spark.createDataFrame(rows, "operation_id string, parameter string, default double, least double, most double, step double, above boolean, odd boolean")


def policy(spark: SparkSession) -> DataFrame:
    """operation_id, side and the caps of a run."""
    return operations(spark).select("operation_id", "side", F.lit(MOST_ACCEPTED).alias("most_accepted"), F.lit(MOST_ATTEMPTS).alias("most_attempts"))


def resolve_operations(requests: DataFrame) -> DataFrame:
    known = operations(requests.sparkSession).select("operation_id", F.lit(True).alias("__known"))
    return requests.join(F.broadcast(known), "operation_id", "left").withColumn("status", F.when(F.col("__known"), "OK").otherwise("UNKNOWN_OPERATION")).drop("__known")


def validate_parameters(requests: DataFrame) -> DataFrame:
    """requests (operation_id, parameter, value) with valid: both known, the value in range, and odd where it has to be.

    A request without a parameter is valid if its operation is known.
    """
    known = operations(requests.sparkSession).select("operation_id", F.lit(True).alias("__op"))
    r = requests.join(F.broadcast(known), "operation_id", "left").join(F.broadcast(parameter_catalog(requests.sparkSession)), ["operation_id", "parameter"], "left")
    v = F.col("value")
    good = F.col("odd").isNotNull() & (F.col("least").isNull() | (v > F.col("least")) | (~F.col("above") & (v == F.col("least")))) & (F.col("most").isNull() | (v <= F.col("most"))) & (~F.col("odd") | (v % 2 == 1))
    valid = F.col("__op").isNotNull() & (F.col("parameter").isNull() | F.coalesce(good, F.lit(False)))
    return r.select(*requests.columns, valid.alias("valid"))


def apply_operation(px: DataFrame, operation_id: str, **parameters) -> DataFrame:
    """A treatment by name; an unknown name or parameter is an error."""
    if operation_id not in OPERATIONS:
        raise KeyError(f"unknown operation {operation_id}")
    return OPERATIONS[operation_id][0](px, **parameters)


def sweep_gamma(px: DataFrame, gammas: tuple[float, ...]) -> DataFrame:
    """Every pixel in each of a few cases; the case is a column, so one pass treats them all."""
    cases = px.withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in gammas])))
    return cases.withColumn("v", trunc8(F.round(F.pow(F.col("v") / 255, F.col("gamma")) * 255, 9)))


#: The operation cases of the evaluation.
CASES = (("clahe", {"clip_limit": 1.5}), ("clahe", {"clip_limit": 2.0}), ("histogram_equalization", {}), ("median_denoise", {"kernel_size": 3}), ("sharpen", {"amount": 0.25}), ("sharpen", {"amount": 0.5}), ("global_threshold", {"threshold": 127}), ("adaptive_threshold", {"block_size": 25, "c": 7}), ("morphological_opening", {"kernel_size": 3}), ("morphological_closing", {"kernel_size": 3}), ("clahe", {"clip_limit": 2.5}), ("median_denoise", {"kernel_size": 5}), ("sharpen", {"amount": 0.75}), ("global_threshold", {"threshold": 100}), ("global_threshold", {"threshold": 160}), ("otsu_threshold", {}), ("adaptive_threshold", {"block_size": 35, "c": 11}), ("adaptive_threshold", {"block_size": 51, "c": 15}), ("morphological_opening", {"kernel_size": 5}), ("morphological_closing", {"kernel_size": 5}))


#: Candidates that are compared with each other, by what they treat.
CANDIDATES: tuple[tuple[str, str, str, dict], ...] = (
    ("denoise", "median_k3", "median_denoise", {"kernel_size": 3}),
    ("denoise", "median_k5", "median_denoise", {"kernel_size": 5}),
    ("denoise", "bilateral_weak", "bilateral_denoise", {"diameter": 5, "sigma_color": 20.0, "sigma_space": 20.0}),
    ("denoise", "bilateral_default", "bilateral_denoise", {"diameter": 5, "sigma_color": 25.0, "sigma_space": 25.0}),
    ("denoise", "nlm_weak", "non_local_means_denoise", {"strength": 3, "template_window_size": 7, "search_window_size": 21}),
    ("denoise", "nlm_default", "non_local_means_denoise", {"strength": 5, "template_window_size": 7, "search_window_size": 21}),
    ("exposure", "gamma_085", "gamma_correct", {"gamma": 0.85}),
    ("exposure", "gamma_070", "gamma_correct", {"gamma": 0.70}),
    ("exposure", "intensity_weak", "intensity_adjust", {"alpha": 1.05, "beta": 5}),
    ("exposure", "clahe", "clahe", {"clip_limit": 1.5, "tile_grid_size": 8}),
    ("exposure", "faded_candidate", "faded_text_enhance", {"clip_limit": 1.4, "gamma": 0.95}),
    ("illumination", "weak", "illumination_normalize", {"kernel_size": 51, "strength": 0.45}),
    ("illumination", "default", "illumination_normalize", {"kernel_size": 51, "strength": 0.65}),
    ("illumination", "wide", "illumination_normalize", {"kernel_size": 81, "strength": 0.65}),
    ("illumination", "strong", "illumination_normalize", {"kernel_size": 81, "strength": 0.85}),
    ("bleed_through", "background_weak", "background_suppress", {"kernel_size": 31, "strength": 0.30}),
    ("bleed_through", "background_default", "background_suppress", {"kernel_size": 31, "strength": 0.45}),
    ("bleed_through", "weak_structure", "weak_structure_suppress", {"kernel_size": 31, "threshold": 12, "strength": 0.35}),
    ("bleed_through", "illumination_only", "illumination_normalize", {"kernel_size": 51, "strength": 0.45}),
    ("bleed_through", "clahe_only", "clahe", {"clip_limit": 1.5, "tile_grid_size": 8}),
    ("structure", "opening_k3", "morphological_opening", {"kernel_size": 3}),
    ("structure", "closing_k3", "morphological_closing", {"kernel_size": 3}),
    ("structure", "top_hat_k3", "morphological_top_hat", {"kernel_size": 3}),
    ("structure", "black_hat_k5", "morphological_black_hat", {"kernel_size": 5}),
)


#: Treatments that lines (image_id, y, v: array, other columns, which pass through) go through as lines.
ON_LINES: dict[str, Callable] = {
    "clahe": histogram.clahe_lines,
    "faded_text_enhance": histogram.faded_text_lines,
    "gamma_correct": histogram.gamma_lines,
    "intensity_adjust": histogram.intensity_lines,
    "global_threshold": histogram.threshold_lines,
    "morphological_opening": stencil.open_lines,
    "morphological_closing": stencil.close_lines,
    "morphological_top_hat": stencil.top_hat_lines,
    "morphological_black_hat": stencil.black_hat_lines,
}


def _on_lines(rows: DataFrame, operation_id: str, **parameters) -> DataFrame:
    """Lines (image_id, y, v) after a treatment; what has no way for lines is treated as pixels."""
    treated = ON_LINES[operation_id](rows, **parameters) if operation_id in ON_LINES else metrics.as_lines(apply_operation(stencil.line_values(rows), operation_id, **parameters))
    return treated.withColumn("v", F.col("v").cast("array<int>"))


def _beside(rows: DataFrame, operation_id: str, **parameters) -> DataFrame:
    """image_id, y, v0, v: lines before and after a treatment. Where the treatment is one of pixels, lines meet again, not pixels."""
    if operation_id in ON_LINES:
        return _on_lines(rows.withColumn("v0", F.col("v")), operation_id, **parameters).select("image_id", "y", "v0", "v")
    treated = _on_lines(rows, operation_id, **parameters)
    return treated.join(rows.select("image_id", "y", F.col("v").alias("v0")).hint("merge"), ["image_id", "y"]).select("image_id", "y", "v0", "v")


def _cases(rows: DataFrame, of: list[tuple[str, dict]], before: bool) -> DataFrame:
    """Lines (with `before` also as they were, v0) of treated rasters under ids image_id * 32 + case, in one table, dealt out by these."""
    out = None
    for i, (op, p) in enumerate(of):
        one = (_beside if before else _on_lines)(rows, op, **p).select((F.col("image_id") * 32 + i).alias("image_id"), "y", *(["v0"] if before else []), "v")
        out = one if out is None else out.unionByName(one)
    return by_image(out)


def by_image(rows: DataFrame) -> DataFrame:
    """rows dealt out by image. A checkpoint forgets how its rows were dealt; after this, what groups by image or by an image and more deals nothing again, and branches share it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")


def line_changes(both: DataFrame) -> DataFrame:
    """image_id, pixels, changed (by more than 3), change (sum of differences) of lines before and after (image_id, y, v0, v): exact counts. A line counts its own pixels."""
    d = both.select("image_id", F.zip_with("v0", "v", lambda a, b: F.abs(a - b)).alias("d"))
    return d.groupBy("image_id").agg(F.sum(F.size("d")).cast("long").alias("pixels"), F.sum(F.aggregate("d", F.lit(0), lambda s, e: s + F.when(e > 3, 1).otherwise(0))).alias("changed"), F.sum(F.aggregate("d", F.lit(0).cast("long"), lambda s, e: s + e)).alias("change"))


def _named(out: DataFrame, i: Column, chosen: list) -> DataFrame:
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("candidate")) for k, n, _, _ in chosen])
    return out.withColumn("c", names[i])


def compare_candidates(rows: DataFrame, kinds: tuple[str, ...] = (), verify: bool = True) -> DataFrame:
    """image_id, kind, candidate, pixels, changed, change, and with `verify` the metrics after and the preservation status, of every candidate of `kinds` (all).

    rows: scanlines (image_id, y, v: array), or pixels. Without `verify` nothing of a treated raster is kept: its lines are counted where they are made.
    """
    rows = _lines(rows)
    chosen = [c for c in CANDIDATES if not kinds or c[0] in kinds]
    if not verify:
        out = None
        for i, (_, _, op, p) in enumerate(chosen):
            one = _named(line_changes(_beside(rows, op, **p)), F.lit(i), chosen)
            out = one if out is None else out.unionByName(one)
        return out.select("image_id", "c.*", "pixels", "changed", "change")
    both = cut(_cases(rows, [(op, p) for _, _, op, p in chosen], True))
    out = line_changes(both).join(_light(both.select("image_id", "y", "v")), "image_id", "left").join(verify_lines(both.select("image_id", "y", "v0", F.col("v").alias("v1"))).select("image_id", "status"), "image_id", "left")
    more = [c for c in out.columns if c != "image_id"]
    return _named(out, F.pmod("image_id", F.lit(32)).cast("int"), chosen).select(F.expr("image_id div 32").alias("image_id"), "c.*", *more)


def binarization_candidates(px: DataFrame, recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rasters, records) of the binarizations that `recs` (image_id, operation_id, parameter, mode) recommends, made from the originals.

    Records: image_id, operation_id, parameter, risk, status (of preservation) and decision, which is review_required always:
    a binary result is never taken by itself.
    """
    own = recs.where("mode = 'binarization' AND operation_id = 'adaptive_threshold'").dropDuplicates(["image_id", "operation_id", "parameter"])
    sizes = [r["parameter"] for r in own.select("parameter").distinct().collect()]  # recommendations have a few settings
    out = px.limit(0).select("image_id", "y", "x", F.col("v").cast("int").alias("v"))
    for size in sorted(sizes):
        some = px.join(own.where(F.col("parameter") == size).select("image_id"), "image_id", "left_semi")
        out = out.unionByName(stencil.adaptive_threshold(some, int(size), 11).select("image_id", "y", "x", F.col("v").cast("int").alias("v")))
    out = cut(out.repartition("image_id"))
    report = verify_preservation(px.join(own.select("image_id").distinct(), "image_id", "left_semi"), out).select("image_id", "status")
    return out, own.select("image_id", "operation_id", "parameter", "risk").join(report, "image_id", "left").withColumn("decision", F.lit("review_required"))


def _lines(raster: DataFrame) -> DataFrame:
    """A raster, pixels or scanlines (image_id, y, v: array), as scanlines from a checkpoint, dealt out by image."""
    return by_image(cut(metrics.as_lines(raster) if "x" in raster.columns else raster.select("image_id", "y", "v")))


def _light(rows: DataFrame) -> DataFrame:
    """The metrics of benefit, of scanlines (image_id, y, v: array). Lines are dealt out once, and no metric deals out pixels."""
    rows = by_image(rows)
    return metrics.tone(stencil.line_values(rows)).join(metrics.sharpness_lines(rows), "image_id").join(metrics.noise_lines(rows), "image_id").join(metrics.illumination_lines(rows), "image_id").select("image_id", "brightness", "contrast", "sharpness", "noise", "illumination_variation")


def evaluate_operations(rows: DataFrame, cases=CASES) -> DataFrame:
    """image_id, operation_id, label and metrics before and after each case, of scanlines (image_id, y, v: array) or pixels; "before" is measured once an image."""
    rows = _lines(rows)
    after = _light(cut(_cases(rows, list(cases), False)))
    names = F.array(*[F.struct(F.lit(op).alias("operation_id"), F.lit("__".join(f"{k}_{v}" for k, v in p.items()) or "default").alias("label")) for op, p in cases])
    after = after.select(F.expr("image_id div 32").alias("image_id"), names[F.pmod("image_id", F.lit(32))].alias("c"), *[F.round(c, 3).alias(f"after_{c}") for c in after.columns[1:]]).select("image_id", "c.*", *[f"after_{c}" for c in after.columns[1:]])
    before = _light(rows)
    return after.join(before.select("image_id", *[F.round(c, 3).alias(f"before_{c}") for c in before.columns[1:]]), "image_id")


def smart_pipeline(px: DataFrame) -> DataFrame:
    """image_id, level, recommendations, accepted operation (or null) and final decision of every image.

    Each recommended automatic treatment is tried on the original, all of them at once; the loop is then decided over rows.
    """
    rows = _lines(px)
    px = stencil.line_values(rows)
    before = cut(_light(rows).join(metrics.noise_lines(rows).select("image_id", "impulse_ratio"), "image_id").join(metrics.tone(stencil.line_values(rows)).select("image_id", "dynamic_range"), "image_id").join(metrics.edge_density_lines(rows), "image_id"))
    cond = cut(rules.conditions(before))
    recs = cut(rules.recommend(cond))
    variants = [("illumination_normalize", "strength", (0.45, 0.65)), ("gamma_correct", "gamma", (0.65, 0.85, 1.15, 1.35)), ("clahe", "clip_limit", (1.2, 1.5, 2.0)), ("median_denoise", "kernel_size", (3,)), ("sharpen", "amount", (0.25,))]
    tried = []
    for op, name, values in variants:
        for value in values:
            own = recs.where((F.col("operation_id") == op) & (F.col("parameter") == value)).select("image_id", "priority")
            some = rows.join(own.select("image_id"), "image_id", "left_semi")
            treated = _on_lines(some, op, **{name: value}).join(some.select("image_id", "y", F.col("v").alias("v0")).hint("merge"), ["image_id", "y"], "left")
            tried.append(treated.join(own.hint("shuffle_hash"), "image_id").select((F.col("image_id") * 128 + F.col("priority")).alias("image_id"), "y", "v0", "v"))
    out = tried[0]
    for one in tried[1:]:
        out = out.unionByName(one)
    out = cut(out)
    after = _light(out.select("image_id", "y", "v"))
    # what both have; a treatment that changes the size is rejected below
    both = F.least(F.size("v0"), F.size("v"))
    report = verify_lines(out.where("v0 IS NOT NULL").select("image_id", "y", F.slice("v0", F.lit(1), both).alias("v0"), F.slice("v", F.lit(1), both).alias("v1")))
    size = lambda lines: lines.groupBy("image_id").agg((F.max("y") + 1).alias("h"), F.max(F.size("v")).alias("w"))
    same = size(out).toDF("image_id", "h1", "w1").join(size(rows).toDF("__i", "h0", "w0"), F.expr("image_id div 128 = __i")).select("image_id", ((F.col("h0") == F.col("h1")) & (F.col("w0") == F.col("w1"))).alias("same_size"))
    names = [c for c in after.columns if c != "image_id"]
    key = [F.expr("image_id div 128").alias("image_id"), F.pmod("image_id", F.lit(128)).cast("int").alias("priority")]
    # a recommendation whose treatment left no raster has not been executed
    automatic = recs.where(F.col("operation_id").isin([k for k, (_, _, side) in OPERATIONS.items() if side == "automatic"])).select("image_id", "priority", "operation_id")
    both = automatic.join(after.join(same, "image_id").select(*key, "same_size", *[F.col(c).alias(f"after_{c}") for c in names]), ["image_id", "priority"], "left")
    both = both.join(before.select("image_id", *[F.col(c).alias(f"before_{c}") for c in names]), "image_id")
    checked = rules.benefit(both).join(report.select(*key, "status"), ["image_id", "priority"], "left").join(cond.select("image_id", "level"), "image_id")
    checked = cut(checked.withColumns({"executed": F.col("same_size").isNotNull(), "same_size": F.coalesce("same_size", F.lit(True))}))
    decided = rules.candidate_decision(checked).select("image_id", "priority", "decision", "status")
    steps = rules.enhancement_loop(recs.where("mode = 'enhancement'").join(decided, ["image_id", "priority"], "left").withColumns({"eligible": F.col("decision").isNotNull(), "decision": F.coalesce("decision", F.lit("deferred"))}))
    n = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    taken = F.col("step_status").startswith("accepted")
    g = steps.groupBy("image_id").agg(n(taken).alias("accepted"), n(F.col("step_status") == "accepted_with_caution").alias("cautions"), n(F.col("step_status").startswith("rejected")).alias("rejected"), n(F.col("step_status") == "deferred").alias("deferred"), F.max(F.when(taken, F.col("operation_id"))).alias("operation_id"), F.coalesce(F.bool_and(F.when(taken, F.col("status").isNotNull())), F.lit(True)).alias("verified"))
    _, binary = binarization_candidates(px, recs)
    all_ = recs.groupBy("image_id").agg(F.count("*").alias("recommendations")).join(binary.groupBy("image_id").agg(F.count("*").alias("binarized")), "image_id", "left")
    rows = cond.select("image_id", "level").join(all_, "image_id", "left").join(g, "image_id", "left").fillna(0).fillna(True, ["verified"])
    return rules.final_decision(rows.withColumn("limit_hit", F.col("rejected") >= MOST_ATTEMPTS)).select("image_id", "level", "recommendations", "operation_id", "binarized", "final")
