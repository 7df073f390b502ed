"""Rules over metrics: diagnoses, conditions, recommendations and decisions. Limits stand in tables; rows are decided by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code, severity, metric, low (inclusive or null), high (exclusive or null) of the band in which it applies.
DIAGNOSES = (
    ("very_dark", "high", "brightness", None, 55.0),
    ("dark", "medium", "brightness", 55.0, 85.0),
    ("very_low_contrast", "high", "contrast", None, 20.0),
    ("low_contrast", "medium", "contrast", 20.0, 35.0),
    ("very_low_sharpness", "high", "sharpness", None, 25.0),
    ("low_sharpness", "medium", "sharpness", 25.0, 60.0),
)
#: Bands above limits (low exclusive, high inclusive or null).
DIAGNOSES_ABOVE = (
    ("very_bright", "high", "brightness", 220.0, None),
    ("bright", "medium", "brightness", 200.0, 220.0),
    ("high_noise", "high", "noise", 20.0, None),
    ("moderate_noise", "medium", "noise", 12.0, 20.0),
    ("strong_uneven_illumination", "high", "illumination_variation", 0.18, None),
    ("uneven_illumination", "medium", "illumination_variation", 0.10, 0.18),
)
IMPULSE_HIGH, IMPULSE_MEDIUM = 0.012, 0.004


def rule_table(spark: SparkSession) -> DataFrame:
    """code, severity, metric, lo, hi, above: the bands as rows, a table of fixed size."""
    rows = [(*r, False) for r in DIAGNOSES] + [(*r, True) for r in DIAGNOSES_ABOVE]
    return spark.createDataFrame(rows, "code string, severity string, metric string, lo double, hi double, above boolean")


def metrics_long(m: DataFrame, names: tuple[str, ...] = ("brightness", "contrast", "sharpness", "noise", "illumination_variation")) -> DataFrame:
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return m.selectExpr("image_id", f"stack({len(names)}, {pairs}) as (metric, value)")


def diagnose(m: DataFrame) -> DataFrame:
    """image_id, code, severity: band join with the rule table; impulse rules apply where no noise rule does."""
    rules = F.broadcast(rule_table(m.sparkSession))
    long = metrics_long(m)
    v = F.col("value")
    above = F.col("above") & (F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi")))
    below = ~F.col("above") & (F.col("lo").isNull() | (v >= F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi")))
    found = long.join(rules, "metric").where(above | below).select("image_id", "code", "severity")
    impulse = m.where((F.col("noise") <= 12) & (F.col("impulse_ratio") >= IMPULSE_MEDIUM))
    high = F.col("impulse_ratio") >= IMPULSE_HIGH
    return found.unionByName(impulse.select("image_id", F.when(high, "high_noise").otherwise("moderate_noise").alias("code"), F.when(high, "high").otherwise("medium").alias("severity")))


def preservation_profile(m: DataFrame) -> DataFrame:
    """image_id, points, level, indicators."""
    tests = [("dense_edge_structure", F.col("edge_density") >= 0.12, 2), ("weak_contrast_details", F.col("contrast") < 35, 1), ("weak_edge_definition", F.col("sharpness") < 60, 1), ("limited_dynamic_range", F.col("dynamic_range") < 60, 1)]
    points = sum((F.when(t, p).otherwise(0) for _, t, p in tests), F.lit(0))
    level = F.when(points >= 3, "high").when(points >= 1, "moderate").otherwise("low")
    codes = F.filter(F.array(*[F.when(t, F.lit(c)) for c, t, _ in tests]), lambda c: c.isNotNull())
    return m.select("image_id", points.alias("points"), level.alias("level"), codes.alias("indicators"))


CONDITIONS = {"dark": ("dark", "very_dark"), "bright": ("bright", "very_bright"), "low_contrast": ("low_contrast", "very_low_contrast"), "low_sharpness": ("low_sharpness", "very_low_sharpness"), "noise": ("moderate_noise", "high_noise"), "uneven": ("uneven_illumination", "strong_uneven_illumination")}


def severity(codes: Column, medium: str, high: str) -> Column:
    return F.when(F.array_contains(codes, high), "high").when(F.array_contains(codes, medium), "medium").otherwise("none")


def code_set(diagnoses: DataFrame) -> DataFrame:
    """image_id, codes (sorted, distinct)."""
    return diagnoses.groupBy("image_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def conditions(m: DataFrame) -> DataFrame:
    """A wide row an image: six severities, impulse and gaussian noise, preservation level and skew."""
    codes = m.select("image_id").join(code_set(diagnose(m)), "image_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    c = codes.select("image_id", "codes", *[severity(F.col("codes"), *pair).alias(k) for k, pair in CONDITIONS.items()])
    c = c.join(m.select("image_id", "noise", "impulse_ratio").withColumnRenamed("noise", "noise_level"), "image_id").join(preservation_profile(m).select("image_id", "level"), "image_id")
    noisy = F.col("noise") != "none"
    impulse = noisy & (F.col("impulse_ratio") >= IMPULSE_HIGH)
    return c.withColumn("impulse_noise", impulse).withColumn("gaussian_noise", noisy & ~impulse & (F.col("noise_level") > 0)).drop("noise_level", "impulse_ratio")


def _on(name: str) -> Column:
    return F.col(name) != "none"


def conflicts(c: DataFrame) -> DataFrame:
    """image_id, code, severity."""
    tests = [
        ("NOISE_SHARPNESS_CONFLICT", "high", _on("noise") & _on("low_sharpness")),
        ("GAUSSIAN_NOISE_MANUAL_REVIEW", "medium", F.col("gaussian_noise")),
        ("ILLUMINATION_CONTRAST_ORDER", "medium", _on("uneven") & _on("low_contrast")),
        ("ILLUMINATION_DARKNESS_ORDER", "medium", _on("uneven") & _on("dark")),
        ("DARK_LOW_CONTRAST_SEQUENCE", "medium", _on("dark") & _on("low_contrast")),
        ("BRIGHT_LOW_CONTRAST_SEQUENCE", "medium", _on("bright") & _on("low_contrast")),
    ]
    rows = F.array(*[F.when(t, F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"))) for k, s, t in tests])
    return c.select("image_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("image_id", "r.*")


def blocked(c: DataFrame) -> DataFrame:
    """image_id, operation_id, rule: which rule blocks it; a later rule takes the place of an earlier one."""
    high = F.col("level") == "high"
    order = [("sharpen", [("noise", _on("noise"))]), ("bilateral_denoise", [("sensitivity", high), ("gaussian", F.col("gaussian_noise"))]), ("non_local_means_denoise", [("sensitivity", high), ("gaussian", F.col("gaussian_noise"))]), ("median_denoise", [("sensitivity", high)]), ("morphological_opening", [("sensitivity", high)]), ("morphological_closing", [("sensitivity", high)]), ("clahe", [("uneven", _on("uneven"))])]
    rows = []
    for op, rules in order:
        rule = F.coalesce(*[F.when(t, F.lit(r)) for r, t in rules])
        rows.append(F.when(rule.isNotNull(), F.struct(F.lit(op).alias("operation_id"), rule.alias("rule"))))
    return c.select("image_id", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("image_id", "r.*")


def parameters(c: DataFrame) -> DataFrame:
    """Adapted parameters: clip_limit, strength, gamma_dark and gamma_bright of each image."""
    clip = F.when(F.col("low_contrast") == "high", 2.0).otherwise(1.5)
    return c.select(
        "image_id",
        F.when(F.col("level") == "high", F.least(clip, F.lit(1.2))).otherwise(clip).alias("clip_limit"),
        F.when(F.col("level") == "high", 0.45).otherwise(0.65).alias("strength"),
        F.when(F.col("dark") == "high", 0.65).otherwise(0.85).alias("gamma_dark"),
        F.when(F.col("bright") == "high", 1.35).otherwise(1.15).alias("gamma_bright"),
    )


def recommend(c: DataFrame) -> DataFrame:
    """image_id, priority, operation_id, parameter, mode, risk; the first of each operation counts. `c` may hold skew_angle and skew_confidence."""
    p = c.join(parameters(c), "image_id")
    rows = [
        (10, "illumination_normalize", "strength", "enhancement", "medium", _on("uneven")),
        (20, "gamma_correct", "gamma_dark", "enhancement", "low", _on("dark")),
        (25, "gamma_correct", "gamma_bright", "enhancement", "low", ~_on("dark") & _on("bright")),
        (30, "clahe", "clip_limit", "enhancement", "medium", _on("low_contrast") & ~_on("uneven")),
        (40, "median_denoise", 3.0, "enhancement", "medium-high", F.col("impulse_noise") & (F.col("level") != "high")),
        (50, "sharpen", 0.25, "enhancement", "medium", _on("low_sharpness") & ~_on("noise") & (F.col("level") != "high")),
        (70, "adaptive_threshold", 35.0, "binarization", "medium-high", _on("uneven")),
    ]
    if "skew_angle" in c.columns:
        rows.insert(6, (60, "deskew", "skew_angle", "alignment", "medium", (F.abs("skew_angle") >= 0.75) & (F.col("skew_confidence") >= 0.5)))
    one = lambda n, op, v, mode, risk: F.struct(F.lit(n).alias("priority"), F.lit(op).alias("operation_id"), (F.col(v) if isinstance(v, str) else F.lit(v)).cast("double").alias("parameter"), F.lit(mode).alias("mode"), F.lit(risk).alias("risk"))
    found = F.filter(F.array(*[F.when(t, one(n, op, v, mode, risk)) for n, op, v, mode, risk, t in rows]), lambda r: r.isNotNull())
    return p.select("image_id", F.explode(found).alias("r")).select("image_id", "r.*")


AVOID = ("histogram_equalization", "global_threshold", "morphological_opening", "morphological_closing")


def avoid(c: DataFrame) -> DataFrame:
    """image_id, seq, operation_id: what not to use, the fixed list last."""
    high = F.col("level") == "high"
    rows = [F.when(F.col("impulse_noise") & high, F.array(F.lit("median_denoise"))), F.when(_on("noise") & ~F.col("impulse_noise"), F.array(F.lit("bilateral_denoise"), F.lit("non_local_means_denoise"))), F.when(_on("low_sharpness") & (_on("noise") | high), F.array(F.lit("sharpen"))), F.array(*[F.lit(a) for a in AVOID])]
    return c.select("image_id", F.posexplode(F.flatten(F.filter(F.array(*rows), lambda r: r.isNotNull()))).alias("seq", "operation_id"))


def candidate_plan(c: DataFrame) -> DataFrame:
    """image_id, priority, operation_id (null: manual review), mode, automatic: one tonal step only, in the proven order."""
    one = lambda n, op, mode, auto: F.struct(F.lit(n).alias("priority"), F.lit(op).cast("string").alias("operation_id"), F.lit(mode).alias("mode"), F.lit(auto).alias("automatic"))
    rows = [
        F.when(_on("uneven"), one(10, "illumination_normalize", "candidate", True)).when(_on("dark"), one(20, "gamma_correct", "candidate", True)).when(_on("bright"), one(25, "gamma_correct", "candidate", True)),
        F.when(_on("low_contrast") & ~_on("uneven"), one(30, "clahe", "candidate", True)),
        F.when(F.col("impulse_noise"), one(40, "median_denoise", "candidate", False)).when(_on("noise"), one(40, None, "manual_review", False)),
        F.when(_on("low_sharpness") & ~_on("noise"), one(50, "sharpen", "candidate", True)),
    ]
    return c.select("image_id", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("image_id", "r.*")


def requires_treatment(c: DataFrame) -> DataFrame:
    any_ = F.lit(False)
    for k in CONDITIONS:
        any_ = any_ | _on(k)
    return c.select("image_id", any_.alias("requires_treatment"))


def benefit(r: DataFrame) -> DataFrame:
    """r (operation_id and brightness, contrast, sharpness, noise, illumination_variation as before_ and after_) with metric, gain, required and passed."""
    off = lambda c: F.greatest(F.lit(85.0) - F.col(c), F.col(c) - F.lit(200.0), F.lit(0.0))
    table = [
        ("gamma_correct", "brightness", off("before_brightness") - off("after_brightness"), F.lit(1.0)),
        ("clahe", "contrast", F.col("after_contrast") - F.col("before_contrast"), F.lit(1.0)),
        ("sharpen", "sharpness", F.col("after_sharpness") - F.col("before_sharpness"), F.col("before_sharpness") * 0.02),
        ("median_denoise", "noise", F.col("before_noise") - F.col("after_noise"), F.lit(0.5)),
        ("illumination_normalize", "illumination_variation", F.col("before_illumination_variation") - F.col("after_illumination_variation"), F.lit(0.01)),
    ]
    pick = lambda i: F.coalesce(*[F.when(F.col("operation_id") == t[0], t[i]) for t in table])
    metric = F.coalesce(*[F.when(F.col("operation_id") == t[0], F.lit(t[1])) for t in table])
    out = r.withColumns({"metric": metric, "gain": F.round(pick(2), 6), "required": F.round(pick(3), 6)})
    return out.withColumn("passed", F.coalesce(F.col("gain") >= F.col("required"), F.lit(False)))


def candidate_decision(r: DataFrame) -> DataFrame:
    """r (executed, same_size, passed, status or null if the check failed, level) with decision."""
    rules = [(~F.col("executed"), "rejected_execution_failed"), (~F.col("same_size"), "rejected_dimension_change"), (~F.col("passed"), "rejected_no_benefit"), (F.col("status").isNull(), "rejected_verification_failed"), (F.col("status") == "high_risk", "rejected_high_risk"), ((F.col("status") == "caution") & (F.col("level") == "high"), "rejected_sensitive"), (F.col("status") == "caution", "accepted_with_caution")]
    out = F.lit("accepted")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return r.withColumn("decision", out)


def enhancement_loop(r: DataFrame, most_accepted: int = 1, most_attempts: int = 4) -> DataFrame:
    """r (image_id, priority, operation_id, eligible, decision: what each would get on the original) with step_status.

    Attempts go in order of priority; once one is accepted, or the attempts are used up, the rest is deferred; a second
    step with an operation that was tried is skipped. Since acceptance ends the run, every attempt is on the original, so all were decided in parallel.
    """
    order = Window.partitionBy("image_id").orderBy("priority", "operation_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("image_id", "operation_id").orderBy("priority")) == 1
    tried = F.col("eligible") & F.col("fresh")
    r = r.withColumn("fresh", first).withColumn("attempts", F.coalesce(F.sum(tried.cast("int")).over(before), F.lit(0)))
    good = tried & F.col("decision").startswith("accepted") & (F.col("attempts") < most_attempts)
    r = r.withColumn("accepted_before", F.coalesce(F.sum(good.cast("int")).over(before), F.lit(0)))
    status = F.when(~F.col("fresh"), "skipped").when(~F.col("eligible"), "deferred").when((F.col("accepted_before") >= most_accepted) | (F.col("attempts") >= most_attempts), "deferred").otherwise(F.col("decision"))
    return r.withColumn("step_status", status).drop("fresh", "attempts", "accepted_before")


def analyze(m: DataFrame) -> DataFrame:
    """The whole record of each image: its metrics, the sorted diagnosis codes with their severities, and the preservation profile."""
    found = diagnose(m).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("code", "severity"))).alias("diagnoses"))
    none = F.array().cast("array<struct<code:string,severity:string>>")
    profile = preservation_profile(m).select("image_id", "points", "level", "indicators")
    return m.join(profile, "image_id").join(found, "image_id", "left").withColumn("diagnoses", F.coalesce("diagnoses", none))


def audit(steps: DataFrame, most_accepted: int = 1, most_attempts: int = 4) -> DataFrame:
    """violation, images, audited: how many of the audited images break each rule of a run (steps: image_id, priority, operation_id, step_status)."""
    taken, turned = F.col("step_status").startswith("accepted"), F.col("step_status").startswith("rejected")
    tried = F.when(taken | turned, F.col("operation_id"))
    last = F.max(F.when(taken, F.col("priority"))).over(Window.partitionBy("image_id"))
    g = steps.withColumn("__at", last).groupBy("image_id").agg(F.count_if(taken).alias("a"), F.count_if(taken | turned).alias("t"), F.count_distinct(tried).alias("k"), F.count_if(turned & (F.col("priority") > F.col("__at"))).alias("l"))
    rules = {"more_than_one_accepted": F.col("a") > most_accepted, "more_than_four_attempts": F.col("t") > most_attempts, "operation_repeated": F.col("t") > F.col("k"), "attempt_after_acceptance": F.col("l") > 0}
    sums = g.agg(F.count("*").alias("audited"), *[F.count_if(test).alias(name) for name, test in rules.items()])
    return sums.select("audited", F.explode(F.array(*[F.struct(F.lit(name).alias("violation"), F.col(name).alias("images")) for name in rules])).alias("v")).select("v.*", "audited")


def final_decision(s: DataFrame) -> DataFrame:
    """s (image_id, recommendations, accepted, cautions, limit_hit, rejected, deferred, binarized, verified) with final."""
    out = (
        F.when(F.col("recommendations") == 0, "no_treatment")
        .when(F.col("accepted") > 0, F.when(~F.col("verified"), "review_required").when(F.col("cautions") > 0, "accepted_with_caution").otherwise("accepted"))
        .when(F.col("limit_hit"), "review_required")
        .when(F.col("rejected") > 0, "unchanged_due_to_risk")
        .when((F.col("deferred") > 0) | (F.col("binarized") > 0), "review_required")
        .otherwise("no_treatment")
    )
    return s.withColumn("final", out)
