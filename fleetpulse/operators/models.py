"""Model fitting with MLlib, scoring guards, and checks of recorded model evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.operators.boosting import Boosted
from fleetpulse.operators.extratrees import ExtraTrees, Forest
from fleetpulse.operators.forecast import ordered_reasons
from fleetpulse.params import PROBABILITY_TARGETS, REQUIRED_TARGETS

SEED = 42


# ---- fitting ---------------------------------------------------------------------

MISSING = -1e12  # far below every feature, so that a tree can part missing values from all others


def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All rows with their feature vector; null and NaN become ``MISSING``."""
    safe = {c: f"f{i}" for i, c in enumerate(cols)}
    rows = df.select("*", *[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")),
                                       F.lit(MISSING)).alias(n) for c, n in safe.items()])
    out = VectorAssembler(inputCols=list(safe.values()), outputCol="features", handleInvalid="error").transform(rows)
    return out.drop(*safe.values())


def fit_eta(train: DataFrame, target: str = "target_hours", weight: str = "weight", *, trees: int = 20,
            depth: int = 5) -> GBTRegressor:
    """Boosted trees on absolute error, lifecycle-weighted."""
    return GBTRegressor(labelCol=target, weightCol=weight, lossType="absolute", maxIter=trees, maxDepth=depth,
                        stepSize=0.1, seed=SEED, featuresCol="features", predictionCol="prediction").fit(train)


def _with_gaps() -> Column:
    """The assembled vector as an array in which missing values are NaN again."""
    return F.transform(vector_to_array("features"), lambda v: F.when(v == MISSING, F.lit(float("nan"))).otherwise(v))


@dataclass(frozen=True)
class ExtraTreesClassifier:
    """Extremely randomised trees on assembled rows, fitted like an MLlib estimator."""
    settings: ExtraTrees

    def fit(self, train: DataFrame) -> Forest:
        width = train.select(F.size(vector_to_array("features")).alias("n")).first()
        return self.settings.fit(train, _with_gaps(), width["n"] if width else 1)


def horizon_candidates(trees: int = 20) -> dict:
    """Boosted trees, two ensembles of extremely randomised trees and two forests.

    A constant stands in where one class is missing.
    """
    common = dict(labelCol="y", weightCol="weight", seed=SEED, featuresCol="features")
    return {"boosted": GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.1, **common),
            "extra_trees": ExtraTreesClassifier(ExtraTrees(trees, 8, "sqrt", seed=SEED)),
            "stable_extra_trees": ExtraTreesClassifier(ExtraTrees(trees * 3 // 2, 16, 0.35, seed=SEED + 17)),
            "forest": RandomForestClassifier(numTrees=trees, minInstancesPerNode=8, featureSubsetStrategy="sqrt", maxDepth=8, **common),
            "stable_forest": RandomForestClassifier(numTrees=trees, minInstancesPerNode=16, featureSubsetStrategy="0.35", maxDepth=10, **common)}


def positive_probability(scored: DataFrame, name: str = "score") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def fit_horizon_candidates(train: DataFrame, trees: int = 20) -> dict:
    """name -> fitted model, or ``{"constant": rate}`` when training has one class."""
    row = train.agg(F.avg("y").alias("rate"), F.count_distinct("y").alias("classes")).first()
    if row["classes"] < 2:
        return {"constant": float(row["rate"] or 0.0)}
    return {name: est.fit(train) for name, est in horizon_candidates(trees).items()}


def score_with(model, df: DataFrame, name: str = "score") -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    if isinstance(model, Forest):
        return model.score(df, _with_gaps(), name)
    return positive_probability(model.transform(df), name)


def oof_scores(df: DataFrame, estimator, folds: int) -> DataFrame:
    """Scores of every row by a model that never saw its lifecycle's fold."""
    parts = []
    for k in range(folds):
        train, held = df.filter(F.col("fold") != k), df.filter(F.col("fold") == k)
        row = train.agg(F.avg("y").alias("rate"), F.count_distinct("y").alias("classes")).first()
        model = float(row["rate"] or 0.0) if row["classes"] < 2 else estimator.fit(train)
        parts.append(score_with(model, held, "oof"))
    return reduce(DataFrame.unionByName, parts)


def _logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def calibrate(calibration: DataFrame, selection: DataFrame, score: str = "score") -> DataFrame:
    """Calibrated scores of the selection rows by the method with the lowest Brier score.

    Methods: none, logistic on the logit, isotonic. Ties go in that order.
    """
    cal = calibration.withColumns({"_x": _logit(F.col(score)), "_y": F.col("y").cast("double")})
    sel = selection.withColumns({"_x": _logit(F.col(score)), "_y": F.col("y").cast("double")})
    linear = LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(
        VectorAssembler(inputCols=["_x"], outputCol="_v").transform(cal))
    step = IsotonicRegression(featuresCol=score, labelCol="_y", predictionCol="isotonic").fit(cal)
    out = step.transform(linear.transform(VectorAssembler(inputCols=["_x"], outputCol="_v").transform(sel)))
    out = out.withColumns({"none": F.col(score), "sigmoid": vector_to_array("_p")[1]}).drop("_v", "_p", "_c", "_r", "_x")
    methods = ("none", "sigmoid", "isotonic")
    brier = out.agg(*[F.avg((F.col(m) - F.col("_y")) * (F.col(m) - F.col("_y"))).alias(m) for m in methods]).select(
        F.array_min(F.array(*[F.struct(F.col(m).alias("brier"), F.lit(i).alias("i"), F.lit(m).alias("method"))
                              for i, m in enumerate(methods)])).alias("b"))
    best = brier.select(F.col("b.method").alias("calibration"), F.col("b.brier").alias("brier_score"))
    picked = F.col("none")
    for m in methods[1:]:
        picked = F.when(F.col("calibration") == m, F.col(m)).otherwise(picked)
    return out.crossJoin(F.broadcast(best)).withColumn("calibrated", picked).drop("_y", *methods)  # one row


def select_candidate(scores: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Best candidate per target: feasible first, then the order of its metrics, then its name."""
    ok = F.col("eligible")
    order = F.struct(
        F.when(ok, 0).otherwise(1).alias("a"),
        F.when(ok, F.coalesce("early_fn", F.lit(1.0))).otherwise(F.col("violation")).alias("b"),
        F.when(ok, F.col("fn_rate")).otherwise(F.col("fp_rate")).alias("c"),
        F.when(ok, F.col("fp_rate")).otherwise(F.col("fn_rate")).alias("d"),
        F.when(ok, F.col("brier_score")).otherwise(F.coalesce("early_fn", F.lit(1.0))).alias("e"),
        F.when(ok, F.coalesce("event_fn", F.lit(1.0))).otherwise(F.col("brier_score")).alias("f"), F.col("candidate"))
    cols = [c for c in scores.columns if c not in by]
    return scores.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("r")).select(*by, "r.*")


def score(models: dict, df: DataFrame) -> DataFrame:
    """All targets on one table: regressors give hours, classifiers probabilities."""
    out = df
    for target, model in models.items():
        if isinstance(model, Boosted):
            out = model.score(out, _with_gaps(), f"ml_{target}_hours")
        elif target.startswith("time_to_"):
            out = model.transform(out).withColumnRenamed("prediction", f"ml_{target}_hours")
        else:
            out = score_with(model, out, f"ml_{target}")
    return out


def save_models(models: dict, folder: str) -> None:
    for target, model in models.items():
        if isinstance(model, Forest):
            model.nodes(SparkSession.active()).write.mode("overwrite").parquet(f"{folder}/{target}")
        elif not isinstance(model, float):
            PipelineModel([model]).write().overwrite().save(f"{folder}/{target}")


# ---- scoring guards -------------------------------------------------------------------

def out_of_distribution(df: DataFrame, envelope: dict[str, tuple[float, float]], *, margin: float = 0.1,
                        max_outside: float = 0.1, gap: str | None = None, max_gap_s: float | None = None) -> DataFrame:
    """Share of features outside their widened training envelope, and the resulting flag.

    The envelope has one pair of numbers per feature, so it is inlined as literals.
    """
    tests = []
    for c, (lo, hi) in envelope.items():
        room = margin * max(hi - lo, 1e-9)
        tests.append(F.when((F.col(c) < lo - room) | (F.col(c) > hi + room), 1.0).otherwise(0.0))
    share = F.aggregate(F.array(*tests), F.lit(0.0), lambda a, x: a + x) / float(len(tests))
    sampling = F.coalesce(F.col(gap) > 1.5 * max_gap_s, F.lit(False)) if gap and max_gap_s is not None else F.lit(False)
    return df.withColumns({"outside_feature_fraction": share, "sampling_ood": sampling}).withColumn(
        "outside_distribution", (F.col("outside_feature_fraction") > max_outside) | F.col("sampling_ood"))


def support_flags(df: DataFrame, support: dict[str, tuple[float, float]], max_duration_h: float | None = None) -> DataFrame:
    """Forecasts outside training support, physically invalid or out of order; values are never clipped."""
    out, broken, beyond = {}, F.lit(False), F.lit(False)
    for target, (lo, hi) in support.items():
        p = F.col(f"ml_time_to_{target}_hours")
        bad = F.coalesce((p < lo) | (p > hi), F.lit(False))
        wrong = p.isNotNull() & (F.isnan(p) | (F.abs(p) == float("inf")) | (p < 0))
        out |= {f"{target}_support_violation": bad, f"{target}_physically_invalid": wrong}
        beyond, broken = beyond | bad, broken | wrong
    if max_duration_h is not None:
        beyond = beyond | (F.col("elapsed_lifecycle_hours") > max_duration_h)
    late = F.coalesce(F.col("ml_time_to_warning_hours") > F.col("ml_time_to_critical_hours"), F.lit(False))
    reasons = F.array_compact(F.array(F.when(broken, "invalid_eta"), F.when(late, "inconsistent_warning_critical_eta")))
    return df.withColumns(out | {"beyond_support": beyond, "physical_reasons": reasons})


# ---- recorded evidence ------------------------------------------------------------------

METRICS = ("validation_fp_rate", "validation_fn_rate", "validation_fn_ceiling", "test_fp_rate", "test_fn_rate", "test_fn_ceiling")


def _rate(c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & ~F.isnan(v) & v.between(0, 1)


def _open_rate(c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < 1)


def _named(code: str) -> Column:
    return F.concat(F.lit(f"{code}:"), F.col("target"))


def _listed(tests: list[tuple[Column, Column]]) -> Column:
    return ordered_reasons(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for cond, name in tests]))


def probability_evidence_reasons(evidence: DataFrame, ceiling: float = 0.10, required: Column | None = None) -> DataFrame:
    """Why a probability target's recorded evidence is not acceptable; gates are recomputed from its numbers.

    ``selected_threshold`` is the evidence's own, ``runtime_threshold`` the one in force.
    """
    must = F.lit(True) if required is None else required
    tests = []
    for c in ("selected_threshold", "runtime_threshold"):
        tests += [(~_open_rate(c) & _rate(c), _named("threshold_at_invalid_boundary")),
                  (~_open_rate(c) & ~_rate(c), _named("invalid_threshold"))]
    tests.append((_open_rate("selected_threshold") & _open_rate("runtime_threshold")
                  & (F.abs(F.col("selected_threshold") - F.col("runtime_threshold")) > 1e-12), _named("threshold_evidence_mismatch")))
    tests.append((~reduce(lambda a, b: a & b, [_rate(c) for c in METRICS]), _named("invalid_probability_metric")))
    for part in ("validation", "test"):
        ok = _rate(f"{part}_fn_rate") & _rate(f"{part}_fn_ceiling")
        rate, limit, met = F.col(f"{part}_fn_rate"), F.col(f"{part}_fn_ceiling"), F.col(f"{part}_fn_ceiling_met")
        tests += [(ok & (limit > ceiling), _named("model_fn_ceiling_exceeds_runtime_policy")),
                  (ok & ~met.eqNullSafe(rate <= limit), _named(f"{part}_fn_numeric_contradiction")),
                  (ok & (rate > F.least(limit, F.lit(ceiling))), _named(f"{part}_fn_ceiling_not_met"))]
    need, reasons = F.col("target_required"), F.col("target_ineligibility_reasons")
    tests += [(~F.col("baseline_passed").eqNullSafe(True), _named("baseline_not_passed")),
              (~F.col("calibration_passed").eqNullSafe(True), _named("calibration_not_passed")),
              (~F.col("target_eligible").eqNullSafe(True), _named("target_ineligible")),
              (need.isNull(), _named("required_target_flag_missing")),
              (must & (need == F.lit(False)), _named("mandatory_target_not_marked_required")),
              (~must & (need == F.lit(True)), _named("optional_target_marked_required")),
              (reasons.isNull(), _named("required_target_evidence_missing")),
              (F.size(reasons) > 0, _named("eligible_target_has_rejection_reasons"))]
    return evidence.withColumn("evidence_reasons", _listed(tests))


def eta_evidence_reasons(evidence: DataFrame) -> DataFrame:
    """Why a time target's recorded evidence is not acceptable."""
    def no(c):
        return ~F.col(c).eqNullSafe(True)
    lo, hi = F.col("support_min_hours"), F.col("support_max_hours")

    def bad(v):
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)
    reasons = F.col("target_ineligibility_reasons")
    base = [(no("target_required"), _named("mandatory_target_not_marked_required")),
            (no("target_eligible"), _named("required_target_ineligible")),
            (~F.col("model_loaded").eqNullSafe(F.col("loaded")), _named("eta_model_loaded_evidence_mismatch")),
            (no("model_schema_compatible") | no("feature_schema_compatible"), _named("eta_schema_incompatible")),
            (no("physical_validation_passed") | no("baseline_passed"), _named("eta_validation_not_passed")),
            (reasons.isNull() | (F.size(reasons) > 0), _named("eta_target_reasons_invalid")),
            (bad(lo) | bad(hi), _named("eta_support_invalid"))]
    clean = ~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, _ in base])
    return evidence.withColumn("evidence_reasons", _listed(base + [(clean & (hi < lo), _named("eta_support_invalid"))]))


def required_targets(models: DataFrame, mandated: Sequence[str] = REQUIRED_TARGETS, declared: str = "declared_targets",
                     loaded: str = "loaded_targets") -> DataFrame:
    """Targets a model must carry: what code mandates plus what it declares, and what is missing."""
    must = F.array(*[F.lit(t) for t in mandated])
    listed = F.coalesce(F.col(declared), F.array().cast("array<string>"))
    effective = F.array_sort(F.array_union(must, listed))
    return models.withColumns({
        "effective_required": effective, "undeclared_mandatory": F.array_except(must, listed),
        "missing_required": F.array_except(effective, F.coalesce(F.col(loaded), F.array().cast("array<string>")))})


def runtime_policy(evidence: DataFrame) -> DataFrame:
    """Threshold in force and eligibility per model and target."""
    rows = probability_evidence_reasons(evidence, required=F.col("target_required").eqNullSafe(True))
    valid = _open_rate("runtime_threshold")
    return rows.withColumns({
        "threshold": F.when(valid, F.col("runtime_threshold")),
        "runtime_eligible": F.col("threshold_eligible").eqNullSafe(True) & valid & (F.size("evidence_reasons") == 0)})


def production_eligibility(models: DataFrame, evidence: DataFrame, *, domain: str = "plant", ceiling: float = 0.10,
                           mandated: Sequence[str] = REQUIRED_TARGETS) -> DataFrame:
    """One gate per model: metadata, loaded targets and evidence of every required target."""
    rows = required_targets(models, mandated)
    def unless(cond, code):
        return F.when(~F.coalesce(cond, F.lit(False)), F.lit(code))

    def when(c, code):
        return F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(code))
    base = F.array(
        unless(F.col("maturity_stage") == "deployed", "model_not_deployed"),
        unless(F.col("model_stage").isin("plant_production", "production"), "model_stage_not_allowed"),
        unless(F.col("production_eligible"), "production_ineligible"), unless(F.col("data_domain") == domain, "data_domain_not_allowed"),
        when("revoked", "model_revoked"), when("superseded", "model_superseded"), when("corrupted", "model_corrupted"),
        F.when(F.col("metadata_invalid").isNotNull(), F.concat(F.lit("metadata_invalid:"), F.col("metadata_invalid"))),
        unless(F.col("model_version").isNotNull(), "missing_model_version"))
    named = F.concat(F.transform("undeclared_mandatory", lambda t: F.concat(F.lit("mandatory_target_missing_from_metadata:"), t)),
                     F.transform("missing_required", lambda t: F.concat(F.lit("missing_required_model:"), t)))
    rows = rows.withColumn("_own", F.concat(F.array_compact(base), named))
    found = probability_evidence_reasons(evidence, ceiling).join(rows.select("model_id", "effective_required"), "model_id")
    per = found.filter(F.array_contains("effective_required", F.col("target"))).groupBy("model_id").agg(
        F.flatten(F.collect_list("evidence_reasons")).alias("_evidence"), F.collect_set("target").alias("_seen"))
    out = rows.join(per, "model_id", "left")
    none = F.array().cast("array<string>")
    absent = F.array_except(F.filter("effective_required", lambda t: t.startswith("probability_")), F.coalesce("_seen", none))
    lost = F.concat(F.transform(absent, lambda t: F.concat(F.lit("required_probability_target_missing:"), t)),
                    F.transform(absent, lambda t: F.concat(F.lit("required_target_evidence_missing:"), t)))
    reasons = ordered_reasons(F.concat("_own", F.coalesce("_evidence", none), lost))
    return out.withColumn("production_reasons", reasons).withColumn(
        "production_ok", F.size("production_reasons") == 0).drop("_own", "_evidence", "_seen")


def promotion_policy(models: DataFrame, evidence: DataFrame, **kw) -> DataFrame:
    """Acceptance gate of a promotion: as in production, but for a candidate that is not deployed yet."""
    ready = models.withColumns({"maturity_stage": F.lit("deployed"), "model_stage": F.lit("production"),
                                "production_eligible": F.lit(True), "metadata_invalid": F.lit(None).cast("string")})
    return production_eligibility(ready, evidence, **kw)


def promotion_decisions(candidate: DataFrame, production: DataFrame, *, min_lifecycles: int = 10) -> DataFrame:
    """Per time target: does the candidate beat its paired baseline and the model in production?"""
    prod = production.select("target", F.col("test_mae").alias("production_test_mae"))
    rows = candidate.join(prod, "target", "left")
    val = F.coalesce("paired_validation_mae", "validation_mae")
    test = F.coalesce("paired_test_mae", "test_mae")
    base_test = F.coalesce("baseline_test_mae", "baseline_validation_mae")
    beats_v = F.coalesce(val < F.col("baseline_validation_mae"), F.lit(False))
    beats_t = F.coalesce(test < base_test, F.lit(False))
    beats_p = F.col("production_test_mae").isNull() | F.coalesce(F.col("test_mae") < F.col("production_test_mae"), F.lit(False))
    enough = F.col("training_lifecycles") >= min_lifecycles
    ok = enough & beats_v & beats_t & beats_p
    return rows.withColumns({"lifecycle_count_ok": enough, "beats_validation_baseline": beats_v, "beats_test_baseline": beats_t,
                             "beats_production": beats_p, "eligible": ok, "recommended_source": F.when(ok, "ml").otherwise("statistical")})


SCHEMA_VERSION, CONTRACT_VERSION = "3.0", "3.0"


def normalize_evidence(raw: DataFrame, required: Sequence[str] = REQUIRED_TARGETS) -> DataFrame:
    """Bring older evidence rows to the current names; nothing absent is invented.

    A threshold counts only where the paths that record it agree; counts are
    recovered only where rate x rows is a whole number.
    """
    version = F.col("schema_version")
    contract = F.col("contract_version")
    invalid = (F.when(version.isNotNull() & (version != SCHEMA_VERSION), F.concat(
                   F.lit("unsupported_model_metadata_schema_version:"), version))
               .when(contract.isNotNull() & (contract != CONTRACT_VERSION), F.concat(
                   F.lit("unsupported_forecast_policy_contract_version:"), contract)))

    def open_(v):
        return v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < 1)
    own = F.coalesce("selected_threshold", "validation_threshold_selected", "validation_classification_threshold")
    test = F.col("test_classification_threshold")
    threshold = F.when(open_(own) & (test.isNull() | (open_(test) & (F.abs(own - test) <= 1e-12))), own)

    def count(part, positive):
        n, r = F.col(f"{part}_sample_count"), F.col(f"{part}_event_rate")
        hit = F.rint(n * r)
        good = n.isNotNull() & r.between(0, 1) & (F.abs(hit - n * r) <= 1e-6)
        return F.when(good, (hit if positive else n - hit).cast("long"))
    reasons = F.coalesce("target_ineligibility_reasons", F.when(
        F.col("eligible").eqNullSafe(True), F.array().cast("array<string>")).otherwise(
        F.array(F.coalesce("reason", F.lit("legacy_target_ineligible")))))
    limit = F.col("maximum_calibration_error")
    calm = (F.col("validation_calibration_error") <= limit) & (F.col("test_calibration_error") <= limit)
    return raw.withColumns({
        "metadata_invalid": invalid, "selected_threshold": threshold, "baseline_passed": F.coalesce("baseline_passed", "beats_constant_rate_baseline"),
        "calibration_passed": F.coalesce("calibration_passed", F.coalesce(calm, F.lit(False))),
        "target_required": F.when(version.isNull(), F.col("target").isin(*required)).otherwise(F.coalesce("target_required", F.col("target").isin(*required))),
        **{f"{part}_{kind}_count": count(part, kind == "positive") for part in ("validation", "test") for kind in ("positive", "negative")},
        "target_ineligibility_reasons": reasons,
        "target_eligible": F.coalesce("target_eligible", F.col("eligible").eqNullSafe(True) & (F.size(reasons) == 0))})


def contract_report(evidence: DataFrame, models: DataFrame, targets: Sequence[str] = PROBABILITY_TARGETS,
                    required: Sequence[str] = REQUIRED_TARGETS) -> DataFrame:
    """Every model x target: what is required, present, numeric and eligible, and its structural failures."""
    grid = models.select("model_id", "loaded_targets", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    rows = grid.join(runtime_policy(evidence).withColumn("_present", F.lit(True)), ["model_id", "target"], "left")
    present = F.col("_present").isNotNull()
    numeric = F.coalesce(F.col("threshold").isNotNull(), F.lit(False))
    failures = F.array_compact(F.array(F.when(~numeric, _named("invalid_threshold")), F.when(~present, _named("target_evidence_missing"))))
    return rows.select(
        "model_id", "target", F.col("target").isin(*required).alias("required"),
        F.coalesce(F.array_contains("loaded_targets", F.col("target")), F.lit(False)).alias("artifact_present"),
        F.col("threshold").alias("selected_threshold"), numeric.alias("threshold_numeric"), present.alias("evidence_present"),
        F.coalesce("runtime_eligible", F.lit(False)).alias("runtime_eligible"), failures.alias("structural_failures"))


def compatible_evidence(evidence: DataFrame, runtime: dict[str, str]) -> DataFrame:
    """Evidence whose recorded versions equal the runtime's, or why it is refused."""
    # Version columns and their refusal reasons.
    reasons = {"feature_list_version": "feature_schema_mismatch", "input_schema_version": "input_schema_version_mismatch",
               "threshold_config_version": "threshold_config_version_mismatch",
               "lifecycle_config_version": "lifecycle_config_version_mismatch"}
    tests = [F.when(~F.col(c).eqNullSafe(F.lit(runtime[c])), F.lit(r)) for c, r in reasons.items() if c in runtime]
    out = evidence.withColumn("refusals", F.array_compact(F.array(*tests)))
    return out.withColumn("compatible", F.size("refusals") == 0)


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """Newest record per model and target."""
    w = Window.partitionBy("model_id", "target").orderBy(F.col("recorded_us").desc())
    return evidence.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
