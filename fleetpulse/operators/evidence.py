"""Is an audit row's model evidence complete and free of contradictions?

One array of failed checks per row, built from a rule list and evaluated as a
projection; the report is a count per failed check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.rules import strict_bool
from fleetpulse.operators.evaluate import n_where
from fleetpulse.params import ETA_TARGETS, PROBABILITY_TARGETS, REQUIRED_TARGETS

# Audit cells by type.
LISTS = ("required_model_targets", "loaded_model_targets", "configured_mandatory_targets", "metadata_required_targets",
         "effective_required_targets", "mandatory_targets_missing_from_metadata", "missing_required_model_targets",
         "production_policy_reasons_json", "withholding_reasons_json", "physical_validation_reasons_json",
         "feature_readiness_reasons_json", "recommendation_trigger_targets", "recommendation_trigger_probability_targets",
         "recommendation_trigger_eta_targets", "recommendation_trigger_rules", "probability_threshold_crossings")
NUMBER_MAPS = ("selected_probability_thresholds", "model_recorded_probability_fn_ceiling", "effective_probability_fn_ceiling",
               "model_recorded_validation_fn_ceilings", "model_recorded_test_fn_ceilings",
               "effective_validation_fn_ceilings", "effective_test_fn_ceilings")
FLAGS = ("production_eligible", "production_policy_passed", "model_revoked", "model_superseded", "model_corrupted",
         "model_metadata_valid", "model_artifacts_valid", "model_schema_compatible", "model_feature_schema_compatible",
         "physical_validation_passed", "feature_ready", "ood_detected", "target_support_valid", "disagreement_detected",
         "forecast_withheld", "recommendation_actionable")
RATES = ("validation_fp_rate", "validation_fn_rate", "validation_fn_ceiling", "test_fp_rate", "test_fn_rate", "test_fn_ceiling")
_RECORD = ("struct<" + ",".join(f"{c}:double" for c in ("selected_threshold", *RATES)) + ","
           + ",".join(f"{c}:boolean" for c in ("target_required", "target_eligible", "validation_fn_ceiling_met",
                                               "test_fn_ceiling_met", "baseline_passed", "calibration_passed"))
           + ",target_ineligibility_reasons:array<string>>")
_ETA_FLAGS = ("target_required", "target_eligible", "model_loaded", "model_schema_compatible", "feature_schema_compatible",
              "physical_validation_passed", "baseline_passed")
_ETA_RECORD = ("struct<" + ",".join(f"{c}:boolean" for c in _ETA_FLAGS)
               + ",support_min_hours:double,support_max_hours:double,target_ineligibility_reasons:array<string>>")
TYPES = {**{c: "array<string>" for c in LISTS}, **{c: "map<string,double>" for c in NUMBER_MAPS},
         "model_load_failures_json": "map<string,string>", "probability_target_eligibility": "map<string,boolean>",
         "probability_target_ineligibility_reasons": "map<string,array<string>>",
         "probability_target_evidence": f"map<string,{_RECORD}>",
         "eta_target_evidence": f"map<string,{_ETA_RECORD}>", "urgency_policy_parameters": "map<string,string>"}
# Versions and urgency parameters an audit row must carry.
POLICY, CONTRACT, URGENCY, THRESHOLDS = "2.0", "3.0", "1.0", "1.0"
URGENCY_PARAMETERS = {"critical_probability_6h_target": "probability_critical_6h",
                      "critical_probability_24h_target": "probability_critical_24h",
                      "warning_probability_12h_target": "probability_warning_12h",
                      "critical_eta_soon_hours": "6.0", "critical_eta_plan_hours": "24.0", "warning_eta_plan_hours": "12.0"}
PLAIN = ("model_version", "model_maturity_stage", "model_stage", "model_data_domain", "recommendation_source",
         "forecast_policy_version", "forecast_policy_contract_version", "urgency_policy_version",
         "probability_threshold_schema_version", "runtime_probability_fn_ceiling", "runtime_validation_fn_ceiling",
         "runtime_test_fn_ceiling", "raw_status")
# Which lists hold targets and which hold reasons.
REASON_LISTS = ("production_policy_reasons_json", "withholding_reasons_json", "physical_validation_reasons_json",
                "feature_readiness_reasons_json")
TARGET_LISTS = ("required_model_targets", "loaded_model_targets", "missing_required_model_targets", "configured_mandatory_targets",
                "metadata_required_targets", "effective_required_targets", "mandatory_targets_missing_from_metadata",
                "recommendation_trigger_targets")
AUDIT_COLUMNS = (*TYPES, *FLAGS, *PLAIN)
# Cells that change from row to row; the others describe the model and repeat.
PER_ROW = ("withholding_reasons_json", "physical_validation_reasons_json", "feature_readiness_reasons_json",
           "recommendation_trigger_targets", "recommendation_trigger_probability_targets", "recommendation_trigger_eta_targets",
           "recommendation_trigger_rules", "probability_threshold_crossings", "physical_validation_passed", "feature_ready",
           "ood_detected", "target_support_valid", "disagreement_detected", "forecast_withheld", "recommendation_actionable",
           "recommendation_source", "raw_status")
PER_MODEL = tuple(c for c in AUDIT_COLUMNS if c not in PER_ROW)


def _all(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _same(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _list(items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _only_strings(cell: str) -> Column:
    """Whether a JSON list holds strings alone: without them, brackets, commas and blanks are left."""
    return F.regexp_replace(cell, r'"(?:[^"\\]|\\.)*"', "").rlike(r"^\s*\[[\s,]*\]\s*$")


def _expected_triggers(rows: DataFrame, p: dict[str, Column]) -> DataFrame:
    """Which targets cross their threshold, and what an acting row must name as its trigger."""
    def crossed(t):
        limit = p["selected_probability_thresholds"][t]
        return F.coalesce((F.col(t) >= limit) & (limit > 0) & (limit < 1) & p["probability_target_eligibility"][t], F.lit(False))
    rows = rows.withColumns({f"_hit_{t}": crossed(t) for t in PROBABILITY_TARGETS})
    empty = F.array().cast("array<string>")
    hits = F.array_compact(F.array(*[F.when(F.col(f"_hit_{t}"), F.lit(t)) for t in PROBABILITY_TARGETS]))
    expected = F.when((F.upper("raw_status") == "NORMAL") & p["production_policy_passed"], hits).otherwise(empty)
    acting = p["recommendation_actionable"] & ~p["forecast_withheld"]

    def soon(kind, hours):
        return F.coalesce(F.col(f"ml_time_to_{kind}_hours") <= hours, F.lit(False))
    # The urgency rules in order (rule, probability target, time target).
    ladder = ((F.col("_hit_probability_critical_6h"), "critical_probability_6h", "probability_critical_6h", ""),
              (soon("critical", 6.0), "critical_eta_soon", "", "time_to_critical"),
              (F.col("_hit_probability_critical_24h"), "critical_probability_24h", "probability_critical_24h", ""),
              (F.col("_hit_probability_warning_12h"), "warning_probability_12h", "probability_warning_12h", ""),
              (soon("warning", 12.0), "warning_eta_plan", "", "time_to_warning"))
    rows = rows.withColumn("_expected", expected)
    want_p, want_e, want_r = F.col("_expected"), empty, empty
    for cond, rule, prob, eta in reversed(ladder):
        want_p = F.when(acting & cond, _list([prob] if prob else [])).otherwise(want_p)
        want_e = F.when(acting & cond, _list([eta] if eta else [])).otherwise(want_e)
        want_r = F.when(acting & cond, _list([rule])).otherwise(want_r)
    return rows.withColumns({"_want_p": want_p, "_want_e": want_e, "_want_r": want_r})


def _parsed(df: DataFrame, cells) -> tuple[DataFrame, dict[str, Column], Column]:
    """Typed copies of the given audit cells and whether all of them could be read."""
    kinds = {c: F.from_json(c, TYPES[c]) for c in cells if c in TYPES}
    flags = {c: strict_bool(c) for c in cells if c in FLAGS}
    rows = df.withColumns({f"_{c}": v for c, v in (kinds | flags).items()})
    p = {c: F.col(f"_{c}") for c in (*kinds, *flags)}
    return rows, p, _all([v.isNotNull() for v in p.values()])


def _failed(checks) -> Column:
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), code if isinstance(code, Column) else F.lit(code)) for ok, code in checks]))


def _model_checks(p: dict[str, Column], mandated) -> list:
    must = _list(mandated)
    effective, loaded = p["effective_required_targets"], p["loaded_model_targets"]
    declared, absent = p["metadata_required_targets"], p["missing_required_model_targets"]

    def none(c):
        return F.size(p[c]) == 0
    ceiling = F.col("runtime_probability_fn_ceiling")
    checks: list[tuple[Column, Column | str]] = [
        (F.trim(F.col("model_version")) != "", "missing_model_version"),
        (F.col("model_maturity_stage") == "deployed", "model_not_deployed"),
        (F.col("model_stage").isin("production", "plant_production"), "model_stage_not_allowed"),
        (F.col("model_data_domain") == "plant", "data_domain_not_allowed"),
        (p["production_eligible"], "production_ineligible"),
        (p["production_policy_passed"] & none("production_policy_reasons_json"), "production_policy_contradiction"),
        (~p["model_revoked"], "model_revoked"), (~p["model_superseded"], "model_superseded"),
        (~p["model_corrupted"], "model_corrupted"), (p["model_metadata_valid"], "model_metadata_invalid"),
        (p["model_artifacts_valid"], "model_artifacts_invalid"), (p["model_schema_compatible"], "model_schema_incompatible"),
        (p["model_feature_schema_compatible"], "feature_schema_mismatch"),
        ((F.size(F.array_except(p["required_model_targets"], loaded)) == 0) & none("missing_required_model_targets")
         & (F.size(p["model_load_failures_json"]) == 0), "required_model_artifact_evidence_failed"),
        (_same(p["configured_mandatory_targets"], must), "configured_mandatory_targets_mismatch"),
        (ceiling.between(0, 1), "invalid_runtime_fn_ceiling"),
        (_same(effective, F.array_union(must, declared)), "effective_required_targets_mismatch"),
        (_same(p["required_model_targets"], effective), "required_model_targets_mismatch"),
        (_same(absent, F.array_except(effective, loaded)), "missing_required_targets_mismatch"),
        (_same(p["mandatory_targets_missing_from_metadata"], F.array_except(p["configured_mandatory_targets"], declared)),
         "mandatory_metadata_gap_mismatch"),
        (none("mandatory_targets_missing_from_metadata") & (F.size(F.array_except(must, declared)) == 0),
         "mandatory_targets_missing_from_metadata"),
        (F.size(F.array_except(effective, loaded)) == 0, "mandatory_or_required_target_not_loaded"),
        (F.col("forecast_policy_version") == POLICY, "unsupported_forecast_policy_version"),
        (F.col("forecast_policy_contract_version") == CONTRACT, "unsupported_policy_contract_version"),
        ((F.col("urgency_policy_version") == URGENCY) & (F.size(p["urgency_policy_parameters"]) == len(URGENCY_PARAMETERS))
         & _all([p["urgency_policy_parameters"][k] == v for k, v in URGENCY_PARAMETERS.items()]), "unsupported_urgency_policy"),
        (F.col("probability_threshold_schema_version") == THRESHOLDS, "unsupported_threshold_schema_version")]

    checks += [(_all([_only_strings(c) for c in TARGET_LISTS if c in PER_MODEL]), "invalid_target_list_schema"),
               (_all([_only_strings(c) for c in REASON_LISTS if c in PER_MODEL]), "invalid_reason_array")]
    return checks


def _per_target(p: dict[str, Column]) -> Column:
    """Failed checks of every effective probability target, whatever its name."""
    targets = F.filter("_effective_required_targets", lambda t: t.startswith("probability_"))
    return F.flatten(F.transform(targets, lambda t: _failed(_target_checks(p, t))))


def _target_checks(p: dict[str, Column], t: Column) -> list:
    ceiling = F.col("runtime_probability_fn_ceiling")
    e, limit = p["probability_target_evidence"][t], p["selected_probability_thresholds"][t]
    why, there = p["probability_target_ineligibility_reasons"][t], p["probability_target_evidence"][t].isNotNull()
    checks: list[tuple[Column, Column | str]] = []

    def rate(c):
        return F.coalesce(e[c].between(0, 1), F.lit(False))

    def add(cond, code, named=True, has=None):
        ok = F.coalesce(cond, F.lit(False))
        checks.append((ok if has is None else ~has | ok, F.concat(F.lit(f"{code}:"), t) if named else F.lit(code)))
    add(p["probability_target_eligibility"][t].isNotNull(), "invalid_target_eligibility_mapping", False)
    add(why.isNotNull() & (~there | e["target_ineligibility_reasons"].isNotNull()), "invalid_target_reason_mapping", False)
    add(there, "target_evidence_missing")
    add((limit > 0) & (limit < 1), "threshold_invalid")
    add(p["probability_target_eligibility"][t] & (F.size(why) == 0) & e["target_eligible"]
        & (F.size(e["target_ineligibility_reasons"]) == 0), "target_ineligible", has=there)
    add(e["target_required"], "target_not_declared_required", has=there)
    add(_all([rate(c) for c in RATES]), "invalid_probability_metric", has=there)
    add(e["baseline_passed"], "baseline_not_passed", has=there)
    add(e["calibration_passed"], "calibration_not_passed", has=there)
    add(F.abs(e["selected_threshold"] - limit) <= 1e-12, "threshold_evidence_mismatch", has=there)
    for part in ("validation", "test"):
        value, cap, met = e[f"{part}_fn_rate"], e[f"{part}_fn_ceiling"], e[f"{part}_fn_ceiling_met"]
        numbers = there & rate(f"{part}_fn_rate") & rate(f"{part}_fn_ceiling")
        runtime = F.col(f"runtime_{part}_fn_ceiling")
        add(met, f"{part}_fn_ceiling_failed", has=there)
        add(met == (value <= cap), f"{part}_fn_numeric_contradiction", has=numbers)
        add(value <= F.least(ceiling, cap, runtime), f"{part}_fn_ceiling_not_met", has=numbers)
        add(cap <= ceiling, "model_fn_ceiling_exceeds_runtime_policy", has=numbers)
        add(runtime.between(0, 1), f"invalid_runtime_{part}_fn_ceiling", False, has=there)
        add((p[f"model_recorded_{part}_fn_ceilings"][t] == cap)
            & (p[f"effective_{part}_fn_ceilings"][t] == F.least(runtime, cap)), f"{part}_ceiling_mapping_mismatch", has=numbers)
        if part == "validation":
            add(p["model_recorded_probability_fn_ceiling"][t] == cap, "recorded_fn_ceiling_mismatch", has=numbers)
            add(p["effective_probability_fn_ceiling"][t] == F.least(ceiling, cap), "effective_fn_ceiling_mismatch", has=numbers)
    return checks


def _eta_checks(p: dict[str, Column], mandated) -> list:
    """Evidence of the time targets that the contract mandates; without any, the cell need only be readable."""
    checks: list[tuple[Column, Column | str]] = []
    for t in (t for t in mandated if t in ETA_TARGETS):
        e = p["eta_target_evidence"][t]
        low, high, reasons = e["support_min_hours"], e["support_max_hours"], e["target_ineligibility_reasons"]
        rules = ((e["target_required"], "eta_target_not_required"), (e["target_eligible"], "eta_target_ineligible"),
                 (e["model_loaded"] & F.array_contains(p["loaded_model_targets"], t), "eta_model_not_loaded"),
                 (e["model_schema_compatible"] & e["feature_schema_compatible"], "eta_schema_incompatible"),
                 ((F.size(reasons) == 0) & e["physical_validation_passed"] & e["baseline_passed"], "eta_evidence_malformed"),
                 ((low >= 0) & (high >= low) & (high < float("inf")), "eta_support_invalid"))
        checks.append((e.isNotNull(), f"eta_target_evidence_missing:{t}"))
        checks += [(e.isNull() | F.coalesce(ok, F.lit(False)), f"{code}:{t}") for ok, code in rules]
    return checks


def _row_checks(p: dict[str, Column]) -> list:
    def none(c):
        return F.size(p[c]) == 0
    checks: list[tuple[Column, Column | str]] = [
        (p["physical_validation_passed"] & none("physical_validation_reasons_json"), "physical_validation_failed"),
        (p["feature_ready"] & none("feature_readiness_reasons_json"), "feature_readiness_failed"),
        (~p["ood_detected"] & p["target_support_valid"] & ~p["disagreement_detected"], "runtime_guardrail_failed"),
        (p["forecast_withheld"] | none("withholding_reasons_json"), "withholding_contradiction"),
        (~p["recommendation_actionable"] | (F.col("recommendation_source") == "ml"), "recommendation_not_actionable_ml"),
        (_same(p["recommendation_trigger_targets"], F.array_union(
            p["recommendation_trigger_probability_targets"], p["recommendation_trigger_eta_targets"])), "trigger_target_union_mismatch")]
    got = p["recommendation_trigger_probability_targets"]
    checks += [(_same(p["probability_threshold_crossings"], F.col("_expected")), "threshold_crossing_mismatch"),
               (_same(got, F.col("_want_p")), F.when(F.size(F.array_except("_want_p", got)) > 0, "missing_expected_probability_trigger")
                .otherwise("unexpected_probability_trigger")),
               (_same(p["recommendation_trigger_eta_targets"], F.col("_want_e")), F.when(F.size(F.array_except(
                   "_want_e", p["recommendation_trigger_eta_targets"])) > 0, "missing_expected_eta_trigger").otherwise("unexpected_eta_trigger")),
               (_same(p["recommendation_trigger_rules"], F.col("_want_r")), "trigger_rule_mismatch")]
    checks += [(_all([_only_strings(c) for c in TARGET_LISTS if c in PER_ROW]), "invalid_target_list_schema"),
               (_all([_only_strings(c) for c in REASON_LISTS if c in PER_ROW]), "invalid_reason_array")]
    return checks


def _wrong_triggers(p: dict[str, Column]) -> Column:
    """Triggers that name a target which isn't one, or isn't over its threshold or has no time."""
    hits = F.array_compact(F.array(*[F.when(F.col(f"_hit_{t}"), F.lit(t)) for t in PROBABILITY_TARGETS]))
    timed = F.array_compact(F.array(*[F.when((F.col(f"ml_{t}_hours") >= 0) & (F.col(f"ml_{t}_hours") < float("inf")), F.lit(t))
                                      for t in ETA_TARGETS]))

    def named(code, triggers, right):
        return F.transform(F.array_except(triggers, right), lambda t: F.concat(F.lit(f"{code}:"), t))
    return F.concat(named("invalid_probability_trigger_target", p["recommendation_trigger_probability_targets"], hits),
                    named("invalid_eta_trigger_target", p["recommendation_trigger_eta_targets"], timed))


def trusted_evidence(df: DataFrame, mandated=REQUIRED_TARGETS) -> DataFrame:
    """Adds ``evidence_failures`` (sorted distinct codes) and ``trusted``.

    ``mandated`` are the targets that the contract requires, probabilities and times. Cells that describe the model repeat over many rows, so each distinct set of
    them is parsed and checked once and joined back by its digest.
    """
    missing = sorted(set(AUDIT_COLUMNS) - set(df.columns))
    if missing:
        return df.withColumns({"evidence_failures": F.array(F.lit("missing_audit_evidence")), "trusted": F.lit(False)})
    digest = F.sha2(F.to_json(F.struct(*PER_MODEL)), 256)
    rows = df.withColumn("_digest", digest)
    once, p, readable = _parsed(rows.select("_digest", *PER_MODEL).dropDuplicates(["_digest"]), PER_MODEL)
    kept = ("selected_probability_thresholds", "probability_target_eligibility", "production_policy_passed")
    once = once.select("_digest", F.concat(_failed(_model_checks(p, mandated) + _eta_checks(p, mandated)),
                                             _per_target(p)).alias("_model_failures"),
                       F.coalesce(readable, F.lit(False)).alias("_model_ok"), *[f"_{c}" for c in kept])
    rows, own, legible = _parsed(rows.join(once, "_digest"), PER_ROW)
    own |= {c: F.col(f"_{c}") for c in kept}
    rows = _expected_triggers(rows, own)
    failures = F.array_sort(F.array_distinct(F.concat("_model_failures", _failed(_row_checks(own)), _wrong_triggers(own))))
    clean = F.col("_model_ok") & F.coalesce(legible, F.lit(False))
    out = rows.select(*df.columns, F.when(clean, failures).otherwise(
        F.array(F.lit("malformed_audit_row"))).alias("evidence_failures"))
    return out.withColumn("trusted", F.size("evidence_failures") == 0)


def failure_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("evidence_failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("rows"))


def trust_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), n_where(F.col("trusted")).alias("trusted_rows"))
