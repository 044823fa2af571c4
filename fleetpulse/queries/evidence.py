"""Audit rows with complete evidence and known defects."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fleetpulse.operators import evidence as evd
from fleetpulse.params import ETA_TARGETS, REQUIRED_TARGETS
from fleetpulse.plans.shared import table
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.queries.evaluation import BASE, scored

W12, C24 = REQUIRED_TARGETS


ETA_RECORD = {"target_required": True, "target_eligible": True, "target_ineligibility_reasons": [], "model_loaded": True,
              "model_schema_compatible": True, "feature_schema_compatible": True, "support_min_hours": 0.0,
              "support_max_hours": 100.0, "physical_validation_passed": True, "baseline_passed": True}


def _record():
    return {"selected_threshold": 0.4, **{c: 0.05 for c in evd.RATES}, "validation_fn_ceiling": 0.1, "test_fn_ceiling": 0.1,
            **{c: True for c in ("target_required", "target_eligible", "validation_fn_ceiling_met", "test_fn_ceiling_met",
                                 "baseline_passed", "calibration_passed")}, "target_ineligibility_reasons": []}


def complete(df):
    """A clean audit row for every reading; probabilities come from the scored table."""
    both, caps = json.dumps([W12, C24]), json.dumps({W12: 0.1, C24: 0.1})
    text = {**{c: "[]" for c in evd.LISTS}, **{c: caps for c in evd.NUMBER_MAPS}, "selected_probability_thresholds": json.dumps({W12: 0.4, C24: 0.4}),
            "model_load_failures_json": "{}", "probability_target_eligibility": json.dumps({W12: True, C24: True}),
            "probability_target_ineligibility_reasons": json.dumps({W12: [], C24: []}),
            "probability_target_evidence": json.dumps({W12: _record(), C24: _record()}),
            "urgency_policy_parameters": json.dumps(evd.URGENCY_PARAMETERS),
            "eta_target_evidence": json.dumps({t: ETA_RECORD for t in ETA_TARGETS})}
    for c in ("required_model_targets", "loaded_model_targets", "configured_mandatory_targets", "metadata_required_targets", "effective_required_targets"):
        text[c] = both
    flags = {c: F.lit("true") for c in evd.FLAGS}
    for c in ("model_revoked", "model_superseded", "model_corrupted", "ood_detected", "disagreement_detected", "forecast_withheld", "recommendation_actionable"):
        flags[c] = F.lit("false")
    w, c = F.coalesce(F.col(W12) >= 0.4, F.lit(False)), F.coalesce(F.col(C24) >= 0.4, F.lit(False))
    normal = F.col("raw_status") == 0
    crossed = F.to_json(F.array_compact(F.array(F.when(normal & w, W12), F.when(normal & c, C24))))
    return df.withColumns({**{k: F.lit(v) for k, v in text.items()}, **flags}).withColumns({
        "raw_status": F.when(F.col("raw_status") == 0, "NORMAL").when(F.col("raw_status") == 1, "WARNING").otherwise("CRITICAL"),
        "probability_threshold_crossings": crossed, "recommendation_trigger_targets": crossed, "recommendation_trigger_probability_targets": crossed,
        "model_version": F.lit("v1"), "model_maturity_stage": F.lit("deployed"), "model_stage": F.lit("production"), "model_data_domain": F.lit("plant"),
        "recommendation_source": F.lit("ml"), "forecast_policy_version": F.lit("2.0"), "forecast_policy_contract_version": F.lit("3.0"),
        "urgency_policy_version": F.lit("1.0"), "probability_threshold_schema_version": F.lit("1.0"), "runtime_probability_fn_ceiling": F.lit(0.1),
        "runtime_validation_fn_ceiling": F.lit(0.1), "runtime_test_fn_ceiling": F.lit(0.1),
        "ml_time_to_warning_hours": F.lit(None).cast("double"), "ml_time_to_critical_hours": F.lit(None).cast("double")})


def audited(spark, sf):
    """Clean rows, one row in seven broken in a known way."""
    e = F.col("event_id")

    def when(n, value, column):
        return F.when(e % 70 == n, value).otherwise(F.col(column))
    bad = _record() | {"validation_fn_rate": 0.2}
    return table(spark, f"audited:{sf}", lambda: complete(scored(spark, sf)).withColumns({
        "model_version": when(0, " ", "model_version"), "model_revoked": when(10, "true", "model_revoked"),
        "loaded_model_targets": when(20, json.dumps([W12]), "loaded_model_targets"), "ood_detected": when(30, "perhaps", "ood_detected"),
        "selected_probability_thresholds": when(40, json.dumps({W12: 1.0, C24: 0.4}), "selected_probability_thresholds"),
        "probability_target_evidence": when(50, json.dumps({W12: bad, C24: _record()}), "probability_target_evidence"),
        "withholding_reasons_json": F.when(e % 70 == 60, '["ood_detected"]').otherwise("[]")}))


_FAIL = f"""CASE event_id % 70 WHEN 0 THEN ['missing_model_version'] WHEN 10 THEN ['model_revoked']
  WHEN 20 THEN ['mandatory_or_required_target_not_loaded', 'missing_required_targets_mismatch', 'required_model_artifact_evidence_failed'] WHEN 30 THEN ['malformed_audit_row']
  WHEN 40 THEN list_concat(['threshold_evidence_mismatch:{W12}', 'threshold_invalid:{W12}'], CASE WHEN raw_status = 0 AND {W12} >= 0.4 THEN ['invalid_probability_trigger_target:{W12}', 'threshold_crossing_mismatch', 'unexpected_probability_trigger'] ELSE
    CASE WHEN raw_status = 0 AND {W12} >= 0.4 THEN [] ELSE []::VARCHAR[] END END)
  WHEN 50 THEN ['validation_fn_ceiling_not_met:{W12}', 'validation_fn_numeric_contradiction:{W12}'] WHEN 60 THEN ['withholding_contradiction'] ELSE []::VARCHAR[] END"""


@query("trusted_evidence", "E23", q.with_readings(
    f"SELECT machine_id, us, array_to_string(list_sort({_FAIL}), '|') AS failures, len({_FAIL}) = 0 AS trusted FROM scored", *BASE))
def trusted_evidence(spark, sf):
    return evd.trusted_evidence(audited(spark, sf)).select(
        "machine_id", "us", F.array_join("evidence_failures", "|").alias("failures"), "trusted")


@query("trust_failure_counts", "E23", q.with_readings(
    f"SELECT failure, count(*) AS rows FROM (SELECT unnest({_FAIL}) AS failure FROM scored) GROUP BY failure", *BASE))
def trust_failure_counts(spark, sf):
    return evd.failure_counts(evd.trusted_evidence(audited(spark, sf)))


# ---- a contract that mandates time targets ------------------------------------

TTW, TTC = ETA_TARGETS
MANDATED = (*ETA_TARGETS, *REQUIRED_TARGETS)
# What recorded evidence may look like, from clean to unreadable; a row takes the one that its amount falls on.
ETA_CELLS = tuple(json.dumps(c) for c in (
    {TTW: ETA_RECORD, TTC: ETA_RECORD}, {}, {TTW: ETA_RECORD}, {TTW: ETA_RECORD, TTC: None},
    {TTW: {**ETA_RECORD, "target_required": False}, TTC: {**ETA_RECORD, "target_eligible": "true"}},
    {TTW: {**ETA_RECORD, "model_loaded": False}, TTC: {**ETA_RECORD, "model_schema_compatible": None}},
    {TTW: {**ETA_RECORD, "feature_schema_compatible": False}, TTC: {**ETA_RECORD, "target_ineligibility_reasons": ["too_few_rows"]}},
    {TTW: {**ETA_RECORD, "support_max_hours": -1.0}, TTC: {**ETA_RECORD, "support_min_hours": None}},
    {TTW: {**ETA_RECORD, "baseline_passed": False}, TTC: {**ETA_RECORD, "physical_validation_passed": False}},
)) + ("not json",)


def eta_audited(spark, sf):
    """The complete rows, under a contract that mandates both time targets, with evidence of varying quality."""
    every, cells = json.dumps(MANDATED), F.array(*[F.lit(c) for c in ETA_CELLS])
    lists = ("required_model_targets", "loaded_model_targets", "configured_mandatory_targets", "metadata_required_targets",
             "effective_required_targets")
    picked = F.element_at(cells, (F.floor(F.col("vibration_mps2") * 1000) % len(ETA_CELLS) + 1).cast("int"))
    return complete(scored(spark, sf)).withColumns({c: F.lit(every) for c in lists}).withColumn("eta_target_evidence", picked)


_CELLS = ", ".join("'" + c + "'" for c in ETA_CELLS)


def _eta_sql(t):
    """Failed checks of one target, read from the JSON cell."""
    def true(f):
        return f"coalesce(json_extract(e, '$.{t}.{f}')::VARCHAR = 'true', false)"
    number = "TRY_CAST(json_extract(e, '$.{t}.{f}') AS DOUBLE)"
    low, high = (number.format(t=t, f=f) for f in ("support_min_hours", "support_max_hours"))
    rules = [(true("target_required"), "eta_target_not_required"), (true("target_eligible"), "eta_target_ineligible"),
             (true("model_loaded"), "eta_model_not_loaded"),
             (f"{true('model_schema_compatible')} AND {true('feature_schema_compatible')}", "eta_schema_incompatible"),
             (f"coalesce(json_array_length(e, '$.{t}.target_ineligibility_reasons') = 0, false) AND "
              f"{true('physical_validation_passed')} AND {true('baseline_passed')}", "eta_evidence_malformed"),
             (f"coalesce({low} >= 0 AND {high} >= {low}, false)", "eta_support_invalid")]
    there = f"coalesce(json_type(e, '$.{t}') = 'OBJECT', false)"
    return ", ".join([f"CASE WHEN NOT {there} THEN 'eta_target_evidence_missing:{t}' END",
                      *[f"CASE WHEN {there} AND NOT ({ok}) THEN '{code}:{t}' END" for ok, code in rules]])


@query("trusted_eta_evidence", "E23", q.with_readings(
    f"""SELECT machine_id, us, CASE WHEN json_valid(cell) THEN array_to_string(list_sort(list_filter([{_eta_sql(TTW)}, {_eta_sql(TTC)}],
        lambda x: x IS NOT NULL)), '|') ELSE 'malformed_audit_row' END AS failures
    FROM (SELECT *, CASE WHEN json_valid(cell) THEN cell ELSE '{{}}' END::JSON AS e FROM (SELECT machine_id, us,
        list_extract([{_CELLS}], CAST(floor(vibration_mps2 * 1000) % {len(ETA_CELLS)} + 1 AS INTEGER)) AS cell FROM scored))""", *BASE))
def trusted_eta_evidence(spark, sf):
    return evd.trusted_evidence(eta_audited(spark, sf), MANDATED).select(
        "machine_id", "us", F.array_join("evidence_failures", "|").alias("failures"))
