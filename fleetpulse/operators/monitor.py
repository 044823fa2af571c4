"""The full replay: readings in, one audited decision per reading out.

Stages are written to the shared folder where the next one reads its input more
than once, so the work grows linearly with the number of stages. After lifecycles
are known the parallel unit is a slice of a lifecycle; only the healthy baseline
is keyed by machine, on a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import anomaly, features, forecast, lifecycles, persistence, rules, state
from fleetpulse.params import DAY_US, DEFAULT, HORIZONS_H, SENSOR_KEYS, SENSORS, Params
from fleetpulse.plans.shared import cut
from fleetpulse.plans.slices import add_slice

ROW = ("machine_id", "lifecycle_id", "us", "ingest_seq")
KEY = ["machine_id", "us", "ingest_seq"]
LATE = ("persistent_crossings", "urgency_decision", "guardrail_result", "worst_sensor", "reasons")  # last columns of a replay
FEATURE_STATS = ("slope_per_hour", "sample_count", "coverage_fraction", "gap_or_discontinuity",
                 "available_history_duration_seconds", "feature_available", "window_mature")


def with_lifecycles(df: DataFrame, params: Params = DEFAULT, plan: DataFrame | None = None,
                    fold_width: int = state.FOLD_WIDTH_US) -> DataFrame:
    """Lifecycle id, state, start and reset flags; boundaries are inferred when not given."""
    states = None
    if plan is None:
        found = cut(state.discover_lifecycles(add_slice(df, width=fold_width), params).drop("slice"))
        plan = state.closed_lifecycles(found).select("machine_id", "lifecycle_id", "start_us", "end_us", "reset_us")
        states = found.select("machine_id", "us", "ingest_seq", F.col("lifecycle_state").alias("_phase"))
    plan = plan.select("machine_id", "end_us", "reset_us")
    rows = df if states is None else df.join(states, KEY)
    rows = lifecycles.assign_lifecycle(add_slice(rules.machine_status(rows)), plan)
    rows = lifecycles.lifecycle_state(rows, plan, "_phase" if states is not None else None)
    resets = plan.select("machine_id", F.col("reset_us").alias("us"), F.lit(True).alias("_done"))
    rows = rows.join(resets, ["machine_id", "us"], "left")
    return rows.withColumn("reset_complete", F.coalesce("_done", F.lit(False))).drop("_done", "_phase", "slice")


def assessed(df: DataFrame, params: Params = DEFAULT, confirmations: DataFrame | None = None,
             fold_width: int = state.FOLD_WIDTH_US, day: int = DAY_US) -> DataFrame:
    """Findings, smoothed signals and status layers of rows with a lifecycle."""
    rows = rules.sensor_status(rules.machine_status(df, params.inclusive), params.inclusive)
    found = cut(anomaly.detect(add_slice(rows, width=fold_width), params, confirmations=confirmations))
    narrow = found.select(*ROW, *SENSOR_KEYS, "commit", "raw_status", "slice")
    smooth = cut(state.smoothed(narrow, params=params, carry=("commit", "raw_status")).drop("slice"))
    # Status layers read two columns; each of their scans reads its input twice, so tables lie between them.
    layers = add_slice(smooth.select(*ROW, "commit", "raw_status"), width=day)
    layers = cut(persistence.event_status(layers, state.LIFE, params))
    layers = cut(persistence.stabilized_status(layers, state.LIFE, params))
    layers = forecast.history_points(layers, cap=params.monitoring.minimum_forecast_points)
    signals = smooth.drop("lifecycle_id", "commit", "raw_status", *SENSOR_KEYS)
    joined = found.drop("slice").join(signals, KEY).join(
        layers.select(*KEY, "event_status", "stabilized_status", "history_points"), KEY)
    return anomaly.confirmed_critical_quality(joined)


def teachable(df: DataFrame) -> Column:
    """Rows allowed to move the healthy baseline."""
    return ((F.col("raw_status") == 0) & F.col("use_for_features") & ~F.col("requires_human_review")
            & ~F.col("anomaly_severity").isin("HIGH", "CRITICAL"))


def monitor(df: DataFrame, params: Params = DEFAULT, *, plan: DataFrame | None = None,
            confirmations: DataFrame | None = None, fold_width: int = state.FOLD_WIDTH_US,
            day: int = DAY_US) -> DataFrame:
    """Readings (machine_id, ingest_seq, us, three sensors) to decisions."""
    rows = with_lifecycles(df, params, plan, fold_width)
    rows = features.elapsed_lifecycle_hours(rows)
    rows = cut(assessed(rows, params, confirmations, fold_width, day))

    windows = features.window_features(rows.filter("commit"), params=params, stats=FEATURE_STATS, width=4 * day)
    windows = features.feature_availability(windows).withColumnRenamed("feature_available", "windows_available")
    mature = F.lit(True)
    for k in SENSOR_KEYS:
        for m in features.WINDOWS_MIN:
            mature = mature & (F.col(f"{k}__w{m}m__window_mature") >= 0.5)
    # What the windows say is two flags and a list of slopes per sensor; their columns, several hundred, stay behind.
    trends = [f"{k}__trend" for k in SENSOR_KEYS]
    windows = cut(forecast.trend_window_evidence(windows.withColumn("windows_mature", mature), params).select(
        *KEY, "windows_available", "windows_mature", "available_history_s", *trends))

    lessons = rows.select("machine_id", "us", "ingest_seq", *SENSOR_KEYS, teachable(rows).alias("teach"))
    base = cut(state.healthy_baseline(lessons, params).drop("slice"))

    wide = rows.join(windows, KEY, "left").join(base, KEY)
    ok = F.col("features_available") if "features_available" in df.columns else F.lit(True)

    def forecasts(joined: DataFrame) -> DataFrame:
        joined = joined.withColumns({
            "feature_available": ok & F.col("use_for_features") & F.coalesce("windows_available", F.lit(True)),
            "available_history_s": F.coalesce("available_history_s", F.lit(0.0)),
            "windows_mature": F.coalesce("windows_mature", F.lit(False)),
            **{c: F.coalesce(c, F.array().cast(windows.schema[c].dataType)) for c in trends}})
        return forecast.apply_withholding(forecast.suppress_on_reset(forecast.prognose(joined, params)))

    # The alert latches scan four columns several times, so these alone are written. The wide rows never are:
    # forecasts are worked out again, which costs less than writing and reading two hundred columns.
    limits = forecast.action_thresholds(params)
    latches = {f"_alert_{t}": (F.col(t), F.lit(v), state.persistence_minutes(F.lit(t), params))
               for t, v in limits.items()}
    crossed = cut(forecasts(wide).select(*ROW, *limits))
    alerts = state.alert_latches(add_slice(crossed, width=day), latches, params)
    alerts = cut(alerts.select(*KEY, F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"_alert_{t}"), F.lit(t)) for t in limits]))).alias("persistent_crossings")))

    out = forecasts(wide.join(alerts, KEY))
    out = forecast.kalman_eta(forecast.kalman_eta(out, "warning", params), "critical", params)
    out = forecast.sensor_kalman_forecast(out, params)
    out = forecast.prognostic_decision(forecast.prognostic_decision(out, "warning"), "critical")
    out = forecast.final_forecast(forecast.enforce_consistency(out))
    out = forecast.apply_anomaly_policy(forecast.urgency(out, params))
    out = rules.status_reasons(rules.worst_sensor(out), "stabilized_status").drop(*trends)
    return out.select(*[c for c in out.columns if c not in LATE], *LATE)


# ---- audit rows -------------------------------------------------------------------------

# Versions written to every audit row.
METHOD_VERSION = "probabilistic_degradation_v6.0"
POLICY_VERSION, CONTRACT_VERSION, URGENCY_VERSION = "2.0", "3.0", "1.0"


def _json(column: str) -> Column:
    return F.to_json(column)


def audit_rows(df: DataFrame, detailed: bool = False) -> DataFrame:
    """Flat rows for a text or table sink: half-even rounding, JSON only for nested cells."""
    d = F.col("urgency_decision")
    names = F.split("anomaly_types", r"\|")
    out = [F.col("machine_id"), F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"), F.col("us"),
           F.when(F.col("interpolated"), "interpolated").otherwise("original").alias("row_provenance"),
           *[F.bround(k, 3).alias(k) for k in SENSOR_KEYS],
           *[rules_name(c, a) for c, a in (("raw_status", "status"), ("stabilized_status", "stabilized_status"),
                                            ("event_status", "event_status"))],
           F.array_join("reasons", " | ").alias("status_reason"), F.col("worst_sensor"),
           F.col("lifecycle_id"), F.col("lifecycle_state"),
           F.col("lifecycle_state").startswith("open_").alias("lifecycle_censored"),
           F.bround("elapsed_lifecycle_hours", 4).alias("elapsed_lifecycle_hours"),
           F.bround("health_percent", 3).alias("health_percent")]
    for t in forecast.TARGETS:
        out += [F.bround(f"statistical_{t}_hours", 3).alias(f"statistical_time_to_{t}_hours"),
                F.col(f"statistical_{t}_sensor"),
                F.bround(f"prognostic_time_to_{t}_hours", 3).alias(f"prognostic_time_to_{t}_hours"),
                F.bround(f"prognostic_{t}_earliest_hours", 3).alias(f"prognostic_{t}_earliest_hours"),
                F.bround(f"prognostic_{t}_latest_hours", 3).alias(f"prognostic_{t}_latest_hours"),
                F.col(f"prognostic_{t}_sensor"),
                F.bround(f"{t}_decision.absolute_disagreement", 3).alias(f"{t}_absolute_disagreement_hours"),
                F.bround(f"{t}_decision.relative_disagreement", 4).alias(f"{t}_relative_disagreement"),
                F.bround(f"final_time_to_{t}_hours", 3).alias(f"final_time_to_{t}_hours"),
                F.bround(f"conservative_time_to_{t}_hours", 3).alias(f"conservative_alert_time_to_{t}_hours"),
                F.col(f"{t}_primary_source"),
                *[F.bround(f"probability_{t}_{h}h", 4).alias(f"probability_{t}_{h}h") for h in HORIZONS_H]]
    out += [F.col("forecast_confidence"), F.col("prognostic_confidence"), F.col("prognostic_baseline_ready"),
            F.bround("prognostic_history_hours", 3).alias("prognostic_history_hours"),
            F.bround("health_deviation_score", 4).alias("health_deviation_score"),
            _json("prognostic_threshold_crossings").alias("prognostic_probability_threshold_crossings"),
            F.col("prognostic_withheld"), F.col("feature_available"),
            F.bround("available_history_s", 3).alias("available_history_duration_seconds"),
            F.col("guardrail_result"), F.col("forecast_withheld"),
            F.array_join("withholding_reasons", "|").alias("withholding_reasons"),
            _json("withholding_reasons").alias("withholding_reasons_json"),
            forecast.primary_reason(F.col("withholding_reasons")).alias("primary_withholding_reason"),
            F.array_contains("withholding_reasons", "reset_suppression").alias("withheld_due_to_reset_suppression"),
            F.lit(METHOD_VERSION).alias("forecast_method"), F.lit(POLICY_VERSION).alias("forecast_policy_version"),
            F.lit(CONTRACT_VERSION).alias("forecast_policy_contract_version"),
            F.lit(URGENCY_VERSION).alias("urgency_policy_version"),
            d["urgency"].alias("maintenance_urgency"), d["actionable"].alias("recommendation_actionable"),
            d["urgency"].isin("PLAN_INSPECTION", "PLAN_MAINTENANCE", "MAINTENANCE_RECOMMENDED_SOON")
            .alias("recommendation_advisory"), d["source"].alias("recommendation_source"),
            *[F.to_json(F.filter(F.array(d[c]), lambda x: x != "")).alias(a) for c, a in (
                ("probability_target", "recommendation_trigger_probability_targets"),
                ("eta_target", "recommendation_trigger_eta_targets"), ("rule", "recommendation_trigger_rules"))],
            _json("persistent_crossings").alias("probability_threshold_crossings"),
            F.col("quality_status"), F.array_join(names, "|").alias("anomaly_type"), F.col("anomaly_severity"),
            F.bround("anomaly_confidence", 4).alias("anomaly_confidence"), F.col("suspected_origin"),
            F.col("affected_sensors"), F.col("first_observed_us"), F.col("confirmed_at_us"), F.col("resolved_us"),
            F.col("anomaly_is_active"), F.col("safety_action"), F.col("model_action"),
            F.col("feature_history_action"), F.col("use_for_features"), F.col("use_for_prediction"),
            F.bround("confidence_multiplier", 4).alias("confidence_multiplier"),
            F.col("final_offline_classification"), F.col("training_eligible"),
            F.col("training_exclusion_reason"), F.col("requires_human_review"),
            F.col("confidence_penalty_reason"), F.bround("gap_s", 3).alias("gap_duration_seconds")]
    if detailed:
        out += [F.col("smoothed_severity").alias("maximum_severity"), F.col("degradation").alias("estimated_degradation"),
                F.col("degradation_rate_per_hour"),
                *[F.col(f"{k}__{n}") for k in SENSOR_KEYS for n in state.SIGNALS],
                *[F.col(f"{k}__trend_{n}") for k in SENSOR_KEYS
                  for n in ("target", "eta_s", "critical_eta_s", "confidence")],
                *[F.col(f"{k}__statistical_{t}_hours") for k in SENSOR_KEYS for t in forecast.TARGETS],
                F.to_json(F.struct(*[F.struct(
                    F.col(f"{s.key}__effective_slope").alias("effective_slope_per_hour"),
                    F.col(f"{s.key}__effective_sigma").alias("slope_sigma_per_hour"),
                    F.col(f"{s.key}__consistency").alias("slope_consistency"),
                    F.col(f"{s.key}__window_count").alias("window_count"),
                    F.col(f"{s.key}__health_deviation_z").alias("health_deviation_z")).alias(s.key)
                    for s in SENSORS])).alias("prognostic_sensor_evidence_json")]
    return df.select(*out)


def rules_name(code: str, alias: str) -> Column:
    from fleetpulse.functions.rules import status_name
    return status_name(code).alias(alias)


def write_audit(df: DataFrame, path: str) -> None:
    """Parquet partitioned by date; machines stay in the file statistics, not in the layout."""
    (df.withColumn("date", F.to_date("timestamp")).repartition("date", "machine_id")
     .sortWithinPartitions("machine_id", "us").write.mode("overwrite").partitionBy("date").parquet(path))
