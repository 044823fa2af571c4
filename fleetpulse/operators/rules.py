"""Projections of the manufacturer rules onto readings (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import rules
from fleetpulse.params import SENSORS


def normalize_label(df: DataFrame, column: str = "health_status") -> DataFrame:
    """Trim and lower the label, blank to null, and test its domain."""
    text = F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))
    return df.withColumn("label", text).withColumn(
        "label_known", F.col("label").isNull() | F.col("label").isin("normal", "warning", "critical"))


def range_check(df: DataFrame) -> DataFrame:
    """First sensor (in configured order) without a finite value or out of its range."""
    return df.withColumn("range_reason", range_reason())


def range_reason() -> Column:
    tests = [F.when(~rules.finite(s.key), F.lit(f"{s.key} has no finite value")).when(
        ~F.col(s.key).between(s.low, s.high),
        F.concat(F.lit(f"{s.label} "), F.col(s.key).cast("string"), F.lit(
            f" {s.unit} lies outside [{s.low}, {s.high}]")))
        for s in SENSORS]
    return F.coalesce(*tests)


def raw_safety_status(df: DataFrame) -> DataFrame:
    """Worst status over the finite sensors of any parseable row, else UNKNOWN."""
    codes = [F.when(rules.finite(s.key), rules.status(s.key, s)) for s in SENSORS]
    return df.withColumn("raw_safety_status", F.coalesce(
        rules.status_name(F.greatest(*codes)), F.lit("UNKNOWN")))


def sensor_status(df: DataFrame, inclusive: bool = False) -> DataFrame:
    return df.withColumns({f"{s.key}__status": rules.status(s.key, s, inclusive) for s in SENSORS})


def machine_status(df: DataFrame, inclusive: bool = False) -> DataFrame:
    return df.withColumn("raw_status", rules.machine_status(inclusive=inclusive))


def worst_sensor(df: DataFrame) -> DataFrame:
    """Sensor at the worst status with the highest raw severity; earlier sensors win ties."""
    ranked = F.array(*[
        F.struct(rules.status(s.key, s).alias("status"), rules.severity(s.key, s).alias("severity"),
                 F.lit(-i).alias("order"), F.lit(s.key).alias("name"))
        for i, s in enumerate(SENSORS)])
    return df.withColumn("worst_sensor", F.array_max(ranked)["name"])


def severity_summary(df: DataFrame, suffix: str = "") -> DataFrame:
    """Maximum and weight-normalised severity of the sensors (optionally a smoothed column)."""
    parts = [(rules.severity(s.key + suffix, s), s.weight) for s in SENSORS]
    total = sum(w for _, w in parts)
    weighted = sum((sev * w for sev, w in parts[1:]), parts[0][0] * parts[0][1])
    return df.withColumns({"maximum_severity": F.greatest(*[p for p, _ in parts]),
                           "weighted_severity": weighted / total})


def status_reasons(df: DataFrame, effective: str | None = None) -> DataFrame:
    """Readable reasons; ``effective`` adds a note where the stabilised status differs."""
    notes = []
    for s in SENSORS:
        code = rules.status(s.key, s)
        limit = F.when(code == 2, s.critical).otherwise(s.warning)
        notes.append(F.when(code > 0, F.format_string(
            f"{s.label} %s: %.3f {s.unit}, limit %.3f {s.unit}",
            rules.status_name(code), F.col(s.key), limit)))
    found = F.array_compact(F.array(*notes))
    text = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(
        "Every sensor is below its warning limit.")))
    if effective:
        text = F.concat(text, F.when(F.col(effective) != rules.machine_status(), F.array(
            F.format_string("Shown as %s after smoothing over time; this reading alone is %s.",
                            rules.status_name(effective), rules.status_name(rules.machine_status()))))
            .otherwise(F.array().cast("array<string>")))
    return df.withColumn("reasons", text)


# Data domain -> stage of a candidate trained on it.
DOMAIN_STAGES = {"accelerated_mock": "mock_test", "realistic_synthetic": "realistic_candidate",
                 "plant": "plant_candidate"}


def domain_stage(domain: Column) -> Column:
    """Stage for a known data domain, null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, stage in DOMAIN_STAGES.items():
        out = F.when(domain == name, stage).otherwise(out)
    return out


def promotion_refusal(domain: Column, stage: Column) -> Column:
    """Why a model of this domain may not enter the stage, or null."""
    return F.when((stage == "plant_production") & (domain != "plant"), F.concat(
        F.lit("trained on "), domain, F.lit(": not for plant_production")))
