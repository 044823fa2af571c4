"""Data-quality findings and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions.rules import r6
from fleetpulse.operators import anomaly, persistence, rules as ops
from fleetpulse.params import INTEGRITY, PENALTIES, SENSOR_KEYS, SENSORS
from fleetpulse.plans.shared import table
from fleetpulse.plans.slices import add_slice
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.queries.stateful import (EDITED_ARRIVAL, VALIDATED, W, validated)
from fleetpulse.queries.windows import PLANNED, planned

ID = ["machine_id", "us"]
KEY = "machine_id, us"
K = SENSOR_KEYS

# Readings with clipped, stuck, stepping and missing stretches.
FAULTY = f"""
faulty AS (SELECT machine_id, lifecycle_id, us, ingest_seq, event_id, rn, health_status,
  CASE WHEN (rn // 4) % 61 = 0 THEN 20.0::DOUBLE WHEN rn % 1000 BETWEEN 700 AND 719 THEN 1.2::DOUBLE + 2.0 * (rn % 2)
    WHEN rn % 1000 BETWEEN 500 AND 660 THEN 2.0::DOUBLE ELSE vibration_mps2 END AS vibration_mps2,
  CASE WHEN rn % 1000 BETWEEN 100 AND 680 THEN 41.3::DOUBLE ELSE temperature_c END AS temperature_c,
  CASE WHEN (rn // 150) % 2 = 0 THEN current_ampere + 1.2::DOUBLE ELSE current_ampere END AS current_ampere
  FROM planned WHERE event_id % 83 <> 0),
fraw AS (SELECT *, {q.machine_status()} AS raw_status FROM faulty),
fg AS (SELECT *, coalesce((us - lag(us) OVER w) / 1e6::DOUBLE, 0) AS gap_s,
    row_number() OVER w AS p, """ + ", ".join(f"lag({k}) OVER w AS w_{k}" for k in K) + """ FROM fraw
  WINDOW w AS (PARTITION BY machine_id, lifecycle_id ORDER BY us, ingest_seq))"""


def faulty(spark, sf):
    rn, ramp = F.col("rn"), F.col("rn") % 1000
    df = planned(spark, sf).filter(F.col("event_id") % 83 != 0).withColumns({
        "vibration_mps2": F.when(F.floor(rn / 4) % 61 == 0, 20.0).when(
            ramp.between(700, 719), F.lit(1.2) + 2.0 * (rn % 2)).when(
            ramp.between(500, 660), 2.0).otherwise(F.col("vibration_mps2")),
        "temperature_c": F.when(ramp.between(100, 680), 41.3).otherwise(F.col("temperature_c")),
        "current_ampere": F.when(F.floor(rn / 150) % 2 == 0, F.col("current_ampere") + 1.2)
        .otherwise(F.col("current_ampere"))})
    return ops.machine_status(df)


def sliced(spark, sf):
    return add_slice(faulty(spark, sf))


def found(spark, sf):
    """All findings, written once."""
    def build():
        rows, place = faulty(spark, sf), [*ID, "ingest_seq"]
        # Event status reads one column, so its scans need not run over the findings.
        status = persistence.event_status(add_slice(rows.select(*place, "raw_status"))).select(*place, "event_status")
        return anomaly.confirmed_critical_quality(
            anomaly.detect(add_slice(rows.join(status, place), width=W)).drop("slice"))
    return table(spark, f"findings:{sf}", build)


def found_sliced(spark, sf):
    return add_slice(found(spark, sf), width=W)


@query("long_gap", "A3", q.with_readings(
    f"SELECT {KEY}, {q.r6('gap_s')} AS gap_s, gap_s >= 300 AS long_gap FROM fg", q.RAW, PLANNED, FAULTY))
def long_gap(spark, sf):
    return anomaly.long_gap(sliced(spark, sf)).select(*ID, r6("gap_s").alias("gap_s"), "long_gap")


@query("gap_recovery", "A4", q.with_readings(f"""
SELECT {KEY}, CASE WHEN gap_s < 300 AND p - lg <= 5 THEN CAST(5 - (p - lg) AS INTEGER) END AS recovery_left
FROM (SELECT *, max(CASE WHEN gap_s >= 300 THEN p END) OVER (PARTITION BY machine_id, lifecycle_id ORDER BY p
  ROWS UNBOUNDED PRECEDING) AS lg FROM fg)""", q.RAW, PLANNED, FAULTY))
def gap_recovery(spark, sf):
    return anomaly.gap_recovery(sliced(spark, sf)).select(*ID, "recovery_left")


_MISSING = "greatest(round_even(gap_s / 60, 0) - 1, 0)"
_SHORT = f"({_MISSING} > 0 AND gap_s > 65 AND gap_s < 300)"


@query("short_gap", "A5 T5", q.with_readings(
    f"SELECT {KEY}, CAST({_MISSING} AS INTEGER) AS missing_samples, {_SHORT} AS short_gap FROM fg",
    q.RAW, PLANNED, FAULTY))
def short_gap(spark, sf):
    return anomaly.short_gap(sliced(spark, sf)).select(*ID, "missing_samples", "short_gap")


def _bnd(k):
    m = INTEGRITY[k]
    tol = m.resolution * 0.5
    return f"(abs({k} - {q.d(m.physical_min)}) <= {tol} OR abs({k} - {q.d(m.physical_max)}) <= {tol})"


@query("clipping", "A6", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"CAST(CASE WHEN {_bnd(k)} THEN p - coalesce(f_{k}, 0) ELSE 0 END AS INTEGER) AS {k}__clip_rows" for k in K)
    + " FROM (SELECT *, " + ", ".join(f"max(CASE WHEN NOT {_bnd(k)} THEN p END) OVER w AS f_{k}" for k in K)
    + " FROM fg WINDOW w AS (PARTITION BY machine_id, lifecycle_id ORDER BY p ROWS UNBOUNDED PRECEDING))", q.RAW, PLANNED, FAULTY))
def clipping(spark, sf):
    return anomaly.clipping(sliced(spark, sf)).select(*ID, *[f"{k}__clip_rows" for k in K])


def _moved(k):
    m = INTEGRITY[k]
    return f"coalesce(abs({k} - w_{k}) >= {q.d(max(m.context_change, m.resolution * 5))}, false)"


def _context(k):
    return "(" + " OR ".join(_moved(r) for r in INTEGRITY[k].related) + ")"


@query("context_events", "A8", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{_context(k)} AS {k}__context" for k in K) + " FROM fg", q.RAW, PLANNED, FAULTY))
def context_events(spark, sf):
    return anomaly.context_events(sliced(spark, sf)).select(*ID, *[f"{k}__context" for k in K])


_RES = " ".join(f"WHEN '{k}' THEN {q.d(INTEGRITY[k].resolution * 0.5)}" for k in K)


def _limit(field):
    return "CASE sensor " + " ".join(f"WHEN '{k}' THEN {getattr(INTEGRITY[k], field)}" for k in K) + " END"


CONSTANCY = f"""
cs0 AS (SELECT machine_id, lifecycle_id, p, us, unnest([{", ".join(f"'{k}'" for k in K)}]) AS sensor,
  unnest([{", ".join(K)}]) AS v, unnest([{", ".join(_context(k) for k in K)}]) AS ctx FROM fg),
cs1 AS (SELECT machine_id, lifecycle_id, sensor, p, us, v AS rv, us AS rs, 0::DOUBLE AS longest, CASE WHEN ctx THEN 1 ELSE 0 END AS n,
  CASE WHEN ctx THEN us END AS lc FROM cs0 WHERE p = 1
  UNION ALL
  SELECT machine_id, lifecycle_id, sensor, p, us, CASE WHEN brk THEN v ELSE rv END, CASE WHEN brk THEN us ELSE rs END,
    CASE WHEN brk THEN greatest(longest, (us - rs) / 1e6::DOUBLE) ELSE longest END,
    CASE WHEN brk THEN 0 ELSE n END + CASE WHEN ctx THEN 1 ELSE 0 END, CASE WHEN ctx THEN us WHEN brk THEN NULL ELSE lc END
  FROM (SELECT t.machine_id, t.lifecycle_id, t.sensor, r.p, r.us, r.v, r.ctx, t.rv, t.rs, t.longest, t.n, t.lc,
      abs(r.v - t.rv) > CASE t.sensor {_RES} END AS brk
    FROM cs1 t JOIN cs0 r ON r.machine_id = t.machine_id AND r.lifecycle_id = t.lifecycle_id AND r.sensor = t.sensor AND r.p = t.p + 1)),
cs AS (SELECT *, CASE WHEN n = 0 OR secs <= greatest({_limit('stuck_observe_s')}, longest * 1.5::DOUBLE) THEN 0
    WHEN secs >= {_limit('stuck_suspect_s')} AND n >= 2 AND (us - lc) / 1e6::DOUBLE >= {_limit('response_s')} THEN 2 ELSE 1 END AS stuck
  FROM (SELECT *, (us - rs) / 1e6::DOUBLE AS secs FROM cs1))"""


@query("constancy_and_stuck_evidence", "A7 A9 A10", q.with_readings(
    f"SELECT machine_id, us, sensor, {q.r6('secs')} AS run_s, {q.r6('longest')} AS longest_s, n AS context_events, stuck FROM cs",
    q.RAW, PLANNED, FAULTY, CONSTANCY))
def constancy_and_stuck_evidence(spark, sf):
    rows = anomaly.constancy(add_slice(faulty(spark, sf), width=W))
    return rows.select(*ID, F.explode(F.array(*[F.struct(
        F.lit(k).alias("sensor"), r6(f"{k}__run_s").alias("run_s"), r6(f"{k}__longest_s").alias("longest_s"),
        F.col(f"{k}__context_events").alias("context_events"), F.col(f"{k}__stuck").alias("stuck")) for k in K])
    ).alias("x")).select(*ID, "x.*")


def neighbours(spark, sf):
    return table(spark, f"neighbours:{sf}", lambda: anomaly.neighbourhood(sliced(spark, sf)))


EVIDENCE = f"""
nb0 AS (SELECT *, """ + ", ".join(
    f"median({k}) OVER w10 AS med_{k}, count(*) OVER w10 AS cnt_{k}, list({k}) OVER w40 AS near_{k}, "
    f"CASE WHEN abs({k} - w_{k}) > {q.d(INTEGRITY[k].resolution * 0.5)} THEN sign({k} - w_{k}) END AS st_{k}, "
    f"count(*) OVER w120 AS n120_{k}, {k} - first({k}) OVER w120 AS move_{k}" for k in K) + """ FROM fg
  WINDOW w10 AS (PARTITION BY machine_id, lifecycle_id ORDER BY p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    w40 AS (PARTITION BY machine_id, lifecycle_id ORDER BY p ROWS BETWEEN 39 PRECEDING AND CURRENT ROW),
    w120 AS (PARTITION BY machine_id, lifecycle_id ORDER BY p ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
nb1 AS (SELECT *, """ + ", ".join(
    f"count(*) FILTER (st_{k} > 0) OVER w119 AS up_{k}, count(*) FILTER (st_{k} < 0) OVER w119 AS dn_{k}, "
    f"list_transform(range(1, 21), lambda i: near_{k}[i] - (near_{k}[1] + (near_{k}[20] - near_{k}[1]) / 19 * (i - 1))) AS o_{k}, "
    f"list_transform(range(1, 21), lambda i: near_{k}[20 + i] - (near_{k}[21] + (near_{k}[40] - near_{k}[21]) / 19 * (i - 1))) AS e_{k}, "
    f"len(list_filter(range(22, 40), lambda i: (near_{k}[i] - near_{k}[i - 1]) * (near_{k}[i + 1] - near_{k}[i]) < 0)) AS tn_{k}"
    for k in K) + """ FROM nb0
  WINDOW w119 AS (PARTITION BY machine_id, lifecycle_id ORDER BY p ROWS BETWEEN 118 PRECEDING AND CURRENT ROW)),
ev2 AS (SELECT *, """ + ", ".join(
    f"cnt_{k} >= 5 AND coalesce(abs({k} - med_{k}) >= {q.d(max(INTEGRITY[k].resolution * 8, s.span * 0.25))}, false) AS ab_{k}, "
    f"coalesce(len(near_{k}) = 40 AND list_median(list_transform(e_{k}, lambda v: abs(v - list_median(e_{k})))) > 8 * greatest("
    f"list_median(list_transform(o_{k}, lambda v: abs(v - list_median(o_{k})))), {q.d(INTEGRITY[k].resolution)}) AND tn_{k} >= 5, false) AS no_{k}, "
    f"coalesce(n120_{k} = 120 AND up_{k} + dn_{k} > 0 AND greatest(up_{k}, dn_{k}) / (up_{k} + dn_{k})::DOUBLE >= 0.85::DOUBLE "
    f"AND abs(move_{k}) >= {q.d(s.span * 0.35)}, false) AS dr_{k}"
    for k, s in zip(K, SENSORS)) + " FROM nb1)"


@query("abrupt_change", "A11", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{q.r6(f'med_{k}')} AS {k}__recent_median, ab_{k} AS {k}__abrupt" for k in K) + " FROM ev2",
    q.RAW, PLANNED, FAULTY, EVIDENCE))
def abrupt_change(spark, sf):
    return neighbours(spark, sf).select(*ID, *[c for k in K for c in (
        r6(f"{k}__recent_median").alias(f"{k}__recent_median"), F.col(f"{k}__abrupt"))])


@query("excessive_noise", "A16", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"no_{k} AS {k}__noise" for k in K) + " FROM ev2", q.RAW, PLANNED, FAULTY, EVIDENCE))
def excessive_noise(spark, sf):
    return neighbours(spark, sf).select(*ID, *[f"{k}__noise" for k in K])


@query("drift", "A17", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"dr_{k} AS {k}__drift, {q.r6(f'CASE WHEN n120_{k} = 120 THEN move_{k} END')} AS {k}__drift_move" for k in K)
    + " FROM ev2", q.RAW, PLANNED, FAULTY, EVIDENCE))
def drift(spark, sf):
    return neighbours(spark, sf).select(*ID, *[c for k in K for c in (
        F.col(f"{k}__drift"), r6(f"{k}__drift_move").alias(f"{k}__drift_move"))])


def _per(template, sep=", "):
    return sep.join(template(i, k) for i, k in enumerate(K))


LADDER = f"""
stuck_wide AS (SELECT machine_id, lifecycle_id, p, """ + _per(
    lambda i, k: f"max(stuck) FILTER (sensor = '{k}') AS sk{i}, max(rs) FILTER (sensor = '{k}') AS rs{i}") + f"""
  FROM cs GROUP BY machine_id, lifecycle_id, p),
ld0 AS (SELECT machine_id, lifecycle_id, p, us, gap_s, {_SHORT} AS short, """ + _per(
    lambda i, k: f"{_bnd(k)} AS bn{i}, sk{i}, {k} AS v{i}, med_{k} AS md{i}, ab_{k} AS ab{i}, no_{k} AS no{i}, dr_{k} AS dr{i}") + f"""
  FROM ev2 JOIN stuck_wide USING (machine_id, lifecycle_id, p)),
ld1 AS (SELECT machine_id, lifecycle_id, 0::BIGINT AS p, '' AS rule, '' AS sensors, 0 AS rec, """ + _per(
    lambda i, k: f"0 AS c{i}, NULL::BIGINT AS s{i}, NULL::DOUBLE AS b{i}, false AS t{i}") + f"""
  FROM ld0 WHERE p = 1
  UNION ALL
  SELECT machine_id, lifecycle_id, p, rule,
    CASE WHEN rule IN ('LONG_GAP','RECOVERY','RECOVERY_END','SHORT_GAP') THEN 'current_ampere|temperature_c|vibration_mps2'
      WHEN rule = 'NONE' THEN '' ELSE array_to_string(list_sort(list_filter([{_per(lambda i, k: f"CASE WHEN hit{i} THEN '{k}' END")}], lambda x: x IS NOT NULL)), '|') END,
    rec2, {_per(lambda i, k: f"c{i}, CASE WHEN del{i} THEN NULL ELSE s{i} END, CASE WHEN del{i} THEN NULL ELSE b{i} END, NOT del{i} AND t{i}")}
  FROM (SELECT *, {_per(lambda i, k: f'''CASE rule WHEN 'CLIPPING' THEN c{i} >= 3 WHEN 'STUCK' THEN sk{i} = 2 WHEN 'POSSIBLE_STUCK' THEN sk{i} >= 1
        WHEN 'CORRELATED' THEN k{i} IN ('held','step') WHEN 'PERSISTENT' THEN k{i} = 'step' WHEN 'ABRUPT' THEN k{i} = 'held'
        WHEN 'RESOLVED' THEN k{i} = 'back' WHEN 'RESOLVED_STEP' THEN k{i} = 'backstep' WHEN 'NOISE' THEN no{i} WHEN 'DRIFT' THEN dr{i} ELSE false END AS hit{i},
        coalesce((rule = 'RESOLVED' AND k{i} = 'back') OR (rule = 'RESOLVED_STEP' AND k{i} = 'backstep'), false) AS del{i}''')}
  FROM (SELECT *, CASE WHEN early IS NOT NULL THEN early
      WHEN len(opn) >= 2 AND list_max(opn) - list_min(opn) <= 300000000 THEN 'CORRELATED'
      WHEN list_contains(ks, 'step') THEN 'PERSISTENT' WHEN list_contains(ks, 'held') THEN 'ABRUPT'
      WHEN list_contains(ks, 'back') THEN 'RESOLVED' WHEN list_contains(ks, 'backstep') THEN 'RESOLVED_STEP'
      WHEN {_per(lambda i, k: f'no{i}', ' OR ')} THEN 'NOISE' WHEN {_per(lambda i, k: f'dr{i}', ' OR ')} THEN 'DRIFT' ELSE 'NONE' END AS rule
  FROM (SELECT * EXCLUDE ({_per(lambda i, k: f's{i}, b{i}, t{i}')}),
      {_per(lambda i, k: f"CASE WHEN s{i} IS NULL AND k{i} = 'held' THEN us ELSE s{i} END AS s{i}, CASE WHEN s{i} IS NULL AND k{i} = 'held' THEN md{i} ELSE b{i} END AS b{i}, t{i} OR coalesce(k{i} = 'step', false) AS t{i}")},
      [{_per(lambda i, k: f'k{i}')}] AS ks,
      list_filter([{_per(lambda i, k: f"CASE WHEN k{i} IN ('held','step') THEN coalesce(s{i}, us) END")}], lambda x: x IS NOT NULL) AS opn
  FROM (SELECT *, {_per(lambda i, k: f'''CASE WHEN early IS NOT NULL THEN NULL WHEN s{i} IS NULL THEN CASE WHEN ab{i} THEN 'held' END
        WHEN abs(v{i} - b{i}) <= {q.d(max(INTEGRITY[k].resolution * 3, max(INTEGRITY[k].resolution * 8, SENSORS[i].span * 0.25) * 0.25))}
          THEN CASE WHEN t{i} THEN 'backstep' WHEN us - s{i} >= 180000000 THEN 'back' ELSE 'held' END
        WHEN us - s{i} >= 180000000 THEN 'step' ELSE 'held' END AS k{i}''')}
  FROM (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN {_per(lambda i, k: f'c{i} >= 3', ' OR ')} THEN 'CLIPPING'
      WHEN greatest({_per(lambda i, k: f'sk{i}')}) = 2 THEN 'STUCK' WHEN greatest({_per(lambda i, k: f'sk{i}')}) = 1 THEN 'POSSIBLE_STUCK' END AS early
  FROM (SELECT * EXCLUDE ({_per(lambda i, k: f'c{i}')}), {_per(lambda i, k: f'CASE WHEN gate IS NOT NULL THEN c{i} WHEN bn{i} THEN c{i} + 1 ELSE 0 END AS c{i}')}
  FROM (SELECT t.* EXCLUDE (rule, sensors), n.* EXCLUDE (machine_id, lifecycle_id, p),
      CASE WHEN n.gap_s >= 300 THEN 'LONG_GAP' WHEN t.rec > 1 THEN 'RECOVERY' WHEN t.rec = 1 THEN 'RECOVERY_END' WHEN n.short THEN 'SHORT_GAP' END AS gate,
      CASE WHEN n.gap_s >= 300 THEN 5 WHEN t.rec > 0 THEN t.rec - 1 ELSE 0 END AS rec2
    FROM (SELECT * EXCLUDE (p), p + 1 AS p FROM ld1) t JOIN ld0 n USING (machine_id, lifecycle_id, p)))))))))"""


@query("anomaly_findings", "K11 A12 A13 A14 A15", q.with_readings(
    "SELECT f.machine_id, f.us, l.rule, l.sensors AS affected_sensors FROM ld1 l JOIN fg f USING (machine_id, lifecycle_id, p)",
    q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER))
def anomaly_findings(spark, sf):
    return found(spark, sf).select(*ID, "rule", "affected_sensors")


_F = anomaly.FINDINGS


def _of_rule(index):
    def lit(v):
        return {True: "true", False: "false"}.get(v) if isinstance(v, bool) else repr(v) if isinstance(v, str) else q.d(v)
    return "CASE l.rule " + " ".join(f"WHEN '{r}' THEN {lit(row[index])}" for r, row in _F.items()) + " END"


_ACTION = _of_rule(5)
_PENALTY = "CASE " + _of_rule(6) + " " + " ".join(f"WHEN '{p}' THEN {q.d(v)}" for p, v in PENALTIES.items()) + " END"


@query("finding_attributes", "A18 A19 A20", q.with_readings(f"""
SELECT f.machine_id, f.us, {_ACTION} AS model_action,
  {_ACTION} NOT IN ('HOLD_FOR_CONFIRMATION','SUSPEND_PREDICTION') AS use_for_prediction,
  CASE {_ACTION} WHEN 'HOLD_FOR_CONFIRMATION' THEN 'HOLD_OUTSIDE_FEATURE_HISTORY' WHEN 'SUSPEND_PREDICTION'
    THEN 'DISCARD_FROM_FEATURE_HISTORY' ELSE 'COMMIT_TO_FEATURE_HISTORY' END AS feature_history_action,
  {q.r6(_PENALTY)} AS confidence_multiplier, {_of_rule(8)} AS training_eligible,
  CASE WHEN e.event_status >= 2 THEN 'CONFIRMED_MACHINE_CRITICAL' ELSE {_of_rule(0)} END AS quality_status
FROM ld1 l JOIN fg f USING (machine_id, lifecycle_id, p) JOIN evs e ON e.machine_id = f.machine_id AND e.us = f.us""",
    q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER, q.EVENT_STATUS.replace("FROM raw", "FROM fraw")))
def finding_attributes(spark, sf):
    return found(spark, sf).select(*ID, "model_action", "use_for_prediction", "feature_history_action",
                                   r6("confidence_multiplier").alias("confidence_multiplier"),
                                   "training_eligible", "quality_status")


@query("detector_disabled", "A1", q.with_readings(
    f"SELECT {KEY}, 'NORMAL' AS quality_status, 'USE_NORMALLY' AS model_action, true AS use_for_features FROM fraw",
    q.RAW, PLANNED, FAULTY))
def detector_disabled(spark, sf):
    return anomaly.describe(anomaly.pass_through(faulty(spark, sf))).select(
        *ID, "quality_status", "model_action", "use_for_features")


def confirmations(spark, sf):
    """One external confirmation for a sensor of each of two machines."""
    rows = faulty(spark, sf)
    return rows.filter(F.col("machine_id").isin("m1", "m3") & (F.col("rn") % 400 == 100)).select(
        "machine_id", F.when(F.col("machine_id") == "m1", K[0]).otherwise(K[1]).alias("sensor"), "us",
        F.concat(F.lit("bench test "), F.col("rn").cast("string")).alias("evidence"),
        F.lit("diagnostic").alias("source"), F.lit("technician").alias("actor"),
        (-F.col("us")).alias("recorded"))


@query("external_confirmation", "A2", q.with_readings(f"""
SELECT r.machine_id, r.us, coalesce(c.sensor, '') AS confirmed, c.us AS confirmed_us, c.evidence AS confirmation_evidence
FROM fraw r LEFT JOIN (SELECT machine_id, CASE machine_id WHEN 'm1' THEN '{K[0]}' ELSE '{K[1]}' END AS sensor,
    min(us) AS us, arg_min('bench test ' || rn, us) AS evidence FROM fraw
    WHERE machine_id IN ('m1','m3') AND rn % 400 = 100 GROUP BY machine_id) c
  ON c.machine_id = r.machine_id AND c.us <= r.us""", q.RAW, PLANNED, FAULTY))
def external_confirmation(spark, sf):
    out = anomaly.external_confirmation(faulty(spark, sf), confirmations(spark, sf))
    return out.select(*ID, "confirmed", "confirmed_us",
                      F.nullif(F.col("confirmation_evidence"), F.lit("")).alias("confirmation_evidence"))


@query("findings_with_confirmation", "A2 K11")
def findings_with_confirmation(spark, sf):
    out = anomaly.detect(add_slice(faulty(spark, sf), width=W), confirmations=confirmations(spark, sf))
    return anomaly.evidence_text(out).select(
        *ID, "rule", "affected_sensors", "first_observed_us", "confirmed_at_us",
        F.array_join("supporting_evidence", " | ").alias("evidence"))


@query("rejected_rows", "P5 S9", q.with_readings("""
SELECT machine_id, ingest_seq, CASE kind WHEN 'duplicate' THEN 'DUPLICATE_TIMESTAMP' WHEN 'order' THEN 'OUT_OF_ORDER_TIMESTAMP'
  WHEN 'jump' THEN 'OUT_OF_RANGE' ELSE 'MALFORMED_VALUE' END AS anomaly_types, 'REFUSE_PREDICTION' AS model_action
FROM val WHERE NOT valid""", EDITED_ARRIVAL, VALIDATED))
def rejected_rows(spark, sf):
    bad = ops.raw_safety_status(validated(spark, sf).filter("NOT valid"))
    return anomaly.classify_invalid(bad).select("machine_id", "ingest_seq", "anomaly_types", "model_action")


@query("primary_anomaly_type", "A22", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PERSISTENT_STEP_CHANGE' WHEN 1 THEN 'ORIGIN_UNCERTAIN' WHEN 2 THEN 'NONE'
  WHEN 3 THEN 'EXCESSIVE_NOISE' ELSE 'SENSOR_DISAGREEMENT' END AS primary_type FROM events""")
def primary_anomaly_type(spark, sf):
    m = F.col("event_id") % 5
    text = (F.when(m == 0, "PERSISTENT_STEP_CHANGE|SENSOR_DISAGREEMENT|ORIGIN_UNCERTAIN").when(m == 1, "ORIGIN_UNCERTAIN")
            .when(m == 2, "NONE").when(m == 3, "NONE|EXCESSIVE_NOISE").otherwise("SENSOR_DISAGREEMENT|ORIGIN_UNCERTAIN"))
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", anomaly.primary_type(text).alias("primary_type"))


@query("anomaly_event_log", "S11", q.with_readings(f"""
SELECT f.machine_id, f.ingest_seq, {_of_rule(1)} AS anomaly_types, {_ACTION} AS model_action
FROM ld1 l JOIN fg f USING (machine_id, lifecycle_id, p) WHERE l.rule <> 'NONE'
UNION ALL
SELECT machine_id, ingest_seq, CASE kind WHEN 'duplicate' THEN 'DUPLICATE_TIMESTAMP' WHEN 'order' THEN 'OUT_OF_ORDER_TIMESTAMP'
  WHEN 'jump' THEN 'OUT_OF_RANGE' ELSE 'MALFORMED_VALUE' END, 'REFUSE_PREDICTION' FROM val WHERE NOT valid""",
    q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER, EDITED_ARRIVAL, VALIDATED))
def anomaly_event_log(spark, sf):
    bad = anomaly.classify_invalid(ops.raw_safety_status(validated(spark, sf).filter("NOT valid")))
    return anomaly.anomaly_events(found(spark, sf), bad).select(
        "machine_id", "ingest_seq", "anomaly_types", "model_action")


@query("anomaly_intervals", "A23")
def anomaly_intervals(spark, sf):
    return anomaly.anomaly_intervals(found_sliced(spark, sf)).withColumns({
        "safety_actions": F.array_join("safety_actions", "|"), "model_actions": F.array_join("model_actions", "|")})


@query("anomaly_interval_export", "A27")
def anomaly_interval_export(spark, sf):
    return anomaly.export_intervals(anomaly.anomaly_intervals(found_sliced(spark, sf)))


_ACTIVE = _of_rule(11)


@query("anomaly_current_state", "A24", q.with_readings(f"""
, st AS (SELECT f.machine_id, f.us, s.sensor, {_ACTIVE} AND contains(l.sensors, s.sensor) AS on_, {_of_rule(1)} AS types, {_ACTION} AS action
  FROM ld1 l JOIN fg f USING (machine_id, lifecycle_id, p), (VALUES ('vibration_mps2'), ('temperature_c'), ('current_ampere')) s(sensor)),
st2 AS (SELECT *, lag(on_) OVER (PARTITION BY machine_id, sensor ORDER BY us) AS was FROM st)
SELECT machine_id, sensor, CASE WHEN arg_max(on_, us) THEN arg_max(types, us) ELSE 'NONE' END AS current_anomaly_type,
  arg_max(on_, us) AS active, max(us) AS latest_update_us, CASE WHEN NOT arg_max(on_, us) THEN max(us) FILTER (NOT on_ AND was) END AS resolution_us,
  CASE WHEN arg_max(on_, us) THEN arg_max(action, us) ELSE 'USE_NORMALLY' END AS model_action FROM st2 GROUP BY machine_id, sensor""",
    q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER))
def anomaly_current_state(spark, sf):
    return anomaly.anomaly_state(found_sliced(spark, sf)).select(
        "machine_id", "sensor", "current_anomaly_type", "active", "latest_update_us", "resolution_us", "model_action")


@query("anomaly_summary", "A25", q.with_readings(f"""
SELECT dimension, item, count(*) AS rows FROM (SELECT unnest(['quality_status', 'anomaly_type', 'model_action']) AS dimension,
  unnest([CASE WHEN e.event_status >= 2 THEN 'CONFIRMED_MACHINE_CRITICAL' ELSE {_of_rule(0)} END, {_of_rule(1)}, {_ACTION}]) AS item
  FROM ld1 l JOIN fg f USING (machine_id, lifecycle_id, p) JOIN evs e ON e.machine_id = f.machine_id AND e.us = f.us)
GROUP BY ALL UNION ALL
SELECT 'stuck', CASE rule WHEN 'STUCK' THEN 'suspected' ELSE 'possible' END, count(*) FROM ld1 WHERE rule IN ('STUCK','POSSIBLE_STUCK') GROUP BY ALL""",
    q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER, q.EVENT_STATUS.replace("FROM raw", "FROM fraw")))
def anomaly_summary(spark, sf):
    return anomaly.anomaly_summary(found(spark, sf))


@query("reconciled_counts", "A26", q.with_readings("""
SELECT rule, count(*) AS rows_a, count(*) FILTER (p % 10 <> 0) AS rows_b, count(*) = count(*) FILTER (p % 10 <> 0) AS equal
FROM ld1 l WHERE p > 0 GROUP BY rule""", q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER))
def reconciled_counts(spark, sf):
    rows = found(spark, sf)
    place = faulty(spark, sf).select("machine_id", "lifecycle_id", "us", "ingest_seq")
    from fleetpulse.plans.slices import scan
    numbered = scan(add_slice(place), ["machine_id", "lifecycle_id"], total={"p": F.lit(1).cast("long")})
    thinned = rows.join(numbered.filter("p % 10 <> 0").select("machine_id", "us"), ["machine_id", "us"], "left_semi")
    return anomaly.reconcile_counts(rows, thinned, ["rule"])


@query("latest_decision", "A28", q.with_readings("""
SELECT f.machine_id, max(f.us) AS us, arg_max(l.rule, f.us) AS rule, arg_max(l.sensors, f.us) AS affected_sensors
FROM ld1 l JOIN fg f USING (machine_id, lifecycle_id, p) GROUP BY f.machine_id""",
    q.RAW, PLANNED, FAULTY, CONSTANCY, EVIDENCE, LADDER))
def latest_decision(spark, sf):
    return anomaly.explain(found(spark, sf)).select("machine_id", "us", "rule", "affected_sensors")
