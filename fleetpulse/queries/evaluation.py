"""Evaluation metrics on scored readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions.rules import r6, status_name
from fleetpulse.operators import cadence, evaluate as ev, lifecycles as life
from fleetpulse.params import HORIZONS_H, PROBABILITY_TARGETS, SENSOR_KEYS
from fleetpulse.plans.shared import table
from fleetpulse.plans.slices import add_slice
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.queries.stateful import EDITED_ARRIVAL, VALIDATED, validated
from fleetpulse.queries.windows import PLANNED, planned
from fleetpulse.operators import rules as ops

ID = ["machine_id", "us"]
T6 = PROBABILITY_TARGETS

# ---- scored readings, the same in both engines -----------------------------------

_P = {"warning": ("(vibration_mps2 - 1) / 4", (0.8, 1.0, 1.1)), "critical": ("(temperature_c - 30) / 60", (0.7, 0.85, 1.0))}


def _p_sql(kind, i):
    base, gains = _P[kind]
    return f"least(greatest({base} * {q.d(gains[i])}, 0), 1)"


_PSQL = ", ".join(
    f"CASE WHEN event_id % 13 = 0 AND '{t}' = 'probability_warning_12h' THEN NULL ELSE {_p_sql(t.split('_')[1], HORIZONS_H.index(int(t.split('_')[2][:-1])))} END AS {t}"
    for t in T6)
_LOADED = "CASE WHEN event_id % 17 = 0 THEN '[\"probability_warning_12h\"]' ELSE '[" + ",".join(f'"{t}"' for t in T6) + "]' END"
SCORED = f"""
sc0 AS (SELECT machine_id, lifecycle_id, us, ingest_seq, event_id, raw_status, upper(health_status) AS actual, vibration_mps2, temperature_c,
  CASE WHEN vibration_mps2 > 3.8 OR temperature_c > 78 THEN 'CRITICAL' WHEN vibration_mps2 > 2.9 OR temperature_c > 61 THEN 'WARNING' ELSE 'NORMAL' END AS status,
  event_id % 10 <> 0 AS trusted, (vibration_mps2 - 1) / 4 >= 0.3 AND event_id % 4 <> 0 AS act, event_id % 6 <> 0 AS from_ml, event_id % 9 = 0 AS held,
  CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '["ood_detected","model_revoked"]' ELSE 'oops' END ELSE '[]' END AS withholding_reasons_json,
  {_LOADED} AS loaded_model_targets, CASE WHEN event_id % 3 = 0 THEN '["probability_warning_12h"]' ELSE '[]' END AS probability_threshold_crossings,
  CASE WHEN temperature_c > 30 THEN (80 - temperature_c) / 3 END AS eta_warning, CASE WHEN event_id % 8 <> 0 THEN (100 - temperature_c) / 3 END AS eta_critical, {_PSQL} FROM planned),
sc1 AS (SELECT *, lag(us) OVER w AS p_us, lag(lifecycle_id) OVER w AS p_life FROM sc0 WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_seq)),
scored AS (SELECT *, CAST(sum(CASE WHEN p_us IS NOT NULL AND (p_life <> lifecycle_id OR us - p_us > 600000000) THEN 1 ELSE 0 END) OVER (
  PARTITION BY machine_id ORDER BY us, ingest_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM sc1)"""
NB = """
sn AS (SELECT *, lag(actual) OVER w AS pa, lag(segment) OVER w AS ps, lead(segment) OVER w AS ns, lead(lifecycle_id) OVER w AS nl FROM scored
  WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_seq)),
onset AS (SELECT *, actual = 'WARNING' AND pa = 'NORMAL' AND ps = segment AS on_w, actual = 'CRITICAL' AND pa IN ('NORMAL','WARNING') AND ps = segment AS on_c FROM sn),
nx AS (SELECT *, min(CASE WHEN on_w THEN us END) OVER w AS next_w, min(CASE WHEN on_c THEN us END) OVER w AS next_c FROM onset
  WINDOW w AS (PARTITION BY machine_id, segment ORDER BY us, ingest_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
BASE = (q.RAW, PLANNED, SCORED)
FULL = (*BASE, NB)


def _prob(t):
    kind, hours = t.split("_")[1], int(t.split("_")[2][:-1])
    base = (F.col("vibration_mps2") - 1) / 4 if kind == "warning" else (F.col("temperature_c") - 30) / 60
    p = F.least(F.greatest(base * _P[kind][1][HORIZONS_H.index(hours)], F.lit(0.0)), F.lit(1.0))
    return F.when(F.col("event_id") % 13 != 0, p) if t == "probability_warning_12h" else p


def scored(spark, sf):
    """Segmented readings with predictions, probabilities and audit cells."""
    def build():
        e, v, t = F.col("event_id"), F.col("vibration_mps2"), F.col("temperature_c")
        rows = planned(spark, sf).withColumns({
            "actual": F.upper("health_status"),
            "status": F.when((v > 3.8) | (t > 78), "CRITICAL").when((v > 2.9) | (t > 61), "WARNING").otherwise("NORMAL"),
            "trusted": e % 10 != 0, "act": ((v - 1) / 4 >= 0.3) & (e % 4 != 0), "from_ml": e % 6 != 0, "held": e % 9 == 0,
            "withholding_reasons_json": F.when(e % 9 == 0, F.when(e % 2 == 0, '["ood_detected","model_revoked"]').otherwise("oops")).otherwise("[]"),
            "loaded_model_targets": F.when(e % 17 == 0, '["probability_warning_12h"]').otherwise("[" + ",".join(f'"{x}"' for x in T6) + "]"),
            "probability_threshold_crossings": F.when(e % 3 == 0, '["probability_warning_12h"]').otherwise("[]"),
            "eta_warning": F.when(t > 30, (80 - t) / 3), "eta_critical": F.when(e % 8 != 0, (100 - t) / 3),
            **{x: _prob(x) for x in T6}})
        rows = cadence.segment(add_slice(rows), order=("us", "ingest_seq"))
        return rows.select("machine_id", "lifecycle_id", "us", "ingest_seq", "event_id", "raw_status", "actual", "status",
                           *SENSOR_KEYS, "trusted", "act", "from_ml", "held", "withholding_reasons_json", "loaded_model_targets",
                           "probability_threshold_crossings", "eta_warning", "eta_critical", *T6, "segment")
    return add_slice(table(spark, f"scored:{sf}", build))


def alert():
    return F.col("trusted") & F.col("act") & F.col("from_ml")


ALERT = "(trusted AND act AND from_ml)"


def labelled(spark, sf):
    """Scored rows with the next onset of each kind, written once."""
    return add_slice(table(spark, f"onsets:{sf}", lambda: ev.next_onsets(scored(spark, sf)).drop("slice")))


def _label_sql(kind, hours):
    return f"coalesce(next_{kind[0]} - us <= {hours * 3_600_000_000}, false)"


# ---- classification -----------------------------------------------------------------

@query("confusion", "E1", q.with_readings("""
SELECT actual, count(*) FILTER (status = 'NORMAL') AS predicted_normal, count(*) FILTER (status = 'WARNING') AS predicted_warning,
  count(*) FILTER (status = 'CRITICAL') AS predicted_critical, count(*) AS rows, """ + q.r6("count(*) FILTER (status = actual) / count(*)::DOUBLE")
    + " AS accuracy FROM scored GROUP BY actual", *BASE))
def confusion(spark, sf):
    return ev.confusion(scored(spark, sf), "actual", "status").withColumn("accuracy", r6("accuracy"))


@query("label_agreement", "E2", q.with_readings(f"""
SELECT machine_id, count(*) AS input_rows, count(*) FILTER (valid) AS valid_rows, count(*) FILTER (NOT valid) AS invalid_rows,
  count(*) FILTER (valid AND rs = 0) AS normal_rows, count(*) FILTER (valid AND rs = 1) AS warning_rows, count(*) FILTER (valid AND rs = 2) AS critical_rows,
  count(*) FILTER (valid) AS labelled_rows, {q.r6("count(*) FILTER (valid AND upper(label) = nm) / count(*) FILTER (valid)::DOUBLE")} AS label_accuracy
FROM (SELECT *, {q.machine_status()} AS rs, {q.name(q.machine_status())} AS nm FROM val) GROUP BY machine_id""", EDITED_ARRIVAL, VALIDATED))
def label_agreement(spark, sf):
    return ev.label_agreement(ops.machine_status(validated(spark, sf))).withColumn("label_accuracy", r6("label_accuracy"))


@query("resolved_label", "S7", q.with_readings("SELECT 'health_status' AS label_column, count(*) AS rows FROM readings"))
def resolved_label(spark, sf):
    rows = planned(spark, sf).withColumn("source_label", F.when(F.col("event_id") % 100 == 0, "odd").otherwise(F.col("health_status")))
    name = ev.resolve_label(rows)
    return rows.agg(F.lit(name).alias("label_column"), F.count("*").alias("rows"))


@query("aligned_labels", "L7", q.with_readings("SELECT machine_id, actual, count(*) AS rows FROM scored GROUP BY ALL", *BASE))
def aligned_labels(spark, sf):
    rows = scored(spark, sf).select("machine_id", "us", "ingest_seq", "status")
    labels = planned(spark, sf).select("machine_id", "us", "ingest_seq", "health_status")
    return ev.align_labels(rows, labels).groupBy("machine_id", "actual").agg(F.count("*").alias("rows"))


_RATES = ", ".join(f"{q.r6(e)} AS {n}" for n, e in {
    "fn_rate": "fn / nullif(tp + fn, 0)::DOUBLE", "fp_rate": "fp / nullif(tn + fp, 0)::DOUBLE", "precision": "tp / nullif(tp + fp, 0)::DOUBLE",
    "recall": "tp / nullif(tp + fn, 0)::DOUBLE", "specificity": "tn / nullif(tn + fp, 0)::DOUBLE",
    "f1": "CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"}.items())
_RATES_0 = ", ".join(f"{q.r6(f'coalesce({e}, 0)')} AS {n}" for n, e in {
    "fn_rate": "fn / nullif(tp + fn, 0)::DOUBLE", "fp_rate": "fp / nullif(tn + fp, 0)::DOUBLE", "precision": "tp / nullif(tp + fp, 0)::DOUBLE",
    "recall": "tp / nullif(tp + fn, 0)::DOUBLE", "specificity": "tn / nullif(tn + fp, 0)::DOUBLE",
    "f1": "2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)"}.items())
_RATE_COLS = ("fn_rate", "fp_rate", "precision", "recall", "specificity", "f1")


def _rates(df):
    return df.withColumns({c: r6(c) for c in _RATE_COLS})


def _bin_sql(y, p):
    return f"count(*) FILTER ({y} AND {p}) AS tp, count(*) FILTER (NOT {y} AND NOT {p}) AS tn, count(*) FILTER (NOT {y} AND {p}) AS fp, count(*) FILTER ({y} AND NOT {p}) AS fn"


@query("binary_metrics", "E4", q.with_readings(
    f"SELECT machine_id, tp, tn, fp, fn, tp + fn AS positive_rows, tn + fp AS negative_rows, {_RATES} FROM (SELECT machine_id, {_bin_sql('y', 'p')} "
    f"FROM (SELECT *, {_label_sql('warning', 12)} AS y, coalesce(probability_warning_12h >= 0.4, false) AS p FROM nx) GROUP BY machine_id)", *FULL))
def binary_metrics(spark, sf):
    rows = labelled(spark, sf).withColumns({"y": ev.within("WARNING", 12), "p": F.coalesce(F.col("probability_warning_12h") >= 0.4, F.lit(False))})
    return _rates(ev.binary_metrics(rows, "y", "p", ["machine_id"]))


_CLIP = "least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"


@query("probability_scores", "E5 E6", q.with_readings(f"""
SELECT a.machine_id, probability_rows, {q.r6('coverage')} AS probability_coverage, {q.r6('brier')} AS brier_score, {q.r6('loss')} AS log_loss, {q.r6('ece')} AS calibration_error
FROM (SELECT machine_id, count(p) AS probability_rows, count(p) / count(*)::DOUBLE AS coverage, avg(({_CLIP} - y) ** 2) FILTER (p IS NOT NULL) AS brier,
    avg(-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))) FILTER (p IS NOT NULL) AS loss FROM (SELECT machine_id, probability_warning_12h AS p, CAST({_label_sql('warning', 12)} AS INTEGER)::DOUBLE AS y FROM nx) GROUP BY machine_id) a
JOIN (SELECT machine_id, sum(n * abs(my - mp)) / sum(n) AS ece FROM (SELECT machine_id, least(floor(p * 10), 9) AS b, count(*) AS n, avg(y) AS my, avg(p) AS mp
    FROM (SELECT machine_id, probability_warning_12h AS p, CAST({_label_sql('warning', 12)} AS INTEGER)::DOUBLE AS y FROM nx) WHERE p IS NOT NULL GROUP BY ALL) GROUP BY machine_id) b USING (machine_id)""", *FULL))
def probability_scores(spark, sf):
    rows = labelled(spark, sf).withColumn("y", ev.within("WARNING", 12))
    out = ev.probability_scores(rows, "y", "probability_warning_12h", ["machine_id"]).join(
        ev.calibration_error(rows, "y", "probability_warning_12h", by=["machine_id"]), "machine_id")
    return out.withColumns({c: r6(c) for c in ("probability_coverage", "brier_score", "log_loss", "calibration_error")})


@query("ranking_scores", "E7 E8", q.with_readings(f"""
SELECT machine_id, {q.r6('sum(pos * (cn - neg + neg / 2.0::DOUBLE)) / nullif(max(P) * max(N), 0)')} AS roc_auc,
  {q.r6('CASE WHEN max(N) > 0 AND max(P) > 0 THEN sum(pos / P::DOUBLE * (P - cp + pos) / (P - cp + pos + N - cn + neg)) END')} AS average_precision
FROM (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER a AS P, sum(neg) OVER a AS N FROM (
    SELECT machine_id, probability_warning_24h AS s, count(*) FILTER ({_label_sql('warning', 24)}) AS pos, count(*) FILTER (NOT {_label_sql('warning', 24)}) AS neg FROM nx GROUP BY ALL)
  WINDOW w AS (PARTITION BY machine_id ORDER BY s ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY machine_id)) GROUP BY machine_id""", *FULL))
def ranking_scores(spark, sf):
    rows = labelled(spark, sf).withColumn("y", ev.within("WARNING", 24))
    return ev.ranking_scores(rows, "y", "probability_warning_24h").withColumns({c: r6(c) for c in ("roc_auc", "average_precision")})


# ---- forecast errors --------------------------------------------------------------------

_ETA_ROWS = "(SELECT *, (next_c - us) / 3.6e9::DOUBLE AS a, eta_critical AS p, eta_critical - (next_c - us) / 3.6e9::DOUBLE AS e FROM nx)"


def eta_rows(spark, sf):
    return labelled(spark, sf).withColumn("a", (F.col("next_critical_us") - F.col("us")) / 3.6e9)


@query("regression_metrics", "E9", q.with_readings(f"""
SELECT m.*, {", ".join(f"{q.r6(e)} AS {n}" for n, e in {"macro_mae": "x.mm", "median_lifecycle_mae": "x.md", "worst_lifecycle_mae": "x.mx", "macro_bias": "x.mb"}.items())}, x.n AS lifecycle_count
FROM (SELECT machine_id, {q.r6('avg(abs(e))')} AS micro_mae, {q.r6('median(abs(e))')} AS micro_median, {q.r6('avg(e)')} AS micro_bias, {q.r6('quantile_cont(abs(e), 0.9)')} AS micro_p90, count(*) AS sample_count
  FROM {_ETA_ROWS} WHERE e IS NOT NULL GROUP BY machine_id) m JOIN (SELECT machine_id, avg(l) AS mm, median(l) AS md, max(l) AS mx, avg(b) AS mb, count(*) AS n FROM (
  SELECT machine_id, lifecycle_id, avg(abs(e)) AS l, avg(e) AS b FROM {_ETA_ROWS} WHERE e IS NOT NULL GROUP BY ALL) GROUP BY machine_id) x USING (machine_id)""", *FULL))
def regression_metrics(spark, sf):
    out = ev.regression_metrics(eta_rows(spark, sf), "a", "eta_critical", ["machine_id"])
    return out.withColumns({c: r6(c) for c in ("micro_mae", "micro_median", "micro_bias", "micro_p90", "macro_mae", "median_lifecycle_mae", "worst_lifecycle_mae", "macro_bias")})


# Lifecycle attributes: regime and family by machine and lifecycle number.
ATTRS = """attrs AS (SELECT machine_id, lifecycle_id, (max(us) - min(us)) / 3.6e9::DOUBLE AS duration_hours,
  CASE WHEN CAST(right(machine_id, 1) AS INTEGER) % 2 = 0 THEN 'steady' ELSE 'cyclic' END AS operating_regime,
  CASE WHEN CAST(right(lifecycle_id, 4) AS INTEGER) % 2 = 0 THEN 'wear' ELSE 'heat' END AS degradation_family FROM planned GROUP BY ALL)"""


def attrs(spark, sf):
    odd = F.substring("machine_id", -1, 1).cast("int") % 2 == 1
    return planned(spark, sf).groupBy("machine_id", "lifecycle_id").agg(
        ((F.max("us") - F.min("us")) / 3.6e9).alias("duration_hours")).withColumns({
            "operating_regime": F.when(odd, "cyclic").otherwise("steady"),
            "degradation_family": F.when(F.substring("lifecycle_id", -4, 4).cast("int") % 2 == 0, "wear").otherwise("heat")})


BOUNDS = (6, 12, 15, 18)
_BUCKET = ("CASE " + " ".join(f"WHEN duration_hours < {b} THEN '{n}'" for b, n in zip(BOUNDS, life.bucket_names(BOUNDS)))
           + f" ELSE '{life.bucket_names(BOUNDS)[-1]}' END")


@query("lifecycle_attributes", "L10 L12", q.with_readings(
    f"SELECT machine_id, us, operating_regime, degradation_family, {_BUCKET} AS bucket FROM planned JOIN attrs USING (machine_id, lifecycle_id)",
    q.RAW, PLANNED, ATTRS))
def lifecycle_attributes(spark, sf):
    rows = life.attach_lifecycle_attrs(planned(spark, sf), attrs(spark, sf))
    return rows.select(*ID, "operating_regime", "degradation_family", life.duration_bucket("duration_hours", BOUNDS).alias("bucket"))


_DB = ["mae", "bias", "p90", "max_error", "p90_late", "max_late", "early_rate", *[f"late_{m}_min" for m in ev.LATE_MIN]]
_DB_SQL = {"mae": "avg(abs(e))", "bias": "avg(e)", "p90": "quantile_cont(abs(e), 0.9)", "max_error": "max(abs(e))",
           "p90_late": "quantile_cont(CASE WHEN e IS NOT NULL THEN greatest(e, 0) END, 0.9)", "max_late": "max(CASE WHEN e IS NOT NULL THEN greatest(e, 0) END)", "early_rate": "avg(CAST(e < 0 AS INTEGER))",
           **{f"late_{m}_min": f"avg(CAST(e > {m / 60.0!r} AS INTEGER))" for m in ev.LATE_MIN}}


@query("duration_bucket_metrics", "E10", q.with_readings(f"""
SELECT bucket, machine_id, lifecycle_id, count(DISTINCT CASE WHEN e IS NOT NULL THEN machine_id || lifecycle_id END) AS lifecycle_count, count(e) AS sample_count,
  {q.r6('count(e) / count(*)::DOUBLE')} AS coverage, {", ".join(f"{q.r6(e)} AS {n}" for n, e in _DB_SQL.items())}
FROM (SELECT *, {_BUCKET} AS bucket FROM {_ETA_ROWS} JOIN attrs USING (machine_id, lifecycle_id) WHERE a IS NOT NULL)
GROUP BY GROUPING SETS ((bucket), (bucket, machine_id, lifecycle_id))""", *FULL, ATTRS))
def duration_bucket_metrics(spark, sf):
    rows = life.attach_lifecycle_attrs(eta_rows(spark, sf), attrs(spark, sf)).withColumn("bucket", life.duration_bucket("duration_hours", BOUNDS))
    out = ev.duration_bucket_metrics(rows, "a", "eta_critical", "bucket")
    return out.withColumns({c: r6(c) for c in ["coverage", *_DB]})


@query("forecast_backtest", "E31", q.with_readings(f"""
SELECT machine_id, count(*) AS forecasts, {q.r6('avg(abs(e))')} AS mae, {q.r6('median(abs(e))')} AS median,
  {q.r6('list_sort(list(abs(e)))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1]')} AS p90, {q.r6('avg(e)')} AS bias
FROM {_ETA_ROWS} WHERE e IS NOT NULL GROUP BY machine_id""", *FULL))
def forecast_backtest(spark, sf):
    out = ev.forecast_backtest(eta_rows(spark, sf), "a", "eta_critical")
    return out.withColumns({c: r6(c) for c in ("mae", "median", "p90", "bias")})


@query("paired_rows", "L13", q.with_readings(f"""
SELECT machine_id, count(*) AS pairs, {q.r6('avg(abs(eta_critical - a))')} AS candidate_mae, {q.r6('avg(abs(greatest(eta_warning, 0) - a))')} AS baseline_mae
FROM {_ETA_ROWS} WHERE a IS NOT NULL AND eta_critical IS NOT NULL AND eta_warning IS NOT NULL GROUP BY machine_id""", *FULL))
def paired_rows(spark, sf):
    rows = eta_rows(spark, sf)
    pairs = rows.filter(F.col("a").isNotNull()).select(*ID, "a", F.col("eta_critical").alias("c")).filter("c is not null").join(
        rows.select(*ID, F.greatest("eta_warning", F.lit(0.0)).alias("b"), "eta_warning").filter("eta_warning is not null"), ID)
    return pairs.groupBy("machine_id").agg(F.count("*").alias("pairs"), r6(F.avg(F.abs(F.col("c") - F.col("a")))).alias("candidate_mae"),
                                           r6(F.avg(F.abs(F.col("b") - F.col("a")))).alias("baseline_mae"))


# ---- events per lifecycle ---------------------------------------------------------------------

_Y12, _P12 = _label_sql("warning", 12), "coalesce(probability_warning_12h >= 0.6, false)"


def twelve(spark, sf):
    return labelled(spark, sf).withColumns({
        "y": ev.within("WARNING", 12), "p": F.coalesce(F.col("probability_warning_12h") >= 0.6, F.lit(False)),
        "lead": (F.col("next_warning_us") - F.col("us")) / 3.6e9})


@query("event_detection", "E11", q.with_readings(f"""
SELECT count(*) FILTER (ev) AS event_count, count(*) FILTER (fd) AS detected_event_count, count(*) FILTER (ev) - count(*) FILTER (fd) AS missed_event_count,
  {q.r6('(count(*) FILTER (ev) - count(*) FILTER (fd)) / nullif(count(*) FILTER (ev), 0)::DOUBLE')} AS event_fn_rate
FROM (SELECT machine_id, lifecycle_id, bool_or({_Y12}) AS ev, bool_or({_Y12} AND {_P12}) AS fd FROM nx GROUP BY ALL)""", *FULL))
def event_detection(spark, sf):
    return ev.event_detection(twelve(spark, sf), "y", "p").withColumn("event_fn_rate", r6("event_fn_rate"))


@query("lead_time_halves", "E12", q.with_readings("SELECT machine_id, " + ", ".join(
    f"count(*) FILTER (y AND {c}) AS {n}_positives, count(*) FILTER (y AND {c} AND p) AS {n}_detected, "
    + q.r6(f"(count(*) FILTER (y AND {c}) - count(*) FILTER (y AND {c} AND p)) / nullif(count(*) FILTER (y AND {c}), 0)::DOUBLE") + f" AS {n}_fn_rate"
    for n, c in (("early", "l >= 6"), ("late", "l < 6")))
    + f" FROM (SELECT machine_id, {_Y12} AS y, {_P12} AS p, (next_w - us) / 3.6e9::DOUBLE AS l FROM nx) GROUP BY machine_id", *FULL))
def lead_time_halves(spark, sf):
    out = ev.lead_time_halves(twelve(spark, sf), "y", "p", "lead", 12, ["machine_id"])
    return out.withColumns({c: r6(c) for c in ("early_fn_rate", "late_fn_rate")})


@query("group_metrics", "E13", q.with_readings(f"""
SELECT dimension, g AS "group", tp, tn, fp, fn, lifecycle_count, tp + fn AS positive_rows, tn + fp AS negative_rows, {_RATES_0} FROM (
  SELECT 'bucket' AS dimension, {_BUCKET} AS g, count(DISTINCT machine_id || lifecycle_id) AS lifecycle_count, {_bin_sql('y', 'p')} FROM rows12 GROUP BY ALL
  UNION ALL SELECT 'operating_regime', operating_regime, count(DISTINCT machine_id || lifecycle_id), {_bin_sql('y', 'p')} FROM rows12 GROUP BY ALL)""",
    *FULL, ATTRS, f"rows12 AS (SELECT *, {_Y12} AS y, {_P12} AS p FROM nx JOIN attrs USING (machine_id, lifecycle_id))"))
def group_metrics(spark, sf):
    rows = life.attach_lifecycle_attrs(twelve(spark, sf), attrs(spark, sf)).withColumn("bucket", life.duration_bucket("duration_hours", BOUNDS))
    return _rates(ev.group_metrics(rows, "y", "p", ["bucket", "operating_regime"]))


def target_rows(spark, sf):
    rows = labelled(spark, sf).withColumns({
        **{f"raw_{t}": F.col(t) for t in T6},
        **{f"reconciled_{t}": F.greatest(*[F.col(f"probability_{t.split('_')[1]}_{h}h") for h in HORIZONS_H if h <= int(t.split('_')[2][:-1])])
           if int(t.split('_')[2][:-1]) > 6 else F.col(t) for t in T6},
        "thresholds": F.create_map(*[x for t in T6 for x in (F.lit(t), F.lit(0.4))]),
        "eligible": F.array(*[F.lit(t) for t in T6 if t != "probability_critical_6h"]),
        "loaded": F.from_json("loaded_model_targets", "array<string>"),
        "crossings": F.from_json("probability_threshold_crossings", "array<string>")})
    return add_slice(table(spark, f"target_rows:{sf}", lambda: ev.per_target_rows(rows).drop("slice")))


def _rec_sql(t):
    kind, h = t.split("_")[1], int(t.split("_")[2][:-1])
    cells = [f"probability_{kind}_{x}h" for x in HORIZONS_H if x <= h]
    return f"greatest({', '.join(cells)})" if len(cells) > 1 else cells[0]


TARGET_ROWS = "trg AS (" + " UNION ALL ".join(
    f"SELECT machine_id, lifecycle_id, segment, us, actual, '{t}' AS target, {_label_sql(t.split('_')[1], int(t.split('_')[2][:-1]))} AS y, {t} AS raw, {_rec_sql(t)} AS rec, "
    f"{'false' if t == 'probability_critical_6h' else 'true'} AS el, contains(loaded_model_targets, '{t}') AS ld, "
    f"contains(probability_threshold_crossings, '{t}') AND trusted AND {'false' if t == 'probability_critical_6h' else 'true'} AND contains(loaded_model_targets, '{t}') AS st FROM nx" for t in T6) + ")"


@query("per_target_metrics", "E20", q.with_readings("SELECT target, count(*) AS rows, count(raw) AS raw_probability_rows, count(rec) AS reconciled_probability_rows, "
    "count(*) FILTER (ld) AS loaded_rows, count(*) FILTER (el) AS eligible_rows, count(*) FILTER (y AND NOT st) AS positive_without_strict_alert, "
    "count(*) FILTER (abs(raw - rec) > 1e-8 + 1e-5 * abs(rec)) AS changed_probability_rows, count(*) FILTER (pr <> pc) AS changed_classification_rows, "
    + ", ".join(f"count(*) FILTER (y AND {p}) AS {n}_tp, count(*) FILTER (NOT y AND NOT {p}) AS {n}_tn, count(*) FILTER (NOT y AND {p}) AS {n}_fp, count(*) FILTER (y AND NOT {p}) AS {n}_fn"
                for n, p in (("alert_raw", "pr"), ("alert_reconciled", "pc"), ("strict", "st")))
    + " FROM (SELECT *, coalesce(raw >= 0.4, false) AS pr, coalesce(rec >= 0.4, false) AS pc FROM trg) GROUP BY target", *FULL, TARGET_ROWS))
def per_target_metrics(spark, sf):
    return ev.per_target_metrics(target_rows(spark, sf))


def _score_sql(fp_max):
    def ex(c, m):
        return "0" if m is None else f"greatest(0, {c} - {m}) / {m}"
    ok = "fn <= 0.1 AND efn <= 0.1" + ("" if fp_max is None else f" AND fp <= {fp_max}")
    a, b, c = ex("fn", 0.1), ex("efn", 0.1), ex("fp", fp_max)
    return f"""
tp0 AS (SELECT target, raw AS s, y, machine_id || lifecycle_id AS lc FROM trg WHERE raw IS NOT NULL),
cand AS (SELECT target, s FROM tp0 WHERE s > 0 AND s < 1 UNION SELECT DISTINCT target, i / 100.0::DOUBLE FROM tp0, range(1, 100) r(i) UNION SELECT DISTINCT target, 0.5::DOUBLE FROM tp0),
cnt AS (SELECT target, s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM tp0 GROUP BY ALL),
bst AS (SELECT target, s, count(*) AS b FROM (SELECT target, lc, max(s) AS s FROM tp0 WHERE y GROUP BY ALL) GROUP BY ALL),
strm AS (SELECT target, s, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(b, 0) AS b FROM (SELECT target, s FROM cand UNION SELECT target, s FROM cnt UNION SELECT target, s FROM bst)
  LEFT JOIN cnt USING (target, s) LEFT JOIN bst USING (target, s)),
scr AS (SELECT target, s, (cp - pos) / greatest(P, 1)::DOUBLE AS fn, (N - cn + neg) / greatest(N, 1)::DOUBLE AS fp, (cb - b) / greatest(B, 1)::DOUBLE AS efn, P, N FROM (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(b) OVER w AS cb, sum(pos) OVER a AS P, sum(neg) OVER a AS N, sum(b) OVER a AS B FROM strm
  WINDOW w AS (PARTITION BY target ORDER BY s ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY target)) WHERE s > 0 AND s < 1),
rnk AS (SELECT *, {ok} AS ok, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN {ok} THEN 0 ELSE 1 END, CASE WHEN {ok} THEN fp ELSE greatest({a}, {b}, {c}) END,
  CASE WHEN {ok} THEN efn ELSE ({a}) + ({b}) + ({c}) END, CASE WHEN {ok} THEN abs(s - 0.5) ELSE fp END, CASE WHEN {ok} THEN s ELSE fn END, efn, abs(s - 0.5), s) AS k FROM scr)"""


@query("alert_threshold", "E14", q.with_readings(f"""
SELECT target, {q.r6('CASE WHEN min(least(P, N)) = 0 THEN 0.5::DOUBLE ELSE min(s) FILTER (k = 1) END')} AS selected_threshold, bool_or(ok) AND min(least(P, N)) > 0 AS eligible,
  CASE WHEN min(least(P, N)) = 0 THEN 'single_class_in_split' WHEN bool_or(ok) THEN NULL WHEN bool_or(fn <= 0.1 AND efn <= 0.1)
  THEN 'no_threshold_satisfies_joint_fn_fp_constraints' ELSE 'fn_ceiling_not_met' END AS reason, {q.r6('min(fn) FILTER (k = 1)')} AS fn_rate,
  {q.r6('min(fp) FILTER (k = 1)')} AS fp_rate, {q.r6('min(efn) FILTER (k = 1)')} AS event_fn_rate, count(*) AS candidate_count FROM rnk GROUP BY target""",
    *FULL, TARGET_ROWS, _score_sql(0.15)))
def alert_threshold(spark, sf):
    out = ev.select_threshold(target_rows(spark, sf), "label", "raw")
    return out.withColumns({c: r6(c) for c in ("selected_threshold", "fn_rate", "fp_rate", "event_fn_rate")})


# ---- episodes ------------------------------------------------------------------------------------

def _island_sql(mask, src="scored", keys="machine_id", split="segment"):
    change = f" OR p_sp <> {split}" if split else ""
    sp = f", lag({split}) OVER w AS p_sp" if split else ""
    return f"""(SELECT *, CASE WHEN m THEN sum(CASE WHEN m AND (NOT coalesce(pm, false){change}) THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY us, ingest_seq ROWS UNBOUNDED PRECEDING) END AS island
      FROM (SELECT *, lag(m) OVER w AS pm{sp} FROM (SELECT *, coalesce({mask}, false) AS m FROM {src}) WINDOW w AS (PARTITION BY {keys} ORDER BY us, ingest_seq)))"""


def _episode_sql(mask, dur, split="segment"):
    return f"(SELECT machine_id, island, count(*) AS n, {dur} AS d FROM {_island_sql(mask, split=split)} WHERE island IS NOT NULL GROUP BY machine_id, island)"


@query("alert_episodes", "E15", q.with_readings(" UNION ALL ".join(f"""
SELECT machine_id, '{rule}' AS rule, count(*) AS episodes, max(n) AS longest_rows, {q.r6('median(d)')} AS median_duration, {q.r6('quantile_cont(d, 0.9)')} AS p90_duration, {q.r6('max(d)')} AS max_duration
FROM {src} GROUP BY machine_id""" for rule, src in (
    ("span", _episode_sql(ALERT, "(max(us) - min(us)) / 3.6e9::DOUBLE")), ("rows", _episode_sql(ALERT, "count(*)::DOUBLE")),
    ("cadence", f"(SELECT machine_id, n, n * c AS d FROM {_episode_sql(ALERT, '0')} JOIN (SELECT machine_id, median((us - p_us) / 3.6e9::DOUBLE) AS c FROM scored GROUP BY machine_id) USING (machine_id))"))), *BASE))
def alert_episodes(spark, sf):
    out = None
    for rule in ("span", "rows", "cadence"):
        one = ev.episode_summary(ev.episodes(scored(spark, sf), alert(), duration=rule)).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: r6(c) for c in ("median_duration", "p90_duration", "max_duration")})


@query("false_alert_metrics", "E16", q.with_readings(f"""
SELECT machine_id, normal_rows, false_rows, normal_periods, periods_hit, coalesce(e.n, 0) AS false_episodes, {q.r6('e.md')} AS median_hours, {q.r6('e.mx')} AS max_hours, {q.r6('x.h')} AS normal_hours,
  {q.r6('false_rows / nullif(normal_rows, 0)::DOUBLE')} AS false_row_rate, {q.r6('periods_hit / nullif(normal_periods, 0)::DOUBLE')} AS period_rate, {q.r6('100 * coalesce(e.n, 0) / nullif(x.h, 0)')} AS episodes_per_100_normal_hours
FROM (SELECT machine_id, count(*) FILTER (actual = 'NORMAL') AS normal_rows, count(*) FILTER (actual = 'NORMAL' AND {ALERT}) AS false_rows FROM scored GROUP BY machine_id)
LEFT JOIN (SELECT machine_id, count(*) AS n, median(d) AS md, max(d) AS mx FROM {_episode_sql(f"actual = 'NORMAL' AND {ALERT}", "(max(us) - min(us)) / 3.6e9::DOUBLE")} GROUP BY machine_id) e USING (machine_id)
LEFT JOIN (SELECT machine_id, count(*) AS normal_periods, count(*) FILTER (hit) AS periods_hit FROM (SELECT machine_id, island, bool_or({ALERT}) AS hit FROM {_island_sql("actual = 'NORMAL'")} WHERE island IS NOT NULL GROUP BY ALL) GROUP BY machine_id) USING (machine_id)
LEFT JOIN (SELECT machine_id, sum(h) AS h FROM (SELECT machine_id, segment, (max(us) - min(us)) / 3.6e9::DOUBLE AS h FROM scored WHERE actual = 'NORMAL' GROUP BY ALL) GROUP BY machine_id) x USING (machine_id)""", *BASE))
def false_alert_metrics(spark, sf):
    out = ev.false_alert_metrics(scored(spark, sf), alert())
    return out.withColumns({c: r6(c) for c in ("median_hours", "max_hours", "normal_hours", "false_row_rate", "period_rate", "episodes_per_100_normal_hours")})


def _unsafe_sql(kind):
    inside, before = ev.ONSETS[kind]
    ins, bef = ", ".join(f"'{x}'" for x in inside), ", ".join(f"'{x}'" for x in before)
    return f"""(SELECT *, '{kind.lower()}_' || lpad(CAST(row_number() OVER (PARTITION BY machine_id ORDER BY onset_us) AS VARCHAR), 4, '0') AS episode_id FROM (
      SELECT machine_id, '{kind}' AS kind, arg_min(lifecycle_id, us) AS lifecycle_id, arg_min(segment, us) AS segment, min(us) AS onset_us, max(us) AS end_us,
        CASE WHEN arg_max(coalesce(ns, -1), us) = -1 THEN 'end_of_file' WHEN arg_max(ns, us) = arg_max(segment, us) THEN '' WHEN arg_max(nl, us) <> arg_max(lifecycle_id, us) THEN 'lifecycle_boundary' ELSE 'timestamp_gap' END AS censoring_reason,
        arg_min(coalesce(pa IN ({bef}) AND ps = segment, false), us) AS is_onset FROM {_island_sql(f"actual IN ({ins})", "sn")} WHERE island IS NOT NULL GROUP BY machine_id, island) WHERE is_onset)"""


@query("unsafe_episodes", "E17", q.with_readings(" UNION ALL ".join(
    f"SELECT machine_id, kind, lifecycle_id, segment, onset_us, end_us, censoring_reason, censoring_reason <> '' AS censored, episode_id FROM {_unsafe_sql(k)}" for k in ev.ONSETS), *FULL))
def unsafe_episodes(spark, sf):
    out = None
    for kind in ev.ONSETS:
        one = ev.unsafe_episodes(scored(spark, sf), kind)
        out = one if out is None else out.unionByName(one)
    return out


def events(spark, sf, kind):
    return table(spark, f"events_{kind}:{sf}", lambda: ev.unsafe_episodes(scored(spark, sf), kind))


@query("horizon_metrics", "E18", q.with_readings(f"""
SELECT hours, count(*) FILTER (el) AS eligible, count(l) FILTER (el) AS predicted, count(*) FILTER (el) - count(l) FILTER (el) AS missed, count(*) FILTER (NOT el) AS insufficient_history,
  {q.r6('count(l) FILTER (el) / nullif(count(*) FILTER (el), 0)::DOUBLE')} AS recall, {q.r6('median(l) FILTER (el)')} AS median_lead, {q.r6('min(l) FILTER (el)')} AS min_lead, {q.r6('max(l) FILTER (el)')} AS max_lead
FROM (SELECT e.*, h.hours, onset_us - s.s0 >= h.hours * 3600000000 AS el, (onset_us - (SELECT min(us) FROM scored r WHERE r.machine_id = e.machine_id AND r.segment = e.segment
    AND r.us >= onset_us - h.hours * 3600000000 AND r.us < onset_us AND {ALERT} AND r.actual = 'NORMAL')) / 3.6e9::DOUBLE AS l
  FROM {_unsafe_sql('WARNING')} e JOIN (SELECT machine_id, segment, min(us) AS s0 FROM scored GROUP BY ALL) s USING (machine_id, segment), (VALUES (1.0::DOUBLE), (2.0), (4.0)) h(hours)) GROUP BY hours""", *FULL))
def horizon_metrics(spark, sf):
    out = ev.horizon_metrics(scored(spark, sf), events(spark, sf, "WARNING"), alert() & (F.col("actual") == "NORMAL"), (1, 2, 4))
    return out.withColumns({c: r6(c) for c in ("recall", "median_lead", "min_lead", "max_lead")})


@query("rows_before_onset", "L8", q.with_readings(
    f"SELECT machine_id, us, segment FROM nx WHERE {_label_sql('critical', 6)}", *FULL))
def rows_before_onset(spark, sf):
    return ev.rows_before_onset(scored(spark, sf), "CRITICAL", 6).select("machine_id", "us", "segment")


@query("future_event_labels", "E19 D7", q.with_readings("SELECT machine_id, us, " + ", ".join(
    f"{_label_sql(k, h)} AS {k}_{h}h" for k in ("warning", "critical") for h in HORIZONS_H) + " FROM nx", *FULL))
def future_event_labels(spark, sf):
    return labelled(spark, sf).select(*ID, *[ev.within(k, h).alias(f"{k}_{h}h") for k in ("warning", "critical") for h in HORIZONS_H])


@query("target_event_metrics", "E19", q.with_readings(f"""
SELECT count(*) AS event_onsets, count(l) AS warned, count(*) - count(l) AS missed, {q.r6('(count(*) - count(l)) / nullif(count(*), 0)::DOUBLE')} AS event_fn_rate,
  {q.r6('median(l)')} AS median_lead, {q.r6('min(l)')} AS min_lead, {q.r6('max(l)')} AS max_lead, {", ".join(f"{q.r6(f'count(*) FILTER (l >= {h}) / nullif(count(*), 0)::DOUBLE')} AS warned_{h}h_early_rate" for h in ev.LEADS)}
FROM (SELECT (onset_us - (SELECT min(us) FROM scored r WHERE r.machine_id = e.machine_id AND r.segment = e.segment AND r.us >= onset_us - 43200000000 AND r.us < onset_us AND r.probability_warning_12h >= 0.4)) / 3.6e9::DOUBLE AS l
  FROM {_unsafe_sql('WARNING')} e)""", *FULL))
def target_event_metrics(spark, sf):
    out = ev.target_event_metrics(scored(spark, sf), events(spark, sf, "WARNING"), F.col("probability_warning_12h") >= 0.4, 12)
    return out.withColumns({c: r6(c) for c in ("event_fn_rate", "median_lead", "min_lead", "max_lead", *[f"warned_{h}h_early_rate" for h in ev.LEADS])})


# ---- layers, coverage, causes ----------------------------------------------------------------------

@query("status_layer_metrics", "E21", q.with_readings("SELECT layer, fp_count, fp_denominator, " + q.r6("fp_count / nullif(fp_denominator, 0)::DOUBLE")
    + " AS fp_rate, fn_count, fn_denominator, " + q.r6("fn_count / nullif(fn_denominator, 0)::DOUBLE") + " AS fn_rate FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS layer, count(*) FILTER (actual = 'NORMAL' AND {on}) AS fp_count, count(*) FILTER (actual = 'NORMAL') AS fp_denominator, count(*) FILTER (actual <> 'NORMAL' AND {off}) AS fn_count, count(*) FILTER (actual <> 'NORMAL') AS fn_denominator FROM scored"
    for n, on, off in (("status", "status <> 'NORMAL'", "status = 'NORMAL'"), ("raw_status_name", "raw_status > 0", "raw_status = 0"), ("recommendation_actionability", "act", "NOT act"))) + ")", *BASE))
def status_layer_metrics(spark, sf):
    rows = scored(spark, sf).withColumn("raw_status_name", status_name("raw_status"))
    out = ev.status_layer_metrics(rows, ["status", "raw_status_name"], actionable="act")
    return out.withColumns({c: r6(c) for c in ("fp_rate", "fn_rate")})


def audited(spark, sf):
    e = F.col("event_id")
    limits = "{" + ",".join(f'"{t}":0.4' for t in T6) + "}"
    flags = "{" + ",".join(f'"{t}":{"false" if t == "probability_critical_6h" else "true"}' for t in T6) + "}"
    return scored(spark, sf).withColumns({
        "selected_probability_thresholds": F.when(e % 19 == 0, "not json").otherwise(limits),
        "probability_target_eligibility": F.lit(flags), "recommendation_trigger_targets": F.col("probability_threshold_crossings"),
        "forecast_withheld": F.when(e % 9 == 0, "true").when(e % 9 == 1, "?").otherwise("0"),
        "recommendation_actionable": F.when(F.col("act"), "1").otherwise("false")})


_COV = " UNION ALL ".join(
    f"SELECT '{t}' AS target, count({t}) AS valid_rows, count(*) FILTER ({t} >= 0.4 AND event_id % 19 <> 0) AS above_threshold_rows, "
    f"count(*) FILTER (trusted AND act AND {t} >= 0.4 AND event_id % 19 <> 0 AND {'false' if t == 'probability_critical_6h' else 'true'} AND contains(probability_threshold_crossings, '{t}')) AS triggered_rows, "
    f"count(*) FILTER (trusted AND act) AS any_action_rows, count(*) FILTER (event_id % 9 IN (0, 1)) AS withheld_rows, count(*) FILTER (NOT contains(loaded_model_targets, '{t}')) AS missing_model_rows, "
    f"{'count(*)' if t == 'probability_critical_6h' else '0::BIGINT'} AS ineligible_rows, {q.r6(f'count({t}) / count(*)::DOUBLE')} AS coverage_rate, "
    f"{q.r6('count(*) FILTER (trusted AND act AND ' + t + ' >= 0.4 AND event_id % 19 <> 0 AND ' + ('false' if t == 'probability_critical_6h' else 'true') + ' AND contains(probability_threshold_crossings, ' + chr(39) + t + chr(39) + ')) / count(*)::DOUBLE')} AS trigger_rate FROM scored" for t in T6)


@query("target_coverage", "E22", q.with_readings(_COV, *BASE))
def target_coverage(spark, sf):
    return ev.target_coverage(audited(spark, sf)).withColumns({c: r6(c) for c in ("coverage_rate", "trigger_rate")})


@query("withholding_counts", "E26", q.with_readings("""
SELECT reason, count(*) AS rows FROM (SELECT unnest(CASE WHEN withholding_reasons_json = 'oops' THEN ['malformed_withholding_reasons']
  WHEN withholding_reasons_json = '[]' THEN [] ELSE ['ood_detected', 'model_revoked'] END) AS reason FROM scored) GROUP BY reason""", *BASE))
def withholding_counts(spark, sf):
    return ev.withholding_counts(scored(spark, sf))


@query("coverage_and_operations", "E26", q.with_readings(f"""
SELECT machine_id, count(*) AS rows, {q.r6('count(*) FILTER (coalesce(' + ', '.join(T6) + ') IS NOT NULL) / count(*)::DOUBLE')} AS availability_rate, count(*) FILTER (event_id % 9 IN (0, 1)) AS withheld_rows,
  {q.r6('count(*) FILTER (event_id % 9 IN (0, 1)) / count(*)::DOUBLE')} AS withheld_rate, count(*) FILTER (act) AS actionable_rows, {q.r6('count(*) FILTER (act) / count(*)::DOUBLE')} AS actionable_rate,
  {q.r6('count(*) FILTER (trusted) / count(*)::DOUBLE')} AS trusted_coverage FROM scored GROUP BY machine_id""", *BASE))
def coverage_and_operations(spark, sf):
    rows = audited(spark, sf)
    out = ev.operational_metrics(rows).join(ev.coverage_by_lifecycle(rows, ["machine_id"]).select("machine_id", "trusted_coverage"), "machine_id")
    return out.withColumns({c: r6(c) for c in ("availability_rate", "withheld_rate", "actionable_rate", "trusted_coverage")})


@query("fp_root_cause", "E25", q.with_readings("""
, fpr AS (SELECT * FROM (SELECT *, lag(lifecycle_id) OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS plife FROM scored) WHERE actual = 'NORMAL' AND act)
SELECT 'by_status' AS dimension, status AS item, count(*) AS rows FROM fpr GROUP BY ALL UNION ALL SELECT 'held_rows', 'true', count(*) FROM fpr WHERE held HAVING count(*) > 0
UNION ALL SELECT 'actionable_false_positive_rows', 'all', count(*) FROM fpr HAVING count(*) > 0
UNION ALL SELECT 'lifecycle_first_row', 'true', count(*) FROM fpr WHERE plife IS NULL OR plife <> lifecycle_id HAVING count(*) > 0
UNION ALL SELECT 'stale_rows', 'true', count(*) FROM fpr WHERE probability_threshold_crossings = '[]' HAVING count(*) > 0
UNION ALL SELECT 'by_forecast_target', 'probability_warning_12h', count(*) FROM fpr WHERE probability_threshold_crossings <> '[]' HAVING count(*) > 0
UNION ALL SELECT 'by_reason', r, count(*) FROM (SELECT unnest(CASE WHEN withholding_reasons_json = 'oops' THEN ['malformed_or_missing'] WHEN withholding_reasons_json = '[]' THEN [] ELSE ['ood_detected', 'model_revoked'] END) AS r FROM fpr) GROUP BY r""", *BASE))
def fp_root_cause(spark, sf):
    return ev.fp_root_cause(audited(spark, sf), ["status"], ["held"], {
        "recommendation_trigger_targets": "by_forecast_target", "withholding_reasons_json": "by_reason"})


@query("payload_validation", "E24 L11", q.with_readings("""
SELECT * FROM (VALUES ('selected_probability_thresholds', 2::BIGINT, 1::BIGINT), ('probability_target_eligibility', 1, 0), ('probability_threshold_crossings', 2, 0), ('loaded_model_targets', 2, 0))
  v(payload, distinct_payloads, invalid_payloads)"""))
def payload_validation(spark, sf):
    return ev.validate_payloads(audited(spark, sf))


@query("parsed_payloads", "L11", q.with_readings(
    "SELECT machine_id, us, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 6 END AS loaded, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS crossed FROM scored", *BASE))
def parsed_payloads(spark, sf):
    rows = ev.parse_payloads(scored(spark, sf), {"loaded_model_targets": "array<string>", "probability_threshold_crossings": "array<string>"})
    return rows.select(*ID, F.size("loaded_model_targets__parsed").alias("loaded"), F.size("probability_threshold_crossings__parsed").alias("crossed"))


@query("contains_target", "E33", """
SELECT event_id, event_id % 5 IN (0, 1, 3) AS hit FROM events""")
def contains_target(spark, sf):
    m, t = F.col("event_id") % 5, "probability_warning_12h"
    cell = (F.when(m == 0, f'["a", "{t}"]').when(m == 1, f"a| {t}").when(m == 2, '["a"]').when(m == 3, f"{t},b"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", ev.contains_target(cell, t).alias("hit"))


# ---- first-event evaluation, scenarios -------------------------------------------------------------------

@query("evaluate_prognostics", "E27", q.with_readings(f"""
, fo AS (SELECT machine_id, lifecycle_id, min(us) AS onset FROM scored WHERE raw_status >= 1 GROUP BY ALL),
pr AS (SELECT s.*, onset, (onset - us) / 3.6e9::DOUBLE AS lead, onset IS NULL OR us < onset AS elig, coalesce(us < onset AND (onset - us) / 3.6e9::DOUBLE <= 3, false) AS y, probability_warning_12h AS p,
    coalesce(probability_warning_12h >= 0.25, false) AS al, event_id % 3 = 0 AS op, (onset IS NULL OR us < onset) AND probability_warning_12h IS NOT NULL AS ok FROM scored s LEFT JOIN fo USING (machine_id, lifecycle_id)),
cad AS (SELECT machine_id, lifecycle_id, coalesce(median(floor(g / 1e6) / 3600.0::DOUBLE), 0) AS c FROM (SELECT machine_id, lifecycle_id, us - lag(us) OVER (PARTITION BY machine_id, lifecycle_id ORDER BY us, ingest_seq) AS g FROM scored) GROUP BY ALL),
evt AS (SELECT machine_id, lifecycle_id, max(onset) AS o, min(us) FILTER (al AND us < onset AND us >= onset - 10800000000) AS r, min(us) FILTER (op AND us < onset AND us >= onset - 10800000000) AS q FROM pr GROUP BY ALL HAVING max(onset) IS NOT NULL),
e1 AS (SELECT machine_id, lifecycle_id, island, count(*) AS n FROM {_island_sql('ok AND NOT y AND al', 'pr', 'machine_id, lifecycle_id', '')} WHERE island IS NOT NULL GROUP BY ALL),
e2 AS (SELECT machine_id, lifecycle_id, island, count(*) AS n FROM {_island_sql('ok AND NOT y AND op', 'pr', 'machine_id, lifecycle_id', '')} WHERE island IS NOT NULL GROUP BY ALL)
SELECT count(*) FILTER (ok AND y AND al) AS tp, count(*) FILTER (ok AND NOT y AND al) AS fp, count(*) FILTER (ok AND y AND NOT al) AS fn, count(*) FILTER (ok AND NOT y AND NOT al) AS tn, count(*) FILTER (ok) AS eligible_rows,
  {q.r6('avg((p - CAST(y AS INTEGER)) ** 2) FILTER (ok)')} AS brier_score, (SELECT count(*) FROM evt) AS event_count, (SELECT count(r) FROM evt) AS detected_events, (SELECT count(q) FROM evt) AS operational_detected,
  {q.r6('(SELECT median((o - r) / 3.6e9::DOUBLE) FROM evt)')} AS median_lead, {q.r6('(SELECT median((o - q) / 3.6e9::DOUBLE) FROM evt)')} AS operational_median_lead,
  (SELECT count(*) FROM e1) AS raw_alert_episodes, {q.r6('(SELECT sum(n * c) FROM e1 JOIN cad USING (machine_id, lifecycle_id))')} AS raw_alert_hours,
  (SELECT count(*) FROM e2) AS operational_alert_episodes, {q.r6('(SELECT sum(n * c) FROM e2 JOIN cad USING (machine_id, lifecycle_id))')} AS operational_alert_hours,
  {q.r6('(SELECT sum(c) FROM pr JOIN cad USING (machine_id, lifecycle_id) WHERE ok AND NOT y)')} AS negative_hours,
  count(*) FILTER (elig AND eta_warning IS NOT NULL AND lead > 0 AND lead <= 3) AS eta_rows, {q.r6('avg(abs(eta_warning - lead)) FILTER (elig AND lead > 0 AND lead <= 3)')} AS eta_mae FROM pr""", *BASE))
def evaluate_prognostics(spark, sf):
    rows = ev.prognostic_rows(scored(spark, sf).withColumn("event_status", F.col("raw_status")), level=1, hours=3,
                              probability="probability_warning_12h", threshold=0.25, operational=F.col("event_id") % 3 == 0)
    rows = add_slice(table(spark, f"prognostic_rows:{sf}", lambda: rows.drop("slice")))
    out = ev.evaluate_prognostics(rows, hours=3, probability="probability_warning_12h", eta="eta_warning")
    keep = ["tp", "fp", "fn", "tn", "eligible_rows", "event_count", "detected_events", "operational_detected", "raw_alert_episodes", "operational_alert_episodes", "eta_rows"]
    return out.select(*keep, *[r6(c).alias(c) for c in ("brier_score", "median_lead", "operational_median_lead", "raw_alert_hours",
                                                        "operational_alert_hours", "negative_hours", "eta_mae")])


_MANIFEST = """mani AS (SELECT machine_id, lifecycle_id AS scenario, min(us) + 3600000000 AS start_us, max(us) + 7200000000 AS end_us FROM planned GROUP BY ALL)"""


def manifest(spark, sf):
    return planned(spark, sf).groupBy("machine_id", F.col("lifecycle_id").alias("scenario")).agg(
        (F.min("us") + 3_600_000_000).alias("start_us"), (F.max("us") + 7_200_000_000).alias("end_us"))


@query("rows_by_scenario", "L9 S5", q.with_readings(
    "SELECT s.machine_id, s.us, m.scenario FROM scored s JOIN mani m ON m.machine_id = s.machine_id AND s.us BETWEEN m.start_us AND m.end_us", *BASE, _MANIFEST))
def rows_by_scenario(spark, sf):
    return ev.rows_by_scenario(scored(spark, sf), manifest(spark, sf)).select("machine_id", "us", "scenario")


@query("fp_rate", "E28", q.with_readings(f"""
SELECT machine_id, scenario, count(*) AS rows, count(*) FILTER (m) AS fp_rows, {q.r6('count(*) FILTER (m) / count(*)::DOUBLE')} AS fp_rate, count(*) FILTER (status = 'WARNING') AS warning_rows,
  count(*) FILTER (status = 'CRITICAL') AS critical_rows, count(DISTINCT island) AS episodes, coalesce(max(n), 0) AS longest_rows
FROM (SELECT *, CASE WHEN island IS NOT NULL THEN count(*) OVER (PARTITION BY machine_id, scenario, island) END AS n FROM {_island_sql("status <> 'NORMAL'", 'sm', 'machine_id, scenario', '')}) GROUP BY machine_id, scenario""",
    *BASE, _MANIFEST, "sm AS (SELECT s.*, m.scenario FROM scored s JOIN mani m ON m.machine_id = s.machine_id AND s.us BETWEEN m.start_us AND m.end_us)"))
def fp_rate(spark, sf):
    rows = ev.rows_by_scenario(scored(spark, sf), manifest(spark, sf))
    return ev.fp_rate(rows, "status", ["machine_id", "scenario"]).withColumn("fp_rate", r6("fp_rate"))


@query("disabled_fraction", "E32", q.with_readings(f"""
SELECT machine_id, lifecycle_id, count(*) AS rows, count(*) FILTER (held) AS disabled_rows, {q.r6('count(*) FILTER (held) / count(*)::DOUBLE')} AS disabled_fraction FROM scored GROUP BY ALL""", *BASE))
def disabled_fraction(spark, sf):
    return ev.disabled_fraction(scored(spark, sf).withColumn("use", ~F.col("held")), "use").withColumn("disabled_fraction", r6("disabled_fraction"))


# ---- guardrails -----------------------------------------------------------------------------------------------

GUARD = f"""gr AS (SELECT *, event_id % 31 = 0 AS ood, event_id % 37 = 0 AS bw, event_id % 41 = 0 AS bc, (next_w - us) / 3.6e9::DOUBLE AS aw, (next_c - us) / 3.6e9::DOUBLE AS ac,
  CASE WHEN event_id % 7 <> 0 THEN 14 - 3 * vibration_mps2 END AS mw, CASE WHEN event_id % 11 <> 0 THEN 20 - temperature_c / 5 END AS mc,
  CASE WHEN event_id % 3 <> 0 THEN 12 - 2.5 * vibration_mps2 END AS sw, CASE WHEN event_id % 5 <> 0 THEN 15 - temperature_c / 6 END AS scr, CAST(right(lifecycle_id, 4) AS INTEGER) AS ln FROM nx)"""


def guard_rows(spark, sf):
    e, v, t = F.col("event_id"), F.col("vibration_mps2"), F.col("temperature_c")
    return labelled(spark, sf).withColumns({
        "ood": e % 31 == 0, "beyond_warning": e % 37 == 0, "beyond_critical": e % 41 == 0,
        "actual_warning": (F.col("next_warning_us") - F.col("us")) / 3.6e9, "actual_critical": (F.col("next_critical_us") - F.col("us")) / 3.6e9,
        "ml_warning": F.when(e % 7 != 0, 14 - 3 * v), "ml_critical": F.when(e % 11 != 0, 20 - t / 5),
        "stat_warning": F.when(e % 3 != 0, 12 - 2.5 * v), "stat_critical": F.when(e % 5 != 0, 15 - t / 6),
        "ln": F.substring("lifecycle_id", -4, 4).cast("int")})


def _guard_sql(t, limit, rel):
    m, s, b = {"warning": ("mw", "sw", "bw"), "critical": ("mc", "scr", "bc")}[t]
    open_ = f"(NOT {b} AND NOT ood AND {m} IS NOT NULL)"
    strong = f"coalesce({open_} AND abs({m} - {s}) > {limit} AND abs({m} - {s}) / greatest(abs({m}), abs({s}), 1e-6::DOUBLE) > {rel}, false)"
    return open_, strong, m


def _gm(t):
    open_, strong, m = _guard_sql(t, "1.5::DOUBLE" if t == "warning" else "3.0::DOUBLE", "0.2::DOUBLE")
    a, b = {"warning": ("aw", "bw"), "critical": ("ac", "bc")}[t]
    return f"SELECT '{t}' AS target, {a} AS a, CASE WHEN {open_} AND NOT {strong} THEN {m} END AS p, {strong} AS s, {b} AS b, ood FROM gr WHERE {a} IS NOT NULL"


_GPCT = {"coverage_pct": "100.0::DOUBLE * count(p) / count(*)", "mae": "avg(abs(p - a))", "bias": "avg(p - a)", "p90": "quantile_cont(abs(p - a), 0.9)",
         "low_confidence_pct": "100.0::DOUBLE * count(*) FILTER (s) / count(*)", "withheld_pct": "100.0::DOUBLE * (count(*) - count(p)) / count(*)",
         "unsafe_late_pct": "100.0::DOUBLE * count(*) FILTER (p - a > 0) / count(p)",
         **{f"late_{m}_pct": f"100.0::DOUBLE * count(*) FILTER (p - a > {m / 60.0!r}) / count(p)" for m in ev.LATE_MIN},
         "ood_pct": "100.0::DOUBLE * count(*) FILTER (ood) / count(*)", "beyond_support_pct": "100.0::DOUBLE * count(*) FILTER (b) / count(*)"}


@query("guardrail_metrics", "E29", q.with_readings(
    "SELECT target, count(*) AS sample_count, " + ", ".join(f"{q.r6(e)} AS {n}" for n, e in _GPCT.items())
    + f" FROM ({_gm('warning')} UNION ALL {_gm('critical')}) GROUP BY target", *FULL, GUARD))
def guardrail_metrics(spark, sf):
    out = ev.guardrail_metrics(guard_rows(spark, sf), {"warning": 1.5, "critical": 3.0, "relative": 0.2})
    return out.withColumns({c: r6(c) for c in _GPCT})


_OW, _SW, _ = _guard_sql("warning", "gw", "grl")
_OC, _SC, _ = _guard_sql("critical", "gc", "grl")


@query("selected_guardrail", "E30", q.with_readings(f"""
, tq AS (SELECT list_distinct([round_even(quantile_cont(abs(mw - sw), x), 6) FOR x IN [0.5, 0.75, 0.9]]) AS w FROM gr LIMIT 0),
cq AS (SELECT quantile_cont(abs(mw - sw), [0.5, 0.75, 0.9]) AS w, quantile_cont(abs(mc - scr), [0.5, 0.75, 0.9]) AS c FROM gr WHERE ln % 2 = 1 AND NOT ood),
rq AS (SELECT quantile_cont(r, [0.5, 0.75, 0.9]) AS r FROM (SELECT abs(mw - sw) / greatest(abs(mw), abs(sw), 1e-6::DOUBLE) AS r FROM gr WHERE ln % 2 = 1 AND NOT ood UNION ALL
  SELECT abs(mc - scr) / greatest(abs(mc), abs(scr), 1e-6::DOUBLE) FROM gr WHERE ln % 2 = 1 AND NOT ood)),
gd AS (SELECT DISTINCT round_even(a, 6) AS gw, round_even(b, 6) AS gc, round_even(z, 6) AS grl FROM (SELECT unnest(w) AS a FROM cq), (SELECT unnest(c) AS b FROM cq), (SELECT unnest(r) AS z FROM rq)),
gv AS (SELECT gw, gc, grl, count(*) AS n, count(*) FILTER ({_SW} OR {_SC}) AS low, count(*) FILTER (NOT {_OW} OR {_SW} OR NOT {_OC} OR {_SC}) AS held,
  count(*) FILTER (aw IS NOT NULL) AS nw, count(*) FILTER (aw IS NOT NULL AND {_OW} AND NOT {_SW}) AS cw, count(*) FILTER (aw IS NOT NULL AND {_OW} AND NOT {_SW} AND mw > aw) AS lw,
  count(*) FILTER (ac IS NOT NULL) AS nc, count(*) FILTER (ac IS NOT NULL AND {_OC} AND NOT {_SC}) AS cc, count(*) FILTER (ac IS NOT NULL AND {_OC} AND NOT {_SC} AND mc > ac) AS lc
  FROM gr, gd WHERE ln % 2 = 0 GROUP BY ALL),
gs AS (SELECT *, CASE WHEN coalesce(lw / nullif(cw, 0)::DOUBLE, 0) * nw + coalesce(lc / nullif(cc, 0)::DOUBLE, 0) * nc <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM gv)
SELECT {q.r6('gw')} AS warning, {q.r6('gc')} AS critical, {q.r6('grl')} AS relative, {q.r6('recall')} AS recall, low AS low_rows, held AS withheld_rows, n AS rows
FROM gs WHERE recall >= (SELECT max(recall) * 0.9 FROM gs) ORDER BY low, held, -recall, gw, gc, grl LIMIT 1""".replace(
    "tq AS (SELECT list_distinct([round_even(quantile_cont(abs(mw - sw), x), 6) FOR x IN [0.5, 0.75, 0.9]]) AS w FROM gr LIMIT 0),\n", ""), *FULL, GUARD))
def selected_guardrail(spark, sf):
    rows = guard_rows(spark, sf)
    out = ev.select_guardrail(rows.filter("ln % 2 = 1"), rows.filter("ln % 2 = 0"))
    return out.withColumns({c: r6(c) for c in ("warning", "critical", "relative", "recall")})


@query("metric_export", "S13", q.with_readings(f"""
SELECT 'binary' AS scope, machine_id, unnest(['tp', 'fp']) AS metric, unnest([tp, fp])::DOUBLE AS value FROM (SELECT machine_id, {_bin_sql('y', 'p')} FROM (SELECT *, {_Y12} AS y, {_P12} AS p FROM nx) GROUP BY machine_id)""", *FULL))
def metric_export(spark, sf):
    report = ev.binary_metrics(twelve(spark, sf), "y", "p", ["machine_id"]).select("machine_id", "tp", "fp")
    return ev.metrics_long(report, ["machine_id"], "binary")


