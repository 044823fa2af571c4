"""Trends, crossing probabilities, decisions and the full replay."""

from __future__ import annotations

import dataclasses
import math
import re

from pyspark.sql import functions as F

from fleetpulse.functions.normal import erfc_sql, normal_sf, normal_sf_udf
from fleetpulse.functions.rules import r6
from fleetpulse.operators import forecast as fc, monitor as mon, rules as ops
from fleetpulse.params import DEFAULT, HORIZONS_H, SENSOR_KEYS, SENSORS, TREND_WINDOWS_MIN
from fleetpulse.plans.shared import table
from fleetpulse.plans.slices import add_slice
from fleetpulse.queries import query, sqlparts as q
from fleetpulse.queries.anomalies import faulty
from fleetpulse.queries.stateful import BASELINE_FOLD, SMOOTH, baseline, plan, smooth
from fleetpulse.queries.windows import _NEIGHBOURS, _WINDOWS, PLANNED, planned, stat_sql, wide
from fleetpulse.sources.binding import readings

ID = ["machine_id", "us"]
KEY = "machine_id, us"
K = SENSOR_KEYS
T = fc.TARGETS
LIM = {(s.key, t): fc.limit_of(s, t) for s in SENSORS for t in T}

# ---- regression trend ---------------------------------------------------------

TREND_ROWS = 240
TREND_PARAMS = dataclasses.replace(DEFAULT, monitoring=dataclasses.replace(
    DEFAULT.monitoring, minimum_forecast_points=TREND_ROWS, horizon_h=24.0, step_min=30.0))

TREND_SQL = f"""
tr0 AS (SELECT *, (us - 1767225600000000) / 3.6e9::DOUBLE AS x,
  CASE WHEN us > lag(us) OVER o THEN (us - lag(us) OVER o) / 1e6::DOUBLE END AS step FROM planned
  WINDOW o AS (PARTITION BY machine_id, lifecycle_id ORDER BY us, ingest_seq)),
tr AS (SELECT *, count(*) OVER w AS n, """ + ", ".join(
    f"CASE WHEN count(*) OVER w >= 3 THEN regr_slope({k}, x) OVER w END AS sl_{k}, "
    f"CASE WHEN count(*) OVER w >= 3 THEN regr_syy({k}, x) OVER w END AS yy_{k}, "
    f"CASE WHEN count(*) OVER w >= 3 THEN regr_sxy({k}, x) OVER w END AS xy_{k}, "
    f"avg({k}) OVER w + CASE WHEN count(*) OVER w >= 3 THEN regr_slope({k}, x) OVER w END * (x - avg(x) OVER w) AS fit_{k}" for k in K) + f""",
  median(step) OVER (PARTITION BY machine_id, lifecycle_id ORDER BY us, ingest_seq ROWS BETWEEN {TREND_ROWS - 2} PRECEDING AND CURRENT ROW) AS sample_s
  FROM tr0 WINDOW w AS (PARTITION BY machine_id, lifecycle_id ORDER BY us, ingest_seq ROWS BETWEEN {TREND_ROWS - 1} PRECEDING AND CURRENT ROW)),
trend AS (SELECT *, """ + ", ".join(
    f"CASE WHEN n > 2 THEN sqrt(greatest(yy_{k} - sl_{k} * xy_{k}, 0) / (n - 2)) END AS sg_{k}, CASE WHEN yy_{k} > 1e-12 THEN 1 - greatest(yy_{k} - sl_{k} * xy_{k}, 0) / yy_{k} "
    f"WHEN yy_{k} IS NOT NULL THEN 0 END AS r2_{k}" for k in K) + " FROM tr)"


def trends(spark, sf):
    return table(spark, f"trends:{sf}", lambda: fc.trend_forecast(
        add_slice(planned(spark, sf)), TREND_PARAMS))


@query("regression_trend", "F1", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(
        f"{q.r6(f'sl_{k}', 4)} AS {k}__slope, {q.r6(f'r2_{k}', 5)} AS {k}__r2, {q.r6(f'sg_{k}', 5)} AS {k}__sigma, "
        f"{q.r6(f'fit_{k}', 4)} AS {k}__now" for k in K)
    + f", {q.r6('sample_s', 3)} AS sample_s FROM trend", q.RAW, PLANNED, TREND_SQL))
def regression_trend(spark, sf):
    rows = trends(spark, sf)
    return rows.select(*ID, *[c for k in K for c in (
        r6(f"{k}__slope_per_hour", 4).alias(f"{k}__slope"), r6(f"{k}__r_squared", 5).alias(f"{k}__r2"),
        r6(f"{k}__residual_sigma", 5).alias(f"{k}__sigma"), r6(f"{k}__fitted_now", 4).alias(f"{k}__now"))],
        r6(f"{K[0]}__sample_s", 3).alias("sample_s"))


_GRID = TREND_PARAMS.monitoring.step_min * 60.0
_STEPS = int(TREND_PARAMS.monitoring.horizon_h * 3600 / _GRID)


def _passage_sql(k, t):
    z = f"(({LIM[k, t]}::DOUBLE - (fit_{k} + sl_{k} * g * {_GRID / 3600!r}::DOUBLE)) / sg_{k})"
    p = f"0.5::DOUBLE * (1 - tanh({math.sqrt(2 / math.pi)!r}::DOUBLE * ({z} + 0.044715::DOUBLE * {z} ** 3)))"
    return f"""ps_{k}_{t} AS (SELECT machine_id, us, min(g) FILTER (h >= {fc.HAZARDS['eta']!r}) * {_GRID}::DOUBLE AS eta_{k}_{t},
      min(g) FILTER (h >= {fc.HAZARDS['earliest']!r}) * {_GRID}::DOUBLE AS ear_{k}_{t}, min(g) FILTER (h >= {fc.HAZARDS['latest']!r}) * {_GRID}::DOUBLE AS lat_{k}_{t}
    FROM (SELECT machine_id, us, g, sum(least(greatest({p}, 0), 1) * greatest({_GRID} / sample_s, 1)) OVER (
        PARTITION BY machine_id, us ORDER BY g ROWS UNBOUNDED PRECEDING) AS h
      FROM trend, range(1, {_STEPS + 1}) r(g) WHERE sl_{k} > 0 AND sample_s IS NOT NULL) GROUP BY machine_id, us)"""


@query("first_passage_quantiles", "F2", q.with_readings(
    f"SELECT machine_id, us, " + ", ".join(
        f"{n}_{K[0]}_{t} AS {t}_{full}_s" for t in T for n, full in (("eta", "eta"), ("ear", "earliest"), ("lat", "latest")))
    + f" FROM trend LEFT JOIN ps_{K[0]}_warning USING (machine_id, us) LEFT JOIN ps_{K[0]}_critical USING (machine_id, us)",
    q.RAW, PLANNED, TREND_SQL, _passage_sql(K[0], "warning"), _passage_sql(K[0], "critical")))
def first_passage_quantiles(spark, sf):
    return trends(spark, sf).select(*ID, *[F.col(f"{K[0]}__{t}_{n}_s").alias(f"{t}_{n}_s")
                                          for t in T for n in ("eta", "earliest", "latest")])


_V = SENSORS[0]
_CODE = q.status(_V.key, _V)
_ETA = f"CASE WHEN {_CODE} = 0 THEN eta_{K[0]}_warning ELSE eta_{K[0]}_critical END"
_RATIO = f"(lat_{K[0]}_critical - ear_{K[0]}_critical) / eta_{K[0]}_critical"


@query("threshold_forecast", "F3", q.with_readings(
    f"""SELECT machine_id, us, CASE WHEN {_CODE} = 0 THEN 'WARNING' ELSE 'CRITICAL' END AS target, confidence,
      CASE WHEN {_CODE} = 2 THEN 0 WHEN confidence IN ('high','medium','low') THEN {_ETA} END::DOUBLE AS eta_s FROM (
      SELECT *, CASE WHEN {_CODE} = 2 THEN 'reached' WHEN n < {TREND_ROWS} THEN 'insufficient_data'
        WHEN sl_{K[0]} IS NULL OR sample_s IS NULL THEN 'insufficient_data' WHEN sl_{K[0]} <= 0 THEN 'no_rising_trend'
        WHEN ({_ETA}) IS NULL AND eta_{K[0]}_critical IS NULL THEN 'beyond_horizon'
        WHEN r2_{K[0]} >= 0.7 AND coalesce({_RATIO} <= 1, true) THEN 'high' WHEN r2_{K[0]} >= 0.3 THEN 'medium' ELSE 'low' END AS confidence
      FROM trend LEFT JOIN ps_{K[0]}_warning USING (machine_id, us) LEFT JOIN ps_{K[0]}_critical USING (machine_id, us))""",
    q.RAW, PLANNED, TREND_SQL, _passage_sql(K[0], "warning"), _passage_sql(K[0], "critical")))
def threshold_forecast(spark, sf):
    rows = fc.threshold_forecast(trends(spark, sf), _V, TREND_PARAMS)
    return rows.select(*ID, F.col(f"{_V.key}__forecast_target").alias("target"),
                       F.col(f"{_V.key}__forecast_confidence").alias("confidence"),
                       F.col(f"{_V.key}__eta_s").alias("eta_s"))


# ---- level/rate forecasts --------------------------------------------------------

LEVELS = f"""
lv AS (SELECT machine_id, lifecycle_id, n.p, any_value(n.us) AS us, """ + ", ".join(
    f"max(t.ol) FILTER (n.sensor = '{k}') AS l_{k}, max(t.orr * 3600) FILTER (n.sensor = '{k}') AS r_{k}, "
    f"max(t.os) FILTER (n.sensor = '{k}') AS s_{k}, max(n.v) FILTER (n.sensor = '{k}') AS v_{k}" for k in K) + """,
    any_value(n.keep) AS keep FROM sm0 n JOIN sm1 t USING (machine_id, lifecycle_id, sensor, p) GROUP BY machine_id, lifecycle_id, n.p),
lev AS (SELECT *, """ + ", ".join(f"{q.status('v_' + s.key, s)} AS c_{s.key}" for s in SENSORS) + """,
  least(sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id, lifecycle_id ORDER BY p ROWS UNBOUNDED PRECEDING), 1440) AS pts FROM lv)"""


def levels(spark, sf):
    rows = ops.worst_sensor(ops.sensor_status(smooth(spark, sf)))
    return fc.history_points(add_slice(rows.drop("slice")))


def _kalman_sql(t):
    any_hit = "greatest(" + ", ".join(f"c_{k}" for k in K) + f") >= {fc.LEVEL[t]}"
    opts = ", ".join(
        f"CASE WHEN h_{i} IS NOT NULL THEN {{'h': h_{i}, 'o': {i}, 'n': '{s.key}', 'z': r_{s.key} / {fc.limit_of(s, t) - s.baseline}}} END"
        for i, s in enumerate(SENSORS))
    hits = ", ".join(
        f"CASE WHEN c_{s.key} >= {fc.LEVEL[t]} THEN {{'a': c_{s.key}, 'b': l_{s.key} / {q.d(fc.limit_of(s, t))}, 'c': {-i}, 'n': '{s.key}'}} END"
        for i, s in enumerate(SENSORS))
    hours = ", ".join(
        f"CASE WHEN {fc.limit_of(s, t)} - l_{s.key} <= 0 THEN 0 WHEN r_{s.key} > 1e-9 AND ({fc.limit_of(s, t)} - l_{s.key}) / r_{s.key} <= 240 "
        f"THEN ({fc.limit_of(s, t)} - l_{s.key}) / r_{s.key} END AS h_{i}" for i, s in enumerate(SENSORS))
    rising = "greatest(" + ", ".join(f"r_{k}" for k in K) + ") > 1e-9"
    return f"""ke_{t} AS (SELECT machine_id, us, CASE WHEN hit THEN 0 WHEN pts >= 30 THEN best.h END AS hours,
      CASE WHEN hit THEN reach.n WHEN pts >= 30 THEN best.n END AS sensor,
      CASE WHEN hit THEN 'reached' WHEN pts < 30 THEN 'insufficient_history' WHEN best IS NULL AND NOT rising THEN 'no_rising_trend'
        WHEN best IS NULL THEN 'beyond_horizon' WHEN pts >= 1440 AND best.z > 0.02 THEN 'high' WHEN pts >= 60 AND best.z > 0.005 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT *, list_min(list_filter([{opts}], lambda x: x IS NOT NULL)) AS best, list_max(list_filter([{hits}], lambda x: x IS NOT NULL)) AS reach,
      {any_hit} AS hit, {rising} AS rising FROM (SELECT *, {hours} FROM lev)))"""


@query("kalman_eta", "F4", q.with_readings(
    "SELECT w.machine_id, w.us, " + ", ".join(
        f"{q.r6(f'{t[0]}.hours', 4)} AS {t}_hours, {t[0]}.sensor AS {t}_sensor, {t[0]}.confidence AS {t}_confidence" for t in T)
    + " FROM ke_warning w JOIN ke_critical c USING (machine_id, us)",
    q.RAW, PLANNED, SMOOTH, LEVELS, _kalman_sql("warning"), _kalman_sql("critical")))
def kalman_eta(spark, sf):
    rows = fc.kalman_eta(fc.kalman_eta(levels(spark, sf), "warning"), "critical")
    return rows.select(*ID, *[c for t in T for c in (
        r6(f"statistical_{t}_hours", 4).alias(f"{t}_hours"), F.col(f"statistical_{t}_sensor").alias(f"{t}_sensor"),
        F.col(f"statistical_{t}_confidence").alias(f"{t}_confidence"))])


def _sensor_eta(s, limit):
    e = f"greatest(0, ({limit} - l_{s.key}) / r_{s.key} * 3600)"
    return (f"CASE WHEN c_{s.key} = 2 THEN 0 WHEN pts >= 30 AND r_{s.key} > 1e-9 AND {e} / 3600 <= 240 THEN {e} END")


@query("sensor_kalman_forecast", "F5", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(
        f"{q.r6(_sensor_eta(s, f'CASE WHEN c_{s.key} = 0 THEN {s.warning} ELSE {s.critical} END'), 1)} AS {s.key}__eta_s, "
        f"{q.r6(_sensor_eta(s, s.critical), 1)} AS {s.key}__critical_eta_s, CASE WHEN c_{s.key} = 2 THEN 'reached' WHEN pts < 30 THEN 'insufficient_data' "
        f"WHEN r_{s.key} <= 1e-9 THEN 'no_rising_trend' WHEN pts >= 1440 THEN 'high' ELSE 'medium' END AS {s.key}__confidence" for s in SENSORS)
    + " FROM lev", q.RAW, PLANNED, SMOOTH, LEVELS))
def sensor_kalman_forecast(spark, sf):
    rows = fc.sensor_kalman_forecast(levels(spark, sf))
    return rows.select(*ID, *[c for k in K for c in (
        r6(f"{k}__trend_eta_s", 1).alias(f"{k}__eta_s"), r6(f"{k}__trend_critical_eta_s", 1).alias(f"{k}__critical_eta_s"),
        F.col(f"{k}__trend_confidence").alias(f"{k}__confidence"))])


_SEVS = {s.key: f"greatest((l_{s.key} - {q.d(s.baseline)}) / {q.d(s.span)}, 0)" for s in SENSORS}


@query("state_features", "W12", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(
        f"{q.r6(f'f_{s.key} - s_{s.key}', 5)} AS {s.key}__fast_slow_difference, {q.r6(f'{s.warning} - l_{s.key}', 5)} AS {s.key}__distance_warning, "
        f"{q.r6(f'{s.critical} - l_{s.key}', 5)} AS {s.key}__distance_critical, {q.r6(_SEVS[s.key], 5)} AS {s.key}__normalized_severity" for s in SENSORS)
    + f", {q.r6('greatest(' + ', '.join(_SEVS.values()) + ')', 5)} AS maximum_normalized_severity, "
    + q.r6(" + ".join(f"{q.d(s.weight)} * {_SEVS[s.key]}" for s in SENSORS), 5) + " AS weighted_normalized_severity FROM lev JOIN (SELECT machine_id, us, "
    + ", ".join(f"max(t.of_) FILTER (n.sensor = '{k}') AS f_{k}" for k in K)
    + " FROM sm0 n JOIN sm1 t USING (machine_id, lifecycle_id, sensor, p) GROUP BY machine_id, us) USING (machine_id, us)", q.RAW, PLANNED, SMOOTH, LEVELS))
def state_features(spark, sf):
    from fleetpulse.operators import features
    names = [f"{k}__{n}" for k in K for n in ("fast_slow_difference", "distance_warning", "distance_critical", "normalized_severity")]
    rows = features.state_features(smooth(spark, sf))
    return rows.select(*ID, *[r6(c, 5).alias(c) for c in (*names, "maximum_normalized_severity", "weighted_normalized_severity")])


_CRIT_OPTS = "list_min(list_filter([" + ", ".join(
    f"CASE WHEN ({_sensor_eta(s, s.critical)}) IS NOT NULL THEN {{'s': ({_sensor_eta(s, s.critical)})::DOUBLE, 'o': {i}, 'n': '{s.key}'}} END"
    for i, s in enumerate(SENSORS)) + "], lambda x: x IS NOT NULL))"


@query("best_forecast", "F6", q.with_readings(
    f"SELECT {KEY}, b.n AS best_critical_sensor, {q.r6('b.s', 1)} AS best_critical_eta_s FROM (SELECT *, {_CRIT_OPTS} AS b FROM lev)",
    q.RAW, PLANNED, SMOOTH, LEVELS))
def best_forecast(spark, sf):
    rows = fc.best_forecast(fc.sensor_kalman_forecast(levels(spark, sf)), critical=True)
    return rows.select(*ID, "best_critical_sensor", r6("best_critical_eta_s", 1).alias("best_critical_eta_s"))


# ---- several-window prognosis ------------------------------------------------------

def _trend_list(k):
    items = []
    for w in TREND_WINDOWS_MIN:
        usable = " AND ".join([
            f"{stat_sql('sample_count', k, w)} >= 30", f"{stat_sql('coverage_fraction', k, w)} >= 0.8::DOUBLE",
            f"{stat_sql('gap_or_discontinuity', k, w)} < 0.5",
            f"{stat_sql('available_history_duration_seconds', k, w)} >= {q.d(max(60.0, w * 60.0 - 60.0) * 0.9)}"])
        items.append(f"CASE WHEN {usable} THEN {{'s': ({stat_sql('slope_per_hour', k, w)})::DOUBLE, 'w': {math.sqrt(w / 60.0)!r}::DOUBLE}} END")
    return "list_sort(list_filter([" + ", ".join(items) + "], lambda it: it IS NOT NULL))"


def _z_prob(k, t, h):
    lim = q.d(LIM[k, t])
    return (f"CASE WHEN s_{k} >= {lim} THEN 1.0::DOUBLE WHEN es_{k} <= 1e-12 THEN CASE WHEN ef_{k} >= ({lim} - s_{k}) / {h} THEN 1.0::DOUBLE ELSE 0 END "
            f"ELSE {q.d(0.5)} * e_{k}_{t}_{h} END")


def _cross(k, t, rate):
    lim = q.d(LIM[k, t])
    return f"CASE WHEN s_{k} >= {lim} THEN 0 WHEN {rate} > 1e-12 AND ({lim} - s_{k}) / ({rate}) <= 24 THEN ({lim} - s_{k}) / ({rate}) END"


Z90 = q.d(DEFAULT.prognostics.interval_z)
_CELLS = [(k, t, h) for k in K for t in T for h in HORIZONS_H]


def _array_median(expr):
    return f"list_median({expr})"


def _first_hit(t):
    return "list_min(list_filter([" + ", ".join(
        f"CASE WHEN eta_{k}_{t} IS NOT NULL THEN {{'h': eta_{k}_{t}::DOUBLE, 'n': '{k}', 'a': ear_{k}_{t}::DOUBLE, 'z': lat_{k}_{t}::DOUBLE}} END" for k in K) + "], lambda it: it IS NOT NULL))"


def _over(t):
    return "list_max(list_filter([" + ", ".join(
        f"CASE WHEN {k_code(s)} >= {fc.LEVEL[t]} THEN {{'a': {s.key} / {q.d(fc.limit_of(s, t))}, 'o': {-i}, 'n': '{s.key}'}} END"
        for i, s in enumerate(SENSORS)) + "], lambda it: it IS NOT NULL)).n"


def k_code(s):
    return q.status(s.key, s)


PROGNOSIS = f"""
pg0 AS (SELECT *, {", ".join(f"{_trend_list(k)} AS tl_{k}" for k in K)},
  {stat_sql('available_history_duration_seconds', K[0], 1440)} AS hist_s FROM nb {_WINDOWS}),
pg1 AS (SELECT *, {", ".join(f"coalesce(tl_{k}[list_filter(range(1, len(tl_{k}) + 1), lambda i: list_sum(list_transform(tl_{k}[1:i], lambda it: it.w)) >= list_sum(list_transform(tl_{k}, lambda it: it.w)) / 2)[1]].s, 0) AS rs_{k}" for k in K)} FROM pg0),
pg2 AS (SELECT *, {", ".join(f"len(tl_{k}) AS wc_{k}, greatest({q.d(s.span * 0.001)}, CASE WHEN len(tl_{k}) <= 1 THEN abs(rs_{k}) * 0.5::DOUBLE ELSE 1.4826::DOUBLE * list_median(list_transform(tl_{k}, lambda it: abs(it.s - rs_{k}))) END) AS sg_{k}, coalesce(list_sum(list_transform(tl_{k}, lambda it: CASE WHEN it.s * CASE WHEN rs_{k} >= 0 THEN 1 ELSE -1 END >= 0 THEN it.w ELSE 0 END)) / list_sum(list_transform(tl_{k}, lambda it: it.w)), 0) AS co_{k}" for k, s in zip(K, SENSORS))} FROM pg1),
pg3 AS (SELECT *, {", ".join(f"abs(rs_{k}) / greatest(sg_{k}, 1e-12::DOUBLE) AS snr_{k}, rs_{k} * co_{k} * least(1.0::DOUBLE, abs(rs_{k}) / greatest(sg_{k}, 1e-12::DOUBLE) / 2) AS ef_{k}" for k in K)} FROM pg2),
pg4 AS (SELECT *, {", ".join(f"greatest(sg_{k}, abs(rs_{k} - ef_{k}) * 0.5::DOUBLE) AS es_{k}" for k in K)} FROM pg3),
smw AS (SELECT machine_id, us, {", ".join(f"max(t.os) FILTER (n.sensor = '{k}') AS s_{k}" for k in K)} FROM sm0 n JOIN sm1 t USING (machine_id, lifecycle_id, sensor, p) GROUP BY machine_id, us),
blw AS (SELECT r.machine_id, r.us, {", ".join(f"t.m{i} AS bm_{k}, sqrt(t.w{i}) AS bs_{k}, t.n{i} AS bn_{k}" for i, k in enumerate(K))} FROM bl0 r JOIN bl1 t USING (machine_id, p)),
pg5 AS (SELECT *, {", ".join(f"(s_{k} - bm_{k}) / greatest(greatest(bs_{k}, {q.d(s.span * 0.02)}), 1e-9::DOUBLE) AS hz_{k}" for k, s in zip(K, SENSORS))} FROM pg4 JOIN smw USING (machine_id, us) JOIN blw USING (machine_id, us)),
pg6 AS (SELECT *, {", ".join(f"{erfc_sql('x')} AS e_{k}_{t}_{h}".replace('x * x', f'zz_{k}_{t}_{h} * zz_{k}_{t}_{h}').replace('abs(x)', f'abs(zz_{k}_{t}_{h})').replace('- x *', f'- zz_{k}_{t}_{h} *').replace('WHEN x >', f'WHEN zz_{k}_{t}_{h} >') for k, t, h in _CELLS)}
  FROM (SELECT *, {", ".join(f"CASE WHEN es_{k} > 1e-12 THEN (({q.d(LIM[k, t])} - s_{k}) / {h} - ef_{k}) / es_{k} / {math.sqrt(2.0)!r}::DOUBLE END AS zz_{k}_{t}_{h}" for k, t, h in _CELLS)} FROM pg5)),
pg7 AS (SELECT * EXCLUDE ({", ".join(f"e_{k}_{t}_{h}" for k, t, h in _CELLS)}), {", ".join(f"least(greatest({_z_prob(k, t, h)}, 0), 1) AS q_{k}_{t}_{h}" for k, t, h in _CELLS)},
  {", ".join(f"{_cross(k, t, f'ef_{k}')} AS eta_{k}_{t}, {_cross(k, t, f'(ef_{k} + {Z90} * es_{k})')} AS ear_{k}_{t}, {_cross(k, t, f'(ef_{k} - {Z90} * es_{k})')} AS lat_{k}_{t}" for k in K for t in T)} FROM pg6),
pg8 AS (SELECT *, {", ".join(f"greatest(0, " + ", ".join(f"q_{k}_{t}_{x}" for x in HORIZONS_H if x <= h) + f") AS p_{k}_{t}_{h}" for k, t, h in _CELLS)}, {", ".join(f"{_first_hit(t)} AS hit_{t}" for t in T)} FROM pg7),
pg9 AS (SELECT *, {", ".join(f"CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 1 ELSE greatest(" + ", ".join(f"p_{k}_{t}_{h}" for k in K) + f") END AS mp_{t}_{h}" for t in T for h in HORIZONS_H)},
  {", ".join(f"CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 0 ELSE hit_{t}.h END AS mt_{t}, CASE WHEN raw_status >= {fc.LEVEL[t]} THEN coalesce({_over(t)}, hit_{t}.n) ELSE hit_{t}.n END AS ms_{t}" for t in T)},
  list_median(list_filter([{", ".join(f"CASE WHEN wc_{k} >= 2 THEN co_{k} END" for k in K)}], lambda it: it IS NOT NULL)) AS med_co,
  list_min(list_filter([{", ".join(f"CASE WHEN wc_{k} >= 2 THEN wc_{k} END" for k in K)}], lambda it: it IS NOT NULL)) AS min_wc,
  sqrt(({" + ".join(f"{q.d(s.weight)} * least(greatest(hz_{s.key}, 0), 8) ** 2" for s in SENSORS)}) / 1.0::DOUBLE) AS hds FROM pg8),
prog AS (SELECT *, CASE WHEN event_id % 89 = 0 THEN 'sensor_integrity_anomaly' WHEN hist_s / 60 < 180 THEN 'insufficient_prognostic_history'
    WHEN greatest({", ".join(f"wc_{k}" for k in K)}) < 2 THEN 'insufficient_trend_support' END AS why FROM pg9)"""
PROG_PARTS = (q.RAW, PLANNED, _NEIGHBOURS, SMOOTH, BASELINE_FOLD, PROGNOSIS)


def prognosis_inputs(spark, sf):
    need = [f"{k}__w{m}m__{n}" for k in K for m in TREND_WINDOWS_MIN for n in (
        "slope_per_hour", "sample_count", "coverage_fraction", "gap_or_discontinuity", "available_history_duration_seconds")]
    longest = [f"{k}__w1440m__available_history_duration_seconds" for k in K]
    windows = wide(spark, sf, list(dict.fromkeys([*need, *longest]))).select(*ID, *need, F.greatest(*longest).alias("available_history_s"))
    base = baseline(spark, sf).drop("slice", "ingest_seq")
    rows = ops.sensor_status(smooth(spark, sf).drop("slice"))
    rows = rows.join(windows, ID).join(base, ID)
    return rows.withColumns({"use_for_prediction": F.col("event_id") % 89 != 0,
                             "lifecycle_state": F.lit("HEALTHY"), "reset_complete": F.lit(False)})


def prognosis(spark, sf):
    """The forecast columns; window cells and trend arrays, which no reader uses, would be a third of what is written."""
    def build():
        rows = fc.prognose(prognosis_inputs(spark, sf))
        return rows.drop(*[c for c in rows.columns if re.search(r"__w\d+m__|__trend$", c)])
    return table(spark, f"prognosis:{sf}", build)


@query("trend_window_evidence", "F7 F8", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"wc_{k} AS {k}__windows, {q.r6(f'rs_{k}', 4)} AS {k}__robust_slope" for k in K) + " FROM prog", *PROG_PARTS))
def trend_window_evidence(spark, sf):
    return prognosis(spark, sf).select(*ID, *[c for k in K for c in (
        F.col(f"{k}__window_count").cast("long").alias(f"{k}__windows"), r6(f"{k}__robust_slope", 4).alias(f"{k}__robust_slope"))])


@query("slope_uncertainty", "F9 F10", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{q.r6(f'sg_{k}', 4)} AS {k}__sigma, {q.r6(f'co_{k}', 5)} AS {k}__consistency, {q.r6(f'ef_{k}', 4)} AS {k}__effective_slope, "
                                  f"{q.r6(f'es_{k}', 4)} AS {k}__effective_sigma" for k in K) + " FROM prog", *PROG_PARTS))
def slope_uncertainty(spark, sf):
    return prognosis(spark, sf).select(*ID, *[c for k in K for c in (
        r6(f"{k}__slope_sigma", 4).alias(f"{k}__sigma"), r6(f"{k}__consistency", 5).alias(f"{k}__consistency"),
        r6(f"{k}__effective_slope", 4).alias(f"{k}__effective_slope"), r6(f"{k}__effective_sigma", 4).alias(f"{k}__effective_sigma"))])


@query("health_deviation", "F11", q.with_readings(
    f"SELECT {KEY}, {q.r6('hds', 5)} AS health_deviation_score, " + ", ".join(f"{q.r6(f'hz_{k}', 5)} AS {k}__z" for k in K) + " FROM prog", *PROG_PARTS))
def health_deviation(spark, sf):
    return prognosis(spark, sf).select(*ID, r6("health_deviation_score", 5).alias("health_deviation_score"),
                                       *[r6(f"{k}__health_deviation_z", 5).alias(f"{k}__z") for k in K])


@query("crossing_probability", "F12 F14", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{q.r6(f'p_{k}_{t}_{h}', 5)} AS {k}__{t}_{h}h" for k, t, h in _CELLS) + " FROM prog", *PROG_PARTS))
def crossing_probability(spark, sf):
    return prognosis(spark, sf).select(*ID, *[r6(f"{k}__probability_{t}_{h}h", 5).alias(f"{k}__{t}_{h}h") for k, t, h in _CELLS])


@query("eta_interval", "F13", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{q.r6(f'{c}_{k}_{t}', 4)} AS {k}__{t}_{n}" for k in K for t in T
                                  for c, n in (("eta", "eta"), ("ear", "earliest"), ("lat", "latest"))) + " FROM prog", *PROG_PARTS))
def eta_interval(spark, sf):
    return prognosis(spark, sf).select(*ID, *[r6(f"{k}__{t}_{n}_hours", 4).alias(f"{k}__{t}_{n}")
                                              for k in K for t in T for n in ("eta", "earliest", "latest")])


@query("machine_forecast", "F15 F16", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{q.r6(f'mp_{t}_{h}', 5)} AS probability_{t}_{h}h" for t in T for h in HORIZONS_H)
    + ", " + ", ".join(f"{q.r6(f'mt_{t}', 4)} AS time_to_{t}, ms_{t} AS {t}_sensor, {q.r6(f'hit_{t}.a', 4)} AS {t}_earliest" for t in T)
    + " FROM prog", *PROG_PARTS))
def machine_forecast(spark, sf):
    return prognosis(spark, sf).select(
        *ID, *[r6(f"probability_{t}_{h}h", 5).alias(f"probability_{t}_{h}h") for t in T for h in HORIZONS_H],
        *[c for t in T for c in (r6(f"prognostic_time_to_{t}_hours", 4).alias(f"time_to_{t}"),
                                 F.col(f"prognostic_{t}_sensor").alias(f"{t}_sensor"),
                                 r6(f"prognostic_{t}_earliest_hours", 4).alias(f"{t}_earliest"))])


_READY = " AND ".join(f"bn_{k} >= 180" for k in K)
_CONF = "CASE WHEN hist_s / 60 >= 720 AND min_wc >= 4 AND med_co >= 0.75::DOUBLE THEN 'high' WHEN med_co >= 0.55::DOUBLE THEN 'medium' ELSE 'low' END"


@query("forecast_confidence", "F17 F18", q.with_readings(
    f"SELECT {KEY}, why AS withholding_reason, CASE WHEN why IS NULL THEN {_CONF} WHEN why = 'sensor_integrity_anomaly' THEN 'unavailable' ELSE 'insufficient_history' END AS confidence, "
    f"{_READY} AS baseline_ready, CASE WHEN why IS NULL THEN array_to_string(list_filter([CASE WHEN mp_critical_24 >= 0.5 THEN 'probability_critical_24h' END, "
    "CASE WHEN mp_critical_6 >= 0.5 THEN 'probability_critical_6h' END, CASE WHEN mp_warning_12 >= 0.5 THEN 'probability_warning_12h' END], lambda x: x IS NOT NULL), '|') ELSE '' END AS crossings FROM prog", *PROG_PARTS))
def forecast_confidence(spark, sf):
    rows = fc.apply_withholding(prognosis(spark, sf))
    return rows.select(*ID, F.col("prognostic_withholding_reason").alias("withholding_reason"),
                       F.col("prognostic_confidence").alias("confidence"),
                       F.col("prognostic_baseline_ready").alias("baseline_ready"),
                       F.array_join("prognostic_threshold_crossings", "|").alias("crossings"))


@query("normal_tail_udf", "F12", q.with_readings(
    f"SELECT {KEY}, {q.r6('0.5::DOUBLE * e', 9)} AS tail, true AS udf_agrees FROM (SELECT machine_id, us, "
    + erfc_sql("x").replace("x * x", "zz * zz").replace("abs(x)", "abs(zz)").replace("- x *", "- zz *").replace("WHEN x >", "WHEN zz >")
    + f" AS e FROM (SELECT *, (vibration_mps2 - 2) / {math.sqrt(2.0)!r}::DOUBLE AS zz FROM readings))"))
def normal_tail_udf(spark, sf):
    z = F.col("vibration_mps2") - 2
    tail = normal_sf(z)
    return readings(spark, sf).select(*ID, r6(tail, 9).alias("tail"),
                                      (F.abs(tail - normal_sf_udf()(z)) < 1e-12).alias("udf_agrees"))


# ---- decisions --------------------------------------------------------------------------

def decisions(spark, sf):
    """Prognosis plus level/rate forecasts, decided."""
    def build():
        stat = fc.kalman_eta(fc.kalman_eta(levels(spark, sf), "warning"), "critical")
        cols = [f"statistical_{t}_{n}" for t in T for n in ("hours", "sensor", "confidence")]
        rows = prognosis(spark, sf).join(stat.select(*ID, *cols), ID)
        rows = fc.apply_withholding(fc.suppress_on_reset(rows))
        return fc.prognostic_decision(fc.prognostic_decision(rows, "warning"), "critical")
    return table(spark, f"decisions:{sf}", build)


def _decide_sql(t):
    a, b = f"CASE WHEN why IS NULL THEN mt_{t} END", f"k{t[0]}.hours"
    early = f"CASE WHEN why IS NULL THEN hit_{t}.a END"
    return f"""SELECT p.machine_id, p.us, p.raw_status, CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 0 WHEN why IS NOT NULL THEN NULL WHEN cf NOT IN ('medium','high') THEN NULL ELSE {a} END AS hours,
      CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 0 WHEN why IS NOT NULL THEN {b} ELSE {early} END AS conservative,
      CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 'reached' ELSE cf END AS confidence,
      CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 'manufacturer_threshold' WHEN why IS NOT NULL THEN 'unavailable' WHEN cf NOT IN ('medium','high') THEN 'probabilistic_monitoring' ELSE 'probabilistic_degradation' END AS source,
      raw_status < {fc.LEVEL[t]} AND (why IS NOT NULL OR cf NOT IN ('medium','high')) AS withheld,
      CASE WHEN raw_status >= {fc.LEVEL[t]} THEN 'none' WHEN why IS NOT NULL THEN why WHEN cf NOT IN ('medium','high') THEN 'prognostic_confidence' ELSE 'none' END AS reason
    FROM (SELECT *, CASE WHEN why IS NULL THEN {_CONF} WHEN why = 'sensor_integrity_anomaly' THEN 'unavailable' ELSE 'insufficient_history' END AS cf FROM prog) p
    JOIN ke_{t} k{t[0]} USING (machine_id, us)"""


DECIDED = f"dc_warning AS ({_decide_sql('warning')}), dc_critical AS ({_decide_sql('critical')})"
DEC_PARTS = (*PROG_PARTS, LEVELS, _kalman_sql("warning"), _kalman_sql("critical"), DECIDED)


@query("prognostic_decision", "F19 F25", q.with_readings(
    "SELECT w.machine_id, w.us, " + ", ".join(
        f"{q.r6(f'{t[0]}.hours', 3)} AS {t}_hours, {q.r6(f'{t[0]}.conservative', 3)} AS {t}_conservative, {t[0]}.confidence AS {t}_confidence, "
        f"{t[0]}.source AS {t}_source, {t[0]}.withheld AS {t}_withheld, {t[0]}.reason AS {t}_reason" for t in T)
    + " FROM dc_warning w JOIN dc_critical c USING (machine_id, us)", *DEC_PARTS))
def prognostic_decision(spark, sf):
    return decisions(spark, sf).select(*ID, *[c for t in T for c in (
        r6(f"{t}_decision.hours", 3).alias(f"{t}_hours"), r6(f"{t}_decision.conservative_hours", 3).alias(f"{t}_conservative"),
        F.col(f"{t}_decision.confidence").alias(f"{t}_confidence"), F.col(f"{t}_decision.source").alias(f"{t}_source"),
        F.col(f"{t}_decision.withheld").alias(f"{t}_withheld"), F.col(f"{t}_decision.reason").alias(f"{t}_reason"))])


_CLASH = "(w.raw_status = 0 AND coalesce(w.hours > c.hours, false))"
FINAL_SQL = f"""fin AS (SELECT w.machine_id, w.us, w.raw_status,
  CASE WHEN w.raw_status >= 1 THEN 0 WHEN {_CLASH} THEN NULL ELSE w.hours END AS fw,
  CASE WHEN w.raw_status >= 2 THEN 0 WHEN {_CLASH} THEN NULL ELSE c.hours END AS fcr,
  w.withheld OR c.withheld OR {_CLASH} AS withheld,
  list_sort(list_distinct(list_filter([CASE WHEN {_CLASH} THEN 'logical_consistency' WHEN w.withheld AND w.reason <> 'none' THEN w.reason END,
    CASE WHEN {_CLASH} THEN 'logical_consistency' WHEN c.withheld AND c.reason <> 'none' THEN c.reason END], lambda x: x IS NOT NULL))) AS reasons,
  upper(CASE WHEN {_CLASH} THEN 'low' WHEN {{rank_c}} < {{rank_w}} THEN c.confidence ELSE w.confidence END) AS confidence
  FROM dc_warning w JOIN dc_critical c USING (machine_id, us))"""


def _rank(col):
    return f"(CASE {col} WHEN 'reached' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"


FINAL_SQL = FINAL_SQL.format(rank_c=_rank("c.confidence"), rank_w=_rank("w.confidence"))


@query("final_forecast", "F21 F26 F27", q.with_readings(
    f"SELECT {KEY}, {q.r6('fw', 3)} AS final_warning, {q.r6('fcr', 3)} AS final_critical, withheld, array_to_string(reasons, '|') AS reasons, confidence FROM fin",
    *DEC_PARTS, FINAL_SQL))
def final_forecast(spark, sf):
    rows = fc.final_forecast(fc.enforce_consistency(decisions(spark, sf)))
    return rows.select(*ID, r6("final_time_to_warning_hours", 3).alias("final_warning"),
                       r6("final_time_to_critical_hours", 3).alias("final_critical"),
                       F.col("forecast_withheld").alias("withheld"), F.array_join("withholding_reasons", "|").alias("reasons"),
                       F.col("forecast_confidence").alias("confidence"))


_CR = {t: f"(CASE WHEN why IS NULL THEN mp_{t.split('_')[1]}_{t.split('_')[2][:-1]} END)" for t in (
    "probability_critical_6h", "probability_critical_24h", "probability_warning_12h")}


@query("urgency", "F23", q.with_readings(f"""
SELECT f.machine_id, f.us, CASE WHEN f.raw_status = 2 THEN 'IMMEDIATE_MAINTENANCE_REQUIRED' WHEN f.raw_status = 1 THEN '{fc.WARNING_NOW}'
  WHEN f.withheld OR lower(f.confidence) NOT IN ('medium','high','reached') THEN '{fc.UNSURE}'
  WHEN {_CR['probability_critical_6h']} >= 0.5 THEN 'MAINTENANCE_RECOMMENDED_SOON'
  WHEN {_CR['probability_critical_24h']} >= 0.5 THEN 'PLAN_MAINTENANCE'
  WHEN {_CR['probability_warning_12h']} >= 0.5 THEN 'PLAN_INSPECTION' ELSE 'NORMAL_MONITORING' END AS urgency
FROM fin f JOIN prog USING (machine_id, us)""", *DEC_PARTS, FINAL_SQL))
def urgency(spark, sf):
    rows = fc.final_forecast(fc.enforce_consistency(decisions(spark, sf))).withColumns({
        "persistent_crossings": F.col("prognostic_threshold_crossings"), "feature_available": F.lit(True)})
    return fc.urgency(rows).select(*ID, F.col("urgency_decision.urgency").alias("urgency"))


# Learned scores made from the readings, to exercise the older decision path.
ML_ROWS = """ml AS (SELECT machine_id, lifecycle_id, us, event_id, raw_status, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 40 - 12 * vibration_mps2 + k / 10.0::DOUBLE END AS mw,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 90 - temperature_c END AS mc, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 30 - 8 * vibration_mps2 END AS sw,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 70 - temperature_c END AS sc, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS scf,
  CASE WHEN event_id % 9 = 0 THEN 'experimental' ELSE 'deployed' END AS maturity, event_id % 31 = 0 AS ood, event_id % 37 = 0 AS viol, event_id % 41 = 0 AS policy,
  least(greatest((vibration_mps2 - 1) / 4, 0), 1) AS p6, least(greatest((temperature_c - 30) / 55, 0), 1) AS p12,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE least(greatest((current_ampere - 4) / 5, 0), 1) END AS p24 FROM planned)"""


def ml_rows(spark, sf):
    e, v, t = F.col("event_id"), F.col("vibration_mps2"), F.col("temperature_c")
    null = F.lit(None).cast("double")

    def unit(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    p6, p12 = unit((v - 1) / 4), unit((t - 30) / 55)
    p24 = F.when(e % 13 != 0, unit((F.col("current_ampere") - 4) / 5))
    conf = F.when(e % 4 == 0, "low").when(e % 4 == 1, "medium").otherwise("high")
    return planned(spark, sf).select(
        "machine_id", "lifecycle_id", "us", "ingest_seq", "raw_status", "event_id",
        F.when(e % 7 == 0, null).otherwise(40 - 12 * v + F.col("k") / 10.0).alias("ml_time_to_warning_hours"),
        F.when(e % 11 == 0, null).otherwise(90 - t).alias("ml_time_to_critical_hours"),
        F.when(e % 3 == 0, null).otherwise(30 - 8 * v).alias("statistical_warning_hours"),
        F.when(e % 5 == 0, null).otherwise(70 - t).alias("statistical_critical_hours"),
        conf.alias("statistical_warning_confidence"), conf.alias("statistical_critical_confidence"),
        F.when(e % 9 == 0, "experimental").otherwise("deployed").alias("ml_maturity"),
        (e % 31 == 0).alias("ml_outside_distribution"),
        (e % 37 == 0).alias("ml_support_violation_warning"), (e % 37 == 0).alias("ml_support_violation_critical"),
        F.when(e % 41 == 0, F.array(F.lit("production_ineligible"))).otherwise(
            F.array().cast("array<string>")).alias("ml_policy_reasons"),
        F.lit("medium").alias("ml_confidence"), F.lit("medium").alias("ml_prediction_confidence"),
        (e % 41 != 0).alias("ml_policy_passed"), F.lit(True).alias("ml_physically_valid"),
        F.lit(True).alias("feature_available"),
        *[x.alias(f"ml_probability_{k}_{h}h") for k in T for h, x in ((6, p6), (12, p12), (24, p24))],
        F.create_map(*[y for k in T for h in HORIZONS_H for y in (
            F.lit(f"probability_{k}_{h}h"), F.lit(0.6))]).alias("ml_thresholds"),
        F.array(*[F.lit(f"probability_{k}_{h}h") for k in T for h in HORIZONS_H if (k, h) != ("critical", 24)]).alias("ml_eligible"),
        F.array(F.lit("time_to_warning")).alias("ml_eta_eligible"))


def _ml_sql(t, m, s):
    lim, hit = fc.ML_DISAGREEMENT[t], f"raw_status >= {fc.LEVEL[t]}"
    rel = f"abs({m} - {s}) / greatest(abs({m}), abs({s}), 1e-6::DOUBLE)"
    strong = f"coalesce(abs({m} - {s}) > {q.d(lim)} AND {rel} > {q.d(fc.ML_DISAGREEMENT['relative'])}, false)"
    dep = f"(maturity = 'deployed' AND {m} IS NOT NULL)"
    return f"""CASE WHEN {hit} THEN 'manufacturer_threshold' WHEN policy OR viol THEN 'unavailable' WHEN {dep} AND ood THEN 'unavailable' WHEN {dep} AND {strong} THEN 'unavailable'
        WHEN {dep} THEN 'ml' WHEN {s} IS NOT NULL THEN 'statistical_monitoring' ELSE 'unavailable' END AS {t}_source,
      CASE WHEN {hit} THEN 0 WHEN policy OR viol OR NOT {dep} OR ood OR {strong} THEN NULL ELSE {m} END AS {t}_hours,
      CASE WHEN {hit} THEN 'none' WHEN policy THEN 'production_ineligible' WHEN viol THEN 'target_support' WHEN {dep} AND ood THEN 'distribution_check' WHEN {dep} AND {strong} THEN 'disagreement'
        WHEN {dep} THEN 'none' WHEN {s} IS NOT NULL THEN CASE WHEN {m} IS NULL THEN 'missing_ml' ELSE 'statistical_confidence' END WHEN {m} IS NOT NULL THEN 'missing_deployed_ml' ELSE 'missing_ml' END AS {t}_reason,
      CASE WHEN {hit} THEN 'reached' WHEN policy OR viol OR ({dep} AND (ood OR {strong})) THEN 'low' WHEN {dep} THEN 'medium' WHEN {s} IS NOT NULL THEN scf WHEN {m} IS NOT NULL THEN 'experimental' ELSE scf END AS {t}_confidence"""


ML_DECIDED = f"mld AS (SELECT *, {_ml_sql('warning', 'mw', 'sw')}, {_ml_sql('critical', 'mc', 'sc')} FROM ml)"


def ml_decided(spark, sf):
    return fc.combine_forecasts(fc.combine_forecasts(ml_rows(spark, sf), "warning"), "critical")


@query("combined_forecasts", "F20", q.with_readings(
    f"SELECT {KEY}, " + ", ".join(f"{q.r6(f'{t}_hours', 4)} AS {t}_hours, {t}_source, {t}_reason, {t}_confidence" for t in T) + " FROM mld",
    q.RAW, PLANNED, ML_ROWS, ML_DECIDED))
def combined_forecasts(spark, sf):
    return ml_decided(spark, sf).select(*ID, *[c for t in T for c in (
        r6(f"{t}_decision.hours", 4).alias(f"{t}_hours"), F.col(f"{t}_decision.source").alias(f"{t}_source"),
        F.col(f"{t}_decision.reason").alias(f"{t}_reason"), F.col(f"{t}_decision.confidence").alias(f"{t}_confidence"))])


@query("status_constrained_scores", "F22", q.with_readings(
    f"SELECT {KEY}, {q.r6('CASE WHEN raw_status >= 1 THEN 0 ELSE mw END', 4)} AS time_to_warning, {q.r6('CASE WHEN raw_status >= 2 THEN 0 ELSE mc END', 4)} AS time_to_critical, "
    f"{q.r6('CASE WHEN raw_status >= 1 THEN 1 ELSE p24 END', 5)} AS warning_24, {q.r6('CASE WHEN raw_status >= 2 THEN 1 ELSE p6 END', 5)} AS critical_6 FROM ml", q.RAW, PLANNED, ML_ROWS))
def status_constrained_scores(spark, sf):
    rows = fc.constrain_by_status(ml_rows(spark, sf))
    return rows.select(*ID, r6("ml_time_to_warning_hours", 4).alias("time_to_warning"), r6("ml_time_to_critical_hours", 4).alias("time_to_critical"),
                       r6("ml_probability_warning_24h", 5).alias("warning_24"), r6("ml_probability_critical_6h", 5).alias("critical_6"))


_CLASH_ML = "(raw_status = 0 AND coalesce(warning_hours > critical_hours, false))"


@query("urgency_ml", "F24", q.with_readings(f"""
SELECT {KEY}, CASE WHEN raw_status = 2 THEN 'IMMEDIATE_MAINTENANCE_REQUIRED' WHEN raw_status = 1 THEN '{fc.WARNING_NOW}' WHEN policy OR ood THEN '{fc.UNSURE}'
  WHEN p6 >= 0.6 THEN 'MAINTENANCE_RECOMMENDED_SOON' WHEN p12 >= 0.6 THEN 'PLAN_INSPECTION'
  WHEN NOT {_CLASH_ML} AND warning_reason = 'none' AND critical_reason = 'none' AND (warning_source = 'ml' OR critical_source = 'ml') AND warning_hours <= 12 THEN 'PLAN_INSPECTION'
  WHEN {_CLASH_ML} OR least({_rank('warning_confidence')}, {_rank('critical_confidence')}) <= 1 AND
    (CASE WHEN {_rank('critical_confidence')} < {_rank('warning_confidence')} THEN critical_confidence ELSE warning_confidence END) IN ('low','experimental') THEN '{fc.UNSURE}'
  ELSE 'NORMAL_MONITORING' END AS urgency FROM mld""", q.RAW, PLANNED, ML_ROWS, ML_DECIDED))
def urgency_ml(spark, sf):
    rows = fc.urgency_ml(fc.final_forecast(fc.enforce_consistency(ml_decided(spark, sf))))
    return rows.select(*ID, F.col("urgency_decision.urgency").alias("urgency"))


@query("ordered_reasons", "F27", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'model_load_failed:a|model_revoked|zeta' WHEN 1 THEN 'missing_required_model:x|ood_detected'
  WHEN 2 THEN '' ELSE 'alpha|beta' END AS reasons, CASE event_id % 4 WHEN 0 THEN 'model_load_failed:a' WHEN 1 THEN 'missing_required_model:x' WHEN 2 THEN 'none' ELSE 'alpha' END AS primary_reason FROM events""")
def ordered_reasons(spark, sf):
    m = F.col("event_id") % 4
    none = F.array().cast("array<string>")
    given = (F.when(m == 0, F.array(*map(F.lit, ("zeta", "model_revoked", "model_load_failed:a", "zeta"))))
             .when(m == 1, F.array(*map(F.lit, ("ood_detected", "missing_required_model:x", "")))).when(m == 2, none)
             .otherwise(F.array(*map(F.lit, ("beta", "alpha", "beta")))))
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.array_join(fc.ordered_reasons(given), "|").alias("reasons"), fc.primary_reason(given).alias("primary_reason"))


@query("reconciled_horizons", "F28", q.with_readings(
    f"SELECT {KEY}, {q.r6('p6', 5)} AS warning_6, {q.r6('greatest(p6, p12)', 5)} AS warning_12, {q.r6('CASE WHEN p24 IS NOT NULL THEN greatest(p6, p12, p24) END', 5)} AS warning_24, "
    f"{q.r6('p24', 5)} AS critical_24, (CASE WHEN p6 > p12 THEN 2 ELSE 0 END) + (CASE WHEN p24 < greatest(p6, p12) THEN 1 ELSE 0 END) AS changed FROM ml", q.RAW, PLANNED, ML_ROWS))
def reconciled_horizons(spark, sf):
    rows = fc.reconcile_horizons(ml_rows(spark, sf), F.col("ml_eligible"))
    return rows.select(*ID, r6("reconciled_probability_warning_6h", 5).alias("warning_6"), r6("reconciled_probability_warning_12h", 5).alias("warning_12"),
                       r6("reconciled_probability_warning_24h", 5).alias("warning_24"), r6("reconciled_probability_critical_24h", 5).alias("critical_24"),
                       F.size("reconciled_targets").alias("changed"))


POLICY_ROWS = f"""pol AS (SELECT machine_id, us, raw_status, CASE event_id % 4 WHEN 0 THEN 'USE_NORMALLY' WHEN 1 THEN 'USE_WITH_REDUCED_CONFIDENCE' WHEN 2 THEN 'HOLD_FOR_CONFIRMATION' ELSE 'SUSPEND_PREDICTION' END AS action,
  vibration_mps2 AS w, temperature_c AS c FROM planned)"""


@query("anomaly_policy", "A21", q.with_readings(f"""
SELECT {KEY}, {q.r6("CASE WHEN action IN ('HOLD_FOR_CONFIRMATION','SUSPEND_PREDICTION') THEN CASE WHEN raw_status >= 1 THEN 0 END ELSE w END", 5)} AS final_warning,
  {q.r6("CASE WHEN action IN ('HOLD_FOR_CONFIRMATION','SUSPEND_PREDICTION') THEN CASE WHEN raw_status >= 2 THEN 0 END ELSE c END", 5)} AS final_critical,
  action IN ('HOLD_FOR_CONFIRMATION','SUSPEND_PREDICTION') AS withheld,
  CASE action WHEN 'USE_NORMALLY' THEN 'HIGH' WHEN 'USE_WITH_REDUCED_CONFIDENCE' THEN 'LOW' ELSE 'UNAVAILABLE' END AS confidence,
  CASE WHEN action = 'USE_NORMALLY' OR raw_status > 0 THEN 'PLAN_INSPECTION' ELSE '{fc.UNSURE}' END AS urgency,
  CASE action WHEN 'USE_NORMALLY' THEN 'passed' WHEN 'USE_WITH_REDUCED_CONFIDENCE' THEN 'qualified' ELSE 'withheld' END AS guardrail_result FROM pol""",
    q.RAW, PLANNED, POLICY_ROWS))
def anomaly_policy(spark, sf):
    m = F.col("event_id") % 4
    action = (F.when(m == 0, "USE_NORMALLY").when(m == 1, "USE_WITH_REDUCED_CONFIDENCE")
              .when(m == 2, "HOLD_FOR_CONFIRMATION").otherwise("SUSPEND_PREDICTION"))
    from fleetpulse.operators.anomaly import usability
    rows = planned(spark, sf).withColumn("model_action", action)
    rows = rows.withColumns(usability(F.col("model_action"))).withColumns({
        "confidence_multiplier": F.when(m == 1, 0.65).otherwise(1.0),
        "final_time_to_warning_hours": F.col("vibration_mps2"), "conservative_time_to_warning_hours": F.col("vibration_mps2"),
        "final_time_to_critical_hours": F.col("temperature_c"), "conservative_time_to_critical_hours": F.col("temperature_c"),
        "forecast_withheld": F.lit(False), "withholding_reasons": F.array().cast("array<string>"),
        "forecast_confidence": F.lit("HIGH"),
        "urgency_decision": fc._urgency("PLAN_INSPECTION", True, "probabilistic_degradation", "probability_warning_12h", "", "r")})
    out = fc.apply_anomaly_policy(rows)
    return out.select(*ID, r6("final_time_to_warning_hours", 5).alias("final_warning"), r6("final_time_to_critical_hours", 5).alias("final_critical"),
                      F.col("forecast_withheld").alias("withheld"), F.col("forecast_confidence").alias("confidence"),
                      F.col("urgency_decision.urgency").alias("urgency"), "guardrail_result")


# ---- the whole replay ---------------------------------------------------------------------

# Steps on the way to a decision that neither audit rows nor attached scores read; writing them cost a third of the table.
PASSED_ON = ("pending_json", "missing_samples", "confirmed_us", "median_consistency", "minimum_windows", *[f"{k}__{n}" for k in K for n in (
    "robust_slope", "slope_sigma", "slope_snr", "baseline_mean", "baseline_std", "baseline_samples",
    *[f"probability_{t}_{h}h" for t in T for h in HORIZONS_H], *[f"{t}_{n}_hours" for t in T for n in ("eta", "earliest", "latest")])])


def replayed(spark, sf):
    return table(spark, f"replay:{sf}", lambda: mon.monitor(
        faulty(spark, sf).select("machine_id", "us", "ingest_seq", *K, "health_status")).drop(*PASSED_ON))


@query("replay_audit", "F29 S8 L1")
def replay_audit(spark, sf):
    """Flagship: inferred lifecycles, findings, forecasts, urgency; one audit row per reading."""
    return mon.audit_rows(replayed(spark, sf))


@query("replay_audit_detailed", "S8 F29")
def replay_audit_detailed(spark, sf):
    return mon.audit_rows(replayed(spark, sf), detailed=True)


@query("replay_with_plan", "F29 K8 L4")
def replay_with_plan(spark, sf):
    rows = readings(spark, sf).select("machine_id", "us", "ingest_seq", *K)
    out = mon.monitor(rows, plan=plan(spark, sf))
    return out.select(*ID, "lifecycle_id", "lifecycle_state", "rule", "raw_status", "stabilized_status",
                      "event_status", F.col("urgency_decision.urgency").alias("urgency"),
                      F.array_join("persistent_crossings", "|").alias("alerts"))


@query("attached_scores", "F30")
def attached_scores(spark, sf):
    params = dataclasses.replace(DEFAULT, prognostics=dataclasses.replace(DEFAULT.prognostics, enabled=False))
    rows = replayed(spark, sf)
    scores = ml_rows(spark, sf).drop("lifecycle_id", "ingest_seq", "raw_status", "event_id", "feature_available",
                                     *[f"statistical_{t}_{n}" for t in T for n in ("hours", "confidence")])
    out = fc.attach_ml(rows, scores, params)
    return out.select(*ID, "forecast_withheld", "forecast_confidence", "warning_primary_source", "critical_primary_source",
                      F.col("urgency_decision.urgency").alias("urgency"))
