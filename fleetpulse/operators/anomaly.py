"""Data-quality findings.

Gaps, context events and boundary runs are window work; recent medians, noise and
drift look at a bounded number of earlier rows and run vectorised per slice (a
sliding frame would recompute every window for every row). Only what must remember earlier
decisions (frozen spike baselines, recovery countdown, clip counters that stop
while a stronger rule fires, starts of constancy runs) is folded, on a few narrow columns.
A finding is a rule name; its quality status, action, confidence and training
flags are looked up from one table of fixed values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetpulse.operators.cadence import missing_samples, with_gap
from fleetpulse.params import (BY_KEY, DEFAULT, INTEGRITY, PENALTIES, SENSOR_KEYS,
                               Anomaly, Params)
from fleetpulse.plans.fold import sliced_fold
from fleetpulse.plans.shared import cut
from fleetpulse.plans.slices import ORDER, scan, spread, with_history

LIFE = ("machine_id", "lifecycle_id")
ALL_SENSORS = "|".join(sorted(SENSOR_KEYS))

# What each finding means.
# rule: quality, types, severity, confidence, origin, action, penalty key, penalty reason,
#       trainable, exclusion, review, active
FINDINGS: dict[str, tuple] = {
    "NONE": ("NORMAL", "NONE", "NONE", 0.0, "none", "USE_NORMALLY", "observation", "", True, "", False, False),
    "CONFIRMED": ("SUSPECTED_SENSOR_ANOMALY", "STUCK_SENSOR_CONFIRMED", "CRITICAL", 1.0,
                  "externally_confirmed_sensor_fault", "SUSPEND_PREDICTION", "invalid",
                  "confirmed_sensor_fault", False, "confirmed_sensor_fault", True, True),
    "LONG_GAP": ("DATA_UNAVAILABLE", "LONG_DATA_GAP", "HIGH", 1.0, "communication_or_data_availability",
                 "SUSPEND_PREDICTION", "long_gap", "long_data_gap", False,
                 "long_data_gap_or_contaminated_recovery", True, True),
    "RECOVERY": ("VALID_WITH_OBSERVATION", "LONG_DATA_GAP", "MEDIUM", 1.0, "post_gap_recovery",
                 "SUSPEND_PREDICTION", "long_gap", "post_long_gap_recovery", False,
                 "post_long_gap_recovery", False, True),
    "RECOVERY_END": ("VALID_WITH_OBSERVATION", "LONG_DATA_GAP", "MEDIUM", 1.0, "post_gap_recovery",
                     "USE_WITH_REDUCED_CONFIDENCE", "suspected", "post_long_gap_recovery", False,
                     "post_long_gap_recovery", False, True),
    "SHORT_GAP": ("VALID_WITH_OBSERVATION", "SHORT_DATA_GAP", "LOW", 1.0, "source_cadence_gap",
                  "USE_WITH_REDUCED_CONFIDENCE", "short_gap", "short_data_gap", True, "", False, True),
    "INTERPOLATED": ("VALID_WITH_OBSERVATION", "SHORT_DATA_GAP", "LOW", 1.0, "safe_causal_interpolation",
                     "USE_WITH_REDUCED_CONFIDENCE", "short_gap", "short_data_gap", False,
                     "interpolated_short_gap_pending_policy_review", False, True),
    "CLIPPING": ("SUSPECTED_SENSOR_ANOMALY", "CLIPPING_SUSPECTED", "MEDIUM", 0.8,
                 "sensor_or_instrument_boundary", "USE_WITH_REDUCED_CONFIDENCE", "suspected",
                 "clipping_suspected", False, "clipping_suspected", True, True),
    "STUCK": ("SUSPECTED_SENSOR_ANOMALY", "STUCK_SENSOR_SUSPECTED", "MEDIUM", 0.75,
              "sensor_response_uncertain", "USE_WITH_REDUCED_CONFIDENCE", "suspected",
              "stuck_sensor_suspected", False, "stuck_sensor_suspected_pending_review", True, True),
    "POSSIBLE_STUCK": ("VALID_WITH_OBSERVATION", "POSSIBLE_STUCK_SENSOR", "LOW", 0.4, "uncertain",
                       "USE_NORMALLY", "observation", "possible_stuck_observation", True, "", False, True),
    "CORRELATED": ("POSSIBLE_MACHINE_EVENT", "CORRELATED_ABRUPT_CHANGE|PERSISTENT_STEP_CHANGE", "HIGH", 0.8,
                   "possible_abrupt_machine_event", "USE_WITH_REDUCED_CONFIDENCE", "machine_event",
                   "correlated_abrupt_machine_event", False, "possible_abrupt_machine_event", True, True),
    "PERSISTENT": ("SUSPECTED_SENSOR_ANOMALY", "PERSISTENT_STEP_CHANGE|SENSOR_DISAGREEMENT|ORIGIN_UNCERTAIN",
                   "HIGH", 0.7, "machine_or_sensor_or_operating_regime", "USE_WITH_REDUCED_CONFIDENCE",
                   "machine_event", "persistent_change_origin_uncertain", False,
                   "persistent_change_origin_uncertain", True, True),
    "ABRUPT": ("SUSPECTED_SENSOR_ANOMALY", "SINGLE_SAMPLE_SPIKE|SENSOR_DISAGREEMENT|ORIGIN_UNCERTAIN",
               "MEDIUM", 0.45, "uncertain", "HOLD_FOR_CONFIRMATION", "suspected",
               "abrupt_reading_pending_confirmation", False, "abrupt_reading_pending_confirmation", True, True),
    "RESOLVED": ("VALID_WITH_OBSERVATION", "SINGLE_SAMPLE_SPIKE", "LOW", 0.8, "transient_origin_uncertain",
                 "USE_WITH_REDUCED_CONFIDENCE", "short_gap", "resolved_transient_history_contamination_guard",
                 False, "resolved_transient_spike", False, False),
    "RESOLVED_STEP": ("VALID_WITH_OBSERVATION", "PERSISTENT_STEP_CHANGE", "MEDIUM", 0.8,
                      "resolved_machine_sensor_or_regime_change", "USE_WITH_REDUCED_CONFIDENCE", "suspected",
                      "resolved_persistent_change_recovery", False, "persistent_change_episode", False, False),
    "NOISE": ("SUSPECTED_SENSOR_ANOMALY", "EXCESSIVE_NOISE", "MEDIUM", 0.7, "sensor_or_process_variability",
              "USE_WITH_REDUCED_CONFIDENCE", "noise", "excessive_noise", False, "excessive_noise", True, True),
    "DRIFT": ("SUSPECTED_SENSOR_ANOMALY", "DRIFT_SUSPECTED", "MEDIUM", 0.55,
              "sensor_drift_or_real_degradation", "USE_WITH_REDUCED_CONFIDENCE", "suspected",
              "drift_suspected", False, "drift_suspected_pending_calibration_review", True, True),
}
# Closing classifications.
FINAL = {"CONFIRMED": "STUCK_SENSOR_CONFIRMED", "RESOLVED": "RESOLVED_TRANSIENT_SPIKE",
         "RESOLVED_STEP": "RESOLVED_PERSISTENT_CHANGE"}
FIELDS = ("quality_status", "anomaly_types", "anomaly_severity", "anomaly_confidence",
          "suspected_origin", "model_action", "penalty", "confidence_penalty_reason",
          "training_eligible", "training_exclusion_reason", "requires_human_review",
          "anomaly_is_active")


# ---- stand-alone evidence ----------------------------------------------------

def _source_gap(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gap in seconds: the source interval where given, else the step from the row before."""
    rows = with_gap(df.drop("gap_s"), keys) if "source_interval_s" not in df.columns else df
    return rows.withColumn("gap_s", F.coalesce(
        F.nullif(F.col("source_interval_s"), F.lit(0.0)), F.lit(0.0)))


def _features_ok(df: DataFrame) -> Column:
    return F.col("features_available") if "features_available" in df.columns else F.lit(True)


def _interpolated(df: DataFrame) -> Column:
    return F.col("interpolated") if "interpolated" in df.columns else F.lit(False)


def long_gap(df: DataFrame, a: Anomaly = DEFAULT.anomaly, keys: Sequence[str] = LIFE) -> DataFrame:
    rows = _source_gap(df, keys)
    return rows.withColumn("long_gap", (F.col("gap_s") >= a.long_gap_s) | ~_features_ok(rows))


def gap_recovery(df: DataFrame, a: Anomaly = DEFAULT.anomaly, keys: Sequence[str] = LIFE) -> DataFrame:
    """Rows still required after a long gap; null outside the countdown."""
    rows = df if "long_gap" in df.columns else long_gap(df, a, keys)
    rows = scan(rows, keys, total={"_pos": F.lit(1).cast("long")})
    rows = scan(rows, keys, last={"_gap_pos": F.when(F.col("long_gap"), F.col("_pos"))})
    since = F.col("_pos") - F.col("_gap_pos")
    return rows.withColumn("recovery_left", F.when(
        ~F.col("long_gap") & (since <= a.recovery_rows), a.recovery_rows - since).cast("int")
    ).drop("_pos", "_gap_pos")


def short_gap(df: DataFrame, params: Params = DEFAULT, keys: Sequence[str] = LIFE) -> DataFrame:
    a, c = params.anomaly, params.cadence
    rows = _source_gap(df, keys)
    missing = missing_samples(F.col("gap_s"), c.expected_s)
    return rows.withColumns({
        "missing_samples": missing.cast("int"),
        "short_gap": _interpolated(rows) | (
            (missing > 0) & (F.col("gap_s") > c.expected_s + a.gap_tolerance_s)
            & (F.col("gap_s") < a.long_gap_s))})


def at_boundary(key: str, a: Anomaly = DEFAULT.anomaly) -> Column:
    """Value within a fraction of a resolution step of a physical bound."""
    m = INTEGRITY[key]
    tol = m.resolution * a.clip_tolerance
    return ((F.abs(F.col(key) - m.physical_min) <= tol) | (F.abs(F.col(key) - m.physical_max) <= tol))


def clipping(df: DataFrame, a: Anomaly = DEFAULT.anomaly, keys: Sequence[str] = LIFE) -> DataFrame:
    """Length of the current run of boundary values per sensor, and which sensors clip."""
    rows = scan(df, keys, total={"_pos": F.lit(1).cast("long")})
    rows = scan(rows, keys, last={
        f"_free_{k}": F.when(~at_boundary(k, a), F.col("_pos")) for k in SENSOR_KEYS})
    runs = {f"{k}__clip_rows": F.when(at_boundary(k, a), F.col("_pos") - F.coalesce(
        F.col(f"_free_{k}"), F.lit(0))).otherwise(0).cast("int") for k in SENSOR_KEYS}
    rows = rows.withColumns(runs).drop("_pos", *[f"_free_{k}" for k in SENSOR_KEYS])
    return rows.withColumn("clipping", _names_where(
        {k: F.col(f"{k}__clip_rows") >= a.clip_rows for k in SENSOR_KEYS}))


def _names_where(tests: dict[str, Column]) -> Column:
    """Sorted, pipe-separated names of the sensors that pass."""
    return F.concat_ws("|", *[F.when(tests[k], F.lit(k)) for k in sorted(tests)])


def context_events(df: DataFrame, keys: Sequence[str] = LIFE) -> DataFrame:
    """Per sensor: did one of its related sensors move meaningfully on this row?"""
    rows = scan(df, keys, lag={f"_was_{k}": k for k in SENSOR_KEYS})

    def moved(k):
        m = INTEGRITY[k]
        return F.coalesce(F.abs(F.col(k) - F.col(f"_was_{k}")) >= max(
            m.context_change, m.resolution * 5.0), F.lit(False))
    out = {}
    for k in SENSOR_KEYS:
        first, *more = INTEGRITY[k].related
        test = moved(first)
        for other in more:
            test = test | moved(other)
        out[f"{k}__context"] = test
    return rows.withColumns(out).drop(*[f"_was_{k}" for k in SENSOR_KEYS])


def abrupt_threshold(key: str, a: Anomaly = DEFAULT.anomaly) -> float:
    return max(INTEGRITY[key].resolution * 8.0, BY_KEY[key].span * a.abrupt_fraction)


def _neighbourhood_block(v: np.ndarray, resolution: float, span: float, jump: float,
                         a: Anomaly) -> dict[str, np.ndarray]:
    """Evidence of one sensor for every row of a sorted block, from its earlier rows."""
    rows = len(v)
    count = np.minimum(np.arange(rows), 10)
    middle = pd.Series(v).shift(1).rolling(10, min_periods=1).median().to_numpy()
    out = {"recent_count": count, "recent_median": middle,
           "abrupt": (count >= 5) & (np.abs(v - np.nan_to_num(middle)) >= jump)}

    n = a.noise_rows
    noisy = np.zeros(rows, dtype=bool)
    if rows >= 2 * n:
        windows = sliding_window_view(v, n)
        line = np.arange(n) / max(1, n - 1)
        rest = windows - (windows[:, :1] + (windows[:, -1:] - windows[:, :1]) * line)
        scatter = np.median(np.abs(rest - np.median(rest, axis=1, keepdims=True)), axis=1)
        step = np.diff(v)
        turn = np.concatenate(([0], np.cumsum(step[1:] * step[:-1] < 0)))
        turns = turn[n - 2:] - turn[:len(turn) - n + 2]
        old, new = scatter[:-n], scatter[n:]
        noisy[2 * n - 1:] = ((new > np.maximum(old, resolution) * a.noise_multiplier)
                             & (turns[n:] >= n // 4))
    d = a.drift_rows
    move = np.full(rows, np.nan)
    drift = np.zeros(rows, dtype=bool)
    if rows >= d:
        step = np.diff(v)
        moved = np.abs(step) > resolution * 0.5
        up = np.concatenate(([0], np.cumsum(moved & (step > 0))))
        down = np.concatenate(([0], np.cumsum(moved & (step < 0))))
        ups, downs = up[d - 1:] - up[:rows - d + 1], down[d - 1:] - down[:rows - d + 1]
        move[d - 1:] = v[d - 1:] - v[:rows - d + 1]
        share = np.maximum(ups, downs) / np.maximum(ups + downs, 1)
        drift[d - 1:] = ((ups + downs > 0) & (share >= 0.85)
                         & (np.abs(move[d - 1:]) >= span * a.drift_span))
    return out | {"noise": noisy, "drift": drift, "drift_move": move}


EVIDENCE = (("recent_count", "bigint"), ("recent_median", "double"), ("abrupt", "boolean"),
            ("noise", "boolean"), ("drift", "boolean"), ("drift_move", "double"))


def neighbourhood(df: DataFrame, a: Anomaly = DEFAULT.anomaly, keys: Sequence[str] = LIFE) -> DataFrame:
    """Recent median, abrupt, noise and drift evidence of every row, in one shuffle.

    The history of these rules holds every row, also held and discarded ones. Each
    slice comes with the rows before it, so a task sees a bounded block.
    """
    rows = with_history(df, keys, max(2 * a.noise_rows - 1, a.drift_rows - 1, 10))
    added = T._parse_datatype_string(", ".join(f"{k}__{n} {t}" for k in SENSOR_KEYS for n, t in EVIDENCE))
    schema = T.StructType([f for f in rows.schema if f.name != "is_halo"] + added.fields)
    cells = to_arrow_schema(schema)

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ORDER])
        real = ~table["is_halo"].to_numpy()
        found = {}
        for k in SENSOR_KEYS:
            evidence = _neighbourhood_block(table[k].to_numpy().astype(float), INTEGRITY[k].resolution,
                                            BY_KEY[k].span, abrupt_threshold(k, a), a)
            found |= {f"{k}__{n}": evidence[n][real] for n, _ in EVIDENCE}
        plain = table.filter(pa.array(real)).drop_columns(["is_halo"])
        return pa.Table.from_arrays([
            pa.chunked_array([pa.array(found[f.name], type=f.type, from_pandas=True)]) if f.name in found
            else plain[f.name].cast(f.type) for f in cells], schema=cells)

    out = spread(rows, [*keys, "slice"]).groupBy(*keys, "slice").applyInArrow(block, schema)
    gaps = [f"{k}__{n}" for k in SENSOR_KEYS for n in ("recent_median", "drift_move")]
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in gaps})


# ---- constancy ---------------------------------------------------------------

def run_next(runs: list, i: int, key: str, us: int, v: float, context: bool) -> float | None:
    """One reading of a sensor in its run of unchanged readings, measured against the run's first value.

    ``runs[i]`` is [first value, start, context events, time of the last one].
    Returns the seconds of the run that this reading ends, if it ends one.
    """
    run, ended = runs[i], None
    if run is None:
        run = runs[i] = [v, us, 0, None]
    elif abs(v - run[0]) > INTEGRITY[key].resolution * 0.5:
        ended = (us - run[1]) / 1e6
        run[:] = [v, us, 0, None]
    if context:
        run[2] += 1
        run[3] = us
    return ended


def run_cells(run: list, us: int) -> tuple[int, int, float]:
    """(start, context events, seconds since the last one) of a run at one of its readings."""
    return run[1], run[2], (us - run[3]) / 1e6 if run[3] is not None else 0.0


def run_columns(run: list | None, us: np.ndarray, values: list[float], context: np.ndarray,
                key: str) -> tuple[dict[str, np.ndarray], list]:
    """:func:`run_next` and :func:`run_cells` of a whole block, and the run that its last row belongs to.

    Only where runs start is found row by row; the other cells are counted between starts.
    """
    limit = INTEGRITY[key].resolution * 0.5
    first, starts = (run[0] if run else None), []
    for i, v in enumerate(values):
        if first is None or abs(v - first) > limit:
            first = v
            starts.append(i)
    rows = np.arange(len(us))
    begun = np.array(starts, dtype=np.int64)
    nth = np.searchsorted(begun, rows, side="right")  # 0: still the run from before the block
    old = run or [None, 0, 0, None]
    since = np.concatenate(([old[1]], us[begun]))
    ended = np.full(len(us), np.nan)
    ended[begun] = (us[begun] - since[:-1]) / 1e6
    if not run:
        ended[begun[:1]] = np.nan
    seen = np.cumsum(context)
    events = seen - np.concatenate(([-old[2]], seen[begun] - context[begun]))[nth]
    last = np.maximum.accumulate(np.where(context, rows, -1))
    own = last >= np.concatenate(([0], begun))[nth]
    quiet = np.where(own, (us - us[last]) / 1e6, 0.0)
    if old[3] is not None:
        quiet = np.where(~own & (nth == 0), (us - old[3]) / 1e6, quiet)
    at = int(last[-1]) if own[-1] else None
    left = [first, int(since[nth[-1]]), int(events[-1]),
            int(us[at]) if at is not None else old[3] if not starts else None]
    return {"since": since[nth], "ended_s": ended, "context_events": events, "quiet_s": quiet}, left


def carried_runs(state: dict, row: dict, a: Anomaly) -> dict:
    """The run evidence of one row where rows come one by one, as in a stream.

    The longest earlier run is a number that never forgets; batch work takes it
    from a scan and keeps it out of the state that slices hand on.
    """
    runs = state.setdefault("runs", [None] * len(SENSOR_KEYS))
    longest = state.setdefault("longest", [0.0] * len(SENSOR_KEYS))
    row["runs"], row["starts"] = [], {}
    for i, (k, v) in enumerate(zip(SENSOR_KEYS, row["values"])):
        ended = run_next(runs, i, k, row["us"], v, row["context"][i])
        longest[i] = max(longest[i], ended or 0.0)
        start, events, quiet = run_cells(runs[i], row["us"])
        row["runs"].append(((row["us"] - start) / 1e6, longest[i], events, quiet))
        row["starts"][k] = start
    row["stuck"] = [stuck_level(k, run, a) for k, run in zip(SENSOR_KEYS, row["runs"])]
    return row


def stuck_levels(key: str, seconds: np.ndarray, longest: np.ndarray, events: np.ndarray, quiet: np.ndarray,
                 a: Anomaly) -> np.ndarray:
    """:func:`stuck_level` of a whole block."""
    m = INTEGRITY[key]
    factor = 1.0 if m.exact_values else 2.0
    some = (events > 0) & (seconds > np.maximum(m.stuck_observe_s * factor, longest * 1.5))
    sure = (seconds >= m.stuck_suspect_s * factor) & (events >= a.context_events + (not m.exact_values)) & (
        quiet >= m.response_s)
    return some.astype(int) + (some & sure)


def stuck_level(key: str, run: tuple, a: Anomaly) -> int:
    """0 nothing, 1 possibly stuck, 2 suspected stuck."""
    m = INTEGRITY[key]
    seconds, longest, events, quiet = run
    factor = 1.0 if m.exact_values else 2.0
    if not events or seconds <= max(m.stuck_observe_s * factor, longest * 1.5):
        return 0
    enough = events >= a.context_events + (not m.exact_values)
    return 2 if (seconds >= m.stuck_suspect_s * factor and enough and quiet >= m.response_s) else 1


RUN = (("since", "bigint"), ("ended_s", "double"), ("context_events", "int"), ("quiet_s", "double"))


def constancy(df: DataFrame, params: Params = DEFAULT, keys: Sequence[str] = LIFE) -> DataFrame:
    """Constancy runs and stuck evidence of every row.

    Where a run starts depends on its first value, so starts are folded; that state
    forgets with every change of value. The longest earlier run is the running
    maximum of the runs that ended, taken over slices by a scan.
    """
    names = [f"{k}__{n}" for k in SENSOR_KEYS for n, _ in RUN]

    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        runs = state.setdefault("runs", [None] * len(SENSOR_KEYS))
        us, cells = rows["us"].to_numpy(np.int64), {}
        for i, k in enumerate(SENSOR_KEYS):
            found, runs[i] = run_columns(runs[i], us, rows[k].tolist(), rows[f"{k}__context"].to_numpy(bool), k)
            cells |= {f"{k}__{n}": column for n, column in found.items()}
        return pd.concat([rows[["us", "ingest_seq"]], pd.DataFrame(cells, columns=names)], axis=1)

    rows = df if f"{SENSOR_KEYS[0]}__context" in df.columns else context_events(df, keys)
    ddl = ", ".join(["us bigint", "ingest_seq bigint"] + [f"{k}__{n} {t}" for k in SENSOR_KEYS for n, t in RUN])
    found = sliced_fold(rows.select(*keys, "slice", "us", "ingest_seq", *SENSOR_KEYS,
                                    *[f"{k}__context" for k in SENSOR_KEYS]), keys, step, ddl)
    found = found.withColumns({f"{k}__ended_s": F.nanvl(F.col(f"{k}__ended_s"), F.lit(None).cast("double")) for k in SENSOR_KEYS})
    found = scan(found, keys, high={f"{k}__longest_s": f"{k}__ended_s" for k in SENSOR_KEYS})
    out = {}
    for k in SENSOR_KEYS:
        out[f"{k}__longest_s"] = F.coalesce(F.col(f"{k}__longest_s"), F.lit(0.0))
        out[f"{k}__run_s"] = (F.col("us") - F.col(f"{k}__since")) / 1e6
    found = found.withColumns(out)
    return found.withColumns({f"{k}__stuck": stuck_column(k, params.anomaly) for k in SENSOR_KEYS}).drop(
        *[f"{k}__ended_s" for k in SENSOR_KEYS])


def stuck_column(key: str, a: Anomaly) -> Column:
    """:func:`stuck_level` of the run columns."""
    m = INTEGRITY[key]
    seconds, longest, events, quiet = (F.col(f"{key}__{n}") for n in ("run_s", "longest_s", "context_events", "quiet_s"))
    factor = 1.0 if m.exact_values else 2.0
    none = (events == 0) | (seconds <= F.greatest(F.lit(float(m.stuck_observe_s * factor)), longest * 1.5))
    enough = (events >= a.context_events + (not m.exact_values)) & (seconds >= m.stuck_suspect_s * factor) & (quiet >= m.response_s)
    return F.when(none, 0).when(enough, 2).otherwise(1)


# ---- the decision ladder -------------------------------------------------------

def pending_next(state: dict, us: int, values, medians, abrupt, a: Anomaly):
    """Open spikes per sensor against the baseline frozen at their onset.

    Returns the sensors that are held, persistent, back after a spike and back
    after a step, in configured order.
    """
    open_ = state.setdefault("pending", {})
    held, stepped, back, back_step = [], [], [], []
    for k, v, mid, jump in zip(SENSOR_KEYS, values, medians, abrupt):
        p = open_.get(k)
        if p is None:
            if jump:
                open_[k] = {"since": us, "base": mid, "step": False}
                held.append(k)
            continue
        age = (us - p["since"]) / 1e6
        tol = max(INTEGRITY[k].resolution * a.recovery_multiplier, abrupt_threshold(k, a) * 0.25)
        if abs(v - p["base"]) <= tol:
            (back_step if p["step"] else back if age >= a.observe_s else held).append(k)
        elif age >= a.persist_s:
            p["step"] = True
            stepped.append(k)
        else:
            held.append(k)
    return held, stepped, back, back_step


def ladder_next(state: dict, row: dict, a: Anomaly) -> tuple[str, list[str], int]:
    """Highest finding of one row: rule, sensors, time it was first seen.

    ``row`` holds the values and evidence of the row, with the start and the stuck
    level of each sensor's run. Lower rules do not move their counters while a
    higher one fires.
    """
    us, values, starts = row["us"], row["values"], row["starts"]
    last, state["us"] = state.get("us"), us
    if row["confirmed"]:
        return "CONFIRMED", row["confirmed"], min(starts[k] for k in row["confirmed"])
    everything = list(SENSOR_KEYS)
    if row["gap_s"] >= a.long_gap_s or not row["features_ok"]:
        state["recovery"] = a.recovery_rows
        return "LONG_GAP", everything, us if last is None else last
    if state.get("recovery", 0) > 0:
        state["recovery"] -= 1
        return "RECOVERY" if state["recovery"] else "RECOVERY_END", everything, us
    if row["short"]:
        rule = "INTERPOLATED" if row["interpolated"] else "SHORT_GAP"
        return rule, everything, us if last is None else last
    clips = state["clips"] = [(n + 1) if at else 0 for n, at in zip(
        state.get("clips", [0] * len(SENSOR_KEYS)), row["boundary"])]
    clipped = [k for k, n in zip(SENSOR_KEYS, clips) if n >= a.clip_rows]
    if clipped:
        return "CLIPPING", clipped, us
    stuck = row["stuck"]
    if any(stuck):
        worst = max(stuck)
        hit = [k for k, s in zip(SENSOR_KEYS, stuck) if s == worst or (worst == 1 and s)]
        return ("STUCK" if worst == 2 else "POSSIBLE_STUCK"), hit, min(starts[k] for k in hit)
    held, stepped, back, back_step = pending_next(state, us, values, row["medians"], row["abrupt"], a)
    since = {k: p["since"] for k, p in state["pending"].items()}
    open_now = [since[k] for k in held + stepped]
    if len(open_now) >= 2 and max(open_now) - min(open_now) <= a.correlation_s * 1e6:
        return "CORRELATED", held + stepped, min(open_now)
    for rule, found in (("PERSISTENT", stepped), ("ABRUPT", held), ("RESOLVED", back),
                        ("RESOLVED_STEP", back_step)):
        if found:
            if rule.startswith("RESOLVED"):
                for k in found:
                    del state["pending"][k]
            return rule, found, min(since[k] for k in found)
    for rule, flags in (("NOISE", row["noise"]), ("DRIFT", row["drift"])):
        found = [k for k, f in zip(SENSOR_KEYS, flags) if f]
        if found:
            return rule, found, us
    return "NONE", [], us


PENDING_STATE = "pending_json"


def _calm(state: dict) -> bool:
    """Whether a row without any evidence would change nothing but the time of the last row."""
    return ("clips" in state and "pending" in state and not state["pending"]
            and not any(state["clips"]) and not state.get("recovery"))


def _ladder_rows(rows: pd.DataFrame, state: dict, a: Anomaly) -> pd.DataFrame:
    """:func:`ladder_next` of every row; calm stretches without evidence are passed over at once."""
    def triple(suffix):
        return list(zip(*[rows[f"{k}{suffix}"].tolist() for k in SENSOR_KEYS]))

    def flag(name):
        return rows[name].fillna(False).to_numpy(bool)
    count, us = len(rows), rows["us"].tolist()
    confirmed = rows["confirmed"].fillna("").tolist()
    gap_s, features_ok = rows["gap_s"].to_numpy(float), flag("features_ok")
    short, interpolated = flag("short"), flag("interpolated")
    told = np.array([bool(c) for c in confirmed], dtype=bool) | (gap_s >= a.long_gap_s) | ~features_ok | short
    for k in SENSOR_KEYS:
        told |= rows[f"{k}__stuck"].to_numpy() > 0
        for n in ("boundary", "abrupt", "noise", "drift"):
            told |= flag(f"{k}__{n}")
    # The next row with evidence, for every row.
    ahead = np.minimum.accumulate(np.where(told, np.arange(count), count)[::-1])[::-1].tolist()
    cells = {"values": triple(""), "stuck": triple("__stuck"), "boundary": triple("__boundary"),
             "medians": triple("__recent_median"), "abrupt": triple("__abrupt"),
             "noise": triple("__noise"), "drift": triple("__drift")}
    plain = {"us": us, "gap_s": gap_s.tolist(), "features_ok": features_ok.tolist(),
             "short": short.tolist(), "interpolated": interpolated.tolist()}
    columns = list((cells | plain).items())
    began = triple("__since")
    rules, sensors, firsts, open_ = ["NONE"] * count, [""] * count, list(us), ["{}"] * count
    last, text = {}, "{}"
    i = 0
    while i < count:
        if ahead[i] > i and _calm(state):
            i = ahead[i]
            state["us"] = us[i - 1]
            continue
        row = {n: v[i] for n, v in columns}
        row["confirmed"] = [c for c in confirmed[i].split("|") if c]
        row["starts"] = dict(zip(SENSOR_KEYS, began[i]))
        rules[i], found, firsts[i] = ladder_next(state, row, a)
        if found:
            sensors[i] = "|".join(sorted(found))
        since = {k: p["since"] for k, p in state.get("pending", {}).items()}
        if since != last:
            last, text = since, json.dumps(since, sort_keys=True)
        open_[i] = text
        i += 1
    return pd.DataFrame({"us": us, "ingest_seq": rows["ingest_seq"].to_numpy(), "rule": rules, "sensors": sensors,
                         "first_us": firsts, PENDING_STATE: open_})


def _with_confirmations(df: DataFrame, confirmations: DataFrame | None) -> DataFrame:
    """Sensors confirmed faulty from outside, effective from their time onward.

    The newest confirmation of a sensor counts, so a machine has at most one per
    sensor and the table is folded to one small row per machine before the join.
    """
    if confirmations is None:
        return df.withColumn("confirmed", F.lit("")).withColumn("confirmed_us", F.lit(None).cast("long"))
    per_sensor = confirmations.groupBy("machine_id", "sensor").agg(
        F.max_by(F.struct("us", "evidence", "source", "actor"), "recorded").alias("c"))
    per_machine = per_sensor.groupBy("machine_id").agg(
        F.array_sort(F.collect_list(F.struct("sensor", "c.*"))).alias("_all"))
    rows = df.join(per_machine, "machine_id", "left").withColumn(
        "_on", F.filter("_all", lambda c: c["us"] <= F.col("us")))
    named = F.coalesce(F.array_join(F.transform("_on", lambda c: c["sensor"]), "|"), F.lit(""))

    def listed(field, sep):
        return F.array_join(F.array_sort(F.array_distinct(F.transform("_on", lambda c: c[field]))), sep)
    return rows.withColumns({
        "confirmed": named, "confirmed_us": F.array_min(F.transform("_on", lambda c: c["us"])),
        "confirmation_source": listed("source", "|"), "confirming_actor": listed("actor", "|"),
        "confirmation_evidence": F.array_join(F.transform("_on", lambda c: c["evidence"]), " | "),
    }).drop("_all", "_on")


def external_confirmation(df: DataFrame, confirmations: DataFrame) -> DataFrame:
    return _with_confirmations(df, confirmations)


def detect(df: DataFrame, params: Params = DEFAULT, *, keys: Sequence[str] = LIFE,
           confirmations: DataFrame | None = None) -> DataFrame:
    """Findings of every row, with what they mean for features, forecasts and training.

    Optional input columns: ``interpolated``, ``source_interval_s``,
    ``features_available``. ``df`` needs ``raw_status`` and ``slice``.
    """
    if not params.anomaly.enabled:
        return describe(pass_through(df), params)
    a = params.anomaly
    rows = _with_confirmations(short_gap(df, params, keys), confirmations)
    rows = rows.withColumn("features_ok", _features_ok(rows)).withColumn(
        "interpolated", _interpolated(rows)).withColumn("short", F.col("short_gap"))
    rows = cut(context_events(rows, keys).withColumns(
        {f"{k}__boundary": at_boundary(k, a) for k in SENSOR_KEYS}))
    need = [*keys, "slice", "us", "ingest_seq", *SENSOR_KEYS, "gap_s", "features_ok", "short",
            "interpolated", "confirmed",
            *[f"{k}__{n}" for k in SENSOR_KEYS
              for n in ("stuck", "since", "boundary", "recent_median", "abrupt", "noise", "drift")]]
    place = [*keys, "slice", "us", "ingest_seq"]
    runs = constancy(rows.select(*place, *SENSOR_KEYS, *[f"{k}__context" for k in SENSOR_KEYS]), params, keys).select(
        *place, *[f"{k}__{n}" for k in SENSOR_KEYS for n in ("stuck", "since")])
    own = {c for c in need if not c.endswith(tuple(f"__{n}" for n, _ in EVIDENCE)) and not c.endswith(("__stuck", "__since"))}
    narrow = rows.select(*[c for c in need if c in own]).join(runs, place)
    found = sliced_fold(neighbourhood(narrow, a, keys).select(*need), keys, lambda r, s: _ladder_rows(r, s, a),
                        "us bigint, ingest_seq bigint, rule string, sensors string, "
                        f"first_us bigint, {PENDING_STATE} string")
    extra = [c for c in ("confirmed_us", "confirmation_source", "confirming_actor",
                         "confirmation_evidence") if c in rows.columns]
    base = rows.select(*[c for c in df.columns], "missing_samples",
                       *[c for c in ("gap_s",) if c not in df.columns],
                       *[c for c in extra if c not in df.columns],
                       *[c for c in ("interpolated",) if c not in df.columns])
    return describe(base.join(found.drop("slice"), [*keys, "us", "ingest_seq"]), params)


def pass_through(df: DataFrame) -> DataFrame:
    """Detector off: every row is usable and carries no finding."""
    return df.withColumns({
        "rule": F.lit("NONE"), "sensors": F.lit(""), "first_us": F.col("us"),
        PENDING_STATE: F.lit("{}"), "missing_samples": F.lit(0), "gap_s": F.lit(0.0),
        "confirmed_us": F.lit(None).cast("long"), "interpolated": _interpolated(df)})


def _lookup(rule: Column, index: int) -> Column:
    out = F.lit(FINDINGS["NONE"][index])
    groups: dict = {}
    for name, row in FINDINGS.items():
        groups.setdefault(row[index], []).append(name)
    for value, names in groups.items():
        if value != FINDINGS["NONE"][index]:
            out = F.when(rule.isin(*names), F.lit(value)).otherwise(out)
    return out


def usability(action: Column) -> dict[str, Column]:
    """What a model action allows."""
    held = action == "HOLD_FOR_CONFIRMATION"
    stopped = action.isin("SUSPEND_PREDICTION", "REFUSE_PREDICTION")
    use_features = ~(held | stopped | (action == "EXCLUDE_CURRENT_READING_FROM_TREND"))
    return {"use_for_features": use_features, "use_for_prediction": ~(held | stopped),
            "feature_history_action": F.when(held, "HOLD_OUTSIDE_FEATURE_HISTORY").when(
                ~use_features, "DISCARD_FROM_FEATURE_HISTORY").otherwise("COMMIT_TO_FEATURE_HISTORY")}


def confidence_multiplier(penalty: Column, floor: float = 0.0) -> Column:
    out = F.lit(1.0)
    for name, value in PENALTIES.items():
        out = F.when(penalty == name, value).otherwise(out)
    return F.greatest(out, F.lit(float(floor)))


def safety_action(status: Column) -> Column:
    return (F.when(status == 2, "IMMEDIATE_MANUFACTURER_CRITICAL_ACTION")
            .when(status == 1, "PRESERVE_MANUFACTURER_WARNING_ACTION")
            .otherwise("CONTINUE_MANUFACTURER_MONITORING"))


def describe(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Attributes of the finding named in ``rule``."""
    rule = F.col("rule")
    rows = df.withColumns({n: _lookup(rule, i) for i, n in enumerate(FIELDS)})
    final = F.lit("PENDING_OR_SAME_AS_CAUSAL")
    for name, value in FINAL.items():
        final = F.when(rule == name, value).otherwise(final)
    found = rule != "NONE"
    return rows.withColumns({
        **usability(F.col("model_action")),
        "confidence_multiplier": confidence_multiplier(
            F.col("penalty"), params.anomaly.confidence_floor),
        "safety_action": safety_action(F.col("raw_status")),
        "final_offline_classification": final,
        "affected_sensors": F.col("sensors"),
        "first_observed_us": F.when(found, F.col("first_us")),
        "confirmed_at_us": F.when(rule == "CONFIRMED", F.col("confirmed_us")).when(
            ~found & (F.col("raw_status") == 2), F.col("us")),
        "suspicion_us": F.when(rule.isin("STUCK", "POSSIBLE_STUCK", "PERSISTENT"), F.col("us")),
        "resolved_us": F.when(rule.startswith("RESOLVED"), F.col("us")),
        "commit": F.col("model_action").isin("USE_NORMALLY", "USE_WITH_REDUCED_CONFIDENCE",
                                             "EXCLUDE_FROM_RETRAINING")}).drop("penalty", "sensors")


def evidence_text(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One readable line per finding."""
    a, rule, who = params.anomaly, F.col("rule"), F.regexp_replace("affected_sensors", r"\\|", ", ")
    gap = F.col("gap_s")
    text = (F.when(rule == "CONFIRMED", F.coalesce(
                F.col("confirmation_evidence") if "confirmation_evidence" in df.columns
                else F.lit(None).cast("string"), F.lit("external confirmation")))
            .when(rule == "LONG_GAP", F.format_string(f"source gap %.0fs exceeds {a.long_gap_s:.0f}s", gap))
            .when(rule.startswith("RECOVERY"), F.lit("additional valid samples required after a long gap"))
            .when(rule.isin("SHORT_GAP", "INTERPOLATED"), F.format_string(
                f"source interval=%.0fs; expected={params.cadence.expected_s:.0f}s; "
                "estimated missing samples=%d", gap, F.col("missing_samples").cast("int")))
            .when(rule == "CLIPPING", F.concat(who, F.lit(" repeated at a physical boundary")))
            .when(rule.isin("STUCK", "POSSIBLE_STUCK"), F.concat(who, F.format_string(
                " unchanged for %.0fs while related context changed",
                (F.col("us") - F.col("first_us")) / 1e6)))
            .when(rule.isin("CORRELATED", "PERSISTENT", "ABRUPT"), F.concat(
                who, F.lit(" moved abruptly from the recent median")))
            .when(rule.startswith("RESOLVED"), F.concat(who, F.lit(" returned to the level before the change")))
            .when(rule == "NOISE", F.concat(who, F.lit(" detrended variability rose")))
            .when(rule == "DRIFT", F.concat(who, F.lit(" moved steadily in one direction"))))
    return df.withColumn("supporting_evidence", F.array_compact(F.array(text)))


def confirmed_critical_quality(df: DataFrame) -> DataFrame:
    """A time-confirmed critical event overrides the quality status."""
    critical = F.col("event_status") >= 2
    return df.withColumns({
        "quality_status": F.when(critical, "CONFIRMED_MACHINE_CRITICAL").otherwise(F.col("quality_status")),
        "confirmed_at_us": F.coalesce("confirmed_at_us", F.when(critical, F.col("us")))})


# ---- rejected rows ---------------------------------------------------------------

def classify_invalid(df: DataFrame) -> DataFrame:
    """Anomaly type and safety action of rows the validator rejected."""
    text = F.lower("reason")
    kind = (F.when(text.contains("duplicate timestamp"), "DUPLICATE_TIMESTAMP")
            .when(text.contains("earlier than") | text.contains("out of order"), "OUT_OF_ORDER_TIMESTAMP")
            .when(text.contains("outside valid range") | text.contains("jump limit"), "OUT_OF_RANGE")
            .otherwise("MALFORMED_VALUE"))
    safety = (F.when(F.col("raw_safety_status") == "CRITICAL", "IMMEDIATE_MANUFACTURER_CRITICAL_ACTION")
              .when(F.col("raw_safety_status") == "WARNING", "PRESERVE_MANUFACTURER_WARNING_ACTION")
              .otherwise("PRESERVE_ANY_PARSEABLE_RAW_MANUFACTURER_ALERT; DO_NOT_ASSUME_SAFE"))
    return df.withColumns({
        "quality_status": F.lit("INVALID_SENSOR_DATA"), "anomaly_types": kind,
        "anomaly_severity": F.lit("HIGH"), "anomaly_confidence": F.lit(1.0),
        "suspected_origin": F.lit("input_or_sensor_data"), "safety_action": safety,
        "model_action": F.lit("REFUSE_PREDICTION"), "confidence_multiplier": F.lit(0.0),
        "training_eligible": F.lit(False), "anomaly_is_active": F.lit(True),
        "training_exclusion_reason": F.concat(F.lit("invalid_sensor_data:"), kind),
        "requires_human_review": F.lit(True), "supporting_evidence": F.array("reason")})


# ---- roll-ups ----------------------------------------------------------------------

AUXILIARY = ("NONE", "ORIGIN_UNCERTAIN", "SENSOR_DISAGREEMENT")


def primary_type(types: Column) -> Column:
    """First type that says something, else the first that is not NONE, else NONE."""
    listed = F.split(types, r"\|")
    telling = F.filter(listed, lambda t: ~t.isin(*AUXILIARY))
    some = F.filter(listed, lambda t: t != "NONE")
    return F.coalesce(F.get(telling, F.lit(0)), F.get(some, F.lit(0)), F.lit("NONE"))


def interval_next(open_: dict, seq: int, kind: str, sensors: str, active: bool) -> tuple[str | None, list[str]]:
    """Episode that a row belongs to, or None, and the episodes it ends.

    An open episode matches a row of the same primary type and sensor set. A row
    ends every other open episode that has a sensor the row does not hold active.
    """
    hit, ended = None, []
    quiet = set(SENSOR_KEYS) - (set(sensors.split("|")) if active else set())
    for number, (k, s) in list(open_.items()):
        if k == kind and s == sensors:
            hit = number
        elif set(s.split("|")) & quiet:
            ended.append(number)
            del open_[number]
    if kind == "NONE" or not sensors:
        return None, ended
    if hit is None:
        hit = str(seq)
        if active:
            open_[hit] = [kind, sensors]
    elif not active:
        ended.append(hit)
        del open_[hit]
    return hit, ended


def interval_marks(df: DataFrame, keys: Sequence[str] = ("machine_id",)) -> DataFrame:
    """Number the episode each finding belongs to and list the episodes it ends.

    In the fold an episode goes by the sequence number of its first row; the
    running number is counted afterwards.
    """
    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        open_ = state.setdefault("open", {})
        out = []
        for us, seq, kind, sensors, active in zip(*[rows[c].tolist() for c in (
                "us", "ingest_seq", "primary_type", "affected_sensors", "anomaly_is_active")]):
            hit, ended = interval_next(open_, seq, kind, sensors, active)
            if hit is not None or ended:
                out.append([us, seq, int(hit) if hit else None, [int(e) for e in ended]])
        return pd.DataFrame({"us": [o[0] for o in out], "ingest_seq": [o[1] for o in out],
                             "opened_by": pd.array([o[2] for o in out], dtype="Int64"),
                             "ended": [o[3] for o in out]})

    narrow = df.select(*keys, "slice", "us", "ingest_seq",
                       primary_type(F.col("anomaly_types")).alias("primary_type"),
                       "affected_sensors", "anomaly_is_active")
    marks = cut(sliced_fold(narrow, keys, step,
                            "us bigint, ingest_seq bigint, opened_by bigint, ended array<bigint>"))
    opens = (F.col("opened_by") == F.col("ingest_seq")).cast("long")
    numbers = scan(marks, keys, total={"interval_no": F.coalesce(opens, F.lit(0).cast("long"))}).filter(
        F.col("opened_by") == F.col("ingest_seq")).select(*keys, "opened_by", "interval_no")
    return marks.join(numbers, [*keys, "opened_by"], "left")


SEVERITY_RANK = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def anomaly_intervals(df: DataFrame, keys: Sequence[str] = ("machine_id",)) -> DataFrame:
    """One row per episode. Distinct actions are listed in order of first use."""
    marks = cut(interval_marks(df, keys))
    key = [*keys, "interval_no"]
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("anomaly_severity"))
    members = (marks.filter("interval_no is not null").drop("slice", "ended", "opened_by")
               .join(df.select(*keys, "us", "ingest_seq", "anomaly_types", "affected_sensors",
                               "anomaly_severity", "anomaly_confidence", "safety_action", "model_action",
                               "anomaly_is_active", "first_observed_us", "confirmed_at_us", "suspicion_us",
                               "resolved_us", "final_offline_classification"),
                     [*keys, "us", "ingest_seq"]))
    place = F.struct("us", "ingest_seq")
    head = members.groupBy(*key).agg(
        F.min_by(F.struct(primary_type(F.col("anomaly_types")).alias("anomaly_type"), "affected_sensors",
                          "first_observed_us", F.coalesce(
                              "confirmed_at_us", "suspicion_us", "us").alias("decision_us")), place).alias("h"),
        F.max(rank).alias("_rank"), F.max("anomaly_confidence").alias("maximum_confidence"),
        F.count("*").alias("event_row_count"), F.max("us").alias("_last_us"),
        F.max("resolved_us").alias("_resolved_us"),
        F.max_by("final_offline_classification", place).alias("final_offline_classification"))

    def in_order(column):
        seen = members.groupBy(*key, column).agg(F.min(place).alias("_at"))
        return seen.groupBy(*key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("_at", column))), lambda x: x[column]).alias(column + "s"))
    numbers = marks.filter("opened_by = ingest_seq").select(*keys, "opened_by", "interval_no")
    closed = (marks.select(*keys, "us", F.explode("ended").alias("opened_by"))
              .join(numbers, [*keys, "opened_by"]).groupBy(*key).agg(F.max("us").alias("_closed_us")))
    rows = (head.join(in_order("safety_action"), key).join(in_order("model_action"), key)
            .join(closed, key, "left"))
    end = F.coalesce("_closed_us", "_resolved_us")
    return rows.select(
        *keys, F.format_string("anomaly_interval_%08d", "interval_no").alias("interval_id"), "h.*",
        end.alias("end_us"), F.greatest(F.lit(0.0), (F.coalesce(end, F.col("_last_us"))
                                                     - F.col("h.first_observed_us")) / 1e6).alias("duration_s"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("_rank").cast("int"))
        .alias("maximum_severity"), "maximum_confidence", "safety_actions", "model_actions",
        end.isNull().alias("active"), "final_offline_classification", "event_row_count",
        F.coalesce(end, F.col("_last_us")).alias("latest_update_us"))


def anomaly_state(df: DataFrame, keys: Sequence[str] = ("machine_id",)) -> DataFrame:
    """Current finding per sensor and the time its last finding ended."""
    held = F.col("anomaly_is_active")
    per = df.select(*keys, "slice", "us", "ingest_seq", "anomaly_types", "quality_status", "safety_action",
                    "model_action", "first_observed_us",
                    F.explode(F.array(*[F.struct(
                        F.lit(k).alias("sensor"),
                        (held & F.array_contains(F.split("affected_sensors", r"\|"), k)).alias("on"))
                        for k in SENSOR_KEYS])).alias("s")).select("*", "s.*").drop("s")
    per = scan(per, [*keys, "sensor"], lag={"_was": "on"})
    place = F.struct("us", "ingest_seq")
    latest = per.groupBy(*keys, "sensor").agg(
        F.max_by(F.struct("on", "anomaly_types", "quality_status", "first_observed_us", "us",
                          "safety_action", "model_action"), place).alias("l"),
        F.max(F.when(~F.col("on") & F.col("_was"), F.col("us"))).alias("_edge"))
    on = F.col("l.on")
    return latest.select(
        *keys, "sensor", F.when(on, F.col("l.anomaly_types")).otherwise("NONE").alias("current_anomaly_type"),
        F.when(on, F.col("l.quality_status")).otherwise("NORMAL").alias("quality_status"),
        on.alias("active"), F.when(on, F.col("l.first_observed_us")).alias("first_observed_us"),
        F.col("l.us").alias("latest_update_us"), F.when(~on, F.col("_edge")).alias("resolution_us"),
        F.col("l.safety_action").alias("safety_action"),
        F.when(on, F.col("l.model_action")).otherwise("USE_NORMALLY").alias("model_action"))


def anomaly_events(df: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Append-only log: rows with a finding, and rejected rows."""
    cols = ["machine_id", "us", "ingest_seq", "quality_status", "anomaly_types", "model_action",
            "anomaly_is_active", "affected_sensors", "training_eligible"]
    log = df.filter(F.exists(F.split("anomaly_types", r"\|"), lambda t: t != "NONE")).select(*cols)
    if invalid is None:
        return log
    return log.unionByName(invalid.withColumn("affected_sensors", F.lit("")).select(*cols))


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Row counts by quality status, by type and by action, and the stuck subsets."""
    long = df.select(F.explode(F.array(
        F.struct(F.lit("quality_status").alias("dimension"), F.col("quality_status").alias("item")),
        F.struct(F.lit("anomaly_type").alias("dimension"), F.col("anomaly_types").alias("item")),
        F.struct(F.lit("model_action").alias("dimension"), F.col("model_action").alias("item")),
        F.struct(F.lit("stuck").alias("dimension"), F.when(
            F.col("anomaly_types").like("%STUCK_SENSOR_CONFIRMED%"), "confirmed").when(
            F.col("anomaly_types").like("%STUCK_SENSOR_SUSPECTED%"), "suspected").when(
            F.col("anomaly_types").like("%POSSIBLE_STUCK%"), "possible").alias("item")))).alias("x"))
    return (long.select("x.*").filter(F.col("item").isNotNull()).groupBy("dimension", "item")
            .agg(F.count("*").alias("rows")).orderBy("dimension", F.col("rows").desc(), "item"))


def reconcile_counts(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Full outer join of two count tables with the difference per group."""
    left = a.groupBy(*by).agg(F.count("*").alias("rows_a"))
    right = b.groupBy(*by).agg(F.count("*").alias("rows_b"))
    x, y = F.coalesce("rows_a", F.lit(0)), F.coalesce("rows_b", F.lit(0))
    return left.join(right, list(by), "full").select(
        *by, x.alias("rows_a"), y.alias("rows_b"), (x == y).alias("equal"))


def export_intervals(intervals: DataFrame) -> DataFrame:
    """Flat, ordered rows for a text sink."""
    return intervals.withColumns({
        "sensor_count": F.size(F.split("affected_sensors", r"\|")),
        "safety_actions": F.to_json("safety_actions"), "model_actions": F.to_json("model_actions"),
    }).orderBy("machine_id", "first_observed_us", "interval_id")


def explain(df: DataFrame, at_us: int | None = None) -> DataFrame:
    """Latest decision per machine, or the one at a given time."""
    rows = df if at_us is None else df.filter(F.col("us") == at_us)
    cols = [c for c in rows.columns if c != "machine_id"]
    return rows.groupBy("machine_id").agg(F.max_by(
        F.struct(*cols), F.struct("us", "ingest_seq")).alias("r")).select("machine_id", "r.*")


