"""Keyed sequential operators: smoothing, lifecycle resets, healthy baseline, hysteresis."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import baseline, steps
from fleetpulse.params import DEFAULT, HOUR_US, MINUTE_US, SENSOR_KEYS, SENSORS, Lifecycle, Params
from fleetpulse.plans.fold import Phases, sliced_fold
from fleetpulse.plans.shared import cut
from fleetpulse.plans.slices import ORDER, equal_slices, scan

MACHINE = ("machine_id",)
LIFE = ("machine_id", "lifecycle_id")
SIGNALS = ("rolling_median", "fast_ewma", "slow_ewma", "kalman_level", "kalman_rate_per_hour")
BASELINE_ROWS = 20_000
FOLD_WIDTH_US = 7 * 24 * 3_600_000_000


def _signal_fields() -> list[str]:
    return [f"{k}__{n}" for k in SENSOR_KEYS for n in SIGNALS]


def _flat(signals) -> list[float]:
    out = []
    for mid, fast, slow, level, rate in signals:
        out += [mid, fast, slow, level, rate * 3600.0]
    return out


def smoothed(df: DataFrame, keys: Sequence[str] = LIFE, params: Params = DEFAULT,
             carry: Sequence[str] = ()) -> DataFrame:
    """EWMAs, level/rate filters and the degradation filter of every row.

    A boolean ``commit`` column marks rows that enter the state; the others are
    previewed. Without it every row commits. ``carry`` names columns to keep.
    """
    has_commit = "commit" in df.columns
    names = [*_signal_fields(), "smoothed_severity", "degradation", "degradation_rate_per_hour"]
    kept = [c for c in (*ORDER, *SENSOR_KEYS, *(["commit"] if has_commit else []), *carry)]
    kept = list(dict.fromkeys(c for c in kept if c not in keys))

    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        us = rows["us"].tolist()
        cells = list(zip(*[rows[k].tolist() for k in SENSOR_KEYS]))
        commit = rows["commit"].tolist() if has_commit else [True] * len(us)
        last, out = state.get("us"), []
        for t, values, keep in zip(us, cells, commit):
            dt = 1.0 if last is None else max((t - last) / 1e6, 1e-6)
            last = t
            signals = steps.smooth_next(state, values, dt, keep, params.smoothing)
            worst = max(steps.severity_number(s[3], k) for k, s in zip(SENSOR_KEYS, signals))
            level, rate = steps.degrade_next(state, worst, dt, params.smoothing)
            out.append([*_flat(signals), worst, level, rate * 3600.0])
        state["us"] = last
        return pd.concat([rows[kept], pd.DataFrame(out, columns=names)], axis=1)

    fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*kept).schema]
                       + [f"{n} double" for n in names])
    narrow = df.select(*keys, "slice", *kept)
    return (sliced_fold(narrow, keys, step, fields)
            .withColumn("health_percent", F.greatest(F.lit(0.0), F.least(
                F.lit(100.0), (1.0 - F.least(F.col("degradation"), F.lit(1.0))) * 100.0))))


LIFE_ROW = ("us bigint, ingest_seq bigint, stabilized_status int, event_status int, "
            "lifecycle_state string, reset_confidence string, reset_reason string, closed string")
CLOSED = ("end_us bigint, reset_us bigint, critical_reached boolean, confidence string, "
          "reason string, pre map<string,double>, post map<string,double>")


def _life_row(us, seq, status, event, r) -> list:
    return [us, seq, status, event, r["phase"], r["confidence"], r["reason"],
            json.dumps(r["closed"]) if r["closed"] else None]


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lifecycle number and elapsed hours: counts over the rows that confirm a reset."""
    end = F.get_json_object("closed", "$.end_us").cast("bigint")
    rows = scan(rows, keys, total={"_closed": F.col("closed").isNotNull().cast("long")},
                last={"_start": end})
    first = rows.groupBy(*keys).agg(F.min("us").alias("_first"))
    start = F.coalesce("_start", "_first")
    return rows.join(first, list(keys)).withColumns({
        "lifecycle_number": (F.col("_closed") + 1).cast("int"), "lifecycle_start_us": start,
        "elapsed_lifecycle_hours": F.greatest(F.lit(0.0), (F.col("us") - start) / 3.6e9),
    }).drop("_closed", "_start", "_first")


def _quiet_life(phase: str, critical: int | None) -> dict:
    """A lifecycle state whose clocks have all run out."""
    return {"young": None, "phase": phase, "degraded": None, "critical": critical, "candidate": None, "trail": [], "cooling": None}


def _life_phases(wrapped: bool, p: Lifecycle) -> Phases:
    """Entries by phase and by whether there was a critical event; what else a state holds is soon forgotten."""
    lives = {f"{phase}{'!' if critical is not None else ''}": _quiet_life(phase, critical)
             for phase in ("HEALTHY", "DEGRADING") for critical in (None, 0)}

    def of(state: dict) -> str:
        life = state.get("life", {}) if wrapped else state
        if not life:
            return "HEALTHY"
        return ("HEALTHY" if life["phase"] == "HEALTHY" else "DEGRADING") + ("!" if life["critical"] is not None else "")

    limits = {"young": p.min_life_h * HOUR_US, "cooling": p.cooldown_h * HOUR_US, "critical": p.critical_before_reset_min * MINUTE_US}

    def carry(before: dict, exit: dict) -> dict:
        old, new = (s.get("life", {}) if wrapped else s for s in (before, exit))
        if not old or not new["trail"]:
            return exit
        end = new["trail"][-1][0]
        # A clock that ran before the slice runs on, unless a reset in the slice set it anew or it has passed.
        open_ = {c: old[c] for c, limit in limits.items() if old[c] and not new[c] and end - old[c] < limit
                 and (c != "critical" or new[c] == 0)}
        return exit | {"life": new | open_} if wrapped else exit | open_

    return Phases({k: {"life": v} if wrapped else v for k, v in lives.items()}, of, carry)


def detect_lifecycles(df: DataFrame, keys: Sequence[str] = MACHINE,
                      params: Params = DEFAULT) -> DataFrame:
    """Reset inference over given status, event status, smoothed levels and severity."""
    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        cols = [rows[c].tolist() for c in ("us", "ingest_seq", "stabilized_status", "event_status")]
        levels = list(zip(*[rows[f"{k}__kalman_level"].tolist() for k in SENSOR_KEYS]))
        out = [_life_row(us, seq, st, ev, steps.lifecycle_next(
                   state, us, st, ev, lv, sev, params.lifecycle))
               for us, seq, st, ev, lv, sev in zip(*cols, levels, rows["smoothed_severity"].tolist())]
        return pd.DataFrame(out, columns=_columns(LIFE_ROW))

    need = [*ORDER, "stabilized_status", "event_status", "smoothed_severity",
            *[f"{k}__kalman_level" for k in SENSOR_KEYS]]
    found = sliced_fold(df.select(*keys, "slice", *need), keys, step, LIFE_ROW, phases=_life_phases(False, params.lifecycle))
    return _numbered(cut(found), keys)


def discover_lifecycles(df: DataFrame, params: Params = DEFAULT,
                        keys: Sequence[str] = MACHINE) -> DataFrame:
    """First pass of a replay: find resets with rules, smoothing and status feedback."""
    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        cells = zip(*[rows[k].tolist() for k in SENSOR_KEYS])
        out = []
        for us, seq, values in zip(rows["us"].tolist(), rows["ingest_seq"].tolist(), cells):
            r = steps.online_next(state, us, values, params)
            out.append([*_life_row(us, seq, r["status"], r["event"], r), r["raw"]])
        return pd.DataFrame(out, columns=[*_columns(LIFE_ROW), "raw_status"])

    found = sliced_fold(df.select(*keys, "slice", *ORDER, *SENSOR_KEYS), keys, step,
                        LIFE_ROW + ", raw_status int", phases=_life_phases(True, params.lifecycle))
    return _numbered(cut(found), keys)


def closed_lifecycles(life_rows: DataFrame, keys: Sequence[str] = MACHINE) -> DataFrame:
    """Completed lifecycles as a table: one row each, with its first events and worst status."""
    n = F.col("lifecycle_number")
    ends = life_rows.filter(F.col("closed").isNotNull()).select(
        *keys, (n - 1).alias("lifecycle_number"), F.from_json("closed", CLOSED).alias("c"))

    def first(column, level):
        return F.min(F.when(F.col(column) >= level, F.col("us")))
    facts = life_rows.groupBy(*keys, "lifecycle_number").agg(
        F.min("lifecycle_start_us").alias("start_us"), F.max("event_status").alias("highest_status"),
        first("stabilized_status", 1).alias("first_raw_warning_us"),
        first("stabilized_status", 2).alias("first_raw_critical_us"),
        first("event_status", 1).alias("first_confirmed_warning_us"),
        first("event_status", 2).alias("first_confirmed_critical_us"))
    return ends.join(facts, [*keys, "lifecycle_number"]).select(
        *keys, F.concat(F.lit("lifecycle_"), F.lpad(n.cast("string"), 4, "0")).alias("lifecycle_id"),
        "start_us", "c.*", F.greatest(F.lit(0.0), (F.col("c.end_us") - F.col("start_us")) / 3.6e9)
        .alias("duration_hours"), "highest_status", "first_raw_warning_us", "first_raw_critical_us",
        "first_confirmed_warning_us", "first_confirmed_critical_us")


def healthy_baseline(df: DataFrame, params: Params = DEFAULT, keys: Sequence[str] = MACHINE,
                     slice_rows: int | None = BASELINE_ROWS) -> DataFrame:
    """Adaptive healthy mean, deviation and sample count after each row.

    ``df`` needs a boolean ``teach`` column: rows allowed to move the baseline.
    It survives lifecycle boundaries, so it is keyed by machine and carries only
    the columns it reads. Slices report maps that compose (see ``baseline``). They are made
    here, of ``slice_rows`` rows (None: as they are), so that few rounds are needed and no task holds more.
    """
    names = [f"{k}__{n}" for k in SENSOR_KEYS for n in ("baseline_mean", "baseline_std")]
    took = [f"_took_{k}" for k in SENSOR_KEYS]
    p = params.prognostics

    def tracks(rows: pd.DataFrame) -> list[baseline.Track]:
        teach = rows["teach"].fillna(False).to_numpy(bool)
        return [baseline.Track(rows[s.key].to_numpy(float, na_value=float("nan")), teach, s, p) for s in SENSORS]

    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        own, was = tracks(rows), state.get("was")
        for track, entry in zip(own, state.get("at") or [t.guess() for t in own]):
            track.follow(*entry)
        maps = [t.summary() for t in own]
        state.clear()
        state["maps"] = was if baseline.agree(maps, was) else maps
        out = {n: v for n, v in zip(names, (v for t in own for v in (t.mean, np.sqrt(t.variance))))}
        return pd.concat([rows[list(ORDER)], pd.DataFrame(out | {c: t.taken.astype("int64") for c, t in zip(took, own)})], axis=1)

    start = [baseline.Track(np.zeros(0), np.zeros(0, bool), s, p).start for s in SENSORS]
    limit = p.baseline_min_samples

    def compose(exits: list[str]) -> list[str]:
        return baseline.composed(start, exits, limit)

    ddl = ", ".join(["us bigint", "ingest_seq bigint", *[f"{n} double" for n in names],
                     *[f"{n} bigint" for n in took]])
    if slice_rows:
        df = equal_slices(df, keys, slice_rows)
    found = sliced_fold(df.select(*keys, "slice", *ORDER, "teach", *SENSOR_KEYS), keys, step, ddl, compose=compose)
    return scan(cut(found), keys, total={
        f"{k}__baseline_samples": f"_took_{k}" for k in SENSOR_KEYS}).drop(*took)


def persistence_minutes(target: Column, params: Params = DEFAULT) -> Column:
    p = params.prognostics
    return F.when(target.startswith("probability_warning_"), p.warning_persist_min).when(
        target.startswith("probability_critical_"), p.critical_persist_min).otherwise(30.0)


def alert_latches(df: DataFrame, latches: dict[str, tuple[Column, Column, Column]],
                  params: Params = DEFAULT, keys: Sequence[str] = LIFE) -> DataFrame:
    """Operational alerts with slow release, as latches over islands.

    ``latches`` maps an output column to (probability, threshold, minutes to
    switch on). A latch goes on when the probability has stayed at or above the
    threshold long enough, off when it has stayed below the release border long
    enough, and off at once without a probability.
    """
    p = params.prognostics
    zones = {f"_zone_{n}": F.when(v.isNull(), "none").when(v >= t, "above")
             .when(v < t * p.release_fraction, "below").otherwise("between")
             for n, (v, t, _) in latches.items()}
    waits = {f"_wait_{n}": (w * MINUTE_US).cast("long") for n, (_, _, w) in latches.items()}
    rows = scan(df.withColumns(zones | waits), keys, lag={f"_prev_{n}": f"_zone_{n}" for n in latches})
    # Three dependent scans would read their input four times; one table between
    # them keeps the work linear.
    rows = cut(rows)

    def opens(n, zone):
        return F.when((F.col(f"_zone_{n}") == zone)
                      & ~F.col(f"_prev_{n}").eqNullSafe(F.lit(zone)), F.col("us"))
    rows = scan(rows, keys, last={f"_{z}_{n}": opens(n, z) for n in latches for z in ("above", "below")})
    release = int(p.release_min * MINUTE_US)
    events = {f"_set_{n}": F.when(F.col(f"_zone_{n}") == "none", 0)
              .when((F.col(f"_zone_{n}") == "above")
                    & (F.col("us") - F.col(f"_above_{n}") >= F.col(f"_wait_{n}")), 1)
              .when((F.col(f"_zone_{n}") == "below")
                    & (F.col("us") - F.col(f"_below_{n}") >= release), 0) for n in latches}
    rows = scan(rows.withColumns(events), keys, last={f"_on_{n}": f"_set_{n}" for n in latches})
    return rows.select(*df.columns, *[(F.coalesce(F.col(f"_on_{n}"), F.lit(0)) == 1).alias(n)
                                      for n in latches])


def alert_hysteresis(df: DataFrame, params: Params = DEFAULT,
                     keys: Sequence[str] = (*LIFE, "target")) -> DataFrame:
    """Long form: one row per target with ``probability``, ``threshold``, ``withheld``."""
    value = F.when(~F.col("withheld"), F.col("probability"))
    return alert_latches(df, {"active": (value, F.col("threshold"),
                                         persistence_minutes(F.col("target"), params))}, params, keys)


def validate(df: DataFrame, params: Params = DEFAULT, keys: Sequence[str] = MACHINE) -> DataFrame:
    """Accept or reject readings in arrival order.

    Checks in order: label, repeated time, time before the last accepted one, and
    per sensor range then jump. Rejected rows never move the state. ``slice`` must
    grow with ``ingest_seq``. The fold only needs the last accepted row; whether a
    late time was a repeat is settled by an equi-join with the accepted rows.
    """
    jumps = [params.smoothing.jump_multiplier * s.span for s in SENSORS]
    ranges = [(s.low, s.high) for s in SENSORS]

    def step(rows: pd.DataFrame, state: dict) -> pd.DataFrame:
        verdicts = []
        cells = zip(*[rows[k].tolist() for k in SENSOR_KEYS])
        for us, label_ok, values in zip(rows["us"].tolist(), rows["label_known"].tolist(), cells):
            last = state.get("last")
            verdict = ""
            if not label_ok:
                verdict = "label"
            elif last is not None and us <= last[0]:
                verdict = "time"
            else:
                for i, (v, (lo, hi), limit) in enumerate(zip(values, ranges, jumps)):
                    if v is None or v != v or v in (float("inf"), float("-inf")):
                        verdict = f"finite:{i}"
                    elif not lo <= v <= hi:
                        verdict = f"range:{i}"
                    elif last is not None and abs(v - last[1][i]) > limit:
                        verdict = f"jump:{i}:{abs(v - last[1][i]):.3f}"
                    if verdict:
                        break
            if not verdict:
                state["last"] = [us, list(values)]
            verdicts.append(verdict)
        return pd.concat([rows[["us", "ingest_seq"]], pd.Series(verdicts, name="verdict")], axis=1)

    narrow = df.select(*keys, "slice", "us", "ingest_seq", "label_known", *SENSOR_KEYS)
    judged = sliced_fold(narrow, keys, step, "us bigint, ingest_seq bigint, verdict string",
                         order=("ingest_seq",))
    accepted = judged.filter("verdict = ''").select(
        *keys, F.col("us"), F.col("ingest_seq").alias("_first_seq"))
    judged = judged.join(accepted, [*keys, "us"], "left").drop("slice").join(
        df.select(*keys, "ingest_seq", "label", *SENSOR_KEYS), [*keys, "ingest_seq"])
    part = F.split("verdict", ":")
    which = F.get(part, F.lit(1)).cast("int")
    key = F.element_at(F.array(*[F.lit(k) for k in SENSOR_KEYS]), which + 1)
    value = F.element_at(F.array(*[F.col(k) for k in SENSOR_KEYS]), which + 1)
    out_of_range = F.element_at(F.array(*[F.concat(
        F.lit(f"{s.label} "), value.cast("string"), F.lit(
            f" {s.unit} lies outside [{s.low}, {s.high}]"))
        for s in SENSORS]), which + 1)
    limit = F.element_at(F.array(*[F.lit(f"{j:.3f}") for j in jumps]), which + 1)
    kind = F.get(part, F.lit(0))
    reason = (F.when(kind == "", "")
              .when(kind == "label", F.concat(
                  F.lit("label not known: '"), F.col("label"), F.lit("'")))
              .when((kind == "time") & (F.col("_first_seq") < F.col("ingest_seq")),
                    "duplicate timestamp")
              .when(kind == "time", "time earlier than an accepted row")
              .when(kind == "finite", F.concat(key, F.lit(" has no finite value")))
              .when(kind == "range", out_of_range)
              .otherwise(F.concat(
                  F.lit(""), key, F.lit(" changed by "), F.get(part, F.lit(2)),
                  F.lit(", over the jump limit "), limit)))
    verdicts = judged.select(*keys, "ingest_seq", (F.col("verdict") == "").alias("valid"),
                             reason.alias("reason"))
    return df.join(verdicts, [*keys, "ingest_seq"])
