"""The online monitor as Structured Streaming.

A machine's state holds what the batch folds hand from slice to slice, and the same
row steps run on it. A micro-batch is bounded by the source (files or offsets per
trigger), so a group never holds a machine's history. The last 24 hours of committed
rows lie in a map state of typed chunks; windows add and evict rows (``rolling.py``),
so a batch reads what enters and leaves, not the day. The rest of the state has a
fixed size, whatever the batch or the windows, and is one JSON text.

Unlike a replay with known boundaries, the online monitor keeps old state until a
reset is confirmed, and it never inserts rows into gaps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetpulse.operators import anomaly, features, forecast, steps
from fleetpulse.params import (BY_KEY, DEFAULT, INTEGRITY, MINUTE_US, SENSOR_KEYS,
                               Params)
from fleetpulse.sources.readings import READING
from fleetpulse.streaming.rolling import BOOK_SCHEMA, CHUNK_SCHEMA, RollingWindows, StateRows

BLOCK_ROWS = 2048
EVIDENCE_ROWS = 512  # looked at together; what follows a reset among them is looked at anew
TREND_STATS = ("slope_per_hour", "sample_count", "coverage_fraction", "gap_or_discontinuity",
               "available_history_duration_seconds", "feature_available")


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Readings stream with a fixed schema: files, or Kafka with a JSON value."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        rows = raw.select(F.from_json(F.col("value").cast("string"), READING).alias("r")).select("r.*")
    else:
        rows = spark.readStream.format(fmt).schema(READING).options(**options).load(path)
    return rows.withColumn("ts", F.timestamp_micros("us"))


def without_repeats(sdf: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop transport repeats of a row that arrive within the watermark."""
    return sdf.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["machine_id", "ingest_seq"])


def _limits(params: Params) -> list[float]:
    return [params.smoothing.jump_multiplier * BY_KEY[k].span for k in SENSOR_KEYS]


def _verdict(state: dict, us: int, label: str | None, values, jumps) -> str:
    """Why a row is refused, or an empty text; accepted rows move the state."""
    if label is not None and label not in ("", "normal", "warning", "critical"):
        return f"label not known: {label!r}"
    last = state.get("accepted")
    if last is not None and us == last[0]:
        return "duplicate timestamp"
    if last is not None and us < last[0]:
        return "time earlier than an accepted row"
    for i, (k, v) in enumerate(zip(SENSOR_KEYS, values)):
        s = BY_KEY[k]
        if v is None or not np.isfinite(v):
            return f"{k} has no finite value"
        if not s.low <= v <= s.high:
            return f"{s.label} {v} {s.unit} lies outside [{s.low}, {s.high}]"
        if last is not None and abs(v - last[1][i]) > jumps[i]:
            return f"{k} changed by {abs(v - last[1][i]):.3f}, over the jump limit {jumps[i]:.3f}"
    state["accepted"] = [us, list(values)]
    return ""


def _evidence(tail: list, us: list, values: list, ladder: dict, params: Params) -> dict[str, list]:
    """Evidence of new rows, one list per kind, given the earlier rows kept in state; moves the ladder's runs.

    ``told`` says whether a row has any evidence at all.
    """
    a, c = params.anomaly, params.cadence
    old = len(tail)
    at = np.array([*[t[0] for t in tail], *us], dtype=np.int64)
    block = np.array([*[t[1] for t in tail], *values], dtype=float).reshape(len(at), len(SENSOR_KEYS))
    gap = np.zeros(len(at))
    gap[1:] = np.diff(at) / 1e6
    missing = np.maximum(np.rint(gap / c.expected_s) - 1, 0)
    short = (missing > 0) & (gap > c.expected_s + a.gap_tolerance_s) & (gap < a.long_gap_s)
    moved = np.zeros(block.shape, dtype=bool)
    floor = np.array([max(INTEGRITY[k].context_change, INTEGRITY[k].resolution * 5.0) for k in SENSOR_KEYS])
    moved[1:] = np.abs(np.diff(block, axis=0)) >= floor
    tol = np.array([INTEGRITY[k].resolution * a.clip_tolerance for k in SENSOR_KEYS])
    low = np.array([INTEGRITY[k].physical_min for k in SENSOR_KEYS])
    high = np.array([INTEGRITY[k].physical_max for k in SENSOR_KEYS])
    edge = (np.abs(block - low) <= tol) | (np.abs(block - high) <= tol)
    told = (gap >= a.long_gap_s) | short | edge.any(axis=1)
    cells: dict[str, list] = {n: [] for n in ("medians", "abrupt", "noise", "drift", "starts", "stuck")}
    at, told = at[old:], told[old:]
    runs = ladder.setdefault("runs", [None] * len(SENSOR_KEYS))
    longest = ladder.setdefault("longest", [0.0] * len(SENSOR_KEYS))
    for i, k in enumerate(SENSOR_KEYS):
        near = anomaly._neighbourhood_block(block[:, i], INTEGRITY[k].resolution, BY_KEY[k].span,
                                            anomaly.abrupt_threshold(k, a), a)
        for n, name in (("medians", "recent_median"), ("abrupt", "abrupt"), ("noise", "noise"), ("drift", "drift")):
            cells[n].append(near[name][old:].tolist())
        context = moved[old:, [SENSOR_KEYS.index(r) for r in INTEGRITY[k].related]].any(axis=1)
        run, runs[i] = anomaly.run_columns(runs[i], at, block[old:, i].tolist(), context, k)
        before = np.maximum(longest[i], np.maximum.accumulate(np.nan_to_num(run["ended_s"])))
        longest[i] = float(before[-1])
        stuck = anomaly.stuck_levels(k, (at - run["since"]) / 1e6, before, run["context_events"], run["quiet_s"], a)
        cells["starts"].append(run["since"].tolist())
        cells["stuck"].append(stuck.tolist())
        told |= near["abrupt"][old:] | near["noise"][old:] | near["drift"][old:] | (stuck > 0)
    return {n: list(zip(*v)) for n, v in cells.items()} | {
        "us": us, "values": values, "gap_s": gap[old:].tolist(), "short": short[old:].tolist(),
        "boundary": edge[old:].tolist(), "told": told.tolist()}


def _finding(marks: dict[str, list], i: int, ladder: dict, a) -> tuple[str, list[str], int]:
    """The ladder's finding of one row; a calm row without evidence moves nothing but the time."""
    us = marks["us"][i]
    if not marks["told"][i] and anomaly._calm(ladder):
        ladder["us"] = us
        return "NONE", [], us
    row = {n: v[i] for n, v in marks.items()}
    row.update(features_ok=True, interpolated=False, confirmed=[], starts=dict(zip(SENSOR_KEYS, row["starts"])))
    return anomaly.ladder_next(ladder, row, a)


def rolling_windows(params: Params = DEFAULT, rows=None, book=None) -> RollingWindows:
    return RollingWindows(params.cadence.expected_s, params.cadence.max_gap_s, rows, book, windows_min=features.WINDOWS_MIN)


SIGNALS = ("rolling_median", "fast_ewma", "slow_ewma", "kalman_level", "kalman_rate_per_hour")
_WINDOW_COLS = [f"{k}__w{m}m__{s}" for k in SENSOR_KEYS for m in features.WINDOWS_MIN for s in TREND_STATS]
MONITOR_OUT = ", ".join(
    ["machine_id string", "us bigint", "ingest_seq bigint", *[f"{k} double" for k in SENSOR_KEYS],
     "valid boolean", "reason string", "rule string", "affected_sensors string", "first_us bigint",
     "commit boolean", "raw_status int", "stabilized_status int", "event_status int",
     "lifecycle_number int", "lifecycle_state string", "reset_confidence string", "reset_complete boolean",
     "elapsed_lifecycle_hours double", "degradation double", "degradation_rate_per_hour double",
     *[f"{k}__{s} double" for k in SENSOR_KEYS for s in SIGNALS],
     *[f"{k}__baseline_{s} double" for k in SENSOR_KEYS for s in ("mean", "std")],
     *[f"{k}__baseline_samples bigint" for k in SENSOR_KEYS], *[f"{c} double" for c in _WINDOW_COLS]])
_NAMES = [c.split()[0] for c in MONITOR_OUT.split(", ")]
_TOLD = _NAMES[_NAMES.index("rule"):_NAMES.index(_WINDOW_COLS[0])]  # cells of valid rows, in the order in which they are told
_WINDOW_PLACE = {c: i for i, c in enumerate(_WINDOW_COLS)}
_HELD = ("HOLD_FOR_CONFIRMATION", "SUSPEND_PREDICTION", "REFUSE_PREDICTION")


def monitor_rows(machine: str, rows: pd.DataFrame, state: dict, params: Params = DEFAULT,
                 windows: RollingWindows | None = None) -> pd.DataFrame:
    """Process one micro-batch of a machine and advance its state and windows.

    Without ``windows`` they begin with this batch.
    """
    windows = rolling_windows(params) if windows is None else windows
    jumps = _limits(params)
    rows = rows.sort_values(["us", "ingest_seq"], ignore_index=True)
    labels = rows["health_status"].tolist() if "health_status" in rows else [None] * len(rows)
    times, cells = rows["us"].tolist(), list(zip(*[rows[k].tolist() for k in SENSOR_KEYS]))
    reasons = [_verdict(state, us, label.strip().lower() if isinstance(label, str) else None, v, jumps)
               for us, label, v in zip(times, labels, cells)]
    good = [i for i, reason in enumerate(reasons) if not reason]
    told: list[tuple] = []
    held = np.full((len(_WINDOW_COLS), len(rows)), np.nan)
    pending: list[int] = []

    def settle() -> None:
        if not pending:
            return
        found = windows.add(np.array([times[i] for i in pending], dtype=np.int64),
                            np.array([cells[i] for i in pending], dtype=float))
        for n, v in found.items():
            held[_WINDOW_PLACE[n], pending] = v
        pending.clear()

    a, depth = params.anomaly, max(2 * params.anomaly.noise_rows, params.anomaly.drift_rows, 11)
    at = 0
    while at < len(good):
        tail, ladder = state.setdefault("tail", []), state.setdefault("ladder", {})
        part = good[at:at + EVIDENCE_ROWS]
        marks = _evidence(tail, [times[i] for i in part], [list(cells[i]) for i in part], ladder, params) if a.enabled else None
        for j, i in enumerate(part):
            us, values = times[i], cells[i]
            rule, sensors, first = ("NONE", [], us) if marks is None else _finding(marks, j, ladder, a)
            meaning = anomaly.FINDINGS[rule]
            keep = meaning[5] not in _HELD
            r = steps.online_next(state, us, values, params, keep)
            if r["closed"]:
                settle()
                windows.clear()
            if keep:
                pending.append(i)
            number = state.setdefault("number", 1)
            start = state.setdefault("start", us)
            if r["closed"]:
                state["number"] = number = number + 1
                state["start"] = start = r["closed"]["end_us"]
            if "base" not in state:
                state.update(base=steps.baseline_start(params.prognostics), samples=[0] * len(SENSOR_KEYS))
            base, samples = state["base"], state["samples"]
            if r["raw"] == 0 and keep and not meaning[10] and meaning[2] not in ("HIGH", "CRITICAL"):
                moved = steps.baseline_next(state, values, params.prognostics)
                state["samples"] = samples = [x + y for x, y in zip(samples, moved)]
            told.append((
                rule, "|".join(sorted(sensors)), first, keep, r["raw"], r["status"], r["event"], number, r["phase"],
                r["confidence"], r["closed"] is not None, max(0.0, (us - start) / 3.6e9), r["deg"][0], r["deg"][1] * 3600.0,
                *[v for s in r["signals"] for v in (*s[:4], s[4] * 3600.0)],
                *[v for b in base for v in (b[0], b[1] ** 0.5)], *samples))
            at += 1
            if r["closed"]:
                # The detector forgets as well; evidence of later rows starts over.
                state["ladder"], state["tail"] = {}, []
                break
        else:
            if marks is not None:
                state["tail"] = [*tail, *[list(t) for t in zip(marks["us"], marks["values"])]][-depth:]
    state.setdefault("tail", [])
    settle()
    found = dict(zip(_TOLD, zip(*told))) if told else {n: () for n in _TOLD}
    if len(good) < len(rows):
        place = dict(zip(good, range(len(good))))
        found = {n: [v[place[i]] if i in place else None for i in range(len(rows))] for n, v in found.items()}
    out = {"machine_id": machine, "us": times, "ingest_seq": rows["ingest_seq"].tolist(), **{k: rows[k].to_numpy() for k in SENSOR_KEYS},
           "valid": [not reason for reason in reasons], "reason": reasons, **found, **dict(zip(_WINDOW_COLS, held))}
    return pd.DataFrame(out, columns=_NAMES, index=rows.index)


class MonitorProcessor(StatefulProcessor):
    """The monitor on typed state: a text of fixed size, the windows' sums, and chunks of rows."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "held string")
        self.book = handle.getValueState("windows", BOOK_SCHEMA)
        self.chunks = handle.getMapState("rows", "chunk bigint", CHUNK_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.held.get()[0]) if self.held.exists() else {}
        windows = rolling_windows(self.params, StateRows(self.chunks), self.book.get() if self.book.exists() else None)
        # Batches of a group arrive unsorted, so a micro-batch is ordered as a whole. Its rows then
        # go on in blocks: their cells take far more room, and a reset looks at the rest of a block anew.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "ingest_seq"], ignore_index=True)
        for at in range(0, len(batch), BLOCK_ROWS):
            yield monitor_rows(key[0], batch.iloc[at:at + BLOCK_ROWS], held, self.params, windows)
        self.held.update((json.dumps(held),))
        self.book.update(windows.book.row())

    def close(self) -> None:
        pass


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which map states need, in at most two parts a core.

    Every part costs a Python worker, a store and a commit in every micro-batch, also where it holds no key,
    and parts of a stream are not merged by size. A stream keeps the number of its first start.
    """
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_monitor(sdf: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Validation, findings, smoothing, status layers, resets, baseline and windows per machine.

    Start the query inside ``keyed_state_store``.
    """
    return sdf.groupBy("machine_id").transformWithStateInPandas(MonitorProcessor(params), MONITOR_OUT, "append", "none")


def stream_forecast(monitored: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Crossing probabilities and times: projections on the monitor's output, no further state."""
    rows = monitored.filter("valid")
    meaning = anomaly.describe(rows.withColumns({
        "sensors": F.col("affected_sensors"), "pending_json": F.lit("{}"), "confirmed_us": F.lit(None).cast("long")}), params)
    meaning = meaning.withColumns({f"{k}__status": _status(k, params) for k in SENSOR_KEYS})
    usable = features.feature_availability(meaning)
    return forecast.apply_withholding(forecast.suppress_on_reset(forecast.prognose(usable, params)))


def _status(k: str, params: Params):
    from fleetpulse.functions.rules import status
    return status(k, BY_KEY[k], params.inclusive)


ALERT_OUT = "machine_id string, us bigint, target string, active boolean"


def hysteresis_next(state: dict, us: int, value, threshold: float, wait_min: float, params: Params) -> bool:
    """One row of an alert latch: on after staying above, off after staying well below."""
    p = params.prognostics
    if value is None or value != value:
        state.clear()
        return False
    if state.get("on"):
        if value < threshold * p.release_fraction:
            state["low"] = state.get("low") or us
            if us - state["low"] >= p.release_min * MINUTE_US:
                state.clear()
        else:
            state.pop("low", None)
    elif value >= threshold:
        state["high"] = state.get("high") or us
        state["on"] = us - state["high"] >= wait_min * MINUTE_US
    else:
        state.clear()
    return bool(state.get("on"))


def stream_alerts(forecasts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Persistent alerts of a forecast stream, one row per reading and target."""
    limits = forecast.action_thresholds(params)
    waits = {t: params.prognostics.warning_persist_min if "_warning_" in t else params.prognostics.critical_persist_min
             for t in limits}

    def call(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(parts), ignore_index=True).sort_values("us", ignore_index=True)
        for at in range(0, len(rows), BLOCK_ROWS):
            part = rows.iloc[at:at + BLOCK_ROWS]
            us, latches = part["us"].tolist(), []
            for t, limit in limits.items():
                latch, wait = held.setdefault(t, {}), waits[t]
                latches.append([hysteresis_next(latch, u, v, limit, wait, params) for u, v in zip(us, part[t].tolist())])
            yield pd.DataFrame({"machine_id": key[0], "us": np.repeat(us, len(limits)), "target": [*limits] * len(us),
                                "active": np.array(latches, dtype=bool).ravel(order="F")})
        state.update((json.dumps(held),))

    return forecasts.select("machine_id", "us", *limits).groupBy("machine_id").applyInPandasWithState(
        call, ALERT_OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def gap_timeout(sdf: DataFrame, seconds: float = 300.0, delay: str = "1 minute") -> DataFrame:
    """A DATA_UNAVAILABLE row for each time that a machine was silent for longer than the limit.

    Fires on event time, so it needs no further row of the silent machine, only
    that the stream as a whole moves on. A silence that a micro-batch already sees the
    end of is reported from its rows, so the result does not depend on how rows are batched.
    """
    limit_ms = int(seconds * 1000)

    def call(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["machine_id", "last_us", "quality_status"]
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([[key[0], last, "DATA_UNAVAILABLE"]], columns=cols)
            return
        us = np.sort(np.concatenate([p["us"].to_numpy(dtype=np.int64) for p in parts]))
        if state.exists:
            us = np.concatenate([[state.get[0]], us[us > state.get[0]]])
        last = int(us[-1])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1))
        ended = us[:-1][np.diff(us) > limit_ms * 1000]
        yield pd.DataFrame({"machine_id": key[0], "last_us": ended, "quality_status": "DATA_UNAVAILABLE"}, columns=cols)

    return sdf.withWatermark("ts", delay).groupBy("machine_id").applyInPandasWithState(
        call, "machine_id string, last_us bigint, quality_status string", "last bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def rollup(sdf: DataFrame, window: str | None = "1 hour", slide: str | None = None, gap: str | None = None,
           delay: str | None = None) -> DataFrame:
    """Fleet roll-ups by event time: tumbling, sliding, or sessions closed by a gap.

    Works on streams (give ``delay`` for the watermark) and on tables.
    """
    rows = sdf.withWatermark("ts", delay) if delay else sdf
    frame = F.session_window("ts", gap) if gap else F.window("ts", window, slide) if slide else F.window("ts", window)
    cells = [F.count("*").alias("rows")]
    for k in SENSOR_KEYS:
        cells += [F.avg(k).alias(f"{k}_mean"), F.max(k).alias(f"{k}_max")]
    out = rows.groupBy("machine_id", frame.alias("w")).agg(*cells)
    return out.select("machine_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"),
                      "rows", *[f"{k}_{n}" for k in SENSOR_KEYS for n in ("mean", "max")])


def upsert_state(path: str):
    """``foreachBatch`` sink for the per-sensor state: one folder per epoch, replaced on retry."""
    def write(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("machine_id", "sensor").agg(
            F.max_by(F.struct(*[c for c in batch.columns if c not in ("machine_id", "sensor")]), "us").alias("r"))
        latest.select("machine_id", "sensor", "r.*").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current row per machine and sensor over all epochs."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in ("machine_id", "sensor", "epoch")]
    return rows.groupBy("machine_id", "sensor").agg(F.max_by(F.struct(*cols), F.struct("us", "epoch")).alias("r")).select(
        "machine_id", "sensor", "r.*")


def sensor_states(monitored: DataFrame) -> DataFrame:
    """Current finding per sensor from the monitor's output, ready for ``upsert_state``."""
    on = (F.col("rule") != "NONE") & ~F.col("rule").startswith("RESOLVED")
    return monitored.filter("valid").select("machine_id", "us", "rule", F.explode(F.array(*[F.struct(
        F.lit(k).alias("sensor"), (on & F.array_contains(F.split("affected_sensors", r"\|"), k)).alias("active"))
        for k in SENSOR_KEYS])).alias("s")).select("machine_id", "us", "s.*", "rule")


