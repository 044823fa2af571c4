"""Anomaly intervals and the current finding of each sensor, kept up to date by a stream.

A machine's state holds its open intervals, one typed entry each, and per sensor
whether a finding was active; a closed interval leaves the state. A micro-batch gives
the newest image of every interval it touched and of every sensor, so the sink
rewrites those keys alone. Rows are the same as ``anomaly_intervals`` and
``anomaly_state`` give for all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fleetpulse.operators import anomaly
from fleetpulse.params import DEFAULT, SENSOR_KEYS, Params
from fleetpulse.sources.keyed import KeyedTables

KEYS = {"intervals": ("machine_id", "interval_id"), "state": ("machine_id", "sensor")}
INTERVAL = ("anomaly_type string, affected_sensors string, first_observed_us bigint, decision_us bigint, end_us bigint, "
            "duration_s double, maximum_severity string, maximum_confidence double, safety_actions array<string>, "
            "model_actions array<string>, active boolean, final_offline_classification string, event_row_count bigint, "
            "latest_update_us bigint")
STATE = ("current_anomaly_type string, quality_status string, active boolean, first_observed_us bigint, "
         "latest_update_us bigint, resolution_us bigint, safety_action string, model_action string")
CHANGES = f"machine_id string, interval_id string, sensor string, interval struct<{INTERVAL}>, state struct<{STATE}>"
OPEN = ("interval_no bigint, anomaly_type string, affected_sensors string, first_observed_us bigint, decision_us bigint, "
        "last_us bigint, resolved_us bigint, severity int, confidence double, safety_actions array<string>, "
        "model_actions array<string>, final string, event_rows bigint")
NEEDED = ("us", "ingest_seq", "primary_type", "affected_sensors", "anomaly_is_active", "anomaly_types", "quality_status",
          "anomaly_severity", "anomaly_confidence", "safety_action", "model_action", "first_observed_us", "confirmed_at_us",
          "suspicion_us", "resolved_us", "final_offline_classification")
_OPEN = [c.split()[0] for c in OPEN.split(", ")]


def _with(entry: dict | None, number: int, row: dict) -> dict:
    """An interval after one more of its rows."""
    if entry is None:
        decided = next(v for v in (row["confirmed_at_us"], row["suspicion_us"], row["us"]) if v is not None)
        entry = {"interval_no": number, "anomaly_type": row["primary_type"], "affected_sensors": row["affected_sensors"],
                 "first_observed_us": row["first_observed_us"], "decision_us": decided, "resolved_us": None, "severity": 0,
                 "confidence": None, "safety_actions": [], "model_actions": [], "event_rows": 0}
    listed = anomaly.SEVERITY_RANK
    rank = listed.index(row["anomaly_severity"]) + 1 if row["anomaly_severity"] in listed else 0
    entry["severity"] = max(entry["severity"], rank)
    for name, value in (("confidence", row["anomaly_confidence"]), ("resolved_us", row["resolved_us"])):
        if value is not None:
            entry[name] = value if entry[name] is None else max(entry[name], value)
    for name, value in (("safety_actions", row["safety_action"]), ("model_actions", row["model_action"])):
        if value is not None and value not in entry[name]:
            entry[name] = [*entry[name], value]
    entry.update(last_us=row["us"], final=row["final_offline_classification"], event_rows=entry["event_rows"] + 1)
    return entry


def _image(entry: dict, closed_us: int | None) -> tuple:
    end = closed_us if closed_us is not None else entry["resolved_us"]
    upto = end if end is not None else entry["last_us"]
    first = entry["first_observed_us"]
    return (entry["anomaly_type"], entry["affected_sensors"], first, entry["decision_us"], end,
            max(0.0, (upto - first) / 1e6) if first is not None else 0.0,
            anomaly.SEVERITY_RANK[entry["severity"] - 1] if entry["severity"] else None, entry["confidence"],
            list(entry["safety_actions"]), list(entry["model_actions"]), end is None, entry["final"],
            entry["event_rows"], upto)


def _cells(column: pd.Series, name: str) -> list:
    """Plain values, None where there is none; times and numbers as whole numbers."""
    known = column.notna().to_numpy()
    if name == "ingest_seq" or name == "us" or name.endswith("_us"):
        column = column.where(known, 0).astype("int64")
    return [v if k else None for v, k in zip(column.tolist(), known.tolist())]


class IntervalProcessor(StatefulProcessor):
    def init(self, handle) -> None:
        self.open = handle.getMapState("open", "opened_by bigint", OPEN)
        self.count = handle.getValueState("count", "intervals bigint")
        self.sensors = handle.getMapState("sensors", "sensor string", "active boolean, ended_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "ingest_seq"], ignore_index=True)
        entries = {str(k[0]): {**dict(zip(_OPEN, v)), "safety_actions": list(v[9]), "model_actions": list(v[10])}
                   for k, v in self.open.iterator()}
        before = set(entries)
        open_ = {n: [e["anomaly_type"], e["affected_sensors"]] for n, e in entries.items()}
        held = {k: tuple(self.sensors.getValue((k,))) if self.sensors.containsKey((k,)) else (False, None) for k in SENSOR_KEYS}
        number = self.count.get()[0] if self.count.exists() else 0
        touched, closed = {}, {}
        for values in zip(*[_cells(batch[c], c) for c in NEEDED]):
            row = dict(zip(NEEDED, values))
            active, sensors = bool(row["anomaly_is_active"]), row["affected_sensors"] or ""
            hit, ended = anomaly.interval_next(open_, row["ingest_seq"], row["primary_type"], sensors, active)
            if hit is not None:
                if hit not in entries:
                    number += 1
                touched[hit] = entries[hit] = _with(entries.get(hit), number, row)
            for e in ended:
                touched[e], closed[e] = entries[e], row["us"]
            for k in SENSOR_KEYS:
                on = active and k in sensors.split("|")
                held[k] = (on, row["us"] if held[k][0] and not on else held[k][1])
        for n in entries:
            if n in open_ and n in touched:
                self.open.updateValue((int(n),), tuple(entries[n][c] for c in _OPEN))
            elif n in before and n not in open_:
                self.open.removeKey((int(n),))
        self.count.update((number,))
        out = [(key[0], f"anomaly_interval_{e['interval_no']:08d}", None, _image(e, closed.get(n)), None)
               for n, e in touched.items()]
        for k, (on, ended_us) in held.items():
            self.sensors.updateValue((k,), (on, ended_us))
            state = (row["anomaly_types"] if on else "NONE", row["quality_status"] if on else "NORMAL", on,
                     row["first_observed_us"] if on else None, row["us"], None if on else ended_us, row["safety_action"],
                     row["model_action"] if on else "USE_NORMALLY")
            out.append((key[0], None, k, None, state))
        names = ["machine_id", "interval_id", "sensor", "interval", "state"]
        yield pd.DataFrame([dict(zip(names, (*o[:3], _named(INTERVAL, o[3]), _named(STATE, o[4])))) for o in out], columns=names)

    def close(self) -> None:
        pass


def _named(schema: str, values: tuple | None) -> dict | None:
    return None if values is None else dict(zip([c.split()[0] for c in schema.split(", ")], values))


def described(monitored: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Findings of the monitor's rows with all their attributes."""
    rows = monitored.filter("valid").withColumns({
        "sensors": F.col("affected_sensors"),
        "confirmed_us": F.when(F.col("rule") == "CONFIRMED", F.col("us"))})
    return anomaly.describe(rows, params)


def stream_changes(findings: DataFrame) -> DataFrame:
    """Newest images of touched intervals and sensors, one set per micro-batch."""
    rows = findings.withColumn("primary_type", anomaly.primary_type(F.col("anomaly_types"))).select("machine_id", *NEEDED)
    return rows.groupBy("machine_id").transformWithStateInPandas(IntervalProcessor(), CHANGES, "update", "none")


def upsert_changes(tables: KeyedTables):
    """``foreachBatch`` sink: intervals and state of one epoch appear together, in one version."""
    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        try:
            tables.upsert(epoch, intervals=rows.filter("interval_id is not null").select("machine_id", "interval_id", "interval.*"),
                          state=rows.filter("sensor is not null").select("machine_id", "sensor", "state.*"))
        finally:
            rows.unpersist()
    return write
