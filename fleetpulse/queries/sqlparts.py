"""Pieces of oracle SQL that repeat once per sensor."""

from __future__ import annotations

from fleetpulse.params import SENSORS, Sensor
from fleetpulse.sources.binding import READINGS_SQL


def with_readings(body: str, *ctes: str) -> str:
    parts = ",\n".join([READINGS_SQL.strip(), *[c.strip() for c in ctes]])
    recursive = "RECURSIVE " if any("UNION ALL" in c for c in ctes) else ""
    return f"WITH {recursive}{parts}\n{body.strip()}"


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def status(col: str, s: Sensor, op: str = ">") -> str:
    return f"CASE WHEN {col} {op} {s.critical} THEN 2 WHEN {col} {op} {s.warning} THEN 1 ELSE 0 END"


def machine_status(op: str = ">") -> str:
    return "greatest(" + ", ".join(status(s.key, s, op) for s in SENSORS) + ")"


def severity(col: str, s: Sensor) -> str:
    return (f"CASE WHEN {col} <= {s.baseline} THEN 0.0::DOUBLE "
            f"WHEN {col} <= {s.warning} THEN ({col} - {d(s.baseline)}) * {d(0.6)} / {d(s.warning - s.baseline)} "
            f"WHEN {col} <= {s.critical} THEN ({col} - {d(s.warning)}) * {d(0.4)} / {d(s.critical - s.warning)} + {d(0.6)} "
            f"ELSE least(({col} - {d(s.critical)}) * {d(0.5)} / {d(s.cap - s.critical)} + {d(1)}, {d(1.5)}) END")


def health(sev: str) -> str:
    return f"least(greatest(({d(1)} - least({sev}, {d(1)})) * 100, {d(0)}), {d(100)})"


def margin(col: str, s: Sensor) -> str:
    return (f"CASE WHEN {col} <= {s.baseline} THEN {d(100)} ELSE "
            f"least(greatest(({d(s.critical)} - {col}) * 100 / {d(s.span)}, {d(0)}), {d(100)}) END")


def name(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' END"


def r6(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + 3.1e-9::DOUBLE, {digits}) + 0.0::DOUBLE"


def each(template, sep: str = ",\n  ") -> str:
    """Join one piece per sensor; ``template`` maps a sensor to SQL text."""
    return sep.join(template(s) for s in SENSORS)


RAW = f"raw AS (SELECT *, {machine_status()} AS raw_status FROM readings)"

EVENT_STATUS = """
es0 AS (SELECT *, lag(us) OVER w AS pu, lag(raw_status) OVER w AS ps FROM raw
        WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_seq)),
es1 AS (SELECT *, CASE WHEN raw_status >= 1 AND (pu IS NULL OR us - pu > 300000000 OR ps < 1) THEN us END AS wo,
          CASE WHEN raw_status >= 2 AND (pu IS NULL OR us - pu > 300000000 OR ps < 2) THEN us END AS co FROM es0),
es2 AS (SELECT *, max(wo) OVER w AS ws, max(co) OVER w AS cs FROM es1
        WINDOW w AS (PARTITION BY machine_id ORDER BY us, ingest_seq ROWS UNBOUNDED PRECEDING)),
evs AS (SELECT * EXCLUDE (pu, ps, wo, co, ws, cs),
          CASE WHEN raw_status >= 2 AND us - cs >= 1800000000 THEN 2
               WHEN raw_status >= 1 AND us - ws >= 1800000000 THEN 1 ELSE 0 END AS event_status FROM es2)
"""

# Row by row, as the rule reads: one recursion step per row of every machine.
STABILIZED = """
st0 AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY us, ingest_seq) AS p,
          sum(CASE WHEN raw_status >= 1 THEN 1 ELSE 0 END) OVER (
            PARTITION BY machine_id ORDER BY us, ingest_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS votes FROM raw),
st1 AS (SELECT machine_id, p, raw_status AS cur, 0 AS ns, 0 AS ncs FROM st0 WHERE p = 1
  UNION ALL
  SELECT r.machine_id, r.p,
    CASE WHEN r.raw_status = 2 THEN 2
         WHEN s.cur = 2 AND s.ncs + 1 < 5 THEN 2
         WHEN s.cur = 2 THEN CASE WHEN r.raw_status = 1 THEN 1 ELSE 0 END
         WHEN s.cur = 0 THEN CASE WHEN r.votes >= 3 THEN 1 ELSE 0 END
         ELSE CASE WHEN r.raw_status = 0 AND s.ns + 1 >= 5 THEN 0 ELSE 1 END END,
    CASE WHEN r.raw_status = 0 THEN s.ns + 1 ELSE 0 END,
    CASE WHEN r.raw_status = 2 THEN 0 WHEN s.cur = 2 AND s.ncs + 1 >= 5 THEN 0 ELSE s.ncs + 1 END
  FROM st1 s JOIN st0 r ON r.machine_id = s.machine_id AND r.p = s.p + 1),
stab AS (SELECT r.* EXCLUDE (votes, p), s.cur AS stabilized_status FROM st0 r JOIN st1 s USING (machine_id, p))
"""
