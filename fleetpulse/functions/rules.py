"""Manufacturer-limit rules as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.params import SENSORS, STATUS_NAMES, Sensor

Numeric = Column | str
TIE_OFFSET = 3.1e-9


def _c(value: Numeric) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Numeric) -> Column:
    c = _c(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def reached(value: Numeric, limit: float, inclusive: bool = False) -> Column:
    return _c(value) >= limit if inclusive else _c(value) > limit


def status(value: Numeric, sensor: Sensor, inclusive: bool = False) -> Column:
    """0 normal, 1 warning, 2 critical."""
    return (F.when(reached(value, sensor.critical, inclusive), 2)
            .when(reached(value, sensor.warning, inclusive), 1).otherwise(0))


def status_name(code: Numeric) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in STATUS_NAMES]), _c(code).cast("int") + 1)


def machine_status(prefix: str = "", inclusive: bool = False,
                   sensors: Iterable[Sensor] = SENSORS) -> Column:
    return F.greatest(*[status(prefix + s.key, s, inclusive) for s in sensors])


def severity(value: Numeric, sensor: Sensor) -> Column:
    """Piecewise linear: baseline 0, warning 0.6, critical 1.0, cap value 1.5."""
    v = _c(value)
    to_warning = (v - sensor.baseline) * 0.6 / (sensor.warning - sensor.baseline)
    to_critical = (v - sensor.warning) * 0.4 / (sensor.critical - sensor.warning) + 0.6
    beyond = (v - sensor.critical) * 0.5 / (sensor.cap - sensor.critical) + 1.0
    return (F.when(v <= sensor.baseline, 0.0).when(v <= sensor.warning, to_warning)
            .when(v <= sensor.critical, to_critical).otherwise(F.least(beyond, F.lit(1.5))))


def health_percent(severity_value: Numeric) -> Column:
    room = (F.lit(1.0) - F.least(_c(severity_value), F.lit(1.0))) * 100.0
    return F.least(F.greatest(room, F.lit(0.0)), F.lit(100.0))


def critical_margin(value: Numeric, sensor: Sensor) -> Column:
    v = _c(value)
    share = (F.lit(sensor.critical) - v) * 100.0 / sensor.span
    return F.when(v <= sensor.baseline, 100.0).otherwise(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)))


def strict_bool(value: Numeric, default: bool | None = None) -> Column:
    text = F.lower(F.trim(_c(value).cast("string")))
    return (F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
            .otherwise(F.lit(default).cast("boolean")))


def half_even(value: Numeric, digits: int = 0) -> Column:
    return F.bround(_c(value), digits)


def r6(value: Numeric, digits: int = 6) -> Column:
    """Fixed decimals for comparing doubles between engines.

    The offset moves decimal ties off the rounding border; adding zero turns
    -0.0 into 0.0. Only query results are rounded, never operator outputs.
    """
    return F.round(_c(value).cast("double") + TIE_OFFSET, digits) + F.lit(0.0)
