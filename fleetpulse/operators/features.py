"""Causal window features per (machine, lifecycle).

Two forms give the same numbers:

* ``frame_stats``: Catalyst RANGE frames, for windows up to an hour.
* ``window_features``: all windows and statistics in one pass over
  ``(machine, lifecycle, slice)`` groups. Spark re-aggregates a sliding frame
  from scratch for every row, so day-long frames cost rows x window; here sums
  come from prefix sums and order statistics from pandas' rolling kernels.
  Spark cuts the groups (bounded slices plus a halo of the longest window) and
  does the shuffle; a task sees one slice at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence, Set

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.params import (BY_KEY, DAY_US, DEFAULT, MINUTE_US, SENSOR_KEYS, SENSORS,
                               WINDOWS_MIN, Params)
from fleetpulse.plans.slices import ORDER, add_slice, in_slice, slice_of, spread, with_halo, with_history

LIFE = ("machine_id", "lifecycle_id")

# Names of the per-sensor state columns and per-window statistics.
STATE = ("raw", "rolling_median", "fast_ewma", "slow_ewma", "kalman_level",
         "kalman_rate_per_hour", "fast_slow_difference", "distance_warning",
         "distance_critical", "normalized_severity")
STATS = ("mean", "median", "minimum", "maximum", "std", "slope_per_hour", "change",
         "slope_acceleration_per_hour2", "warning_fraction", "critical_fraction",
         "threshold_crossings", "sampling_gap_mean_seconds", "sampling_gap_max_seconds",
         "recent_missing_fraction", "feature_available", "available_history_duration_seconds",
         "coverage_fraction", "window_mature", "sample_count", "gap_or_discontinuity")
ACCELERATION = "slope_acceleration_per_hour2"
_SOURCE = {ACCELERATION: "slope_per_hour"}
_CELLS = frozenset(STATS) - {ACCELERATION}
_SHARED = {"sampling_gap_mean_seconds", "sampling_gap_max_seconds", "recent_missing_fraction", "feature_available",
           "available_history_duration_seconds", "coverage_fraction", "window_mature", "sample_count", "gap_or_discontinuity"}
MACHINE = ("consecutive_warning_hours", "consecutive_critical_hours", "elapsed_lifecycle_hours",
           "maximum_normalized_severity", "weighted_normalized_severity")


def feature_names(sensors: Sequence[str] = SENSOR_KEYS,
                  windows_min: Sequence[int] = WINDOWS_MIN) -> list[str]:
    """Column order of the feature table."""
    names = []
    for key in sensors:
        names += [f"{key}__{n}" for n in STATE]
        names += [f"{key}__w{m}m__{n}" for m in windows_min for n in STATS]
    return names + list(MACHINE)


def rolling_median(df: DataFrame, cols: Sequence[str] = SENSOR_KEYS, rows: int = 5,
                   keys: Sequence[str] = LIFE) -> DataFrame:
    """Median of the last ``rows`` committed values."""
    w = in_slice(keys).rowsBetween(-(rows - 1), 0)
    seen = with_history(df, keys, rows - 1)
    return seen.withColumns({f"{c}__rolling_median": F.percentile(F.col(c), F.lit(0.5)).over(w)
                             for c in cols}).filter(~F.col("is_halo")).drop("is_halo")


def frame_stats(df: DataFrame, windows_min: Sequence[int], cols: Sequence[str] = SENSOR_KEYS,
                keys: Sequence[str] = LIFE) -> DataFrame:
    """Mean, min, max, std, count, slope and change over RANGE frames (short windows)."""
    rows = with_halo(df, max(windows_min) * MINUTE_US)
    base = Window.partitionBy(*keys, "slice").orderBy("us")
    x = F.col("us") / 3.6e9 - F.lit(490_000.0)
    out = {}
    for m in windows_min:
        w = base.rangeBetween(-m * MINUTE_US, 0)
        for c in cols:
            y = F.col(c)
            p = f"{c}__w{m}m__"
            n = F.count(y).over(w)
            out |= {p + "mean": F.avg(y).over(w), p + "minimum": F.min(y).over(w),
                    p + "maximum": F.max(y).over(w), p + "std": F.stddev_pop(y).over(w),
                    p + "sample_count": n.cast("double"), p + "change": y - F.first(y).over(w),
                    p + "slope_per_hour": F.when(n >= 3, F.coalesce(
                        F.regr_slope(y, x).over(w), F.lit(0.0))).otherwise(0.0)}
    return rows.withColumns(out).filter(~F.col("is_halo")).drop("is_halo")


class _Span(BaseIndexer):
    """Windows given by explicit start and end positions."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        super().__init__()
        self.lo, self.hi = start.astype(np.int64), end.astype(np.int64)

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None,
                          step=None):
        return self.lo, self.hi


def _prefix(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(values, dtype=float)))


def _means(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Means of ``values[lo:hi]``, rounded once.

    Whole and fractional parts are summed apart, which keeps all bits of ordinary readings;
    a mean that equals a limit must not come out a bit beyond it.
    """
    scaled = values * 2.0 ** 26
    whole = np.floor(scaled)
    a, b = _prefix(whole), _prefix(scaled - whole)
    total = (a[hi] - a[lo]).astype(np.longdouble) + (b[hi] - b[lo])
    return (total / (hi - lo) / 2.0 ** 26).astype(float)


def _window_block(us: np.ndarray, series: dict[str, np.ndarray], codes: dict[str, np.ndarray],
                  minutes: int, expected_s: float, max_gap_s: float,
                  wanted: Mapping[str, Set[str]] | None = None) -> dict[str, np.ndarray]:
    """Statistics of one window length for every row of a sorted slice.

    ``wanted`` names the statistics of each sensor; without it all are computed. For the
    slope, time is measured from the start of a block as long as the window; a window
    touches at most two blocks, so every sum stays as small as the window itself and
    nothing cancels.
    """
    wanted = {k: _CELLS for k in series} if wanted is None else wanted
    anywhere = set().union(*wanted.values())
    n_rows = len(us)
    width = minutes * MINUTE_US
    at = np.arange(n_rows)
    lo = np.searchsorted(us, us - width, side="left")
    count = (at - lo + 1).astype(float)
    block = us // width
    split = np.maximum(np.searchsorted(us, block * width, side="left"), lo)
    hi = at + 1

    def parts(values):
        p = _prefix(values)
        return p[split] - p[lo], p[hi] - p[split]

    if "slope_per_hour" in anywhere:
        x = (us - block * width) / width
        older = (split - lo).astype(float)
        x_old, x_new = parts(x)
        xx_old, xx_new = parts(x * x)
        sx = x_new + x_old - older
        sxx = xx_new + xx_old - 2.0 * x_old + older
        spread = count * sxx - sx * sx
        hours = minutes / 60.0
        sloped = (count >= 3) & (np.abs(spread) * hours * hours > 1e-9)

    inner = lo + 1
    has_gap = hi > inner
    shared = _gap_block(us, lo, count, minutes, expected_s, max_gap_s) if anywhere & _SHARED else {}

    out: dict[str, np.ndarray] = {}
    span = _Span(lo, hi)
    for key, names in wanted.items():
        raw = series[key]
        rolled = pd.Series(raw).rolling(span, min_periods=1)
        stats = {n: v for n, v in shared.items() if n in names}
        if names & {"std", "slope_per_hour"}:
            y = raw - float(np.median(raw))
            y_old, y_new = parts(y)
            sy = y_old + y_new
            mean = sy / count
        if names & {"minimum", "maximum", "std"}:
            least, most = rolled.min().to_numpy(), rolled.max().to_numpy()
            stats.update({n: v for n, v in (("minimum", least), ("maximum", most)) if n in names})
        if "mean" in names:
            stats["mean"] = _means(raw, lo, hi)
        if "median" in names:
            stats["median"] = rolled.median().to_numpy()
        if "std" in names:
            yy_old, yy_new = parts(y * y)
            spread_y = np.sqrt(np.maximum(0.0, (yy_old + yy_new) / count - mean * mean))
            stats["std"] = np.where(least == most, 0.0, spread_y)
        if "slope_per_hour" in names:
            xy_old, xy_new = parts(x * y)
            sxy = xy_new + xy_old - y_old
            stats["slope_per_hour"] = np.where(
                sloped, (count * sxy - sx * sy) / np.where(sloped, spread, 1.0) / hours, 0.0)
        if "change" in names:
            stats["change"] = raw - raw[lo]
        code = codes[key]
        for name, level in (("warning_fraction", 1), ("critical_fraction", 2)):
            if name in names:
                above = _prefix(code >= level)
                stats[name] = (above[hi] - above[lo]) / count
        if "threshold_crossings" in names:
            turn = np.zeros(n_rows)
            turn[1:] = code[1:] != code[:-1]
            turns = _prefix(turn)
            stats["threshold_crossings"] = np.where(has_gap, turns[hi] - turns[np.minimum(inner, hi)], 0.0)
        out.update({f"{key}__w{minutes}m__{n}": v for n, v in stats.items()})
    return out


def _gap_block(us: np.ndarray, lo: np.ndarray, count: np.ndarray, minutes: int, expected_s: float,
               max_gap_s: float) -> dict[str, np.ndarray]:
    """Statistics of one window length that are the same for every sensor."""
    gap = np.zeros(len(us))
    gap[1:] = np.diff(us) / 1e6
    missing = np.maximum(0.0, np.rint(gap / expected_s) - 1.0)
    hi, inner = np.arange(len(us)) + 1, lo + 1
    gap_sum, miss_sum = _prefix(gap), _prefix(missing)
    has_gap = hi > inner
    gap_total = np.where(has_gap, gap_sum[hi] - gap_sum[np.minimum(inner, hi)], 0.0)
    gap_max = np.where(has_gap, pd.Series(gap).rolling(
        _Span(inner, hi), min_periods=1).max().to_numpy(), 0.0)
    miss_total = np.where(has_gap, miss_sum[hi] - miss_sum[np.minimum(inner, hi)], 0.0)
    needed = max(1.0, minutes * 60.0 / expected_s)
    history = (us - us[lo]) / 1e6
    broken = gap_max > max_gap_s
    coverage = np.minimum(1.0, count / (needed + 1.0))
    mature = ((history >= max(0.0, minutes * 60.0 - expected_s)) & ~broken & (coverage >= 0.95))
    return {
        "sampling_gap_mean_seconds": np.where(has_gap, gap_total / np.maximum(count - 1, 1), 0.0),
        "sampling_gap_max_seconds": gap_max,
        "recent_missing_fraction": np.minimum(1.0, miss_total / needed),
        "feature_available": (~broken).astype(float),
        "available_history_duration_seconds": history,
        "coverage_fraction": coverage, "window_mature": mature.astype(float),
        "sample_count": count, "gap_or_discontinuity": broken.astype(float)}


def window_features(df: DataFrame, windows_min: Sequence[int] = WINDOWS_MIN, *,
                    sensors: Sequence[str] = SENSOR_KEYS, keys: Sequence[str] = LIFE,
                    params: Params = DEFAULT, width: int = 4 * DAY_US,
                    stats: Sequence[str] = STATS, cells: Sequence[str] | None = None,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Window statistics of committed rows; slope acceleration looks one row back.

    ``cells`` names the columns to compute, such as ``x__w60m__mean``; without it there
    are all ``stats`` of all sensors and windows. Time, memory and disk grow with the
    columns, so name them where few are read. A slice comes with one length of the
    longest window of earlier rows, and for accelerations with a second one for the
    windows of the row before it. ``keep`` names further columns of ``df`` to carry through.
    """
    names = list(cells) if cells is not None else [
        f"{k}__w{m}m__{s}" for k in sensors for m in windows_min for s in STATS if s in set(stats)]
    wanted: dict[int, dict[str, set[str]]] = {}
    for name in names:
        k, window, stat = name.split("__")
        wanted.setdefault(int(window[1:-1]), {}).setdefault(k, set()).add(_SOURCE.get(stat, stat))
    accelerate = any(n.endswith(f"__{ACCELERATION}") for n in names)
    base = list(dict.fromkeys([*keys, *ORDER, *sensors, *keep]))
    longest = max(wanted) * MINUTE_US
    flat = add_slice(df.select(*base), width=width)
    if accelerate:
        rows = with_halo(flat, 2 * longest, width).unionByName(_far_predecessors(flat, keys, longest, width))
    else:
        rows = with_halo(flat, longest, width)
    # Earlier rows need their readings only; empty cells cost the shuffle next to nothing.
    carried = [f.name for f in flat.schema if f.dataType == T.DoubleType() and f.name in keep and f.name not in sensors]
    rows = rows.withColumns({c: F.when(~F.col("is_halo"), F.col(c)) for c in carried})
    schema = T.StructType([f for f in rows.schema if f.name != "is_halo"]
                          + [T.StructField(n, T.DoubleType()) for n in names])
    expected, max_gap = params.cadence.expected_s, params.cadence.max_gap_s
    inclusive = params.inclusive

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(ORDER), ignore_index=True)
        real = ~pdf["is_halo"].to_numpy(dtype=bool)
        us = pdf["us"].to_numpy(dtype=np.int64)
        series = {k: pdf[k].to_numpy(dtype=float) for k in sensors}
        codes = {}
        for k, y in series.items():
            s = BY_KEY[k]
            over = np.greater_equal if inclusive else np.greater
            codes[k] = over(y, s.warning).astype(int) + over(y, s.critical).astype(int)
        out = {}
        if real.any():
            for m, cells_of in wanted.items():
                found = _window_block(us, series, codes, m, expected, max_gap, cells_of)
                if accelerate:
                    found.update(_accelerations(us, found))
                out.update(found)
        plain = pdf.loc[real].drop(columns=["is_halo"])
        extra = pd.DataFrame({n: out[n][real] if out else np.empty(0) for n in names},
                             index=plain.index)
        return pd.concat([plain, extra], axis=1)[[f.name for f in schema]]

    return spread(rows, [*keys, "slice"]).groupBy(*keys, "slice").applyInPandas(block, schema)


def _accelerations(us: np.ndarray, cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Change of each slope since the row before, per hour; 0 on the first row."""
    hours = np.diff(us) / 3.6e9
    out = {}
    for name, slope in cells.items():
        if name.endswith("__slope_per_hour"):
            change = np.zeros(len(slope))
            change[1:] = np.where(hours > 0, np.diff(slope) / np.where(hours > 0, hours, 1.0), 0.0)
            out[name.replace("slope_per_hour", "slope_acceleration_per_hour2")] = change
    return out


def _far_predecessors(flat: DataFrame, keys: Sequence[str], longest: int, width: int) -> DataFrame:
    """Rows a slice needs from before its halo: the last row before a long silence and its window.

    Usually empty: it takes a silence longer than the longest window. The slice
    table is small, so this is one equi-join with a few rows.
    """
    ends = flat.groupBy(*keys, "slice").agg(F.max("us").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("slice")
    start = F.col("slice") * F.lit(width)
    far = ends.withColumn("_last", F.lag("_last").over(before)).filter(F.col("_last") < start - longest)
    far = far.select(*keys, F.col("slice").alias("_target"), "_last", F.explode(F.sequence(
        slice_of(F.col("_last") - longest, width), slice_of("_last", width))).alias("slice"))
    rows = flat.join(far, [*keys, "slice"])
    reached = F.col("us") + 2 * longest >= F.col("_target") * F.lit(width)
    return rows.filter((F.col("us") >= F.col("_last") - longest) & ~reached).select(
        *[F.col("_target").alias(c) if c == "slice" else F.col(c) for c in flat.columns], F.lit(True).alias("is_halo"))


def state_features(df: DataFrame) -> DataFrame:
    """Distances to limits and severity from the smoothed columns of each sensor."""
    out = {}
    for s in SENSORS:
        level = F.col(f"{s.key}__kalman_level")
        out |= {f"{s.key}__raw": F.col(s.key),
                f"{s.key}__fast_slow_difference":
                    F.col(f"{s.key}__fast_ewma") - F.col(f"{s.key}__slow_ewma"),
                f"{s.key}__distance_warning": F.lit(s.warning) - level,
                f"{s.key}__distance_critical": F.lit(s.critical) - level,
                f"{s.key}__normalized_severity":
                    F.greatest((level - s.baseline) / s.span, F.lit(0.0))}
    df = df.withColumns(out)
    sev = [(F.col(f"{s.key}__normalized_severity"), s.weight) for s in SENSORS]
    total = sum(w for _, w in sev)
    weighted = sev[0][0] * sev[0][1]
    for c, w in sev[1:]:
        weighted = weighted + c * w
    return df.withColumns({"maximum_normalized_severity": F.greatest(*[c for c, _ in sev]),
                           "weighted_normalized_severity": weighted / total})


def elapsed_lifecycle_hours(df: DataFrame, keys: Sequence[str] = LIFE) -> DataFrame:
    """Hours since the first row of the lifecycle."""
    starts = df.groupBy(*keys).agg(F.min("us").alias("_start"))
    return (df.join(starts, list(keys))
            .withColumn("elapsed_lifecycle_hours", (F.col("us") - F.col("_start")) / 3.6e9)
            .drop("_start"))


def feature_table(df: DataFrame, sensors: Sequence[str] = SENSOR_KEYS,
                  windows_min: Sequence[int] = WINDOWS_MIN,
                  keep: Sequence[str] = ("machine_id", "lifecycle_id", "us")) -> DataFrame:
    """Fixed-order projection; a missing feature column is an analysis error."""
    return df.select(*keep, *feature_names(sensors, windows_min))


def feature_availability(df: DataFrame, sensors: Sequence[str] = SENSOR_KEYS,
                         windows_min: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    """Longest history over all windows, and whether every window is usable."""
    cells = [f"{k}__w{m}m__" for k in sensors for m in windows_min]
    usable = F.lit(True)
    for c in cells:
        usable = usable & (F.col(c + "feature_available") >= 0.5)
    return df.withColumns({
        "available_history_s": F.greatest(
            *[F.col(c + "available_history_duration_seconds") for c in cells]),
        "feature_available": usable})


def maturity_24h(df: DataFrame, sensors: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    """Worst case over sensors of the 24 h window."""
    def over(name):
        return [F.col(f"{k}__w1440m__{name}") for k in sensors]
    return df.withColumns({
        "window_24h_coverage_fraction": F.least(*over("coverage_fraction")),
        "window_24h_mature": F.least(*over("window_mature")) >= 0.5,
        "window_24h_sample_count": F.least(*over("sample_count")).cast("int"),
        "window_24h_gap_or_discontinuity": F.greatest(*over("gap_or_discontinuity")) >= 0.5})
