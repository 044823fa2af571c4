"""Profiling of a readings table before replay or training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators.persistence import status_runs
from fleetpulse.params import SENSOR_KEYS
from fleetpulse.plans.quantiles import join_by, quantiles
from fleetpulse.plans.slices import scan

KEYS = ("machine_id",)
PROBS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
NAMES = ("minimum", "p01", "p05", "p25", "median", "p75", "p95", "p99", "maximum")


def unpivoted(df: DataFrame, values: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """One row per row and value: (groups, variable, value)."""
    cells = [F.struct(F.lit(name).alias("variable"), v.cast("double").alias("value")) for name, v in values.items()]
    return df.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.variable", "_c.value")


def percentiles(df: DataFrame, values: dict[str, Column], by: Sequence[str] = KEYS,
                exact: bool = True) -> DataFrame:
    """Nine percentiles per value, one row per group and value, in one pass over the input.

    ``exact=False`` takes them from one sketch per group and value.
    """
    long, keys = unpivoted(df, values, by), [*by, "variable"]
    if exact:
        out = quantiles(long, keys, F.col("value"), PROBS, "q")
    else:
        out = long.groupBy(*keys).agg(F.percentile_approx("value", F.array(*map(F.lit, PROBS)), F.lit(10000)).alias("q"))
    return out.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(NAMES)])


def sensor_statistics(df: DataFrame, cols: Sequence[str] = SENSOR_KEYS, by: Sequence[str] = KEYS) -> DataFrame:
    """Percentiles, mean, deviation and measurement noise from the spread of adjacent differences."""
    keys = [*by, "variable"]
    table = percentiles(df, {c: F.col(c) for c in cols}, by)
    base = unpivoted(df, {c: F.col(c) for c in cols}, by).groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("standard_deviation"))
    steps = scan(df, by, lag={f"_was_{c}": c for c in cols})
    moves = unpivoted(steps, {c: F.col(c) - F.col(f"_was_{c}") for c in cols}, by)
    center = quantiles(moves, keys, F.col("value"), [0.5], "_m").select(*keys, F.col("_m")[0].alias("_mid"))
    away = moves.join(center, keys)
    spread = quantiles(away, keys, F.abs(F.col("value") - F.col("_mid")), [0.5], "_s")
    extra = join_by(base, spread, keys).select(
        *keys, "mean", "standard_deviation", (F.col("_s")[0] * 1.4826 / 2 ** 0.5).alias("measurement_noise_estimate"))
    return table.drop("p25", "p75").join(extra, keys)


def intervals(df: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Seconds between rows in arrival order, over rows with a time."""
    rows = scan(df.filter(F.col("us").isNotNull()), by, order=order, lag={"_was_us": "us"})
    return rows.withColumn("interval_s", (F.col("us") - F.col("_was_us")) / 1e6)


def quality_counts(parsed: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Repeated, backward, missing and unreadable times; missing and non-numeric cells; odd labels.

    Reads the columns of ``parse_rows``. A repeat is an adjacent equal time; missing
    times are counted against the median cadence.
    """
    def n(cond):
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    timed = F.col("us").isNotNull()
    blank = {k: F.trim(F.col("raw_text")[k]).eqNullSafe("") | F.col("raw_text")[k].isNull() for k in SENSOR_KEYS}
    unusable = {k: F.col(k).isNull() | F.isnan(k) | (F.abs(k) == float("inf")) for k in SENSOR_KEYS}
    counts = parsed.groupBy(*by).agg(
        F.count("*").alias("row_count"), n(~timed).alias("invalid_timestamps"),
        n(timed & (F.col("label").isNull() | ~F.col("label_known"))).alias("invalid_status_values"),
        *[n(timed & blank[k]).alias(f"missing_{k}") for k in SENSOR_KEYS],
        *[n(timed & ~blank[k] & unusable[k]).alias(f"non_numeric_{k}") for k in SENSOR_KEYS])
    steps = intervals(parsed, by)
    s = F.col("interval_s")
    cadence = quantiles(steps.filter(s > 0), by, s, [0.5], "_c").select(*by, F.col("_c")[0].alias("median_seconds"))
    gaps = steps.join(cadence, list(by), "left")
    missing = F.greatest(F.rint(s / F.col("median_seconds")) - 1, F.lit(0.0))
    order = gaps.groupBy(*by).agg(
        n(s == 0).alias("duplicate_timestamps"), n(s < 0).alias("out_of_order_timestamps"),
        F.coalesce(F.sum(F.when(s > 0, missing)), F.lit(0.0)).cast("long").alias("missing_timestamps"),
        F.max("median_seconds").alias("median_seconds"))
    return join_by(counts, order, by)


def validation_summary(df: DataFrame, examples: int = 3, by: Sequence[str] = KEYS) -> DataFrame:
    """Count and first examples per reject reason.

    The rank filter is a group limit Spark applies before the shuffle, so a reason
    shared by most rows sends only its first few from each task.
    """
    bad = df.filter(~F.col("valid"))
    counts = bad.groupBy(*by, "reason").agg(F.count("*").alias("rows"))
    w = Window.partitionBy(*by, "reason").orderBy("ingest_seq")
    first = (bad.select(*by, "reason", "ingest_seq", F.row_number().over(w).alias("_r")).filter(F.col("_r") <= examples)
             .groupBy(*by, "reason").agg(F.array_sort(F.collect_list("ingest_seq")).alias("example_rows")))
    return counts.join(first, [*by, "reason"])


def timeline_summary(df: DataFrame, status: str = "label", by: Sequence[str] = KEYS,
                     cadence_s: float = 60.0) -> DataFrame:
    """Span, first warning and critical, transitions and the longest run of each status."""
    runs = status_runs(df, status, by)
    hours = (F.col("end_us") - F.col("start_us")) / 3.6e9 + cadence_s / 3600.0
    longest = runs.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(F.col(status) == s, hours)), F.lit(0.0)).alias(f"longest_{s}_hours")
          for s in ("normal", "warning", "critical")], (F.count("*") - 1).alias("transitions"))
    span = df.groupBy(*by).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"),
        ((F.max("us") - F.min("us")) / 3.6e9).alias("total_hours"),
        *[F.min(F.when(F.col(status) == s, F.col("us"))).alias(f"first_{s}_us") for s in ("warning", "critical")])
    return span.join(longest, list(by))


# How many finished lifecycles each use needs.
NEEDED = {"training": 10, "validation": 10, "promotion_evaluation": 20}


def suitability(quality: DataFrame, rejected: DataFrame, lifecycles: DataFrame, columns: Sequence[str] | None = None,
                by: Sequence[str] = KEYS) -> DataFrame:
    """Coded refusals per machine and use; a use without rows is suitable."""
    from fleetpulse.sources.readings import contract_violations

    # Refusal codes of single counters.
    codes = {"invalid_timestamps": "invalid_timestamps", "duplicate_timestamps": "duplicate_timestamps",
             "out_of_order_timestamps": "non_monotonic_timestamps", "invalid_status_values": "invalid_status_values"}
    sums = {"non_numeric_sensor_values": [f"non_numeric_{k}" for k in SENSOR_KEYS],
            "missing_sensor_values": [f"missing_{k}" for k in SENSOR_KEYS]}
    cells = [(code, F.col(c)) for c, code in codes.items()]
    for code, parts in sums.items():
        total = F.col(parts[0])
        for c in parts[1:]:
            total = total + F.col(c)
        cells.append((code, total))
    cells.append(("invalid_sampling_intervals", F.when(F.col("median_seconds").isNull() & (F.col("row_count") > 1), 1).otherwise(0)))
    found = quality.select(*by, F.explode(F.array(*[F.struct(
        F.lit(code).alias("code"), n.cast("long").alias("count")) for code, n in cells])).alias("x")).select(*by, "x.*").filter("count > 0")
    refused = rejected.filter(~F.col("valid")).groupBy(*by).agg(F.count("*").alias("count")).select(
        *by, F.lit("input_validator_rejection").alias("code"), "count")
    common = found.unionByName(refused)
    if columns is not None:
        for code, _, n in contract_violations(columns):
            common = common.unionByName(quality.select(*by, F.lit(code).alias("code"), F.lit(n).cast("long").alias("count")))
    uses = F.explode(F.array(*map(F.lit, ("replay", "feature_extraction", *NEEDED)))).alias("use")
    common = common.select(*by, uses, "code", "count")
    finished = quality.select(*by).join(lifecycles.groupBy(*by).agg(F.count("*").alias("n")), list(by), "left").fillna(0, ["n"])
    short = finished.select(*by, "n", F.explode(F.array(*[F.struct(
        F.lit(u).alias("use"), F.lit(k).alias("need"), F.lit(
            "insufficient_completed_lifecycles" if u == "training" else f"insufficient_{u.split('_')[0]}_lifecycles").alias("code"))
        for u, k in NEEDED.items()])).alias("x")).select(*by, "x.use", "x.code", F.col("n").alias("count"), "x.need")
    return common.unionByName(short.filter(F.col("count") < F.col("need")).drop("need"))


def range_vs_envelope(df: DataFrame, envelope: DataFrame, cols: Sequence[str] = SENSOR_KEYS,
                      by: Sequence[str] = KEYS) -> DataFrame:
    """Observed range of each sensor against the training 1 % - 99 % envelope (feature, p01, p99)."""
    seen = df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    rows = seen.select(*by, F.explode(F.array(*[F.struct(
        F.lit(c).alias("sensor"), F.col(f"lo_{c}").alias("observed_minimum"), F.col(f"hi_{c}").alias("observed_maximum"))
        for c in cols])).alias("x")).select(*by, "x.*")
    limits = envelope.select(F.regexp_replace("feature", "__raw$", "").alias("sensor"), "p01", "p99")
    out = rows.join(limits, "sensor")
    return out.withColumn("outside_training_range", (F.col("observed_minimum") < F.col("p01"))
                          | (F.col("observed_maximum") > F.col("p99")))
