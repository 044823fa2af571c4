"""Leakage-free training sets: sampling, labels, weights, derived features, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators.evaluate import n_where, ratio
from fleetpulse.operators.lifecycles import duration_bucket
from fleetpulse.params import DURATION_BOUNDS_H, HORIZONS_H, SENSOR_KEYS
from fleetpulse.plans.quantiles import quantiles
from fleetpulse.plans.ranks import ranked
from fleetpulse.plans.slices import scan

LIFE = ("machine_id", "lifecycle_id")


# ---- sampling -------------------------------------------------------------------

def linspace_sample(df: DataFrame, n: int, keys: Sequence[str] = LIFE) -> DataFrame:
    """At most ``n`` evenly placed rows per lifecycle, first and last included."""
    rows = scan(df, keys, total={"_pos": F.lit(1).cast("long")}).withColumn("_pos", F.col("_pos") - 1)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    step = (F.col("_rows") - 1) / F.lit(float(max(n - 1, 1)))
    some = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(
        i == n - 1, F.col("_rows") - 1).otherwise(F.floor(i * step)).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)
    picks = counts.select(*keys, F.explode(F.array_distinct(
        F.when(F.col("_rows") <= n, every).otherwise(some))).alias("_pos"))
    return rows.join(picks, [*keys, "_pos"], "left_semi").select(*df.columns)


def lead_hours(event: str) -> Column:
    return (F.col(event) - F.col("us")) / 3.6e9


def pre_event_sample(df: DataFrame, event: str, n: int = 500, keys: Sequence[str] = LIFE) -> DataFrame:
    """Evenly placed rows before the event; all rows count where there is none."""
    return linspace_sample(df.filter(F.col(event).isNull() | (F.col("us") < F.col(event))), n, keys)


def near_onset_sample(df: DataFrame, event: str, n: int = 500, horizons: Sequence[int] = HORIZONS_H,
                      keys: Sequence[str] = LIFE) -> DataFrame:
    """Dense rows inside each horizon and in the band just before it."""
    lead = lead_hours(event)
    before = df.filter(lead > 0)
    out = None
    for h in horizons:
        for rows, k in ((before.filter(lead <= h), max(60, n // 3)),
                        (before.filter((lead > h) & (lead <= 2 * h)), max(30, n // 10))):
            one = linspace_sample(rows, k, keys)
            out = one if out is None else out.unionByName(one)
    return out.dropDuplicates([*keys, "us", "ingest_seq"])


def training_sample(df: DataFrame, events: Sequence[str], n: int = 500, keys: Sequence[str] = LIFE) -> DataFrame:
    """Union of the pre-event and near-onset samples of every event."""
    out = None
    for e in events:
        one = pre_event_sample(df, e, n, keys).unionByName(near_onset_sample(df, e, n, keys=keys))
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates([*keys, "us", "ingest_seq"])


def eligible_examples(df: DataFrame, min_rows: int = 12, keys: Sequence[str] = LIFE) -> DataFrame:
    """Trainable rows of lifecycles that keep enough of them."""
    rows = df.filter(F.col("training_eligible"))
    enough = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    return rows.join(enough.select(*keys), list(keys), "left_semi")


def screening_report(df: DataFrame) -> DataFrame:
    """(measure, reason, rows): eligible, excluded by reason, under review, inserted."""
    def one(name, reason, cond):
        return F.when(cond, F.struct(F.lit(name).alias("measure"), reason.alias("reason")))
    ok, none = F.col("training_eligible"), F.lit("")
    why = F.when(F.col("training_exclusion_reason") == "", "anomaly_policy_exclusion").otherwise(F.col("training_exclusion_reason"))
    items = F.array_compact(F.array(
        one("valid_rows", none, F.lit(True)), one("eligible_rows", none, ok), one("excluded_rows", why, ~ok),
        one("human_review_rows", none, F.col("requires_human_review")),
        one("interpolated_eligible_rows", none, ok & F.col("interpolated"))))
    return df.select(F.explode(items).alias("x")).select("x.*").groupBy("measure", "reason").agg(F.count("*").alias("rows"))


# ---- targets ---------------------------------------------------------------------

def regression_targets(df: DataFrame, event: str, n: int | None = None, keys: Sequence[str] = LIFE) -> DataFrame:
    """Hours to the first confirmed event, strictly before it; all rows, or at most ``n`` of each lifecycle."""
    rows = df.filter(F.col("us") < F.col(event))
    if n is not None:
        rows = linspace_sample(rows, n, keys)
    return rows.withColumn("target_hours", lead_hours(event))


def horizon_labels(df: DataFrame, event: str, hours: float) -> DataFrame:
    """Rows before the event labelled by ``0 < lead <= H``; event-free lifecycles are all negative."""
    rows = df.filter(F.col(event).isNull() | (F.col("us") < F.col(event)))
    lead = lead_hours(event)
    return rows.withColumns({"lead_hours": lead, "label": F.coalesce((lead > 0) & (lead <= hours), F.lit(False))})


# ---- weights ----------------------------------------------------------------------

def lifecycle_weights(df: DataFrame, keys: Sequence[str] = LIFE, name: str = "weight") -> DataFrame:
    """Every lifecycle weighs the same; weights sum to the number of rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_lives"))
    rows = df.join(counts, list(keys)).crossJoin(F.broadcast(total))  # one row
    return rows.withColumn(name, F.col("_rows") / (F.col("_lives") * F.col("_n"))).drop("_n", "_rows", "_lives")


def probability_weights(df: DataFrame, hours: float, *, early: float = 1.35, balance: float = 0.35,
                        boundary: float = 1.75, keys: Sequence[str] = LIFE) -> DataFrame:
    """Lifecycle weights, partly class-balanced, with early positives and boundary negatives raised.

    All totals come from one aggregation; emphasis only moves weight among positives.
    """
    rows = lifecycle_weights(df, keys, "_w")
    lead, y, w = F.col("lead_hours"), F.col("label"), F.col("_w")
    part = F.least(F.greatest(lead / float(hours), F.lit(0.0)), F.lit(1.0))
    emphasis = F.coalesce(1.0 + (early - 1.0) * part * part, F.lit(1.0))
    edge = F.coalesce(~y & (lead > hours) & (lead <= 2.0 * hours), F.lit(False))

    def total(cond, value):
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))
    sums = rows.agg(total(y, w).alias("_pos"), total(~y, w).alias("_neg"), total(y, w * emphasis).alias("_emp"),
                    total(edge, w).alias("_edge"), F.count("*").alias("_rows"))
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    factor = F.when(both, F.pow(F.col("_neg") / F.col("_pos"), F.lit(float(balance)))).otherwise(1.0)
    positive = w * factor * emphasis * F.when(F.col("_emp") > 0, F.col("_pos") / F.col("_emp")).otherwise(1.0)
    negative = w * F.when(edge, float(boundary)).otherwise(1.0)
    mass = F.col("_pos") * factor + F.col("_neg") + F.col("_edge") * (boundary - 1.0)
    out = rows.crossJoin(F.broadcast(sums))  # one row
    weight = F.when(y, positive).otherwise(negative) * F.col("_rows") / F.greatest(mass, F.lit(1e-12))
    return out.withColumn("weight", weight).drop("_w", "_pos", "_neg", "_emp", "_edge", "_rows")


def hard_example_weights(df: DataFrame, hours: float, *, negative_q: float = 0.85, negative_x: float = 2.25,
                         positive_q: float = 0.2, positive_x: float = 1.25, score: str = "oof") -> DataFrame:
    """Multipliers for high-scoring negatives and low-scoring early positives of held-out scores."""
    p, y, lead = F.col(score), F.col("label"), F.col("lead_hours")
    early = y & (lead >= 0.5 * hours) & (lead <= hours)
    high = quantiles(df.filter(~y), (), p, [negative_q], "_q").select(F.col("_q")[0].alias("_high"))
    low = quantiles(df.filter(early), (), p, [positive_q], "_q").select(F.col("_q")[0].alias("_low"))
    rows = df.crossJoin(F.broadcast(high)).crossJoin(F.broadcast(low))  # one row each
    hard_neg = F.coalesce(~y & (p >= F.col("_high")), F.lit(False))
    hard_pos = F.coalesce(early & (p <= F.col("_low")), F.lit(False))
    return rows.withColumns({
        "hard_negative": hard_neg, "hard_early_positive": hard_pos,
        "multiplier": F.when(hard_neg, float(negative_x)).otherwise(1.0) * F.when(
            hard_pos, float(positive_x)).otherwise(1.0)}).drop("_high", "_low")


# ---- features ------------------------------------------------------------------------

# Features kept for audit only, and the change features allowed for probabilities.
AUDIT_ONLY = ("elapsed_lifecycle_hours", "consecutive_warning_hours", "consecutive_critical_hours")
CHANGE_TOKENS = ("kalman_rate_per_hour", "fast_slow_difference", "slope_per_hour", "__change",
                 "slope_acceleration_per_hour2")
# Short state minus long baseline, per sensor.
RESIDUALS = (("kalman_level", "w1440m__median"), ("slow_ewma", "w1440m__median"),
             ("w15m__mean", "w360m__median"), ("w60m__mean", "w360m__median"),
             ("w60m__mean", "w720m__median"), ("w180m__mean", "w720m__median"),
             ("w180m__mean", "w1440m__median"), ("w360m__mean", "w1440m__median"))
SNR_WINDOWS = (60, 180, 360, 720, 1440)


def select_features(names: Sequence[str], policy: str) -> list[str]:
    """``eta`` drops age features; ``probability`` keeps rates and changes only."""
    if policy == "eta":
        return [n for n in names if n not in AUDIT_ONLY]
    if policy == "probability":
        return [n for n in names if any(t in n for t in CHANGE_TOKENS)]
    raise ValueError(f"unknown feature policy {policy!r}")


def residual_columns(sensors: Sequence[str] = SENSOR_KEYS) -> list[tuple[str, str, str]]:
    return [(f"{k}__{a}", f"{k}__{b}", f"{k}__{b.split('__')[0]}__std") for k in sensors for a, b in RESIDUALS]


def residual_features(df: DataFrame, sensors: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    return df.withColumns({f"residual::{a}-minus-{b}": F.col(a) - F.col(b)
                           for a, b, _ in residual_columns(sensors)})


def scale_floors(train: DataFrame, sensors: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    """Lower quartile of each positive deviation in training data, one row per column."""
    cols = sorted({s for _, _, s in residual_columns(sensors)}
                  | {f"{k}__w{m}m__std" for k in sensors for m in SNR_WINDOWS})
    long = train.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("scale"), F.abs(F.col(c)).alias("v")) for c in cols])).alias("x")).select("x.*")
    found = quantiles(long.filter(F.col("v") > 1e-12), ["scale"], F.col("v"), [0.25], "q")
    return found.select("scale", F.greatest(F.col("q")[0], F.lit(1e-6)).alias("floor"))


def floor_map(floors: DataFrame) -> dict[str, float]:
    """The floors as literals: one number per deviation column, at most a few dozen."""
    return {r["scale"]: r["floor"] for r in floors.collect()}


def _clip8(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-8.0)), F.lit(8.0))


def standardized_residuals(df: DataFrame, floors: Mapping[str, float],
                           sensors: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    """Residuals over the long deviation, floored by training data, clipped to +-8."""
    return df.withColumns({f"normalized_residual::{a}-minus-{b}-over-{s}": _clip8(
        (F.col(a) - F.col(b)) / F.greatest(F.abs(F.col(s)), F.lit(floors.get(s, 1e-6))))
        for a, b, s in residual_columns(sensors)})


def trend_snr(df: DataFrame, floors: Mapping[str, float], sensors: Sequence[str] = SENSOR_KEYS) -> DataFrame:
    """Movement by slope over the window against its deviation, clipped to +-8."""
    out = {}
    for k in sensors:
        for m in SNR_WINDOWS:
            slope, s = f"{k}__w{m}m__slope_per_hour", f"{k}__w{m}m__std"
            out[f"trend_snr::{slope}-over-{s}"] = _clip8(F.col(slope) * (m / 60.0) / F.greatest(
                F.abs(F.col(s)), F.lit(floors.get(s, 1e-6))))
    return df.withColumns(out)


def feature_envelope(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """1 % and 99 % quantile per feature, as rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("x")).select("x.*")
    return quantiles(long, ["feature"], F.col("v"), [low, high], "q").select(
        "feature", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p99"))


# ---- splits -----------------------------------------------------------------------------

def split_lifecycles(lifecycles: DataFrame, seeds: int = 128, *, train: float = 2 / 3, first_seed: int = 42,
                     bounds: Sequence[float] = DURATION_BOUNDS_H) -> DataFrame:
    """Disjoint train / validation / test lifecycles from the best of many seeded splits.

    Each seed ranks lifecycles by a seeded hash inside their outcome class, so every
    split is stratified. Seeds are scored by missing outcomes, missing regimes, then
    the weighted distance of category shares. Everything is a grouped aggregation over
    seed x lifecycle; the best seed number is the only thing picked globally.
    """
    base = lifecycles.withColumn("duration_bucket", duration_bucket("duration_hours", bounds))
    seeded = base.withColumn("seed", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + seeds - 1))))
    name = F.concat_ws("/", *LIFE)
    # A class may hold most lifecycles: ranks go through ranges, class sizes are the same for every seed.
    sizes = base.groupBy(F.col("critical_reached").alias("_class")).agg(F.count("*").alias("_size"))
    seeded = ranked(seeded, [F.xxhash64("seed", name), name], ["seed", "critical_reached"], "_rank").join(
        F.broadcast(sizes), F.col("critical_reached").eqNullSafe(F.col("_class")))  # three rows at most
    share = (F.col("_rank") - 0.5) / F.col("_size")
    rest = (1.0 - train) / 2.0
    part = F.when(share <= train, "train").when(share <= train + rest, "validation").otherwise("test")
    placed = seeded.withColumn("split", part).drop("_rank", "_size", "_class")
    dims = {"critical_reached": 4.0, "operating_regime": 3.0, "duration_bucket": 1.5, "degradation_family": 1.0}
    long = placed.select("seed", "split", F.explode(F.array(*[F.struct(
        F.lit(d).alias("dim"), F.col(d).cast("string").alias("cat"), F.lit(w).alias("w")) for d, w in dims.items()])).alias("x")).select("seed", "split", "x.*")
    whole = long.groupBy("seed", "dim", "cat", "w").agg(
        F.count("*").alias("n_all"), *[n_where(F.col("split") == s).alias(f"n_{s}") for s in ("validation", "test")])
    sizes = placed.groupBy("seed").agg(F.count("*").alias("t_all"), *[
        n_where(F.col("split") == s).alias(f"t_{s}") for s in ("validation", "test")])
    scored = whole.join(sizes, "seed")
    gap, absent = F.lit(0.0), {"critical_reached": F.lit(0), "operating_regime": F.lit(0)}
    for s in ("validation", "test"):
        gap = gap + F.col("w") * F.abs(F.coalesce(ratio(F.col(f"n_{s}"), F.col(f"t_{s}")), F.lit(2.0)) - F.col("n_all") / F.col("t_all"))
        for d in absent:
            absent[d] = absent[d] + ((F.col("dim") == d) & (F.col(f"n_{s}") == 0)).cast("int")
    best = scored.groupBy("seed").agg(
        F.sum(absent["critical_reached"]).alias("outcome_missing"), F.sum(absent["operating_regime"]).alias("regime_missing"),
        F.round(F.sum(gap), 9).alias("distance")).agg(
        F.min(F.struct("outcome_missing", "regime_missing", "distance", "seed")).alias("b"))
    chosen = best.select(F.col("b.seed").alias("seed"))
    return placed.join(F.broadcast(chosen), "seed").drop("duration_bucket")  # one row


def split_representation(split: DataFrame, bounds: Sequence[float] = DURATION_BOUNDS_H) -> DataFrame:
    """Lifecycles per split and category of every dimension, in one grouping-sets pass."""
    rows = split.withColumns({"duration_bucket": duration_bucket("duration_hours", bounds),
                              "critical_reached": F.col("critical_reached").cast("string")})
    dims = ["duration_bucket", "operating_regime", "critical_reached", "degradation_family"]
    out = rows.groupingSets([[F.col("split"), F.col(d)] for d in dims], F.col("split"), *[F.col(d) for d in dims]).agg(
        F.count("*").alias("lifecycles"), *[F.grouping(F.col(d)).alias(f"_{d}") for d in dims])
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        which, value = F.when(F.col(f"_{d}") == 0, d).otherwise(which), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(value)
    return out.select("split", which.alias("dimension"), value.alias("category"), "lifecycles")


def calibration_split(df: DataFrame, min_lifecycles: int = 8, keys: Sequence[str] = LIFE) -> DataFrame:
    """Every other positive and every other negative lifecycle calibrates; the rest selects.

    With too few lifecycles, or one class in either part, all rows select.
    """
    lives = df.groupBy(*keys).agg(F.bool_or("label").alias("_pos"), F.bool_and("label").alias("_all"))
    lives = ranked(lives, [F.col(k) for k in keys], ["_pos"], "_rank").withColumn("_cal", F.col("_rank") % 2 == 1).drop("_rank")
    pos, neg = F.col("_pos"), ~F.col("_all")
    ok = lives.agg(((F.count("*") >= min_lifecycles) & (n_where(F.col("_cal") & pos) > 0) & (n_where(F.col("_cal") & neg) > 0)
                    & (n_where(~F.col("_cal") & pos) > 0) & (n_where(~F.col("_cal") & neg) > 0)).alias("_ok"))
    marks = lives.crossJoin(F.broadcast(ok)).select(*keys, (F.col("_cal") & F.col("_ok")).alias("calibration"))  # one row
    return df.join(marks, list(keys))


def group_folds(df: DataFrame, folds: int = 3, keys: Sequence[str] = LIFE) -> DataFrame:
    """Fold per lifecycle: largest lifecycles first, dealt back and forth to even out rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    lap = (F.col("_deal") - 1) % (2 * folds)
    fold = F.when(lap < folds, lap).otherwise(2 * folds - 1 - lap)
    dealt = ranked(counts, [-F.col("_n"), *[F.col(k) for k in keys]], name="_deal")
    return df.join(dealt.select(*keys, fold.cast("int").alias("fold")), list(keys))


def target_eligibility(rates: DataFrame, low: float = 0.005, high: float = 0.95) -> DataFrame:
    """Per target: positive rate inside bounds and two classes in every split."""
    r = F.col("positive_rate")
    out = rates.groupBy("target").agg(F.every(r.between(low, high)).alias("_rate"),
                                      F.every((r > 0) & (r < 1)).alias("_both"))
    return out.select("target", (F.col("_rate") & F.col("_both")).alias("eligible"),
                      F.when(~F.col("_rate"), "target_is_nearly_constant").when(~F.col("_both"), "single_class_in_split").alias("reason"))


def guard_training_input(datasets: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Datasets with an acceptance role or a forbidden content hash, with the reason they are refused."""
    bad = forbidden.select("dataset_hash", F.lit(True).alias("_bad")).dropDuplicates(["dataset_hash"])
    rows = datasets.join(bad, "dataset_hash", "left")
    why = F.when(F.col("dataset_role") == "acceptance", "held_out_acceptance_role").when(F.col("_bad"), "forbidden_content_hash")
    return rows.withColumns({"refusal": why, "allowed": why.isNull()}).drop("_bad")
