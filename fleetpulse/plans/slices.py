"""Time slices: how one machine's history is spread over many tasks.

A window partitioned by machine alone puts a machine's whole history into one
task; one busy machine may hold a third of all rows. Every ordered operator of
this package therefore works on ``(machine, slice)`` where a slice is a fixed
stretch of the order column, and gets what it needs from earlier slices in one
of three exact ways:

* ``scan``: previous/next row, last non-null value and running sums. One small
  row per slice is aggregated (map side first), scanned over the slices of a
  machine, and joined back on ``(machine, slice)``.
* ``with_halo``: rows of a bounded time span are also sent to the next slices
  that can see them, for range frames.
* ``with_history``: the last ``k`` rows before a slice are sent to it, for row
  frames.

The slice table has one row per machine and slice, so the only window over a
whole machine runs on data smaller than the input by the rows per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.params import DAY_US, HOUR_US

ORDER = ("us", "ingest_seq")


def slice_of(column: str | Column, width: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    w = F.lit(int(width)).cast("long")
    return ((c - F.pmod(c, w)) / w).cast("long")


def add_slice(df: DataFrame, by: str = "us", width: int = DAY_US) -> DataFrame:
    return df.withColumn("slice", slice_of(by, width))


def equal_slices(df: DataFrame, keys: Sequence[str], rows: int, by: str = "us",
                 widths: tuple[int, int] = (HOUR_US, 10_000_000)) -> DataFrame:
    """Slices of about ``rows`` rows, however densely a key was sampled.

    Rows are counted per key and hour, hours with more than ``rows`` rows again per ten
    seconds; each such stretch goes to the slice that the rows before it lead to. A slice
    holds at most ``rows`` rows and one stretch more. What is
    ordered per key is the table of stretches, not the rows.
    """
    wide, narrow = ((slice_of(by, w) * F.lit(w)).cast("long") for w in widths)
    hours = df.groupBy(*keys, wide.alias("_hour")).agg((F.count("*") > rows).alias("_dense"))
    rows_of = df.withColumn("_hour", wide).join(hours, [*keys, "_hour"])
    rows_of = rows_of.withColumn("_stretch", F.when(F.col("_dense"), narrow).otherwise(F.col("_hour")))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    slices = (rows_of.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
              .withColumn("slice", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).cast("long"))
              .select(*keys, "_stretch", "slice"))
    return rows_of.drop("slice").join(slices, [*keys, "_stretch"]).drop("_hour", "_dense", "_stretch")


def _cols(spec: Mapping[str, Column | str] | None) -> dict[str, Column]:
    return {k: (F.col(v) if isinstance(v, str) else v) for k, v in (spec or {}).items()}


def scan(df: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ORDER,
         lag: Mapping | None = None, lead: Mapping | None = None,
         last: Mapping | None = None, total: Mapping | None = None,
         after: Mapping | None = None, high: Mapping | None = None) -> DataFrame:
    """Add columns that look across slice borders.

    ``lag``/``lead``: value on the neighbouring row. ``last``: last non-null
    value up to and including this row. ``total``: running sum including it.
    ``after``: next non-null value strictly after this row. ``high``: largest value
    up to and including this row.
    """
    lag, lead, last, total, after, high = map(_cols, (lag, lead, last, total, after, high))
    place = F.struct(*order)
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    aggs = []
    if lag:
        aggs.append(F.max_by(F.struct(*[c.alias(n) for n, c in lag.items()]), place).alias("_tail"))
    if lead:
        aggs.append(F.min_by(F.struct(*[c.alias(n) for n, c in lead.items()]), place).alias("_head"))
    for n, c in last.items():
        aggs.append(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_last_{n}"))
    for n, c in total.items():
        aggs.append(F.sum(c).alias(f"_total_{n}"))
    for n, c in after.items():
        aggs.append(F.min_by(c, F.when(c.isNotNull(), place)).alias(f"_after_{n}"))
    for n, c in high.items():
        aggs.append(F.max(c).alias(f"_high_{n}"))
    per_slice = df.groupBy(*keys, "slice").agg(*aggs)

    across = Window.partitionBy(*keys).orderBy("slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    if lag:
        carry.append(F.lag("_tail").over(across).alias("_tail"))
    if lead:
        carry.append(F.lead("_head").over(across).alias("_head"))
    for n in last:
        carry.append(F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}"))
    for n in total:
        carry.append(F.sum(f"_total_{n}").over(before).alias(f"_total_{n}"))
    for n in high:
        carry.append(F.max(f"_high_{n}").over(before).alias(f"_high_{n}"))
    later = Window.partitionBy(*keys).orderBy(F.col("slice").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    for n in after:
        carry.append(F.last(f"_after_{n}", ignorenulls=True).over(later).alias(f"_after_{n}"))
    carried = per_slice.select(*keys, "slice", *carry)

    inner = [F.col("*")]
    if lag:
        inner.append(F.lag(F.struct(*[c.alias(n) for n, c in lag.items()])).over(w).alias("_plag"))
    if lead:
        inner.append(F.lead(F.struct(*[c.alias(n) for n, c in lead.items()])).over(w).alias("_plead"))
    for n, c in last.items():
        inner.append(F.last(c, ignorenulls=True).over(upto).alias(f"_p_{n}"))
    for n, c in total.items():
        inner.append(F.sum(c).over(upto).alias(f"_s_{n}"))
    for n, c in high.items():
        inner.append(F.max(c).over(upto).alias(f"_h_{n}"))
    # A frame to the end of the partition is rebuilt for every row; the same rows
    # in descending order make it a growing frame.
    down = Window.partitionBy(*keys, "slice").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(
        Window.unboundedPreceding, -1)
    for n, c in after.items():
        inner.append(F.last(c, ignorenulls=True).over(down).alias(f"_n_{n}"))
    joined = df.select(*inner).join(carried, [*keys, "slice"], "left")

    out = []
    for n in lag:
        out.append(F.when(F.col("_plag").isNotNull(), F.col("_plag")[n])
                   .otherwise(F.col("_tail")[n]).alias(n))
    for n in lead:
        out.append(F.when(F.col("_plead").isNotNull(), F.col("_plead")[n])
                   .otherwise(F.col("_head")[n]).alias(n))
    for n in last:
        out.append(F.coalesce(f"_p_{n}", f"_last_{n}").alias(n))
    for n in after:
        out.append(F.coalesce(f"_n_{n}", f"_after_{n}").alias(n))
    for n in total:
        out.append((F.coalesce(F.col(f"_s_{n}"), F.lit(0))
                    + F.coalesce(F.col(f"_total_{n}"), F.lit(0))).alias(n))
    for n in high:
        out.append(F.greatest(F.col(f"_h_{n}"), F.col(f"_high_{n}")).alias(n))
    return joined.select(*[F.col(c) for c in df.columns], *out)


def with_halo(df: DataFrame, span_us: int, width: int = DAY_US) -> DataFrame:
    """Send each row to every slice holding rows that look back to it."""
    reach = slice_of(F.col("us") + F.lit(int(span_us)), width)
    return (df.withColumn("_home", F.col("slice"))
            .withColumn("slice", F.explode(F.sequence(F.col("slice"), reach)))
            .withColumn("is_halo", F.col("slice") != F.col("_home"))
            .drop("_home"))


def with_history(df: DataFrame, keys: Sequence[str], rows: int,
                 order: Sequence[str] = ORDER) -> DataFrame:
    """Send the ``rows`` rows before each slice to that slice, marked ``is_halo``."""
    cols = [c for c in df.columns if c not in (*keys, "slice")]
    back = Window.partitionBy(*keys, "slice").orderBy(*[F.col(c).desc() for c in order])
    tails = (df.withColumn("_rank", F.row_number().over(back))
             .filter(F.col("_rank") <= rows)
             .groupBy(*keys, "slice")
             .agg(F.array_sort(F.collect_list(F.struct(
                 *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                 F.struct(*cols).alias("_row")))).alias("_rows")))
    # Rows are counted up to each slice, so only the few slices before a border
    # that hold its last rows are gathered.
    counts = df.groupBy(*keys, "slice").agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*keys).orderBy("slice")
    ends = counts.withColumns({"_end": F.sum("_n").over(across), "_next": F.lead("slice").over(across)})
    near = Window.partitionBy(*keys).orderBy("_end").rangeBetween(-(rows - 1), 0)
    seen = (tails.join(ends, [*keys, "slice"])
            .withColumn("_seen", F.flatten(F.collect_list("_rows").over(near)))
            .filter(F.col("_next").isNotNull()))
    start = F.greatest(F.size("_seen") - F.lit(rows), F.lit(0)) + 1
    halo = (seen.select(*keys, F.col("_next").alias("slice"),
                        F.explode(F.slice("_seen", start, F.lit(rows))).alias("_h"))
            .select(*keys, "slice", "_h._row.*").withColumn("is_halo", F.lit(True)))
    return df.withColumn("is_halo", F.lit(False)).unionByName(halo)


def spread(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Hash rows by group into the configured number of partitions.

    Python kernels cost far more per byte than scans, so their partitions must not
    be merged by size: a fixed number keeps adaptive execution from doing so.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *group)


def in_slice(keys: Sequence[str], order: Sequence[str] = ORDER):
    return Window.partitionBy(*keys, "slice").orderBy(*order)
