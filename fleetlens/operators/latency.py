"""Latency measurements: parsing, time buckets, outliers and the weekly report.

Measurements have ``ts`` and ``time`` (and ``addr``, ``network`` where used);
bucket stats have ``time_bucket, count, avg, max, median``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetlens.functions.formatting import bar, fixed, format_date, half_up
from fleetlens.functions.intervals import interval_seconds, spark_interval
from fleetlens.functions.latency_text import REPLY_FIELDS, REPLY_LINE, reply_field
from fleetlens.operators.skew import MAX_BROADCAST_ROWS, equal_keys, lookup_join
from fleetlens.session import materialize

# Network names, default outlier distance in standard deviations.
NETWORKS = ("local", "global")
OUTLIER_STDDEVS = 1

# percentile_approx promises a rank error of at most n / QUANTILE_ACCURACY, so
# quantiles this far to both sides of one half enclose the exact median.
QUANTILE_ACCURACY = 10_000
_MARGIN = 2.0 / QUANTILE_ACCURACY

# Cells that a bucket's distinct values are cut into; the middle one is ordered in one task.
CELLS = 128

# Weeks start on Monday: the epoch is a Thursday.
_WEEK_START = "4 days"


def parse_ping_lines(lines: DataFrame, col: str = "value", mode: str = "failfast") -> DataFrame:
    """Reply lines as columns next to the other input columns; other lines are dropped.

    Reading a field that a reply lacks raises; with ``mode="quarantine"`` the
    row is kept with the line in ``error``.
    """
    if mode not in ("failfast", "quarantine"):
        raise ValueError(f"mode is failfast or quarantine, not {mode!r}")
    line = F.col(col)
    others = [c for c in lines.columns if c != col]
    replies = lines.filter(line.rlike(REPLY_LINE))
    if mode == "quarantine":
        fields = replies.select(*others, line, *[reply_field(line, name).alias(name) for name in REPLY_FIELDS])
        missing = F.greatest(*[F.col(name).isNull() for name in REPLY_FIELDS])
        return fields.withColumn("error", F.when(missing, line)).drop(col)
    fail = F.raise_error(F.concat(F.lit("incomplete reply line: "), line))
    found = [F.coalesce(reply_field(line, n), fail.cast(REPLY_FIELDS[n][2])).alias(n) for n in REPLY_FIELDS]
    return replies.select(*others, *found)


def check_address(df: DataFrame, expected: str) -> DataFrame:
    """Raise when a reply came from another address than the one resolved."""
    wrong = misaddressed(F.col("addr"), F.lit(expected))
    return df.filter(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean")))


def misaddressed(addr: Column, expected: Column) -> Column:
    """What is wrong with a reply's address; NULL if it is the expected one."""
    got = F.concat(F.lit("expected "), F.coalesce(expected, F.lit("no address")), F.lit(", reply from "), F.coalesce(addr, F.lit("none")))
    return F.when(~addr.eqNullSafe(expected), got)


def by_network(df: DataFrame, network: str) -> DataFrame:
    """Only ``local`` or ``global`` measurements."""
    if network not in NETWORKS:
        raise ValueError(f"network is one of {NETWORKS}, not {network!r}")
    return df.filter(F.col("network") == network)


def since(df: DataFrame, lookback: str, now: Column, ts: str = "ts") -> DataFrame:
    """Rows of the last ``5m``, ``2h``, ``7d`` or ``1w`` before ``now``.

    On the stored measurements (``day`` is the date of ``ts``) older days are
    not read at all.
    """
    first = now - F.expr(f"INTERVAL {spark_interval(lookback)}")
    stored = dict(df.dtypes).get("day") == "date" and ts == "ts"
    recent = df.filter(F.col("day") >= F.to_date(first)) if stored else df
    return recent.filter(F.col(ts) >= first)


def resolve_address(
    df: DataFrame, addresses: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Add the columns of the address table (``addr, addr_id, ...``); NULL where unknown."""
    return lookup_join(df, addresses, "addr", "left", max_broadcast_rows=max_broadcast_rows)


def bucket_window(ts: Column, duration: str) -> Column:
    """The tumbling window ``ts`` lies in, in batch and stream; whole weeks start on Monday."""
    start = _WEEK_START if interval_seconds(duration) % 604800 == 0 else "0 seconds"
    return F.window(ts, spark_interval(duration), startTime=start)


def slot_window(ts: Column, duration: str) -> Column:
    """A tumbling window of an interval such as ``7d``, or of one in words such as ``5 seconds``; weeks start on Monday."""
    if " " not in duration:
        return bucket_window(ts, duration)
    count, unit = duration.split()
    days = int(count) * {"day": 1, "week": 7}.get(unit.rstrip("s"), 0)
    return F.window(ts, duration, startTime=_WEEK_START if days and days % 7 == 0 else "0 seconds")


def bucket_start(ts: Column, duration: str) -> Column:
    return bucket_window(ts, duration)["start"]


def time_bucket_stats(
    df: DataFrame,
    duration: str = "5m",
    ts: str = "ts",
    value: str = "time",
    keys: Sequence[str] = (),
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``count, avg, max, median`` per time bucket (and ``keys``); the median is exact.

    First pass: the plain aggregates and two approximate quantiles that enclose
    the median; only small digests are shuffled. Second pass: count what lies
    below the lower one and keep the distinct values between the two, then pick
    the middle rank. No task sees more than a thin slice of a large bucket.
    """
    keys = list(keys)
    by = [*keys, "time_bucket"]
    rows = df.select(*keys, bucket_start(F.col(ts), duration).alias("time_bucket"), F.col(value).alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull())
    around = F.array(F.lit(0.5 - _MARGIN), F.lit(0.5 + _MARGIN))
    stats = materialize(
        rows.groupBy(*by).agg(
            F.count("_v").alias("count"),
            F.avg("_v").alias("avg"),
            F.max("_v").alias("max"),
            F.percentile_approx("_v", around, QUANTILE_ACCURACY).alias("_around"),
        )
    )
    counts = stats.select(*by, F.col("count").alias("n"))
    near = lookup_join(
        rows, stats, by, spread=["_v"], counts=counts, max_broadcast_rows=max_broadcast_rows, null_safe=True
    ).filter(F.col("_v") <= F.col("_around")[1])
    inside = F.when(F.col("_v") >= F.col("_around")[0], F.col("_v"))
    ranks = near.groupBy(*by, "count", "avg", "max", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    medians = _middle(ranks, [*by, "count", "avg", "max"], "count")
    fail = F.raise_error(F.lit("the quantile bounds do not enclose the median")).cast("double")
    return medians.withColumn("median", F.coalesce("median", fail)).select(*by, "count", "avg", "max", "median")


def _middle(ranks: DataFrame, by: Sequence[str], total: str) -> DataFrame:
    """Median per group of ``_v, _n`` rows (value, how often).

    A row with ``_v`` NULL counts the values below all others.
    """
    order = W.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = ranks.withColumn("_upto", F.sum("_n").over(order))
    n = F.col(total)

    def holds(rank: Column) -> Column:
        return (rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto"))

    lower, upper = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return upto.groupBy(*by).agg(
        ((F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v")))) / 2).alias("median")
    )


def stats_from_counts(
    counts: DataFrame, by: Sequence[str], value: str = "value", n: str = "n", cells: int = CELLS
) -> DataFrame:
    """Bucket stats from ``by, value, n`` rows (how often each value occurs).

    A bucket's values are cut into cells at quantiles of a KLL sketch, so every cell has about the same number of
    distinct values whatever their spread: a stray huge or infinite value is one value among many. The
    cell that holds the middle rank is found from the cell totals, and only that cell is ordered.
    Values that are not numbers sort last.
    """
    by = list(by)
    v, w = F.col(value), F.col(n)
    at = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    number = F.when(~F.isnan(v.cast("double")), v.cast("double"))
    totals = counts.groupBy(*by).agg(
        F.sum(w).alias("count"),
        (F.sum(v * w) / F.sum(w)).alias("avg"),
        F.max(v).alias("max"),
        F.kll_sketch_agg_double(number).alias("_sketch"),
    )
    cuts = F.when(F.kll_sketch_get_n_double("_sketch") > 0, F.kll_sketch_get_quantile_double("_sketch", at))
    totals = materialize(totals.withColumn("_cuts", F.array_distinct(cuts)).drop("_sketch"))
    cell = F.coalesce(F.size(F.filter("_cuts", lambda c: c < v)), F.lit(0))
    placed = lookup_join(
        counts.select(*by, v.alias("_v"), w.alias("_n")).withColumnRenamed("_v", value),
        totals,
        by,
        spread=[value],
        null_safe=True,
    ).withColumn("_cell", cell)
    group = [*by, "count", "avg", "max"]
    sums = placed.groupBy(*group, "_cell").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*by).orderBy("_cell"))
    lower, upper = F.floor((F.col("count") + 1) / 2), F.floor(F.col("count") / 2) + 1
    middle = (
        sums.withColumn("_upto", upto)
        .filter((F.col("_upto") >= lower) & (F.col("_upto") - F.col("_n") < upper))
        .select(*by, "_cell", (F.col("_upto") - F.col("_n")).alias("_below"))
    )
    middle = materialize(middle)
    kept = lookup_join(placed, middle, [*by, "_cell"], spread=[value], null_safe=True).select(*group, F.col(value).alias("_v"), "_n")
    below = middle.groupBy(*by).agg(F.min("_below").alias("_n"))
    heads = equal_keys(totals, below, by, "inner", True).select(*group, F.lit(None).cast("double").alias("_v"), "_n")
    ranks = kept.unionByName(heads).groupBy(*group, "_v").agg(F.sum("_n").alias("_n"))
    return _middle(ranks, group, "count").select(*group, "median")


def stats_for(
    df: DataFrame,
    addresses: DataFrame,
    addr: str | None = None,
    *,
    duration: str = "5m",
    network: str | None = None,
    lookback: str | None = None,
    now: Column | None = None,
    compat: bool = False,
    value: str = "time",
) -> DataFrame:
    """Bucket stats of one address, or of all.

    Filters compose, and an unknown address has no stats. With ``compat=True`` a
    known address ignores the other filters and an unknown one means all.
    """
    filtered = df
    if network is not None:
        filtered = by_network(filtered, network)
    if lookback is not None:
        filtered = since(filtered, lookback, now if now is not None else F.current_timestamp())
    if addr is not None:
        known = not addresses.filter(F.col("addr") == addr).isEmpty()
        if not compat:
            filtered = filtered.filter((F.col("addr") == addr) & F.lit(known))
        elif known:
            filtered = df.filter(F.col("addr") == addr)
    return time_bucket_stats(filtered, duration, value=value)


def aggregate_stats(stats: DataFrame) -> DataFrame:
    """One row over all buckets.

    ``total_pings`` counts buckets and ``total_avg`` is the plain mean of the
    bucket means. NULLs for no buckets; one bucket has no deviation.
    """
    return stats.agg(
        F.min("avg").alias("min_avg"),
        F.max("avg").alias("max_avg"),
        F.sum("avg").alias("avg_sum"),
        F.stddev_samp("avg").alias("std_dev"),
        F.count(F.lit(1)).alias("total_pings"),
        F.avg("avg").alias("total_avg"),
    )


def with_aggregates(stats: DataFrame, aggregates: DataFrame | None = None) -> DataFrame:
    """Add the columns of the one-row ``aggregate_stats`` to every bucket."""
    one = aggregate_stats(stats) if aggregates is None else aggregates
    row = one.select(F.struct(*one.columns)).scalar()
    return stats.withColumn("_all", row).select(*stats.columns, "_all.*")


def high_outliers(stats: DataFrame, k: float = OUTLIER_STDDEVS, aggregates: DataFrame | None = None) -> DataFrame:
    """Buckets whose mean exceeds the mean of all by more than ``k`` deviations."""
    if k != k:
        raise ValueError("k is not a number")
    marked = with_aggregates(stats, aggregates)
    return marked.filter((F.col("avg") - F.col("total_avg")) > F.col("std_dev") * F.lit(k))


def weekly_key(ts: Column) -> list[Column]:
    """Weekday (0 is Sunday), hour and minute, day of month."""
    return [F.dayofweek(ts) - 1, F.date_format(ts, "HHmm"), F.dayofmonth(ts)]


def sort_weekly(stats: DataFrame) -> DataFrame:
    ts = F.col("time_bucket")
    return stats.orderBy(*weekly_key(ts), ts)


def report_lines(stats: DataFrame) -> DataFrame:
    """Add ``line``: day, date, bar and mean of every bucket ``with_aggregates``."""
    ts = F.col("time_bucket")
    drawn = bar("avg", F.col("min_avg"), F.col("max_avg"))
    line = F.concat_ws(" ", format_date(ts, "day"), format_date(ts, "report"), drawn, fixed("avg", 3))
    return stats.withColumn("line", line)


def report_header(aggregates: DataFrame, pretty: bool = False) -> DataFrame:
    """One ``header``: the aggregates as JSON."""
    fields = F.struct(
        F.col("max_avg").alias("maxAvg"),
        F.col("min_avg").alias("minAvg"),
        F.col("total_avg").alias("totalAvg"),
        half_up("total_avg", 3).alias("totalAvgFixed"),
        F.col("std_dev").alias("stdDev"),
    )
    return aggregates.select(F.to_json(fields, {"pretty": str(pretty).lower()}).alias("header"))


def sample_every(df: DataFrame, duration: str, keys: Sequence[str] = (), ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The last row of each time slot (and key): at most one per interval."""
    rows = df.withColumn("slot", slot_window(F.col(ts), duration)["start"])
    last = F.max_by(F.struct(*df.columns), F.struct(ts, *tie))
    return rows.groupBy(*keys, "slot").agg(last.alias("_last")).select("slot", "_last.*")
