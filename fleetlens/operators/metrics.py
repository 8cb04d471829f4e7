"""Counters and gauges: deltas, lookback means, running extrema, history pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetlens.functions.formatting import CPU_BAR_WIDTH, bar, half_up
from fleetlens.operators.ordered import clock, fitting_chunk, last_row, previous, running, slot, time_chunk
from fleetlens.operators.skew import MAX_BROADCAST_ROWS, lookup_join
from fleetlens.session import materialize

# Lookback in ms, samples kept before the older half goes.
LOOKBACK_MS = 1000
MAX_SAMPLES = 1000

# Sums of whole numbers up to a chunk's end may go beyond a BIGINT.
_EXACT = "decimal(28,0)"


def cpu_totals(df: DataFrame) -> DataFrame:
    """``total`` and ``idle`` from the counters of each row."""
    total = F.col("user") + F.col("nice") + F.col("sys") + F.col("idle") + F.col("irq")
    return df.withColumn("total", total)


def counter_deltas(
    df: DataFrame,
    keys: Sequence[str] = ("cpu",),
    ts: str = "ts",
    cols: Sequence[str] = ("total", "idle"),
    tie: Sequence[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Add ``d_<col>``: growth since the key's previous sample; NULL for its first."""
    seen = previous(df, keys, [ts, *tie], time_chunk(df, keys, ts, chunk_seconds), cols)
    return seen.select(*df.columns, *[(F.col(c) - F.col(f"prev_{c}")).alias(f"d_{c}") for c in cols])


def running_extrema(
    df: DataFrame,
    keys: Sequence[str] = ("gauge",),
    ts: str = "ts",
    value: str = "value",
    tie: Sequence[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Add ``min_so_far`` and ``max_so_far`` per key."""
    aggs = {"min_so_far": ("min", value), "max_so_far": ("max", value)}
    return running(df, keys, [ts, *tie], time_chunk(df, keys, ts, chunk_seconds), aggs)


def gauge_extrema(df: DataFrame, keys: Sequence[str] = ("gauge",), ts: str = "ts", value: str = "value", tie: Sequence[str] = ()) -> DataFrame:
    """Latest value and overall extrema per key; also works on a stream in update mode."""
    order = F.struct(ts, *tie) if tie else F.col(ts)
    return df.groupBy(*keys).agg(
        F.max_by(value, order).alias("current"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def sample_counts(df: DataFrame, keys: Sequence[str] = (), kept: Column | None = None, drawn: Column | None = None) -> DataFrame:
    """``seen``, ``kept`` and ``drawn`` samples; without a condition every sample counts."""
    yes = F.lit(True)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(kept if kept is not None else yes).alias("kept"),
        F.count_if(drawn if drawn is not None else yes).alias("drawn"),
    )


def lookback_mean(
    df: DataFrame,
    keys: Sequence[str] = ("cpu",),
    ts: str = "ts",
    cols: Sequence[str] = ("total", "idle"),
    ms: int = LOOKBACK_MS,
    include_edge: bool = True,
    tie: Sequence[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Add ``mean_<col>`` over the samples of the last ``ms`` and the one just before.

    Differences of running sums within a chunk, so a long span costs no more than a short one; exact for
    whole numbers. ``ts`` is a timestamp or epoch milliseconds, as everywhere here. Rows less than ``ms`` before
    the end of their chunk are also shown to the next chunk, and one row per
    chunk stands for all that is older.
    """
    keys, cols, tie = list(keys), list(cols), list(tie)
    t, span_us = clock(df, ts), ms * 1000
    chunk_us = fitting_chunk(df, keys, t, span_us) if chunk_seconds is None else chunk_seconds * 1_000_000
    if span_us > chunk_us:
        raise ValueError("the chunk must not be shorter than the lookback")
    own, late = slot(F.col("_t"), chunk_us), slot(F.col("_t") + span_us, chunk_us)
    rows = df.withColumn("_t", t).withColumn("_own", own).withColumn("_late", late)

    # Per chunk: its last row, and its last row outside the halo it shows to the next chunk.
    outside = F.col("_late") == F.col("_own")
    last = rows.groupBy(*keys, "_own").agg(
        last_row(["_t", *tie], cols).alias("_end"), last_row(["_t", *tie], cols, outside).alias("_early")
    )
    past = W.partitionBy(*keys).orderBy("_own")
    end, before, early = F.lag("_end").over(past), F.lag("_end", 2).over(past), F.lag("_early").over(past)
    adjacent = F.lag("_own").over(past) == F.col("_own") - 1
    older_row = F.when(~adjacent, end).when(early["_t"].isNotNull(), early).otherwise(before)
    heads = (
        last.select(*keys, F.col("_own").alias("_chunk"), older_row.alias("_head"))
        .filter(F.col("_head._t").isNotNull())
        .select(*keys, "_chunk", "_head.*")
    )

    shown = F.when(F.col("_late") > F.col("_own"), F.array("_own", "_late")).otherwise(F.array("_own"))
    body = rows.withColumn("_chunk", F.explode(shown)).withColumn("_real", F.col("_chunk") == F.col("_own"))
    both = body.unionByName(heads.withColumn("_real", F.lit(False)), allowMissingColumns=True)

    # Sums up to every row, then a second order of the same chunks: each row again at the time its span begins
    # with, where the last row before it tells what was summed up by then.
    by_time = W.partitionBy(*keys, "_chunk").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    upto = both.select(
        *df.columns,
        "_chunk",
        "_t",
        "_real",
        F.count(F.lit(1)).over(by_time).alias("_n"),
        *[F.sum(F.col(c).cast(_EXACT) if c in whole else c).over(by_time).alias(f"_sum_{c}") for c in cols],
    )
    ends = F.when(F.col("_real"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    events = upto.withColumn("_end", F.explode(ends))
    at = F.when(F.col("_end"), F.col("_t") - span_us).otherwise(F.col("_t"))
    sums = [f"_sum_{c}" for c in cols]
    held = F.when(~F.col("_end"), F.struct("_n", *sums, *cols))
    order = W.partitionBy(*keys, "_chunk").orderBy("_at", "_end", *tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = events.withColumn("_at", at).withColumn("_before", F.last(held, ignorenulls=True).over(order)).filter("_end")
    older = F.col("_before._n").isNotNull()
    n = F.col("_n") - F.coalesce("_before._n", F.lit(0))

    def mean(c: str) -> Column:
        total = F.col(f"_sum_{c}") - F.coalesce(F.col("_before")[f"_sum_{c}"], F.lit(0))
        if not include_edge:
            return total.cast("double") / n
        edge = F.col("_before")[c]
        return (total + F.coalesce(edge.cast(_EXACT) if c in whole else edge, F.lit(0))).cast("double") / (n + older.cast("int"))

    return seen.select(*df.columns, *[mean(c).alias(f"mean_{c}") for c in cols])


def utilization(total: Column | str, idle: Column | str) -> Column:
    """Busy percent with two decimals; NULL when nothing was counted."""
    return half_up(_busy(total, idle) * 10000) / 100


def _busy(total: Column | str, idle: Column | str) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    idle = F.col(idle) if isinstance(idle, str) else idle
    return F.lit(1.0) - idle / F.nullif(total.cast("double"), F.lit(0.0))


def utilization_bar(total: Column | str, idle: Column | str) -> Column:
    """The ``=`` bar of a utilization and its percent."""
    drawn = bar(_busy(total, idle), F.lit(0.0), F.lit(1.0), CPU_BAR_WIDTH, pad=True)
    return F.concat(drawn, F.lit(" | "), utilization(total, idle).cast("string"))


def keep_newest_half(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    max_samples: int = MAX_SAMPLES,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Of a series with more than ``max_samples`` rows keep the later half of its time span."""
    keys = list(keys)
    rows = df.withColumn("_t", clock(df, ts))
    spans = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    from_t = F.when(F.col("n") > max_samples, F.col("_a") + (F.col("_b") - F.col("_a")) / 2)
    spans = spans.select(*keys, "n", from_t.alias("_from"))
    if keys:
        spans = materialize(spans)
        rows = lookup_join(
            rows,
            spans.drop("n"),
            keys,
            counts=spans,
            spread=["_t"],
            max_broadcast_rows=max_broadcast_rows,
            null_safe=True,
        )
    else:
        rows = rows.withColumn("_from", spans.select("_from").scalar())
    return rows.filter(F.col("_from").isNull() | (F.col("_t") >= F.col("_from"))).select(*df.columns)
