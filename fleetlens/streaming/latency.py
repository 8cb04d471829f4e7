"""Latency measurements as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.latency import (
    bucket_start,
    bucket_window,
    misaddressed,
    parse_ping_lines,
    slot_window,
    stats_from_counts,
)
from fleetlens.session import materialize, scratch_removed

# Fixed value: seconds between two logged replies.
LOG_INTERVAL = "5 seconds"


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; stored tables may hold TIMESTAMP_NTZ."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_measurements(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    src_addr: str | None = None,
    stamp: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Reply lines to rows appended to the measurement table at ``path``.

    Rows get ``stamp`` as ``ts`` (default: the time the line is processed) and
    the source address.
    """
    rows = parse_ping_lines(lines)
    if "ts" not in rows.columns or stamp is not None:
        rows = rows.withColumn("ts", stamp if stamp is not None else F.current_timestamp())
    if src_addr is not None:
        rows = rows.withColumn("src_addr", F.lit(src_addr))
    return (
        rows.withColumn("day", F.to_date("ts"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_measurements_checked(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    expected: Column | str,
    src_addr: str | None = None,
    stamp: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Reply lines to ``path/data/batch=<n>``, those that can't be taken to ``path/errors/batch=<n>`` with their ``error``.

    Replies from another address than ``expected`` (a value or a column of ``lines``) and incomplete ones go to
    the errors, so that one stray reply does not end the stream. Each line is parsed once a batch, and a
    repeated batch overwrites the folders of both halves: what was written before a crash is not there twice.
    """
    spark = lines.sparkSession
    rows = lines.withColumn("_expected", expected if isinstance(expected, Column) else F.lit(expected))
    if "ts" not in lines.columns or stamp is not None:
        rows = rows.withColumn("ts", stamp if stamp is not None else F.current_timestamp())
    if src_addr is not None:
        rows = rows.withColumn("src_addr", F.lit(src_addr))
    parsed = parse_ping_lines(rows, mode="quarantine")
    checked = parsed.withColumn("error", F.coalesce("error", misaddressed(F.col("addr"), F.col("_expected")))).drop("_expected")

    def write(batch: DataFrame, number: int) -> None:
        with scratch_removed(spark):
            both = materialize(batch)
            both.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/data/batch={number}")
            both.filter("error is not null").write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    return (
        checked.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_value_counts(
    df: DataFrame,
    duration: str,
    watermark: str,
    ts: str = "ts",
    value: str = "time",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, time_bucket, value, n``, emitted when the watermark closes a bucket.

    How often each value occurs is all that exact bucket stats need. The state
    has one small row per distinct value, so a busy bucket is spread over all
    state partitions, and it is pre-aggregated before the shuffle.
    """
    rows = event_time(df, ts).filter(F.col(value).isNotNull()).withWatermark(ts, watermark)
    counts = rows.groupBy(*keys, bucket_window(F.col(ts), duration).alias("w"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.col("w.start").alias("time_bucket"), "value", "n")


def stream_bucket_stats(
    df: DataFrame,
    duration: str,
    watermark: str,
    path: str,
    checkpoint: str,
    ts: str = "ts",
    value: str = "time",
    keys: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Closed buckets' ``count, avg, max, median`` to ``path/batch=<n>``.

    All counts of a bucket arrive in the batch in which it closes. A repeated
    batch overwrites its own folder, so nothing is written twice.
    """
    counts = stream_value_counts(df, duration, watermark, ts, value, keys)
    by = [*keys, "time_bucket"]

    def write(batch: DataFrame, number: int) -> None:
        with scratch_removed(batch.sparkSession):
            stats_from_counts(materialize(batch), by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_sample_every(
    df: DataFrame,
    interval: str = LOG_INTERVAL,
    watermark: str = "10 seconds",
    ts: str = "ts",
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
) -> DataFrame:
    """The last row of each closed time slot: at most one per key and interval."""
    rows = event_time(df, ts).withWatermark(ts, watermark)
    last = F.max_by(F.struct(*rows.columns), F.struct(ts, *tie)).alias("last")
    slots = rows.groupBy(*keys, slot_window(F.col(ts), interval).alias("w")).agg(last)
    return slots.select(F.col("w.start").alias("slot"), "last.*")


def batch_bucket(ts: str, duration: str) -> Column:
    """The batch column that equals ``time_bucket`` of the streams."""
    return bucket_start(F.col(ts).cast("timestamp"), duration)
