"""The commands, end to end, as compositions of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.keypad_text import keys_to_digits
from fleetlens.operators import dedup, keypad, latency, metrics
from fleetlens.operators.accounts import token_report
from fleetlens.session import materialize


def duplicates(listing: DataFrame) -> DataFrame:
    """Rows with repeated content, largest first: scan, hash, semi-join, sort."""
    return dedup.sort_duplicates(dedup.duplicate_rows(materialize(listing)))


@dataclass(frozen=True)
class LatencyReport:
    header: DataFrame
    lines: DataFrame


def latency_report(stats: DataFrame, k: float = latency.OUTLIER_STDDEVS) -> LatencyReport:
    """The aggregates over all buckets, and the slow buckets in weekly order."""
    stats = materialize(stats)
    slow = latency.high_outliers(stats, k)
    return LatencyReport(
        latency.report_header(latency.aggregate_stats(stats)), latency.sort_weekly(latency.report_lines(slow))
    )


def cpu_report(deltas: DataFrame, ms: int = metrics.LOOKBACK_MS, **at: object) -> DataFrame:
    """Utilization over the lookback at every sample, with its bar."""
    means = metrics.lookback_mean(deltas, ms=ms, **at)
    return means.withColumn("utilization", metrics.utilization("mean_total", "mean_idle")).withColumn(
        "bar", metrics.utilization_bar("mean_total", "mean_idle")
    )


def keypad_report(words: DataFrame, frequencies: DataFrame, typed: DataFrame, k: int = keypad.TOP_WORDS) -> DataFrame:
    """Best ``k`` words for each ``keys`` typed: ``prefix, word, n, rn``."""
    queries = typed.select(keys_to_digits("keys").alias("prefix"))
    known = keypad.with_frequency(words, frequencies)
    return keypad.top_words(keypad.prefix_lookup(queries, keypad.prefix_index(known)), k)


def renewals(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens to exchange: still valid, but with less than half their life left."""
    return token_report(tokens, now).filter(F.col("status") == "renew")
