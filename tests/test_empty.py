"""Operators on tables without rows."""

from pyspark.sql import functions as F

from fleetlens.operators import accounts, dedup, inventory, keypad, latency, metrics, paths, runs
from fleetlens.plans.reports import latency_report


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_latency(spark):
    df = empty(spark, "ts timestamp, time double, addr string")
    stats = latency.time_bucket_stats(df, "5m", keys=["addr"])
    assert stats.columns == ["addr", "time_bucket", "count", "avg", "max", "median"] and stats.count() == 0
    report = latency_report(stats)
    assert report.lines.count() == 0 and report.header.count() == 1
    counts = empty(spark, "time_bucket timestamp, value double, n bigint")
    assert latency.stats_from_counts(counts, ["time_bucket"]).count() == 0
    assert latency.sample_every(df, "1m", ["addr"]).count() == 0


def test_metrics(spark):
    df = empty(spark, "ts timestamp, cpu string, total double, idle double, gauge string, value double")
    for result in (
        metrics.counter_deltas(df),
        metrics.lookback_mean(df),
        metrics.running_extrema(df),
        metrics.gauge_extrema(df),
        metrics.keep_newest_half(df),
        metrics.keep_newest_half(df, ["cpu"]),
    ):
        assert result.count() == 0


def test_tables(spark):
    listing = empty(spark, "hash string, size bigint, path string")
    assert dedup.duplicate_rows(listing).count() == 0
    assert dedup.duplicate_groups(listing).count() == 0
    assert dedup.join_candidates(listing, dedup.size_candidates(listing)).count() == 0
    nodes = paths.path_nodes(listing)
    assert paths.shallowest_files(nodes).count() == 0 and paths.extension_stats(listing).count() == 0
    entries = empty(spark, "path string, is_dir boolean, is_symlink boolean, size bigint")
    assert tuple(inventory.scan_counts(entries).first()) == (0, 0)
    words = empty(spark, "word string")
    frequencies = empty(spark, "word string, n double")
    index = keypad.prefix_index(keypad.with_frequency(words, frequencies))
    assert keypad.rank_words(index).count() == 0 and keypad.top_words(index).count() == 0
    assert keypad.prefix_index(spark.sql("select '' as word")).count() == 0
    keys = empty(spark, "key_id bigint, key_text string, iv string, user_id string")
    users = empty(spark, "user_id string, user_name string")
    assert accounts.open_keychain(accounts.user_keychain(keys, users), F.lit(b"0123456789abcdef")).count() == 0


def test_runs(spark):
    schema = (
        "run_id bigint, project string, type string, mode string, state string, duration double, "
        "errors array<struct<stack: string, message: string>>"
    )
    df = empty(spark, schema)
    assert tuple(runs.status_rollup(df).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)
    assert tuple(runs.failure_summary(df).first()) == (0, 0, 0, 0)
    assert runs.error_groups(df).count() == 0
