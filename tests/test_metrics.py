import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import metrics


@pytest.fixture(scope="module")
def samples(spark):
    data = [(t, "0", float(v), float(v) / 2) for t, v in zip(range(0, 2400, 300), range(0, 80, 10))]
    return spark.createDataFrame(data, "ts bigint, cpu string, total double, idle double")


def test_lookback_mean(samples):
    got = {r.ts: r for r in metrics.lookback_mean(samples, chunk_seconds=1).collect()}
    assert got[1500].mean_total == 30.0 and got[1500].mean_idle == 15.0
    assert got[0].mean_total == 0.0
    no_edge = {r.ts: r for r in metrics.lookback_mean(samples, include_edge=False).collect()}
    assert no_edge[1500].mean_total == 35.0
    with pytest.raises(ValueError):
        metrics.lookback_mean(samples, ms=2000, chunk_seconds=1)


@pytest.mark.parametrize("chunk_seconds", [1, 3, 3600])
def test_lookback_equals_walking_back(spark, chunk_seconds):
    rng = random.Random(chunk_seconds)
    series = {}
    for i in range(1500):
        key = "hot" if rng.random() < 0.4 else f"c{rng.randrange(8)}"
        series.setdefault(key, set()).add(rng.randrange(20_000) + rng.choice([0, 0, 0, 500_000]))
    data = [(t, k, float(rng.randrange(100)), 1.0) for k, ts in series.items() for t in sorted(ts)]
    df = spark.createDataFrame(data, "ts bigint, cpu string, total double, idle double")
    got = {(r.cpu, r.ts): r.mean_total for r in metrics.lookback_mean(df, ms=1000, chunk_seconds=chunk_seconds).collect()}
    assert len(got) == len(data)
    for key in series:
        own = [(t, v) for t, k, v, _ in data if k == key]
        for i, (now, _) in enumerate(own):
            start = i
            while start > 0 and own[start][0] > now - 1000:
                start -= 1
            picked = [v for _, v in own[start : i + 1]]
            assert got[key, now] == pytest.approx(sum(picked) / len(picked))


def test_counter_deltas(spark, rows):
    data = [(0, "a", 10, 1), (4000, "a", 25, 3), (9_000_000, "a", 30, 9), (0, "b", 7, 7)]
    df = spark.createDataFrame(data, "ms bigint, cpu string, total bigint, idle bigint")
    df = df.withColumn("ts", F.timestamp_millis("ms"))
    got = rows(metrics.counter_deltas(df), "cpu", "ms", "d_total", "d_idle")
    assert got == [("a", 0, None, None), ("a", 4000, 15, 2), ("a", 9_000_000, 5, 6), ("b", 0, None, None)]


def test_cpu_totals_and_utilization(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "user bigint, nice bigint, sys bigint, idle bigint, irq bigint")
    assert metrics.cpu_totals(df).first().total == 15
    used = spark.createDataFrame([(0, 3.0, 1.0), (1, 0.0, 0.0), (2, 4.0, 4.0)], "i int, total double, idle double")
    got = used.orderBy("i").select(
        metrics.utilization("total", "idle").alias("u"), metrics.utilization_bar("total", "idle").alias("bar")
    ).collect()
    assert [r.u for r in got] == [66.67, None, 0.0]
    assert got[0].bar == "=" * 20 + " " * 10 + " | 66.67"


def test_extrema_and_counts(spark, rows):
    df = spark.range(6).selectExpr("timestamp_seconds(id * 2000) ts", "'rss' gauge", "(id * 7) % 5 as value")
    got = rows(metrics.running_extrema(df), "value", "min_so_far", "max_so_far")
    assert sorted(got) == sorted([(0, 0, 0), (2, 0, 2), (4, 0, 4), (1, 0, 4), (3, 0, 4), (0, 0, 4)])
    assert rows(metrics.gauge_extrema(df)) == [("rss", 0, 0, 4)]
    assert rows(metrics.sample_counts(df, kept=F.col("value") > 1)) == [(6, 3, 6)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_keep_newest_half(spark, limit):
    df = spark.range(101).selectExpr("id * 10 as ts", "if(id < 95, 'big', 'small') cpu")
    whole = metrics.keep_newest_half(df, max_samples=100)
    assert sorted(r.ts for r in whole.collect()) == list(range(500, 1010, 10))
    assert metrics.keep_newest_half(df, max_samples=101).count() == 101
    per_cpu = metrics.keep_newest_half(df, ["cpu"], max_samples=50, max_broadcast_rows=limit)
    assert per_cpu.filter("cpu = 'small'").count() == 6
    assert min(r.ts for r in per_cpu.collect()) == 470


def test_long_lookbacks_over_whole_numbers_are_exact(spark):
    """Sums go beyond a BIGINT, and a span of a thousand samples gives the mean of just these."""
    df = spark.range(3000).selectExpr("id * 10 as ts", "'a' as cpu", f"{2**62} + id * id as total", "id as idle")
    got = {r.ts: r for r in metrics.lookback_mean(df, ms=10_000, chunk_seconds=12).collect()}
    for i in range(3000):
        seen = range(max(0, i - 1000), i + 1)
        assert got[i * 10].mean_idle == sum(seen) / len(seen)
        assert got[i * 10].mean_total == float(sum(2**62 + j * j for j in seen)) / len(seen)


def test_lookback_needs_one_shuffle_of_the_rows(spark, tmp_path):
    """Both orders of a chunk's rows use one partitioning; no frame slides over a window."""
    spark.range(100).selectExpr("id as ts", "'a' as cpu", "id as total", "id as idle").write.parquet(str(tmp_path / "t"))
    df = metrics.lookback_mean(spark.read.parquet(str(tmp_path / "t")), chunk_seconds=3600)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and plan.count("Window") >= 2
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") <= 3  # the rows' own, and the chunks' ends'
