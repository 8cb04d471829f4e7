import json
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import latency
from fleetlens.plans.reports import latency_report
from fleetlens.sources import measurements

BASE = datetime(2001, 9, 11, 5, 37)
STATS = "time_bucket timestamp, count bigint, avg double, max double, median double"


@pytest.fixture(scope="module")
def stats(spark):
    data = [(1, 20.0, 25.0, 19.0), (0, 10.0, 15.0, 9.0), (2, 30.0, 35.0, 29.0)]
    return spark.createDataFrame([(BASE + timedelta(minutes=m), 2, a, b, c) for m, a, b, c in data], STATS)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parse(spark, rows):
    got = latency.parse_ping_lines(
        lines(
            spark,
            "PING google.com (142.250.72.14): 56 data bytes",
            "64 bytes from 142.250.72.14: icmp_seq=0 ttl=117 time=29.418 ms",
            "72 bytes from fe80::1%en0: seq=12 ttl=64 time=100 ms",
            "NaN bytes from 142.250.72.14",
            "",
        )
    )
    assert got.columns == ["bytes", "addr", "seq", "ttl", "time", "time_unit"]
    assert rows(got) == [(64, "142.250.72.14", 0, 117, 29.418, "ms"), (72, "fe80::1%en0", 12, 64, 100.0, "ms")]


@pytest.mark.parametrize(
    "line",
    [
        "64 bytes 142.250.72.14: icmp_seq=0 ttl=117 time=29.418 ms",
        "64 bytes from 142.250.72.14: ttl=117 time=29.418 ms",
        "64 bytes from 142.250.72.14: icmp_seq=0 time=29.418 ms",
        "64 bytes from 142.250.72.14: icmp_seq=0 ttl=117 time=x ms",
    ],
)
def test_incomplete_lines(spark, line):
    with pytest.raises(Exception, match="incomplete reply line"):
        latency.parse_ping_lines(lines(spark, line)).collect()
    assert latency.parse_ping_lines(lines(spark, line), mode="quarantine").first().error == line


def test_check_address(spark):
    df = spark.createDataFrame([("123.45.6.78",)], "addr string")
    assert latency.check_address(df, "123.45.6.78").count() == 1
    with pytest.raises(Exception, match="expected 1.1.1.1, reply from 123.45.6.78"):
        latency.check_address(df, "1.1.1.1").count()


def test_network_option(spark):
    df = spark.createDataFrame([("local",), ("global",), (None,)], "network string")
    assert latency.by_network(df, "local").count() == 1
    with pytest.raises(ValueError):
        latency.by_network(df, "lan")


def test_aggregate(stats):
    got = latency.aggregate_stats(stats).first()
    assert got.asDict() == {
        "min_avg": 10.0, "max_avg": 30.0, "avg_sum": 60.0, "std_dev": 10.0, "total_pings": 3, "total_avg": 20.0,
    }


def test_outliers(spark, stats):
    assert latency.high_outliers(stats).count() == 0
    assert [r.avg for r in latency.high_outliers(stats, 0.5).collect()] == [30.0]
    with pytest.raises(ValueError):
        latency.high_outliers(stats, float("nan"))
    one = spark.createDataFrame([(BASE, 420, 12.345, 123.0, 5.678)], STATS)
    assert latency.aggregate_stats(one).first().std_dev is None
    assert latency.high_outliers(one).count() == 0
    none = latency.aggregate_stats(one.filter(F.lit(False))).first()
    assert none.total_pings == 0 and none.min_avg is None and none.total_avg is None


def test_weekly_order(spark, stats):
    assert [r.avg for r in latency.sort_weekly(stats).collect()] == [10.0, 20.0, 30.0]
    times = [datetime(2024, 1, 7, 23, 0), datetime(2024, 1, 1, 9, 5), datetime(2024, 1, 15, 9, 5), datetime(2024, 1, 8, 1, 0)]
    df = spark.createDataFrame([(t,) for t in times], "time_bucket timestamp")
    assert [r[0] for r in latency.sort_weekly(df).collect()] == [times[0], times[3], times[1], times[2]]


def test_report(stats):
    report = latency_report(stats, 0.5)
    assert [r.line for r in report.lines.collect()] == [f"Tue [09-11-2001] 05:39 AM {'=' * 50} 30.000"]
    header = report.header.first().header
    assert json.loads(header) == {"maxAvg": 30.0, "minAvg": 10.0, "totalAvg": 20.0, "totalAvgFixed": 20.0, "stdDev": 10.0}


def measured(spark, n, seed, spread=3600):
    rng = random.Random(seed)
    data = [(BASE + timedelta(seconds=rng.randrange(spread)), rng.choice([rng.gauss(50, 20), 7.0, 1e6 * rng.random()])) for _ in range(n)]
    return data, spark.createDataFrame(data, "ts timestamp, time double")


def expected_stats(data, seconds):
    buckets = {}
    for ts, v in data:
        start = int((ts - datetime(1970, 1, 1)).total_seconds()) // seconds * seconds
        buckets.setdefault(datetime(1970, 1, 1) + timedelta(seconds=start), []).append(v)
    return {k: (len(v), statistics.fmean(v), max(v), statistics.median(v)) for k, v in buckets.items()}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_bucket_stats(spark, limit):
    data, df = measured(spark, 500, 1)
    got = {r.time_bucket: r for r in latency.time_bucket_stats(df, "5m", max_broadcast_rows=limit).collect()}
    want = expected_stats(data, 300)
    assert got.keys() == want.keys()
    for k, (count, avg, top, median) in want.items():
        assert got[k]["count"] == count and got[k]["max"] == top
        assert got[k]["avg"] == pytest.approx(avg) and got[k]["median"] == pytest.approx(median)


@pytest.mark.parametrize("expr", ["rand(3) * 1000", "floor(rand(3) * 3)", "pow(10, rand(3) * 300)", "42D", "-rand(4)"])
def test_median_of_a_large_bucket_is_exact(spark, expr):
    df = spark.range(0, 300_001, 1, 8).selectExpr("timestamp'2024-01-01' as ts", f"cast({expr} as double) as time")
    got = latency.time_bucket_stats(df, "1d").first()
    want = df.agg(F.median("time").alias("m"), F.count("time").alias("n"), F.max("time").alias("x")).first()
    assert (got["count"], got["max"]) == (want.n, want.x)
    assert got["median"] == want.m


@pytest.mark.parametrize("n", [1, 2, 3, 800])
def test_stats_from_counts(spark, n):
    data, df = measured(spark, n, n, 900)
    bucketed = df.select(latency.bucket_start(F.col("ts"), "5m").alias("time_bucket"), F.round("time", -1).alias("value"))
    counts = bucketed.groupBy("time_bucket", "value").agg(F.count("*").alias("n"))
    got = {r.time_bucket: r for r in latency.stats_from_counts(counts, ["time_bucket"]).collect()}
    plain = bucketed.groupBy("time_bucket").agg(
        F.count("value").alias("count"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.median("value").alias("median")
    )
    for r in plain.collect():
        g = got.pop(r.time_bucket)
        assert (g["count"], g["max"]) == (r["count"], r["max"])
        assert g["avg"] == pytest.approx(r["avg"]) and g["median"] == pytest.approx(r["median"])
    assert not got


def test_weeks_start_on_monday(spark):
    df = spark.sql("select timestamp'2024-01-07 23:59:59' ts, 1D time")
    assert latency.time_bucket_stats(df, "1w").first().time_bucket == datetime(2024, 1, 1)


def test_stats_for(spark, rows):
    data = [(BASE, "a", "local", 1.0), (BASE, "b", "global", 3.0), (BASE, "a", "global", 5.0)]
    df = spark.createDataFrame(data, "ts timestamp, addr string, network string, time double")
    known = spark.createDataFrame([("a", 1)], "addr string, addr_id bigint")

    def counts(**opts):
        return [r["count"] for r in latency.stats_for(df, known, **opts).collect()]

    assert counts() == [3]
    assert counts(network="global") == [2]
    assert counts(addr="a") == [2]
    assert counts(addr="a", network="local") == [1]
    assert counts(addr="zz") == [] == counts(addr="b")
    assert counts(addr="a", network="local", compat=True) == [2]
    assert counts(addr="zz", network="global", compat=True) == [2]
    resolved = latency.resolve_address(df, known)
    assert rows(resolved, "addr", "addr_id") == [("a", 1), ("a", 1), ("b", None)]


def test_since(spark):
    df = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-10', interval 1 day)) ts")
    now = F.lit("2024-01-10").cast("timestamp")
    assert [latency.since(df, t, now).count() for t in ("7d", "1w", "24h", "5m")] == [8, 8, 2, 1]


def test_sample_every(spark):
    df = spark.range(100).selectExpr("timestamp_seconds(id) ts", "id", "id % 2 as k")
    got = latency.sample_every(df, "5 seconds", ["k"], tie=["id"]).collect()
    assert len(got) == 40 and all(r.id % 10 in (3, 4, 8, 9) for r in got)


def test_stored_stats(spark, rows, tmp_path):
    doc = {"result": [{"time_bucket": "2001-09-11T05:37:00.000Z", "count": "11", "avg": 12.345, "max": 34.567, "median": 14}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"result": [{**doc["result"][0], "time_bucket": 1000186620000, "count": 12}]}))
    (tmp_path / "c.json").write_text(json.dumps({"result": "none"}))
    got = measurements.read_bucket_stats(spark, str(tmp_path))
    at = datetime(2001, 9, 11, 5, 37)
    assert rows(got) == [(at, 11, 12.345, 34.567, 14.0), (at, 12, 12.345, 34.567, 14.0)]


def test_stored_measurements(spark, rows, tmp_path):
    row = (BASE, "123.45.67.89", "addr.mock", 64, 0, 111, 12.345, "ms", None)
    schema = "ts timestamp, src_addr string, addr string, bytes int, seq bigint, ttl int, time double, time_unit string, network string"
    df = spark.createDataFrame([row], schema)
    measurements.append_measurements(df, str(tmp_path / "m"))
    measurements.append_measurements(df, str(tmp_path / "m"))
    back = measurements.read_measurements(spark, str(tmp_path / "m"))
    assert rows(back, *df.columns) == [row, row]
    measurements.write_by_network(df, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n" / "network=default")).count() == 1


@pytest.mark.parametrize("stray", [80_000.0, float("inf"), float("-inf"), float("nan")])
def test_a_stray_value_does_not_crowd_the_cells(spark, stray):
    """One timeout, or no number at all, among many values: the median stays exact and every cell small."""
    import statistics

    values = [20 + i * 7919 % 10_007 / 1000 for i in range(10_007)]
    counts = spark.createDataFrame([(0, v, 1 + i % 3) for i, v in enumerate(values)] + [(0, stray, 1)], "b int, value double, n long")
    got = latency.stats_from_counts(counts, ["b"]).first()
    last = float("inf") if stray != stray else stray
    every = sorted([v for i, v in enumerate(values) for _ in range(1 + i % 3)] + [last])
    assert got["count"] == len(every) and got.median == statistics.median(every)
