from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import latency, metrics
from fleetlens.streaming import latency as latency_streams
from fleetlens.streaming import metrics as metric_streams

START = datetime(2024, 1, 1)


def write_batches(df, path, batches):
    """One file per batch, in time order."""
    for i in range(batches):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, path, mode="append"):
    seen = []

    def write(batch, number):
        seen.append(number)
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/ckpt")
    q.trigger(availableNow=True).start().awaitTermination()
    return len(seen)


@pytest.fixture(scope="module")
def samples(spark):
    """Four batches; each core's times grow from batch to batch."""
    return spark.range(400).selectExpr(
        "timestamp_millis(id * 250) as ts",
        "if(id % 3 = 0, 'hot', concat('c', id % 5)) as cpu",
        "cast(id * id % 97 as double) as total",
        "cast(id % 7 as double) as idle",
        "cast(floor(id / 100) as int) as part",
    ).cache()


def test_counter_deltas(spark, rows, samples, tmp_path):
    write_batches(samples, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), samples.drop("part").schema)
    assert run(metric_streams.stream_counter_deltas(stream), tmp_path) >= 4
    batch = metrics.counter_deltas(samples.drop("part"), chunk_seconds=10).select(
        "cpu", F.unix_millis("ts").alias("t"), "total", "idle", "d_total", "d_idle"
    )
    assert rows(spark.read.parquet(str(tmp_path / "data")).drop("batch")) == rows(batch)


def test_counter_deltas_by_batch(spark, rows, samples, tmp_path):
    write_batches(samples, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), samples.drop("part").schema)
    q = metric_streams.append_counter_deltas(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), chunk_seconds=10)
    q.awaitTermination()
    batch = metrics.counter_deltas(samples.drop("part"), chunk_seconds=10).select(
        "cpu", F.unix_millis("ts").alias("t"), "total", "idle", "d_total", "d_idle"
    )
    assert rows(spark.read.parquet(str(tmp_path / "out" / "data")).drop("batch")) == rows(batch)


def test_late_samples_are_dropped_either_way(spark, rows, tmp_path):
    data = [(0, "a", 1.0, 0.0, 0), (100, "a", 3.0, 0.0, 0), (50, "a", 9.0, 0.0, 1), (150, "a", 4.0, 1.0, 1), (7, "b", 5.0, 0.0, 1)]
    df = spark.createDataFrame(data, "ts bigint, cpu string, total double, idle double, part int")
    write_batches(df, str(tmp_path / "in"), 2)
    stream = source(spark, str(tmp_path / "in"), df.drop("part").schema)
    metric_streams.append_counter_deltas(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run(metric_streams.stream_counter_deltas(stream), tmp_path)
    want = [("a", 0, None), ("a", 100, 2.0), ("a", 150, 1.0), ("b", 7, None)]
    for path in (tmp_path / "out" / "data", tmp_path / "data"):
        assert rows(spark.read.parquet(str(path)), "cpu", "t", "d_total") == want


def test_restart_goes_on_where_it_stopped(spark, rows, samples, tmp_path):
    schema = samples.drop("part").schema
    for parts in ((0, 1), (2, 3)):
        for i in parts:
            samples.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = source(spark, str(tmp_path / "in"), schema)
        metric_streams.append_counter_deltas(stream, str(tmp_path / "out"), str(tmp_path / "c"), chunk_seconds=10).awaitTermination()
        run(metric_streams.stream_counter_deltas(stream), tmp_path)
    want = rows(metrics.counter_deltas(samples, chunk_seconds=10).select("cpu", F.unix_millis("ts"), "d_total", "d_idle"))
    for path in (tmp_path / "out" / "data", tmp_path / "data"):
        assert rows(spark.read.parquet(str(path)), "cpu", "t", "d_total", "d_idle") == want


def test_sample_gap(spark, rows, tmp_path):
    df = spark.range(300).selectExpr("id * id % 7 + id * 10 as ts", "concat('k', id % 2) as k", "cast(floor(id / 100) as int) as part")
    write_batches(df, str(tmp_path / "in"), 3)
    stream = source(spark, str(tmp_path / "in"), df.drop("part").schema)
    run(metric_streams.stream_sample_gap(stream, ["k"], 200), tmp_path)
    want = []
    for key in ("k0", "k1"):
        last = None
        for r in df.filter(F.col("k") == key).orderBy("ts").collect():
            if last is None or r.ts - last > 200:
                want.append((r.ts, key))
                last = r.ts
    assert rows(spark.read.parquet(str(tmp_path / "data")), "ts", "k") == sorted(want)


def test_lookback_by_batch(spark, samples, tmp_path):
    write_batches(samples, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), samples.drop("part").schema)
    q = metric_streams.append_lookback(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), ms=2000, chunk_seconds=10)
    q.awaitTermination()
    got = {(r.cpu, r.t): r for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()}
    batch = metrics.lookback_mean(samples.drop("part"), ms=2000, chunk_seconds=10).withColumn("t", F.unix_millis("ts"))
    assert len(got) == 400
    for r in batch.collect():
        assert got[r.cpu, r.t].mean_total == pytest.approx(r.mean_total)


def test_lookback(spark, samples, tmp_path):
    write_batches(samples, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), samples.drop("part").schema)
    run(metric_streams.stream_lookback(stream, ms=2000), tmp_path)
    got = {(r.cpu, r.t): r for r in spark.read.parquet(str(tmp_path / "data")).collect()}
    batch = metrics.lookback_mean(samples.drop("part"), ms=2000, chunk_seconds=10).withColumn("t", F.unix_millis("ts"))
    assert len(got) == 400
    for r in batch.collect():
        assert got[r.cpu, r.t].mean_total == pytest.approx(r.mean_total)
        assert got[r.cpu, r.t].mean_idle == pytest.approx(r.mean_idle)


def test_lookback_keeps_all_that_it_reaches(spark, tmp_path):
    df = spark.range(300).selectExpr("id * 10 as ts", "'a' as cpu", "cast(id as double) total", "0D as idle", "cast(id div 100 as int) part")
    write_batches(df, str(tmp_path / "in"), 3)
    stream = source(spark, str(tmp_path / "in"), df.drop("part").schema)
    run(metric_streams.stream_lookback(stream, ms=1500), tmp_path)
    got = {r.t: r.mean_total for r in spark.read.parquet(str(tmp_path / "data")).collect()}
    want = {i * 10: sum(range(max(0, i - 150), i + 1)) / (i + 1 - max(0, i - 150)) for i in range(300)}
    assert got == want


def test_running_extrema(spark, rows, samples, tmp_path):
    write_batches(samples, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), samples.drop("part").schema)
    run(metric_streams.stream_running_extrema(stream, ["cpu"], value="total"), tmp_path, "update")
    latest = metric_streams.latest(spark.read.parquet(str(tmp_path / "data")), ["cpu"])
    assert rows(latest) == rows(metrics.gauge_extrema(samples, ["cpu"], value="total"))


@pytest.fixture(scope="module")
def replies(spark):
    return spark.range(2000).selectExpr(
        "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 3) as ts",
        "cast(pmod(hash(id), 5000) as double) / 8 as time",
        "cast(floor(id / 500) as int) as part",
        "id",
    ).cache()


def test_bucket_stats(spark, replies, tmp_path):
    write_batches(replies, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), replies.drop("part").schema)
    q = latency_streams.stream_bucket_stats(stream, "5m", "1 minute", f"{tmp_path}/data", f"{tmp_path}/ckpt")
    q.awaitTermination()
    got = {r.time_bucket: r for r in spark.read.parquet(f"{tmp_path}/data").collect()}
    batch = {r.time_bucket: r for r in latency.time_bucket_stats(replies, "5m").collect()}
    end = START + timedelta(seconds=3 * 1999) - timedelta(minutes=1)
    closed = [b for b in batch if b + timedelta(minutes=5) <= end]
    assert sorted(got) == sorted(closed) and len(closed) >= 18
    for b in closed:
        assert [got[b][c] for c in ("count", "max", "median")] == [batch[b][c] for c in ("count", "max", "median")]
        assert got[b]["avg"] == pytest.approx(batch[b]["avg"])


def test_sample_every(spark, rows, replies, tmp_path):
    write_batches(replies, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), replies.drop("part").schema)
    run(latency_streams.stream_sample_every(stream, "1 minute"), tmp_path)
    got = rows(spark.read.parquet(f"{tmp_path}/data"), "slot", "id")
    batch = rows(latency.sample_every(replies, "1m"), "slot", "id")
    assert got == batch[: len(got)] and 0 < len(batch) - len(got) <= 2


def test_measurements(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "PING x (1.2.3.4): 56 data bytes\n64 bytes from 1.2.3.4: icmp_seq={} ttl=117 time=29.418 ms\n\n"
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(text.format(i))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    q = latency_streams.stream_measurements(lines, f"{tmp_path}/out", f"{tmp_path}/ckpt", src_addr="me")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [(r.seq, r.src_addr, r.time) for r in got] == [(i, "me", 29.418) for i in range(3)]
    assert all(r.ts is not None for r in got)


def stored(spark, path, name):
    """What a stateful stream holds under a name."""
    reader = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", name)
    return reader.load(f"{path}/ckpt")


def test_a_series_that_ends_leaves_no_state(spark, rows, tmp_path):
    """Series a ends in the first batch, b goes on; two hours after its last sample a is forgotten."""
    hour = 3_600_000
    data = [(m * 60_000, "a", m, 1, 0) for m in range(5)]
    data += [(p * hour + m * 600_000, "b", p * 10 + m, 1, p) for p in range(5) for m in range(5)]
    data += [(4 * hour + 2_400_001, "a", 100, 7, 4)]
    df = spark.createDataFrame(data, "ts bigint, cpu string, total bigint, idle bigint, part int")
    schema = df.drop("part").schema
    for op, states in (
        (lambda s: metric_streams.stream_counter_deltas(s, watermark="1 minute", forget="2h"), ["last", "newest"]),
        (lambda s: metric_streams.stream_lookback(s, ms=1000, watermark="1 minute", forget="2h"), ["newest"]),
    ):
        path = tmp_path / states[0]
        for parts in ((0, 1, 2, 3), (4,)):
            for p in parts:
                df.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(str(path / "in"))
            assert run(op(source(spark, str(path / "in"), schema)), path) >= len(parts)
            if parts[0] == 0:
                for state in states:
                    assert [r.key.cpu for r in stored(spark, path, state).select("key").collect()] == ["b"]
        got = {(r.cpu, r.t): r for r in spark.read.parquet(str(path / "data")).collect()}
        assert len(got) == 31
        again = got["a", 4 * hour + 2_400_001]
        assert (again.d_total if "d_total" in again else again.mean_total) == (None if "d_total" in again else 100.0)


def test_lookback_state_has_few_slots(spark, tmp_path):
    """Of a long history only the slots of a window stay, and every mean is that of the plain rule."""
    df = spark.range(1200).selectExpr("id * 37 + id * id % 11 as ts", "'a' as cpu", "id * id % 101 as total", "id % 7 as idle", "cast(id div 200 as int) as part")
    write_batches(df, str(tmp_path / "in"), 6)
    stream = source(spark, str(tmp_path / "in"), df.drop("part").schema)
    run(metric_streams.stream_lookback(stream, ms=3200), tmp_path)
    data = sorted((r.ts, r.total, r.idle) for r in df.collect())
    got = {r.t: (r.mean_total, r.mean_idle) for r in spark.read.parquet(str(tmp_path / "data")).collect()}
    for i, (t, _, _) in enumerate(data):
        start = max(0, sum(s[0] <= t - 3200 for s in data) - 1)
        seen = data[start : i + 1]
        assert got[t] == (sum(s[1] for s in seen) / len(seen), sum(s[2] for s in seen) / len(seen))
    reader = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "sums")
    assert reader.load(f"{tmp_path}/ckpt").count() <= metric_streams.SLOTS + 2


def test_large_counters_and_ties_at_a_batch_border(spark, rows, tmp_path):
    big = 2**62
    data = [(1, "a", big + 1, 1, 0), (2, "a", big + 2, 2, 0), (2, "a", big + 5, 3, 1), (3, "a", big + 9, 3, 1)]
    df = spark.createDataFrame(data, "ts bigint, cpu string, total bigint, idle bigint, part int")
    write_batches(df, str(tmp_path / "in"), 2)
    stream = source(spark, str(tmp_path / "in"), df.drop("part").schema)
    metric_streams.append_counter_deltas(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run(metric_streams.stream_counter_deltas(stream), tmp_path)
    want = [(1, big + 1, None), (2, big + 2, 1), (2, big + 5, 3), (3, big + 9, 4)]
    for path in (tmp_path / "out" / "data", tmp_path / "data"):
        got = spark.read.parquet(str(path))
        assert rows(got, "t", "total", "d_total") == want and dict(got.dtypes)["d_total"] == "bigint"


def test_microseconds_are_no_ties(spark, rows, tmp_path):
    df = spark.range(6).selectExpr("timestamp_micros(1000000 + id) as ts", "'a' as cpu", "id * id as total", "id as idle", "cast(id div 3 as int) as part")
    write_batches(df, str(tmp_path / "in"), 2)
    run(metric_streams.stream_counter_deltas(source(spark, str(tmp_path / "in"), df.drop("part").schema), unit="us"), tmp_path)
    got = rows(spark.read.parquet(str(tmp_path / "data")), "t", "d_total")
    assert got == [(1000000 + i, None if i == 0 else 2 * i - 1) for i in range(6)]


def test_appending_streams_leave_no_scratch(spark, samples, tmp_path):
    write_batches(samples, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), samples.drop("part").schema)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p for p in shared.rglob("*.parquet") if p.is_file()}
    metric_streams.append_lookback(stream, str(tmp_path / "out"), str(tmp_path / "c"), ms=2000, chunk_seconds=10).awaitTermination()
    assert len(list((tmp_path / "out" / "tail").iterdir())) <= 2
    assert {p for p in shared.rglob("*.parquet") if p.is_file()} == before


def test_checked_measurements(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    line = "64 bytes from {}: icmp_seq={} ttl=117 time=29.418 ms\n"
    for i in range(4):
        text = line.format("1.2.3.4", i) + line.format("9.9.9.9", 10 + i) + "PING x\n64 bytes from 1.2.3.4: no more\n"
        (tmp_path / "in" / f"{i}.txt").write_text(text)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))

    def start():
        latency_streams.stream_measurements_checked(lines, f"{tmp_path}/out", f"{tmp_path}/ckpt", "1.2.3.4", "me").awaitTermination()

    start()
    good, bad = (spark.read.parquet(f"{tmp_path}/out/{half}") for half in ("data", "errors"))
    assert rows(good, "seq", "addr", "src_addr") == [(i, "1.2.3.4", "me") for i in range(4)]
    assert sorted({r.error for r in bad.collect()}) == ["64 bytes from 1.2.3.4: no more", "expected 1.2.3.4, reply from 9.9.9.9"]
    assert bad.count() == 8 and good.select("batch").distinct().count() == 4
    (last,) = sorted((tmp_path / "ckpt" / "commits").glob("[0-9]*"))[-1:]
    last.unlink()  # as after a crash between writing and committing
    (tmp_path / "ckpt" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    start()
    assert spark.read.parquet(f"{tmp_path}/out/data").count() == 4 and spark.read.parquet(f"{tmp_path}/out/errors").count() == 8


def test_weeks_start_on_monday_in_streams(spark, rows, replies, tmp_path):
    df = replies.selectExpr("ts + make_dt_interval(id div 100) as ts", "time", "part", "id")
    write_batches(df, str(tmp_path / "in"), 4)
    stream = source(spark, str(tmp_path / "in"), df.drop("part").schema)
    run(latency_streams.stream_sample_every(stream, "1 week"), tmp_path)
    got = rows(spark.read.parquet(f"{tmp_path}/data"), "slot", "id")
    assert got == rows(latency.sample_every(df, "1w"), "slot", "id")[: len(got)] and len(got) == 2
    assert rows(latency.sample_every(df, "7 days"), "slot", "id") == rows(latency.sample_every(df, "1w"), "slot", "id")
