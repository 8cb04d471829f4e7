import random

import pytest
from pyspark.sql import Window as W, functions as F

from fleetlens.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    """A hot key, gaps of many chunks, equal times and single-row keys."""
    rng = random.Random(11)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        data.append((i, key, rng.randrange(400) * 7 + (50_000 if rng.random() < 0.2 else 0), rng.randrange(1000)))
    data += [(9000 + i, f"single{i}", i, i) for i in range(5)]
    return spark.createDataFrame(data, "id bigint, k string, t bigint, v bigint").cache()


def chunk():
    return F.floor(F.col("t") / 100)


def test_running(rows, series):
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    aggs = {"total": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    got = ordered.running(series, ["k"], ["t", "id"], chunk(), aggs)
    plain = series.select("*", F.sum("v").over(w).alias("total"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    assert got.columns == plain.columns and rows(got) == rows(plain)


def test_previous(rows, series):
    w = W.partitionBy("k").orderBy("t", "id")
    got = ordered.previous(series, ["k"], ["t", "id"], chunk(), ["v", "t"])
    plain = series.select("*", F.lag("v").over(w).alias("prev_v"), F.lag("t").over(w).alias("prev_t"))
    assert rows(got) == rows(plain)


def test_previous_with_missing_values(spark, rows):
    data = [(1, "a", 1, 5), (2, "a", 250, None), (3, "a", 400, 7), (4, "a", 900, 8)]
    df = spark.createDataFrame(data, "id bigint, k string, t bigint, v bigint")
    got = ordered.previous(df, ["k"], ["t"], chunk(), ["v"])
    assert rows(got, "id", "prev_v") == [(1, None), (2, 5), (3, None), (4, 7)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbered(rows, series, keys):
    w = W.partitionBy(*keys).orderBy("t", "id")
    got = ordered.numbered(series, keys, ["t", "id"], chunk())
    assert rows(got) == rows(series.select("*", F.row_number().over(w).cast("bigint").alias("rn")))


def test_time_chunk(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:59:59.999' a, timestamp'2024-01-01 01:00:00' b, 3599999L c")
    a, b, c = df.select(*[ordered.time_chunk(df, [], name, 3600) for name in "abc"]).first()
    assert b - a == 1 and c == 0


def test_chunks_are_fitted(spark):
    """All rows of the hot key lie in one second; the other keys are spread over days."""
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id % 9)) as k", "if(id % 2 = 0, id % 1000, id * 5000) as t")
    t = ordered.clock(df, "t")
    size = ordered.fitting_chunk(df, ["k"], t, max_rows=500)
    assert 1000 <= size < 60_000
    counts = df.groupBy("k", ordered.slot(t, size)).count().agg(F.max("count")).first()[0]
    assert counts <= 500
    assert ordered.fitting_chunk(df, ["k"], t, max_rows=20_000) == ordered.CHUNK_MICROS
    assert ordered.fitting_chunk(df, ["k"], t, least=10**9, max_rows=500) == 10**9
