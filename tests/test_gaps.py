import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import gaps


def plain(times, gap):
    out, last = [], None
    for t in sorted(times):
        if last is None or t > last + gap:
            out.append(t)
            last = t
    return out


def test_steps_are_the_chains():
    rng = random.Random(1)
    for _ in range(400):
        gap, start = rng.randrange(1, 30), rng.randrange(-50, 50)
        times = np.array(sorted({start + rng.randrange(120) for _ in range(rng.randrange(1, 40))}), np.int64)
        upper, last = gaps.steps(times, start, gap)
        assert (last[1:] != last[:-1]).all()
        for e in range(start - 60, start):
            kept = [t for t in plain([e, *times.tolist()], gap) if t > e]
            fits = np.flatnonzero(upper > e + gap)
            assert (int(last[fits[0]]) if len(fits) else None) == (kept[-1] if kept else None)


@pytest.mark.parametrize("chunk_seconds", [None, 1, 2, 60])
def test_rows_of_the_chain(spark, chunk_seconds):
    rng = random.Random(3)
    data = [(rng.randrange(300_000), rng.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(4000)]
    data += [(10**9 + i * 400, "late", i) for i in range(5)] + [(None, "a", 1)]
    df = spark.createDataFrame(data, "ts bigint, k string, id int").withColumn("extra", F.array("id"))
    for gap in (0, 1, 700, 5_000):
        got = gaps.sample_gap(df, ["k"], gap, tie=["id"], chunk_seconds=chunk_seconds).collect()
        want = []
        for k in {d[1] for d in data}:
            mine = [(t, i) for t, key, i in data if key == k and t is not None]
            for t in plain({t for t, _ in mine}, gap):
                want.append((t, k, min(i for u, i in mine if u == t)))
        assert sorted(map(repr, [(r.ts, r.k, r.id) for r in got])) == sorted(map(repr, want))
    assert gaps.sample_gap(df.limit(0), ["k"], 100).count() == 0


def test_one_series_is_spread(spark):
    """No task follows the rows of the only series; what is followed in order are a few steps per chunk."""
    df = spark.range(200_000).selectExpr("id * 7 as ts", "0 as k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = gaps.sample_gap(df, ["k"], 1000, chunk_seconds=20)
    tasks = kept.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept.count() == len(range(0, 1_400_000, 1001)) and len(tasks) > 1
