import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import skew


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [(i, 0 if rng.random() < 0.4 else rng.randrange(1, 60)) for i in range(6000)]
    return spark.createDataFrame(data, "id bigint, k bigint").cache()


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(k, f"name {k}") for k in range(0, 80, 2)], "k bigint, name string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, rows, skewed, dim, how):
    counts = skewed.groupBy("k").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(counts, ["k"], rows_per_salt=300)
    assert rows(hot, "k") == [(0,)]
    got = skew.salted_join(skewed, dim, hot, ["k"], how, ["id"])
    assert rows(got) == rows(skewed.join(dim, "k", how))


def test_hot_rows_are_spread(spark, skewed):
    counts = skewed.groupBy("k").agg(F.count("*").alias("n"))
    salts = skew.hot_keys(counts, ["k"], rows_per_salt=300).first()["_salts"]
    per_salt = skewed.filter("k = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(salts)).alias("s")).count().collect()
    assert len(per_salt) == salts >= 7
    assert max(r["count"] for r in per_salt) < 450


def test_equal_rows_are_spread(spark, rows):
    """Occurrences of one word have nothing but the word."""
    words = spark.range(0, 4000, 1, 16).selectExpr("if(id % 4 < 3, 'the', concat('w', id % 50)) as word")
    names = spark.createDataFrame([("the", 1), ("w7", 2)], "word string, n bigint")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(counts, ["word"], rows_per_salt=300)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = skew.salted_join(words, names, hot, ["word"], "inner", ["word"])
        per_task = joined.filter("word = 'the'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sum(r["count"] for r in per_task) == 3000 and len(per_task) > 1
    assert rows(joined) == rows(words.join(names, "word"))


def test_hot_keys_are_bounded(spark):
    counts = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1000).cast("bigint").alias("n"))
    assert skew.hot_keys(counts, ["k"], rows_per_salt=10).count() < skew.MAX_HOT_KEYS


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join(spark, rows, skewed, dim, limit, how):
    got = skew.lookup_join(skewed, dim, "k", how, max_broadcast_rows=limit, rows_per_salt=300)
    assert rows(got) == rows(skewed.join(dim, "k", how))


@pytest.mark.parametrize("limit", [0, 1000])
def test_members_are_whole(rows, skewed, limit):
    members = skew.group_members(skewed, ["k"], "id", min_n=2, max_broadcast_rows=limit)
    expected = {}
    for r in skewed.collect():
        expected.setdefault(r.k, []).append(r.id)
    want = [(k, len(ids), i) for k, ids in expected.items() if len(ids) > 1 for i in ids]
    assert rows(members, "k", "n", "id") == sorted(want, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("limit", [0, 1000])
def test_null_is_a_key_where_asked(spark, rows, limit):
    data = spark.createDataFrame([(None if i % 3 else i % 5, i) for i in range(3000)], "k long, id long")
    groups = data.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.lookup_join(data, groups, "k", max_broadcast_rows=limit, rows_per_salt=100, null_safe=True)
    assert rows(got, "k", "id", "n") == rows(data.join(groups.withColumnRenamed("k", "g"), F.col("k").eqNullSafe(F.col("g"))), "k", "id", "n")
    plain = skew.lookup_join(data, groups, "k", "left", max_broadcast_rows=limit, rows_per_salt=100)
    assert rows(plain, "k", "id", "n") == rows(data.join(groups, "k", "left"), "k", "id", "n")
    assert skew.group_members(data, ["k"], "id").count() == 3000
