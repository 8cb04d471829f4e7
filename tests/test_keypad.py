import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import keypad
from fleetlens.plans.reports import keypad_report


@pytest.fixture(scope="module")
def words(spark):
    given = ["the"] + ["hello"] * 2 + ["llama"] * 3 + ["it's", "Gekko"]
    return spark.createDataFrame(list(enumerate(given)), "pos bigint, word string")


@pytest.fixture(scope="module")
def frequencies(spark):
    return spark.createDataFrame([("the", 1.0), ("hello", 2.0), ("llama", 3.0), ("unused", 9.0)], "word string, n double")


def found(words, spark, digits):
    queries = spark.createDataFrame([(digits,)], "prefix string")
    return sorted(r.word for r in keypad.prefix_lookup(queries, keypad.prefix_index(words)).collect())


def test_lookup(spark, words):
    assert found(words, spark, "43556") == ["Gekko", "hello", "hello"]
    assert found(words, spark, "4") == ["Gekko", "hello", "hello", "it's"]
    assert found(words, spark, "48") == ["it's"] and found(words, spark, "487") == []
    assert found(words, spark, "9") == []


def test_frequencies(spark, rows, words, frequencies):
    assert rows(keypad.word_frequencies(words, frequencies)) == [("hello", 2.0), ("llama", 3.0), ("the", 1.0)]
    assert {r.word: r.n for r in keypad.with_frequency(words, frequencies).collect()}["it's"] == 0


def test_report(spark, rows, words, frequencies):
    typed = spark.createDataFrame([("a",), ("aesss",)], "keys string")
    got = keypad_report(words.select("word").distinct(), frequencies, typed)
    assert rows(got, "prefix", "rn", "word", "n") == [("4", 1, "hello", 2.0), ("4", 2, "Gekko", 0.0), ("4", 3, "it's", 0.0)]


def test_lookup_equals_scan(spark):
    rng = random.Random(2)
    vocabulary = sorted({"".join(rng.choices("abcgjmé'", k=rng.randrange(1, 7))) for _ in range(500)})
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    queries = spark.createDataFrame([(p,) for p in ("2", "24", "245", "6", "2222")], "prefix string")
    digits = keypad.to_digits("word")
    for limit in (0, 100):
        got = keypad.prefix_lookup(queries, keypad.prefix_index(words), max_broadcast_rows=limit)
        scan = words.crossJoin(queries).filter(digits.startswith(F.col("prefix"))).select("prefix", "word")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan.collect()))


def test_rank_and_top(spark):
    rng = random.Random(4)
    data = [("4" if rng.random() < 0.6 else "5", f"{rng.choice('abc')}{i:04}", rng.randrange(6)) for i in range(800)]
    df = spark.createDataFrame(data, "prefix string, word string, n bigint")
    got = {(r.prefix, r.word): r.rn for r in keypad.rank_words(df).collect()}
    best = {(r.prefix, r.word): r.rn for r in keypad.top_words(df).collect()}
    for prefix in "45":
        want = [w for _, w in sorted((-n, w) for p, w, n in data if p == prefix)]
        assert [got[prefix, w] for w in want] == list(range(1, len(want) + 1))
        assert [best.get((prefix, w)) for w in want[:11]] == [*range(1, 11), None]
    by_pos = df.withColumn("pos", F.monotonically_increasing_id())
    ranked = keypad.rank_words(by_pos, tie="pos", chunk=F.floor(F.col("pos") / 50))
    assert ranked.filter("prefix = '4'").agg(F.max("rn")).first()[0] == sum(p == "4" for p, _, _ in data)


@pytest.mark.parametrize("kind", ["different", "equal", "few"])
def test_large_prefixes_are_ranked_in_bounded_pieces(spark, kind):
    """Frequencies all different, all equal, or few: ranks are exact and pieces bounded and even."""
    rng = random.Random(9)
    n = {"different": lambda i: i, "equal": lambda i: 1, "few": lambda i: i % 3}[kind]
    data = [("4" if i % 10 else "5", "".join(rng.choices("abcdefghéz", k=6)) + str(i), n(i)) for i in range(6000)]
    df = spark.createDataFrame(data, "prefix string, word string, n bigint")
    ranked = keypad.rank_words(df, chunk_rows=200)
    got = {(r.prefix, r.word): r.rn for r in ranked.collect()}
    for prefix in "45":
        want = [w for _, w in sorted((-n, w) for p, w, n in data if p == prefix)]
        assert [got[prefix, w] for w in want] == list(range(1, len(want) + 1))
    place = keypad._place("word", True)
    at = F.array(*[F.lit(i / keypad.RANK_CELLS) for i in range(1, keypad.RANK_CELLS)])
    cuts = df.filter("prefix = '4'").agg(F.array_distinct(F.percentile_approx(place, at)).alias("cuts"))
    cell = F.size(F.filter("cuts", lambda c: c < place))
    sizes = [r["count"] for r in df.filter("prefix = '4'").crossJoin(cuts).groupBy(cell.alias("cell")).count().collect()]
    assert len(sizes) <= keypad.RANK_CELLS and max(sizes) < 5400 / 8


def scanned_rows(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    todo, seen = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.finalPhysicalPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and "prefix" in node.schema().fieldNames() and "word" in node.schema().fieldNames():
            seen += node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return seen


def test_a_stored_index_is_read_where_the_prefix_can_be(spark, tmp_path):
    from fleetlens.sources import listings

    rng = random.Random(6)
    words = spark.createDataFrame([("".join(rng.choices("adgjmptw", k=6)),) for _ in range(20_000)], "word string")
    index = keypad.prefix_index(words)
    listings.write_prefix_index(index, str(tmp_path / "i"), group_bytes=16 * 1024)
    stored = listings.read_prefix_index(spark, str(tmp_path / "i"))
    for wanted in (["2345"], ["23", "9999", "234567"], [f"{a}{b}2" for a in range(2, 10) for b in (2, 5)]):
        queries = spark.createDataFrame([(p,) for p in wanted], "prefix string")
        found = keypad.prefix_lookup(queries, stored)
        want = keypad.prefix_lookup(queries, index)
        assert sorted(map(tuple, found.select("prefix", "word").collect())) == sorted(map(tuple, want.select("prefix", "word").collect()))
        assert scanned_rows(found) <= want.count() + 1500 * len(wanted) < index.count() / 3
