import hashlib

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import dedup


@pytest.fixture(scope="module")
def listing(spark):
    texts = ["aaa", "bbb", "aaa", "", "", "cc", "ccé", "aaa", "bbb", "long text", "long text", "zzzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    return dedup.content_listing(df, "id", "text").cache()


def test_listing(listing):
    got = {r.path: r for r in listing.collect()}
    assert got[6].hash == hashlib.sha1("ccé".encode()).hexdigest()
    assert got[6].size == 4 and got[3].size == 0


def test_short_hash(spark):
    df = spark.createDataFrame([("foo",)], "t string")
    assert df.select(dedup.content_hash("t", dedup.SHORT_HASH)).first()[0] == "0beec7b5ea"


def test_sizes(rows, listing):
    assert rows(dedup.size_histogram(listing)) == [(0, 2), (2, 1), (3, 5), (4, 2), (9, 2)]
    candidates = dedup.size_candidates(listing)
    assert rows(candidates) == [(3, 5), (4, 2), (9, 2)]
    assert rows(dedup.candidate_count(candidates)) == [(9,)]
    kept = dedup.join_candidates(listing, candidates)
    assert [r[0] for r in rows(kept, "path")] == [0, 1, 2, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("limit", [0, 1000])
def test_duplicates(listing, limit):
    found = dedup.sort_duplicates(dedup.duplicate_rows(listing, max_broadcast_rows=limit)).collect()
    hashes = {t: hashlib.sha1(t.encode()).hexdigest() for t in ("aaa", "bbb")}
    small = sorted([(hashes["aaa"], i) for i in (0, 2, 7)] + [(hashes["bbb"], i) for i in (1, 8)])
    assert [(r.size, r.path) for r in found] == [(9, 9), (9, 10)] + [(3, i) for _, i in small]


def test_summaries(rows, listing):
    repeated = dedup.duplicate_hashes(listing)
    assert rows(dedup.duplicate_summary(repeated)) == [(3, 7)]
    assert {r.size for r in dedup.hash_sizes(repeated).collect()} == {3, 9}
    assert dedup.largest_duplicate(repeated).collect()[0].size == 9
    none = repeated.filter(F.lit(False))
    assert rows(dedup.duplicate_summary(none)) == [(0, 0)]
    assert rows(dedup.candidate_count(none)) == [(0,)]
    assert dedup.largest_duplicate(none).count() == 0


def test_groups(rows, listing):
    groups = {}
    for r in dedup.duplicate_groups(listing).collect():
        groups.setdefault((r["hash"], r.n), []).append(r.path)
    assert sorted(map(sorted, groups.values())) == [[0, 2, 7], [1, 8], [9, 10]]
    assert all(n == len(paths) for (_, n), paths in groups.items())
    sizes = rows(dedup.size_groups(listing), "size", "n", "path")
    assert sizes == [(3, 5, i) for i in (0, 1, 2, 7, 8)] + [(4, 2, i) for i in (6, 11)] + [(9, 2, i) for i in (9, 10)]


def test_no_duplicates_is_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id bigint, text string")
    assert dedup.sort_duplicates(dedup.duplicate_rows(dedup.content_listing(df, "id", "text"))).count() == 0
