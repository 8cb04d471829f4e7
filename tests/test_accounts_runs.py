import pytest
from pyspark.sql import functions as F

from fleetlens.functions.secrets import encrypt_column
from fleetlens.operators import accounts, runs

KEY = b"0123456789abcdef"


@pytest.fixture(scope="module")
def keychain(spark):
    data = [(i, f"secret {i}", f"p{i}", "hot" if i % 2 else f"u{i % 7}") for i in range(300)]
    keys = spark.createDataFrame(data, "key_id bigint, plain string, password_id string, user_id string")
    sealed = keys.withColumn("_e", encrypt_column("plain", F.lit(KEY)))
    kept = sealed.select("key_id", "plain", "_e", "password_id", "user_id").cache()
    return kept.select("key_id", "plain", "_e.iv", F.col("_e.text").alias("key_text"), "password_id", "user_id")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("hot", "Hot"), ("u0", "Zero"), ("u3", "Three")], "user_id string, user_name string")


@pytest.mark.parametrize("limit", [0, 1000])
def test_keychain(keychain, users, limit):
    chunked = accounts.user_keychain(keychain, users, F.floor(F.col("key_id") / 20), limit)
    got = accounts.open_keychain(chunked, F.lit(KEY)).collect()
    by_user = {}
    for r in sorted(got, key=lambda r: r.key_id):
        assert r.key_plain == r.plain
        assert r.line == f"{len(by_user.setdefault(r.user_name, []))}: {r.plain}"
        by_user[r.user_name].append(r.key_idx)
    assert sorted(by_user) == ["Hot", "Three", "Zero"]
    assert all(v == list(range(len(v))) for v in by_user.values()) and len(by_user["Hot"]) == 150


ERRORS = "array<struct<stack: string, message: string>>"
RUNS = f"run_id bigint, project string, suite string, name string, type string, mode string, state string, duration double, errors {ERRORS}"


@pytest.fixture(scope="module")
def tasks(spark):
    boom, blank = ("at boom", "boom"), (None, "blank")
    data = [
        (1, "p", "", "file", "suite", "run", "pass", 0.0, None),
        (2, "p", "file", "mock_suite", "suite", "run", "pass", 5.0, []),
        (3, "p", "file", "mock_test", "test", "run", "pass", 1.0, None),
        (4, "p", "file", "mock_failed_test", "test", "run", "fail", 1.0, [boom, blank]),
        (5, "q", "file", "other", "custom", "run", "fail", 1.0, [boom, blank]),
        (6, "p", "file", "s1", "suite", "run", "fail", 2.0, [boom]),
        (7, "q", "file", "s2", "suite", "run", "fail", 3.0, [boom]),
        (8, "p", "file", "skipped", "test", "skip", None, None, None),
        (9, "p", "file", "todo", "test", "todo", None, None, None),
    ]
    return spark.createDataFrame(data, RUNS)


def test_rollup(tasks):
    got = runs.status_rollup(tasks).first().asDict()
    assert got == {
        "total": 9, "passed": 3, "failed": 4, "skipped": 1, "todo": 1, "max_duration": 5.0, "sum_duration": 10.0,
    }


def test_error_groups(tasks):
    got = sorted((r.stack, r.project, r.n, r.task) for r in runs.error_groups(tasks).collect())
    assert got == [("", "", 1, 4), ("", "", 1, 5), ("at boom", "", 2, 4), ("at boom", "", 2, 5), ("at boom", "p", 1, 6), ("at boom", "q", 1, 7)]


def test_a_large_error_group(spark):
    error = [("same", "m")]
    many = spark.createDataFrame([(i, "p", "", "t", "test", "run", "fail", 1.0, error) for i in range(500)], RUNS)
    found = runs.error_groups(many).collect()
    assert {r.n for r in found} == {500} and sorted(r.task for r in found) == list(range(500))


def test_failures(tasks):
    assert tuple(runs.failure_summary(tasks).first()) == (3, 2, 2, 4)


def test_order_and_names(tasks):
    assert [r.run_id for r in runs.skipped_first(tasks, "run_id").collect()][:3] == [8, 9, 1]
    names = tasks.filter("run_id < 3").orderBy("run_id").select(runs.full_name("suite", "name")).collect()
    assert [r[0] for r in names] == ["file", "file > mock_suite"]
