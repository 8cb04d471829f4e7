"""Test-run summaries.

Runs have ``run_id, project, suite, name, type, mode, state, duration`` and
``errors ARRAY<STRUCT<stack, message>>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.skew import group_members

# States, modes and the name separator.
PASS, FAIL = "pass", "fail"
SKIP_MODES = ("skip", "todo")
NAME_SEPARATOR = " > "

# Phases of a suite that are timed, and those that its thread takes.
PHASES = ("collect", "setup", "tests", "environment", "prepare")
THREAD = ("collect", "setup", "tests")


def status_rollup(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per outcome, and the longest and summed duration of the suites."""
    state, mode = F.coalesce("state", F.lit("")), F.coalesce("mode", F.lit(""))
    decided = state.isin(PASS, FAIL)
    suite_time = F.when(F.col("type") == "suite", F.col("duration"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == PASS).alias("passed"),
        F.count_if(state == FAIL).alias("failed"),
        F.count_if(~decided & (mode == "skip")).alias("skipped"),
        F.count_if(~decided & (mode == "todo")).alias("todo"),
        F.coalesce(F.max(suite_time), F.lit(0.0)).alias("max_duration"),
        F.coalesce(F.sum(suite_time), F.lit(0.0)).alias("sum_duration"),
    )


def suite_durations(runs: DataFrame, keys: Sequence[str] = (), file: str = "file_path", phases: Sequence[str] = PHASES) -> DataFrame:
    """The longest and summed time of every phase (a column of ``runs`` each) over the suites that have a file, and of their threads.

    A thread's time is that of its phases in ``THREAD``. Without suites all are zero.
    """
    own = (F.col("type") == "suite") & F.col(file).isNotNull()
    whole = [p for p in phases if p in THREAD]
    times = {p: F.when(own, F.coalesce(F.col(p), F.lit(0.0))) for p in phases}
    rolled = runs.groupBy(*keys).agg(
        F.count_if(own).alias("files"),
        *[F.coalesce(f(t), F.lit(0.0)).alias(f"{how}_{p}") for p, t in times.items() for how, f in (("max", F.max), ("sum", F.sum))],
    )
    for how in ("max", "sum"):
        rolled = rolled.withColumn(f"{how}_thread", sum((F.col(f"{how}_{p}") for p in whole), F.lit(0.0)))
    return rolled


def _keyed_errors(runs: DataFrame, task: str) -> DataFrame:
    """``stack, project, own, task, pos, message``: an error's group is its stack and project, without a stack its own."""
    errors = runs.select(F.posexplode("errors").alias("_pos", "_error"), *runs.columns)
    stack = F.nullif(F.col("_error.stack"), F.lit(""))
    own = F.when(stack.isNull(), F.concat_ws("#", F.col(task).cast("string"), F.col("_pos").cast("string")))
    return errors.select(
        F.coalesce(stack, F.lit("")).alias("stack"),
        F.coalesce(F.when(F.col("type") == "suite", F.col("project")), F.lit("")).alias("project"),
        F.coalesce(own, F.lit("")).alias("own"),
        F.col(task).alias("task"),
        F.col("_pos").alias("pos"),
        F.col("_error.message").alias("message"),
    )


def error_messages(runs: DataFrame, task: str = "run_id") -> DataFrame:
    """A row per group of identical errors: ``stack, project, message, n, task``, message and task those of its first error.

    Merged as in ``error_groups``; the first error is that of the smallest task.
    """
    first = F.min(F.struct("task", "pos", "message")).alias("first")
    groups = _keyed_errors(runs, task).groupBy("stack", "project", "own").agg(F.count(F.lit(1)).alias("n"), first)
    return groups.select("stack", "project", F.col("first.message").alias("message"), "n", F.col("first.task").alias("task"))


def error_groups(runs: DataFrame, task: str = "run_id") -> DataFrame:
    """Tasks by identical error: ``stack, project, n, task``, a row per task.

    Errors merge when the stack and, for suites, the project agree; an error
    without a stack stays alone.
    """
    keyed = _keyed_errors(runs, task).drop("pos", "message")
    return group_members(keyed, ["stack", "project", "own"], "task").drop("own")


def failure_summary(runs: DataFrame) -> DataFrame:
    """One row: failed suites and tests, and how many errors each kind has."""
    is_suite = F.col("type") == "suite"
    bad_suite = is_suite & F.col("errors").isNotNull()
    bad_test = F.col("type").isin("test", "custom") & (F.col("state") == FAIL)
    found = F.coalesce(F.size("errors"), F.lit(0))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond & F.col("errors").isNotNull(), found)), F.lit(0)).cast("bigint")

    return runs.agg(
        F.count_if(bad_suite).alias("failed_suites"),
        F.count_if(bad_test).alias("failed_tests"),
        total(bad_suite).alias("suite_errors"),
        total(bad_test).alias("test_errors"),
    )


def skipped_first(runs: DataFrame, *then: str) -> DataFrame:
    """Skipped and todo rows before the rest, then by the given columns."""
    skipped = F.coalesce(F.col("mode").isin(*SKIP_MODES), F.lit(False))
    return runs.orderBy(F.desc(skipped), *then)


def full_name(*parts: Column | str, separator: str = NAME_SEPARATOR) -> Column:
    """Names from the file down to the test, empty ones left out."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in cols])), separator)
