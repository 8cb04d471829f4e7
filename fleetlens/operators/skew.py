"""Joins and group members that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F, types as T

from fleetlens.session import materialize

# A key is hot when it holds more than 1/MAX_HOT_KEYS of all rows, so there are
# fewer than MAX_HOT_KEYS of them whatever the data: that bounds the broadcast.
MAX_HOT_KEYS = 1000
MAX_SALTS = 4096
ROWS_PER_SALT = 1_000_000
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024**2


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``keys, _salts`` of the keys worth splitting; fewer than MAX_HOT_KEYS rows."""
    limit = counts.agg(F.sum(n) / MAX_HOT_KEYS).scalar()
    salts = F.least(F.ceil(F.col(n) / rows_per_salt), F.lit(MAX_SALTS)).cast("int")
    hot = counts.filter((F.col(n) > rows_per_salt) & (F.col(n) > limit))
    return hot.select(*keys, salts.alias("_salts"))


def equal_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    """Equi-join on ``keys``; ``null_safe`` makes a NULL key equal to a NULL key."""
    if not null_safe:
        return left.join(right, list(keys), how)
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    hot: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Sequence[str],
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join in which a hot key's rows go to ``_salts`` tasks instead of one.

    The salt comes from the ``spread`` columns and the number of the task that
    emits the row: equal rows of different tasks are split too, and a repeated
    task gives the same salts. The matching lookup rows are repeated once per
    salt. Rows with a NULL key, unless it can match, get any salt.
    """
    keys = list(keys)
    marks = F.broadcast(hot)
    mixed = F.xxhash64(*spread, F.spark_partition_id())
    salt = F.coalesce(F.pmod(mixed, F.col("_salts")).cast("int"), F.lit(0))
    if not null_safe:
        absent = reduce(or_, [F.col(k).isNull() for k in keys])
        salt = F.when(absent, F.pmod(mixed, F.lit(MAX_SALTS)).cast("int")).otherwise(salt)
    left = equal_keys(rows, marks, keys, "left", null_safe).withColumn("_salt", salt).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = equal_keys(lookup, marks, keys, "left", null_safe).withColumn("_salt", F.explode(every)).drop("_salts")
    return equal_keys(left, right, [*keys, "_salt"], how, null_safe).drop("_salt")


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the table, counted and measured, is small enough to broadcast."""
    width = F.lit(0)
    for field in df.schema:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(col)
        elif isinstance(field.dataType, T.ArrayType):
            size = F.size(col) * 16
        else:
            size = F.lit(16)
        width = width + F.coalesce(size, F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str] | str,
    how: str = "inner",
    *,
    spread: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    rows_per_salt: int = ROWS_PER_SALT,
    null_safe: bool = False,
) -> DataFrame:
    """Join many ``rows`` to a lookup table.

    The lookup is counted and measured: a small one is broadcast and the rows
    are not shuffled; otherwise both sides are shuffled and hot keys are salted.
    ``counts`` (``keys, n``: rows per key) saves a pass over ``rows``. The lookup
    should be a table or ``materialize``d, as it is read again for the join.
    ``null_safe`` is for groups joined back to their rows: NULL is a key there.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if fits_broadcast(lookup, max_broadcast_rows):
        return equal_keys(rows, F.broadcast(lookup), keys, how, null_safe)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(hot_keys(counts, keys, rows_per_salt=rows_per_salt))
    return salted_join(rows, lookup, hot, keys, how, spread or rows.columns, null_safe)


def group_members(
    rows: DataFrame, keys: Sequence[str], item: str, *, min_n: int = 1, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """``keys, n, item``: each item next to the size of its group, a row per item.

    Rows, not arrays, so a group may have any size and the answer's shape does
    not depend on it. Groups below ``min_n`` rows are left out; NULL is a key.
    ``rows`` is read twice: hand in a table or a ``materialize``d one.
    """
    keys = list(keys)
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n))
    sized = lookup_join(
        rows.select(*keys, item),
        counts,
        keys,
        spread=[item],
        counts=counts,
        max_broadcast_rows=max_broadcast_rows,
        null_safe=True,
    )
    return sized.select(*keys, "n", item)
