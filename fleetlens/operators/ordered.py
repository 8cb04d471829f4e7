"""Ordered computations per key that never need a whole key in one task.

Each splits a key's rows by a ``chunk`` column that grows with the order (an
hour of the timestamp, a range of ids). One pre-aggregated row per key and
chunk is enough to tell what earlier chunks contribute; that contribution joins
the rows of the chunk as one extra leading row, and the window then runs per
key and chunk. Cost: a narrow extra pass over the input, so hand in a table, one
shuffle, and for fitted time chunks another narrow pass that counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# An hour of samples taken every second is 3600 rows of one key.
CHUNK_MICROS = 3_600_000_000
MAX_CHUNK_ROWS = 5_000_000

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}
_FIRST_TO_LAST = (W.unboundedPreceding, W.currentRow)


def slot(value: Column, size: int) -> Column:
    """Number of the ``size``-wide slot a whole number lies in, also below zero."""
    return ((value - F.pmod(value, F.lit(size))) / size).cast("bigint")


def clock(df: DataFrame, ts: str) -> Column:
    """Microseconds of a timestamp column, or of a whole number of epoch milliseconds."""
    if dict(df.dtypes)[ts] in ("bigint", "int"):
        return F.col(ts).cast("bigint") * 1000
    return F.unix_micros(F.col(ts).cast("timestamp"))


def fitting_chunk(
    df: DataFrame, keys: Sequence[str], t: Column, least: int = 1, size: int = CHUNK_MICROS, max_rows: int = MAX_CHUNK_ROWS
) -> int:
    """A chunk size in which no key has more than ``max_rows`` rows in one chunk.

    Starts at ``size`` and shrinks, down to ``least``, while the fullest chunk is
    too full. Each try counts per key and chunk, pre-aggregated before the
    shuffle; usually the first one fits.
    """
    size = max(size, least)
    while size > least:
        counts = df.groupBy(*keys, slot(t, size).alias("_chunk")).agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= max_rows:
            break
        size = max(least, size * max_rows // (2 * most))
    return size


def time_chunk(df: DataFrame, keys: Sequence[str], ts: str, seconds: int | None = None) -> Column:
    """Number of the time slot a row lies in; without ``seconds`` the slot is fitted to the data."""
    t = clock(df, ts)
    return slot(t, fitting_chunk(df, keys, t) if seconds is None else seconds * 1_000_000)


def last_row(order: Sequence[str], cols: Sequence[str], among: Column | None = None) -> Column:
    """Aggregate: ``order`` and ``cols`` of the last row, as a struct with NULL fields if there is none.

    Ordered by one column of a primitive type this is a hash aggregate. More
    order columns need a struct maximum, for which Spark sorts first.
    """
    names = list(dict.fromkeys([*order, *cols]))
    if len(order) == 1:
        by = F.col(order[0]) if among is None else F.when(among, F.col(order[0]))
        return F.struct(*[F.max_by(c, by).alias(c) for c in names])
    row = F.struct(*names)
    return F.max(row if among is None else F.when(among, row))


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    body = rows.withColumn("_body", F.lit(True))
    return body.unionByName(heads.withColumn("_body", F.lit(False)), allowMissingColumns=True)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, aggs: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` per key: ``aggs = {name: (function, column)}``."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_chunk", chunk)
    totals = rows.groupBy(*keys, "_chunk").agg(*[_FOLD[f](c).alias(name) for name, (f, c) in aggs.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = totals.select(*keys, "_chunk", *[_FOLD[f](name).over(before).alias(name) for name, (f, _) in aggs.items()])
    body = rows.select("*", *[F.col(c).alias(name) for name, (_, c) in aggs.items()])
    upto = W.partitionBy(*keys, "_chunk").orderBy("_body", *order).rowsBetween(*_FIRST_TO_LAST)
    folded = _with_heads(body, heads).select(
        *df.columns, "_body", *[_FOLD[f](name).over(upto).alias(name) for name, (f, _) in aggs.items()]
    )
    return folded.filter("_body").drop("_body")


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, cols: Sequence[str]
) -> DataFrame:
    """Add ``prev_<col>``: the value of the row before, per key; NULL on a key's first row."""
    keys, order, cols = list(keys), list(order), list(cols)
    rows = df.withColumn("_chunk", chunk)
    ends = rows.groupBy(*keys, "_chunk").agg(last_row(order, cols).alias("_end"))
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    before = ends.select(*keys, "_chunk", F.lag("_end").over(by_chunk).alias("_end"))
    heads = before.filter(F.col("_end").isNotNull()).select(*keys, "_chunk", "_end.*")
    inside = W.partitionBy(*keys, "_chunk").orderBy("_body", *order)
    seen = _with_heads(rows, heads).select(
        *df.columns, "_body", *[F.lag(c).over(inside).alias(f"prev_{c}") for c in cols]
    )
    return seen.filter("_body").drop("_body")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "rn") -> DataFrame:
    """Exact 1-based ``row_number`` per key (or of all rows, with no keys)."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_chunk", chunk)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_chunk").orderBy("_body", *order)
    whole = W.partitionBy(*keys, "_chunk").orderBy("_body", *order).rowsBetween(*_FIRST_TO_LAST)
    position = F.row_number().over(inside) - 1 + F.max("_offset").over(whole)
    placed = _with_heads(rows, heads).select(*df.columns, "_body", position.cast("bigint").alias(name))
    return placed.filter("_body").drop("_body")
