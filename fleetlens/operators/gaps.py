"""Thinning a series so that kept rows lie more than a gap apart, without a task per series.

Which row is kept next depends on the one kept last, along the whole series. A chunk of time,
however, only has to know when the last row before it was kept, and tells when its own last one is: a step
function, which is short, as chains that start at different rows soon meet. The functions of
a series' chunks are followed in order; then every chunk picks its rows on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.ordered import clock, fitting_chunk, slot
from fleetlens.session import materialize

#: Different times of a series that a task holds at once.
CHUNK_TIMES = 500_000


def steps(times: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """``(upper, last)``: a chain whose last row before ``start`` is kept at ``e`` keeps as its last row of the chunk
    ``last`` of the first step with ``upper > e + gap``, or none if there is no such step.

    ``times`` are sorted and different. Only rows up to the first one a gap after the start can follow an earlier row.
    """
    after = np.searchsorted(times, times + gap, "right")
    jump = np.where(after < len(times), after, np.arange(len(times)))
    while True:  # twice as far each time
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    entries = min(len(times), int(np.searchsorted(times, start + gap)) + 1)
    last = times[jump[:entries]]
    ends = np.append(np.flatnonzero(last[1:] != last[:-1]), entries - 1)
    return times[:entries][ends], last[ends]


def _picked(times: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Places of the rows kept, and the time of the last one."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + gap, "right"))
    while at < len(times):
        out.append(at)
        last = int(times[at])
        at = int(np.searchsorted(times, last + gap, "right"))
    return out, last


def sample_gap(
    df: DataFrame,
    keys: Sequence[str],
    ms: int,
    ts: str = "ts",
    tie: Sequence[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Rows more than ``ms`` after the row of their key that was kept before; the first row is kept.

    The rows that ``stream_sample_gap`` lets through, of a table. Of rows of one time the first by ``tie`` counts.
    Rows without a time are left out; NULL is a key. A series of any length is spread over the tasks;
    only a few numbers per chunk are followed in order.
    """
    keys, tie, gap = list(keys), list(tie), ms * 1000
    rows = df.withColumn("_us", clock(df, ts)).filter("_us is not null")
    if chunk_seconds is None:
        size = fitting_chunk(rows, keys, F.col("_us"), max(gap, 1), max_rows=CHUNK_TIMES)
    else:
        size = chunk_seconds * 1_000_000
    rows = rows.withColumn("_chunk", slot(F.col("_us"), size))
    names, kinds = [*keys, "_chunk"], {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                times = batch.column(len(names))[i].values.to_numpy()
                upper, last = steps(np.sort(times), batch.column(len(keys))[i].as_py() * size, gap)
                at = pa.array(np.full(len(upper), i))
                columns = [c.take(at) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(upper), pa.array(last)], [*names, "upper", "last"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, chunk, entry, kept, settled = None, None, None, None, True
        for batch in batches:
            starts, entries = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for i, (*key, at, upper, last) in enumerate(zip(*columns)):
                if series != key:
                    series, kept, chunk = key, None, None
                if chunk != at:
                    chunk, entry, settled = at, kept, False
                    starts.append(i)
                    entries.append(entry)
                if not settled and (entry is None or upper > entry + gap):
                    kept, settled = last, True
            at = pa.array(starts, pa.int64())
            taken = [c.take(at) for c in batch.columns[: len(names)]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(entries, pa.int64())], [*names, "_us"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            body, us = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            heads = np.flatnonzero(~body)
            places: list[int] = []
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), len(body)]):
                if a < b and not body[a]:
                    last, a = us[a].as_py(), a + 1
                if a < b:
                    found, last = _picked(us.slice(a, b - a).to_numpy(), last, gap)
                    places += [a + i for i in found]
            taken = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(taken.columns[2:], batch.schema.names[2:])

    times = rows.select(*names, "_us").distinct().groupBy(*names).agg(F.collect_list("_us").alias("times"))
    table = times.mapInArrow(functions, f"{head}, upper bigint, last bigint")
    ordered = table.repartition(*keys) if keys else table.coalesce(1)
    entries = ordered.sortWithinPartitions(*names, "upper").mapInArrow(follow, f"{head}, _us bigint")
    heads = materialize(entries).withColumn("_body", F.lit(False))
    both = rows.withColumn("_body", F.lit(True)).unionByName(heads, allowMissingColumns=True)
    dealt = both.repartition(*names).sortWithinPartitions(*names, "_body", "_us", *tie)
    return dealt.select("_body", "_us", *df.columns).mapInArrow(pick, df.schema)
