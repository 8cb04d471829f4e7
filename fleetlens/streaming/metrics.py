"""Counters and gauges as streams.

Two ways to carry what a series needs from one micro-batch to the next. The
stateful operators keep it in the state store and sort a series' part of a
micro-batch in one task: for many series of similar size, in micro-batches
bounded by the source (``maxFilesPerTrigger``). ``append_counter_deltas`` and
``append_lookback`` keep it in a table and run the batch operators, which split a
busy series over many tasks.

The stateful operators run on event time. Rows older than the watermark are late and
dropped. A series of which nothing came for ``forget`` is over: an event-time
timer removes its state once the watermark has passed, and whatever comes after
such a gap is treated as the start of a series, whether or not the timer has run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetlens.functions.intervals import interval_seconds
from fleetlens.operators.metrics import (
    LOOKBACK_MS,
    counter_deltas,
    gauge_extrema,
    lookback_mean,
)
from fleetlens.operators.ordered import clock, last_row
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize, remove, scratch_removed

#: How far rows may lag behind the newest one seen, and after how long without a row a series is over.
WATERMARK, FORGET = "1 hour", "1w"
#: Slots that a lookback's span is cut into.
SLOTS = 32

#: Event time counts from 1870: a watermark starts at zero, and what lies before it is late. Pandas' clock ends with LAST_US.
_ERA_US, _LAST_US = 3_155_760_000_000_000, 9_223_372_036_000_000

_UNITS = {"ms": 1000, "us": 1}


def stream_running_extrema(
    df: DataFrame, keys: Sequence[str] = ("gauge",), ts: str = "ts", value: str = "value", tie: Sequence[str] = ()
) -> DataFrame:
    """Current, lowest and highest value per gauge, for update mode; pre-aggregated before the shuffle."""
    return gauge_extrema(df, keys, ts, value, tie)


def stream_sample_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Samples seen per key, for update mode."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"))


def latest(updates: DataFrame, keys: Sequence[str], batch: str = "batch") -> DataFrame:
    """The last row of each key among the stored batches of an update-mode stream."""
    others = [c for c in updates.columns if c not in (*keys, batch)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), batch).alias("_row")).select(*keys, "_row.*")


def _in_time_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    given = list(frames)
    batch = given[0] if len(given) == 1 else pd.concat(given, ignore_index=True)
    if (np.diff(batch["us"].to_numpy()) >= 0).all():
        return batch.reset_index(drop=True)
    return batch.sort_values("us", kind="stable", ignore_index=True)


def _nullable(values: np.ndarray, absent: np.ndarray) -> pd.Series:
    """A column of the values' own kind in which some are NULL."""
    kind = "Int64" if values.dtype.kind == "i" else "Float64"
    column = pd.array(values, dtype=kind)
    column[absent] = pd.NA
    return pd.Series(column)


class _Expiring(StatefulProcessor):
    """A series that is removed by a timer ``forget_us`` of event time after its last row.

    There is one timer per series. When it fires too early, as rows came after it was set, it is set anew.
    """

    def __init__(self, forget_us: int) -> None:
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("us", T.LongType())]))

    def _due(self, us: int) -> int:
        return -(-(us + _ERA_US + self.forget_us) // 1000) + 1

    def seen(self, us: int, known: bool) -> None:
        """The series' newest row is from this time; a series not ``known`` gets a timer."""
        if not known:
            self.handle.registerTimer(self._due(us))
        self.newest.update((us,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()
        due = None if newest is None else self._due(newest[0])
        if due is not None and due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.newest.clear()
            self.forget()
        return iter(())

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Deltas(_Expiring):
    """State: the last sample of the series."""

    def __init__(self, names: Sequence[str], sample: T.StructType, forget_us: int) -> None:
        super().__init__(forget_us)
        self.names, self.sample = list(names), sample

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", self.sample)

    def forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _in_time_order(rows)
        before = self.last.get()
        if before is not None:
            batch = batch[batch["us"] >= before[0]]
        if batch.empty:
            return
        us = batch["us"].to_numpy()
        out = batch[self.names].reset_index(drop=True)
        first = np.diff(us, prepend=us[0] if before is None else before[0]) > self.forget_us
        first[0] |= before is None
        for i, name in enumerate(("total", "idle"), 1):
            values = batch[name].to_numpy()
            start = values[0] if before is None else before[i]
            out[f"d_{name}"] = _nullable(np.diff(values, prepend=np.array([start], values.dtype)), first)
        self.last.update((int(us[-1]), batch["total"].iloc[-1].item(), batch["idle"].iloc[-1].item()))
        self.seen(int(us[-1]), before is not None)
        yield out


class _Lookback(_Expiring):
    """Samples by slot of time, so that a batch reads and writes the slots that it touches and no others.

    State: per slot the number and sums of its samples (``sums``) and the samples (``samples``), and the last
    sample before all slots (``edge``). The slots between the end of a window and the batch lie in
    every window of the batch, so their sums are enough; samples are read of the slots that
    windows end in.
    """

    def __init__(self, names: Sequence[str], sample: T.StructType, span_us: int, forget_us: int) -> None:
        super().__init__(max(forget_us, span_us))
        self.names, self.sample, self.span_us = list(names), sample, span_us
        self.width = max(1, span_us // SLOTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        slot = T.StructType([T.StructField("slot", T.LongType())])
        lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.sample]
        self.sums = handle.getMapState("sums", slot, T.StructType([T.StructField("n", T.LongType()), *self.sample.fields[1:]]))
        self.samples = handle.getMapState("samples", slot, T.StructType(lists))
        self.edge = handle.getValueState("edge", self.sample)

    def forget(self) -> None:
        for state in (self.sums, self.samples, self.edge):
            state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _in_time_order(rows)
        newest = self.newest.get()
        if newest is not None:
            batch = batch[batch["us"] >= newest[0]]
        if batch.empty:
            return
        us = batch["us"].to_numpy()
        series = [*self._parts(us, batch, us[0] if newest is None else newest[0])]
        out = batch[self.names].reset_index(drop=True)
        out["mean_total"], out["mean_idle"] = (np.concatenate(p) for p in zip(*series))
        self.seen(int(us[-1]), newest is not None)
        yield out

    def _parts(self, us: np.ndarray, batch: pd.DataFrame, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The batch cut where the series, last seen at ``last``, starts anew."""
        cuts = np.flatnonzero(np.diff(us, prepend=last) > self.forget_us).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(us)]):
            if a in cuts:
                self.forget()
            if a < b:
                yield self._means(us[a:b], *[batch[c].to_numpy()[a:b] for c in ("total", "idle")])

    def _means(self, us: np.ndarray, total: np.ndarray, idle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = us - self.span_us  # samples up to there are outside, but for the last of them
        known = {k[0]: v for k, v in self.sums.iterator()}
        split = sorted(k for k in known if k <= ends[-1] // self.width)
        edge = self.edge.get()
        old = [] if edge is None else [tuple(edge)]
        for slot in split:
            old += zip(*self.samples.getValue((slot,)))
        inner = [v for k, v in known.items() if k > ends[-1] // self.width]
        old_us = np.array([o[0] for o in old], np.int64)
        # How many of the old samples, and then of the batch, end outside of each window; the last of them counts.
        out_old, out_new = np.searchsorted(old_us, ends, "right"), np.searchsorted(us, ends, "right")
        from_old, from_new = np.maximum(out_old - 1, 0), np.maximum(out_new - 1, 0)
        in_batch = out_new > 0
        upto = np.arange(1, len(us) + 1)
        more = sum(v[0] for v in inner)
        n = np.where(in_batch, upto - from_new, len(old) - from_old + more + upto)
        means = []
        for i, values in enumerate((total, idle), 1):
            past = np.concatenate([[0], np.cumsum(np.array([o[i] for o in old], values.dtype))]).astype(values.dtype)
            fresh = np.concatenate([[0], np.cumsum(values)]).astype(values.dtype)
            middle = sum(v[i] for v in inner)
            means.append(np.where(in_batch, fresh[upto] - fresh[from_new], past[-1] - past[from_old] + middle + fresh[upto]) / n)
        self._store(us, total, idle, known)
        return means[0], means[1]

    def _store(self, us: np.ndarray, total: np.ndarray, idle: np.ndarray, known: dict[int, tuple]) -> None:
        """Add the batch to its slots; drop slots that no later window reaches, but for the last sample of them."""
        slots = us // self.width
        oldest = (us[-1] - self.span_us) // self.width
        starts = np.flatnonzero(np.diff(slots, prepend=slots[0] - 1))
        edge = None
        for a, b in zip(starts, [*starts[1:], len(us)]):
            slot = int(slots[a])
            some = [c[a:b].tolist() for c in (us, total, idle)]
            if slot < oldest:
                edge = tuple(c[-1] for c in some)
                continue
            held = self.samples.getValue((slot,)) if slot in known else ([], [], [])
            self.samples.updateValue((slot,), tuple([*h, *s] for h, s in zip(held, some)))
            n, sums = known.get(slot, (0, 0, 0))[0], known.get(slot, (0, 0, 0))[1:]
            self.sums.updateValue((slot,), (n + len(some[0]), *[kind(x + sum(s)) for kind, x, s in zip(self._kinds(), sums, some[1:])]))
        gone = sorted(k for k in known if k < oldest)
        if gone and edge is None:
            edge = tuple(c[-1] for c in self.samples.getValue((gone[-1],)))
        for slot in gone:
            self.sums.removeKey((slot,))
            self.samples.removeKey((slot,))
        if edge is not None:
            self.edge.update(edge)

    def _kinds(self) -> list[type]:
        return [int if isinstance(f.dataType, T.LongType) else float for f in self.sample.fields[1:]]


class _Gaps(_Expiring):
    """State: when the series last let a row through; of no use once that is longer ago than the gap."""

    def __init__(self, names: Sequence[str], gap_us: int) -> None:
        super().__init__(gap_us)
        self.names, self.gap_us = list(names), gap_us

    def forget(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _in_time_order(rows)
        times = batch["us"].tolist()
        at, picked = 0, []
        newest = self.newest.get()
        last = None if newest is None else newest[0]
        while (at := 0 if last is None else bisect_right(times, last + self.gap_us)) < len(times):
            picked.append(at)
            last = times[at]
        if picked:
            self.seen(last, newest is not None)
            yield batch.loc[picked, self.names]


def _number(df: DataFrame, name: str) -> T.DataType:
    """Whole numbers stay whole; all others are doubles."""
    return T.LongType() if isinstance(df.schema[name].dataType, T.IntegralType) else T.DoubleType()


def _samples(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "ms") -> DataFrame:
    """``keys, t, us, total, idle`` of the samples that have a time and both counters."""
    us = clock(df, ts)
    numbers = [F.col(c).cast(_number(df, c)).alias(c) for c in ("total", "idle")]
    rows = df.select(*keys, F.floor(us / _UNITS[unit]).cast("bigint").alias("t"), us.alias("us"), *numbers)
    return rows.filter(F.col("us").isNotNull() & F.col("total").isNotNull() & F.col("idle").isNotNull())


def _on_event_time(rows: DataFrame, watermark: str) -> DataFrame:
    at = F.least(F.col("us") + _ERA_US, F.lit(_LAST_US))
    return rows.withColumn("_at", F.timestamp_micros(at)).withWatermark("_at", watermark)


def _sample(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("us", T.LongType()), *[T.StructField(c, _number(df, c)) for c in ("total", "idle")]])


def _forget_us(forget: str) -> int:
    return interval_seconds(forget) * 1_000_000


def _run(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, output: T.StructType) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def stream_sample_gap(df: DataFrame, keys: Sequence[str], ms: int, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Rows more than ``ms`` after the row of their key that passed before; the first row passes.

    Unlike fixed time slots the clock restarts at each row that passes.
    """
    rows = df.withColumn("us", clock(df, ts)).filter("us is not null")
    return _run(_on_event_time(rows, watermark), keys, _Gaps(df.columns, ms * 1000), df.schema)


def stream_counter_deltas(
    df: DataFrame,
    keys: Sequence[str] = ("cpu",),
    ts: str = "ts",
    watermark: str = WATERMARK,
    forget: str = FORGET,
    unit: str = "ms",
) -> DataFrame:
    """``keys, t`` (epoch, in ``unit``) ``, total, idle, d_total, d_idle``; samples older than the last are dropped.

    Counters that are whole numbers stay so. A sample without a time or a counter is left out.
    """
    rows, sample = _samples(df, keys, ts, unit), _sample(df)
    names = [*keys, "t", "total", "idle"]
    deltas = [T.StructField(f"d_{f.name}", f.dataType) for f in sample.fields[1:]]
    output = T.StructType([*rows.select(*names).schema.fields, *deltas])
    return _run(_on_event_time(rows, watermark), keys, _Deltas(names, sample, _forget_us(forget)), output)


def stream_lookback(
    df: DataFrame,
    keys: Sequence[str] = ("cpu",),
    ts: str = "ts",
    ms: int = LOOKBACK_MS,
    watermark: str = WATERMARK,
    forget: str = FORGET,
    unit: str = "ms",
) -> DataFrame:
    """``keys, t, total, idle, mean_total, mean_idle`` over the last ``ms`` and the sample before.

    ``forget`` counts from ``ms`` at least. Other than that as ``stream_counter_deltas``.
    """
    rows, sample = _samples(df, keys, ts, unit), _sample(df)
    names = [*keys, "t", "total", "idle"]
    means = [T.StructField(n, T.DoubleType()) for n in ("mean_total", "mean_idle")]
    output = T.StructType([*rows.select(*names).schema.fields, *means])
    return _run(_on_event_time(rows, watermark), keys, _Lookback(names, sample, ms * 1000, _forget_us(forget)), output)


#: Order of samples of equal time in the appending streams: as they came.
_ARRIVED = ["_batch", "_row"]


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _newest, n``: when each series was last seen."""
    return materialize(rows.groupBy(*keys).agg(F.max("us").alias("_newest"), F.count(F.lit(1)).alias("n")))


def _tail(rows: DataFrame, keys: Sequence[str], us: int, forget_us: int) -> DataFrame:
    """Rows of each series that a lookback after its newest row can reach; none of series that are over."""
    newest = _newest(rows, keys)
    going = newest.withColumn("_over", F.col("_newest") < newest.agg(F.max("_newest")).scalar() - forget_us)
    going = materialize(going.filter("not _over").drop("_over"))
    dated = lookup_join(rows, going.drop("n"), keys, spread=["us"], counts=newest, null_safe=True)
    recent = dated.filter(F.col("us") > F.col("_newest") - us).drop("_newest")
    older = dated.filter(F.col("us") <= F.col("_newest") - us).groupBy(*keys)
    edge = older.agg(last_row(["us", *_ARRIVED], ["t", "total", "idle"]).alias("_last")).select(*keys, "_last.*")
    return recent.unionByName(edge)


def _append_by_batch(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    us: int,
    forget: str,
    path: str,
    checkpoint: str,
    trigger: dict | None,
    operator: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Run a batch operator over each micro-batch and what earlier ones left of its series.

    Batch ``n`` reads ``tail/batch=n-1`` and overwrites ``data/batch=n`` and
    ``tail/batch=n``, so a repeated batch gives the same files. Tails before the last two batches
    and all that a batch wrote on the way are removed.
    """
    samples = _samples(df, keys, ts)
    spark = df.sparkSession
    numbers = T.StructType([T.StructField(c, T.LongType()) for c in _ARRIVED])
    schema = T.StructType([*samples.schema.fields, *numbers.fields])

    def write(batch: DataFrame, number: int) -> None:
        with scratch_removed(spark):
            fresh = batch.withColumn("_batch", F.lit(number).cast("bigint")).withColumn("_row", F.monotonically_increasing_id())
            fresh = materialize(fresh.select(*schema.names))
            if number > 0:
                tail = spark.read.schema(schema).parquet(f"{path}/tail/batch={number - 1}")
                seen = lookup_join(fresh, _newest(tail, keys).drop("n"), keys, "left", spread=["us"], null_safe=True)
                fresh = seen.filter(F.col("_newest").isNull() | (F.col("us") >= F.col("_newest"))).drop("_newest")
            else:
                tail = fresh.limit(0)
            both = materialize(fresh.unionByName(tail))
            out = operator(both).filter(F.col("_batch") == number).drop("us", *_ARRIVED)
            out.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
            tail = _tail(both, keys, us, _forget_us(forget)).select(*schema.names)
            tail.write.mode("overwrite").parquet(f"{path}/tail/batch={number}")
        if number > 1:
            remove(spark, f"{path}/tail/batch={number - 2}")

    return (
        samples.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def append_counter_deltas(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("cpu",),
    ts: str = "ts",
    chunk_seconds: int | None = None,
    trigger: dict | None = None,
    forget: str = FORGET,
) -> StreamingQuery:
    """``stream_counter_deltas`` written to ``path/data/batch=<n>``, busy series split.

    A series ``forget`` behind the newest sample of all is over and leaves the tail.
    """

    def deltas(rows: DataFrame) -> DataFrame:
        # The shared clock takes milliseconds or timestamps.
        timed = rows.withColumn("_at", F.timestamp_micros("us"))
        return counter_deltas(timed, keys, "_at", tie=_ARRIVED, chunk_seconds=chunk_seconds).drop("_at")

    return _append_by_batch(df, keys, ts, 1, forget, path, checkpoint, trigger, deltas)


def append_lookback(
    df: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("cpu",),
    ts: str = "ts",
    ms: int = LOOKBACK_MS,
    chunk_seconds: int | None = None,
    trigger: dict | None = None,
    forget: str = FORGET,
) -> StreamingQuery:
    """``stream_lookback`` written to ``path/data/batch=<n>``, busy series split; series end as in ``append_counter_deltas``."""

    def means(rows: DataFrame) -> DataFrame:
        timed = rows.withColumn("_at", F.timestamp_micros("us"))
        return lookback_mean(timed, keys, "_at", ms=ms, tie=_ARRIVED, chunk_seconds=chunk_seconds).drop("_at")

    return _append_by_batch(df, keys, ts, ms * 1000, forget, path, checkpoint, trigger, means)
