"""Hard negatives by a multiway hyperplane tree with distance ranges (after GNAT).

Vectors become whole numbers, and get one more component that makes all their lengths equal; an anchor
gets a zero there. Then its scores (inner products) are distances, higher ones nearer, and a window of scores
is a ring around it. A node of the tree has split points; each vector belongs to the nearest one, so two
siblings meet at the hyperplane between their points. For each split point the node stores the least and greatest
distance to the vectors of every sibling. An anchor's distance to a split point and those ranges tell how near
a sibling's vectors can be and how far; siblings whose range misses the anchor's rings are left out.

The tree is fitted on a bounded sample, all vectors are placed and give the ranges, and leaves are searched
exactly: blocks of a leaf's rows against blocks of the anchors that reach it, each a task's group. Results do not
depend on the sample; only how many leaves an anchor reaches does.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

# A component's scale, the window of negatives in percent of the positive's score.
SCALE, LOW_PERCENT, HIGH_PERCENT = 256, 80, 100
POSITIVES, NEGATIVES = 5, 5

#: Rows that the tree is fitted on, split points of a node, rows that a leaf should hold, and most nodes.
SAMPLE_ROWS, POINTS, LEAF_ROWS, MAX_NODES = 16_384, 12, 8_192, 512
#: Rows and anchors that a task holds at once.
BLOCK_ROWS, BLOCK_ANCHORS = 8_192, 8_192
#: Products of lengths below these are exact as doubles and as longs; rounding of distances, relative to the longest vector.
EXACT_DOUBLE, EXACT_LONG, ROUNDING = 2.0**53, 2.0**62, 1e-6
LONG = 2**63 - 1


def whole_numbers(column: pa.Array) -> list[np.ndarray | None]:
    """``floor(256 * x)`` of vectors' components, as doubles (they are whole, and exact); None for vectors that take no part."""
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = None if not x or None in x else np.array(x, dtype=np.float64)
        with np.errstate(over="ignore"):
            v = None if v is None or not np.isfinite(v).all() else np.floor(v * SCALE)
        out.append(v if v is not None and np.isfinite(v).all() else None)
    return out


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: longs, or Python's integers where longs are too short."""
    with np.errstate(over="ignore"):
        bound = max(np.abs(left).sum(axis=1), default=0.0) * max(np.abs(right).max(axis=1), default=0.0)
    if bound < EXACT_DOUBLE:
        return np.rint(left @ right.T).astype(np.int64)
    if bound < EXACT_LONG:
        return left.astype(np.int64) @ right.astype(np.int64).T
    as_ints = [np.array([[int(x) for x in v] for v in m], dtype=object) for m in (left, right)]
    return as_ints[0] @ as_ints[1].T


def rows_of(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, dims, v, square`` of the rows that take part: the whole numbers, packed, and their length's square."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = whole_numbers(b.column(3))
            keep = pa.array([v is not None for v in made])
            made = [v for v in made if v is not None]
            with np.errstate(over="ignore"):
                squares = pa.array([float(v @ v) for v in made], pa.float64())
            columns = [pa.array([len(v) for v in made], pa.int32()), pa.array([packed(v) for v in made], pa.binary()), squares]
            yield pa.RecordBatch.from_arrays(
                [*[c.filter(keep) for c in b.columns[:3]], *columns], ["row", "vec_id", "label", "dims", "v", "square"]
            )

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding").filter("label is not null")
    return rows.mapInArrow(run, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, dims int, v binary, square double")


def moved_labels(vectors: DataFrame) -> DataFrame:
    """Every seventh vector gets the next of ten labels, so that some labels contradict their neighbours."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.withColumn("label", moved)


@dataclass
class Node:
    """Split points, and per sibling either the number of a node or, below zero, that of a leaf (its complement)."""

    points: np.ndarray
    children: list[int] = field(default_factory=list)


class Tree:
    """Split points of a sample; ranges come from all rows. Small: at most MAX_NODES nodes."""

    def __init__(self, longest: float, sample: np.ndarray, per_leaf: float, points: int = POINTS) -> None:
        """``longest``: the greatest square of a length; ``per_leaf``: sample rows that a leaf should have."""
        self.longest, self.nodes, self.leaves = longest, [], 0
        if len(sample):
            self.grow(self.raised(sample), per_leaf, points)
        if not self.nodes:
            self.leaves = 1

    def raised(self, vectors: np.ndarray) -> np.ndarray:
        """With the component that makes every row's length the longest."""
        rest = np.maximum(self.longest - np.einsum("ij,ij->i", vectors, vectors), 0.0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def grow(self, sample: np.ndarray, per_leaf: float, points: int) -> int:
        chosen = spread_out(sample, points) if len(sample) > max(per_leaf, points) and len(self.nodes) < MAX_NODES else []
        if len(chosen) < 2:
            self.leaves += 1
            return -self.leaves
        at, node = len(self.nodes), Node(sample[chosen])
        self.nodes.append(node)
        nearest = distances(sample, node.points).argmin(axis=1)
        for child in range(len(chosen)):
            node.children.append(self.grow(sample[nearest == child], per_leaf, points))
        return at

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int, int], tuple[float, float]]]:
        """Each vector's leaf, and the distances from every split point to every sibling's vectors on the way."""
        raised = self.raised(vectors)
        leaf, ranges = np.zeros(len(vectors), dtype=np.int64), {}
        todo = [(0, np.arange(len(vectors)))] if self.nodes else []
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            apart = distances(raised[some], node.points)
            nearest = apart.argmin(axis=1)
            for child, to in enumerate(node.children):
                mine = nearest == child
                if mine.any():
                    for point, (low, high) in enumerate(zip(apart[mine].min(axis=0), apart[mine].max(axis=0))):
                        ranges[at, point, child] = (float(low), float(high))
                    if to >= 0:
                        todo.append((to, some[mine]))
                    else:
                        leaf[some[mine]] = -to - 1
        return leaf, ranges

    def reached(self, vectors: np.ndarray, rings: np.ndarray, ranges: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, each with the anchors (places in ``vectors``) in one of whose rings a vector of the leaf may lie.

        ``rings``: per anchor its least and greatest distances; a ring that is none has no numbers.
        """
        if not self.nodes:
            yield 0, np.flatnonzero(~np.isnan(rings[:, :, 0]).all(axis=1))
            return
        slack = ROUNDING * np.sqrt(self.longest)
        anchors = np.column_stack([vectors, np.zeros(len(vectors))])
        todo = [(0, np.flatnonzero(~np.isnan(rings[:, :, 0]).all(axis=1)))]
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            apart = distances(anchors[some], node.points)
            for child, to in enumerate(node.children):
                points = [p for p in range(len(node.points)) if (at, p, child) in ranges]
                if not points:
                    continue  # no vectors there
                low, high = np.array([ranges[at, p, child] for p in points]).T
                d = apart[:, points]
                least = np.maximum((low - d).max(axis=1), (d - high).max(axis=1))[:, None] - slack
                most = (d + high).min(axis=1)[:, None] + slack
                # So written that distances beyond a double's range (not numbers) leave nothing out.
                missed = (rings[some, :, 1] < least) | (rings[some, :, 0] > most) | np.isnan(rings[some, :, 0])
                left = some[~missed.all(axis=1)]
                if len(left) and to >= 0:
                    todo.append((to, left))
                elif len(left):
                    yield -to - 1, left


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences: products would lose small ones to rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((left - p) ** 2).sum(axis=1)) for p in right], axis=1)


def spread_out(sample: np.ndarray, points: int) -> list[int]:
    """Rows of the sample that lie far from each other: each the farthest from those before it among some."""
    some = np.linspace(0, len(sample) - 1, min(len(sample), 3 * points)).astype(int)
    chosen = [int(some[0])]
    apart = distances(sample[some], sample[chosen])[:, 0]
    while len(chosen) < points and np.nanmax(apart, initial=0.0) > 0:
        chosen.append(int(some[np.nanargmax(apart)]))
        apart = np.minimum(apart, distances(sample[some], sample[chosen[-1:]])[:, 0])
    return chosen


def best_of_window(found: np.ndarray, ids: np.ndarray, low: float | int, high: float | int, most: int) -> np.ndarray:
    """Places of the highest scores within a window, ties by smaller id, as bounded work: only candidates are sorted."""
    at = np.flatnonzero((found >= low) & (found <= high))
    if len(at) > 4 * most and found.dtype != object:
        limit = np.partition(found[at], len(at) - most)[len(at) - most]
        at = at[found[at] >= limit]
    return at[np.lexsort((ids[at], -found[at]))[:most]] if found.dtype != object else np.array(
        sorted(at, key=lambda i: (-found[i], ids[i]))[:most], dtype=int
    )


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they fit, and first of all in what kind."""
    most = np.abs(v).max()
    kind = "h" if most < 2**15 else "i" if most < 2**31 else "d"
    return kind.encode() + v.astype(kind).tobytes()


def unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(v, dtype=chr(v[0]), offset=1).astype(np.float64)


def stacked(vectors: list[bytes]) -> np.ndarray:
    return np.stack([unpacked(v) for v in vectors])


def by_dims(dims: list[int]) -> Iterator[tuple[int, list[int]]]:
    for n in sorted(set(dims)):
        yield n, [i for i, d in enumerate(dims) if d == n]


def fitted(rows: DataFrame, sample_rows: int, leaf_rows: int, points: int) -> dict[int, Tree]:
    """A tree per number of components that occurs in a sample of at most ``sample_rows`` rows; others are one leaf."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("dims", "v").collect()
    dims = [r["dims"] for r in sample]
    known = rows.filter(F.col("dims").isin(sorted(set(dims)))).groupBy("dims")
    sizes = {r["dims"]: r for r in known.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("longest")).collect()}
    trees = {}
    for n, some in by_dims(dims):
        per_leaf = leaf_rows * len(some) / sizes[n]["n"]
        trees[n] = Tree(sizes[n]["longest"], stacked([sample[i]["v"] for i in some]), per_leaf, points)
    return trees


def placed(rows: DataFrame, trees: dict[int, Tree]) -> tuple[DataFrame, dict[int, dict]]:
    """``rows`` with their ``leaf``; and per tree the ranges of distances, at most a node's points squared each."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "vec_id", "label", "dims", "v", "leaf", "node", "point", "child", "low", "high"]
        seen: dict[tuple, tuple[float, float]] = {}
        types = None
        for b in batches:
            types = types or [c.type for c in b.columns]
            leaf = np.zeros(b.num_rows, dtype=np.int64)
            for n, some in by_dims(b.column(3).to_pylist()):
                if n in trees:
                    leaf[some], ranges = trees[n].placed(stacked(b.column(4).take(pa.array(some)).to_pylist()))
                    for at, (low, high) in ranges.items():
                        before = seen.get((n, *at), (low, high))
                        seen[(n, *at)] = (min(before[0], low), max(before[1], high))
            empty = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), *empty], names)
        if seen:
            n, node, point, child = zip(*seen)
            low, high = zip(*seen.values())
            empty = [pa.nulls(len(seen), t) for t in types]
            columns = [pa.array(x, pa.int32()) for x in (node, point, child)] + [pa.array(x, pa.float64()) for x in (low, high)]
            yield pa.RecordBatch.from_arrays(
                [*empty[:3], pa.array(n, pa.int32()), empty[4], pa.nulls(len(seen), pa.int64()), *columns], names
            )

    schema = f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, dims int, v binary, leaf long"
    both = rows.select("row", "vec_id", "label", "dims", "v").mapInArrow(
        run, f"{schema}, node int, point int, child int, low double, high double"
    )
    both = materialize(both)
    slots = both.filter("node is not null").groupBy("dims", "node", "point", "child").agg(F.min("low"), F.max("high"))
    ranges: dict[int, dict] = {}
    for n, node, point, child, low, high in slots.collect():
        ranges.setdefault(n, {})[node, point, child] = (low, high)
    return both.filter("node is null").select("row", "vec_id", "label", "dims", "v", "leaf"), ranges


def routed(anchors: DataFrame, trees: dict[int, Tree], ranges: dict[int, dict]) -> DataFrame:
    """``anchors`` (with ``windows``) once for every leaf that one of their windows may reach."""
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows = b.column(names.index("windows")).to_pylist()
            vectors = b.column(names.index("v")).to_pylist()
            leaves, places = [], []
            for n, some in by_dims(b.column(names.index("dims")).to_pylist()):
                if n not in trees:
                    leaves += [0] * len(some)
                    places += some
                    continue
                rings = np.full((len(some), max(1, *(len(windows[i]) for i in some)), 2), np.nan)
                own = stacked([vectors[i] for i in some])
                for i, place in enumerate(some):
                    for j, w in enumerate(windows[place]):
                        rings[i, j] = ring(own[i], trees[n].longest, w["low"], w["high"])
                for leaf, left in trees[n].reached(own, rings, ranges.get(n, {})):
                    leaves += [leaf] * len(left)
                    places += [some[i] for i in left]
            taken = b.take(pa.array(places, pa.int64()))
            columns = [taken.column(i) if c != "leaf" else pa.array(leaves, pa.int64()) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return anchors.mapInArrow(run, anchors.schema)


def ring(anchor: np.ndarray, longest: float, low: int | None, high: int | None) -> tuple[float, float]:
    """Distances of the vectors whose scores lie between two, when all are as long as the longest."""
    with np.errstate(over="ignore", invalid="ignore"):
        both = float(anchor @ anchor) + longest
        near, far = (0.0 if s is None else np.sqrt(np.maximum(both - 2.0 * s, 0.0)) for s in (high, low))
    return near, np.inf if low is None else far


def blocks(rows: DataFrame, anchors: DataFrame, block_rows: int, block_anchors: int) -> DataFrame:
    """Rows and anchors of each leaf, dealt into blocks of both; every block of the one meets each of the other."""
    leaf = ["dims", "leaf"]
    n_rows = rows.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"), F.count(F.lit(1)).alias("n"))
    n_anchors = anchors.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / block_anchors).alias("somes"), F.count(F.lit(1)).alias("asked"))
    sizes = materialize(n_rows.join(n_anchors, leaf))
    part, some = F.pmod(F.xxhash64("row"), F.col("parts")), F.pmod(F.xxhash64("row"), F.col("somes"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    columns = [*leaf, "part", "some", "kind", "row", "vec_id", "label", "v", "windows"]
    held = lookup_join(rows, sizes.drop("n", "asked"), leaf, spread=["row"], counts=sizes.select(*leaf, "n"))
    held = held.withColumn("part", part).withColumn("some", every("somes")).withColumn("kind", F.lit(0))
    asked = lookup_join(anchors, sizes.drop("n", "asked"), leaf, spread=["row"], counts=sizes.select(*leaf, F.col("asked").alias("n")))
    asked = asked.withColumn("some", some).withColumn("part", every("parts")).withColumn("kind", F.lit(1))
    held = held.withColumn("windows", F.lit(None).cast(anchors.schema["windows"].dataType))
    return held.select(columns).unionByName(asked.select(columns))


def clipped(score: int) -> int:
    return max(-LONG, min(LONG, int(score)))


def searched(entries: DataFrame, most: int, same: bool) -> DataFrame:
    """``anchor_row, tag, row, vec_id, score``: of every block, the best rows within each window of its anchors.

    ``entries``: see ``blocks``; ``windows`` of anchors have a tag and a least and greatest score. ``same``:
    rows of the anchor's label but itself, else those of other labels. A task holds a block of rows and some anchors.
    """
    keys = ["dims", "leaf", "part", "some"]
    names = ["anchor_row", "tag", "row", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [pa.int64(), pa.int64(), pa.int64(), first.schema.field("vec_id").type, pa.int64()]
        rows = (r for b in itertools.chain([first], batches) for r in zip(*[c.to_pylist() for c in b.columns]))
        for _, group in itertools.groupby(rows, key=lambda r: r[:4]):
            block = None
            for kind, members in itertools.groupby(group, key=lambda r: r[4]):
                if kind == 0:
                    block = list(members)
                    matrix = stacked([m[8] for m in block])
                elif block:
                    while some := list(itertools.islice(members, 256)):
                        if found := answered(some, block, matrix):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def answered(some: list[tuple], block: list[tuple], matrix: np.ndarray) -> list[tuple]:
        own, labels = np.array([m[5] for m in block]), np.array([m[7] for m in block])
        order = np.array([LONG if m[6] is None else m[6] for m in block])
        out = []
        for a, line in zip(some, scores(stacked([a[8] for a in some]), matrix)):
            at = np.flatnonzero((labels == a[7]) & (own != a[5]) if same else labels != a[7])
            for w in a[9]:
                low, high = (-np.inf if w["low"] is None else w["low"]), (np.inf if w["high"] is None else w["high"])
                for i in at[best_of_window(line[at], order[at], low, high, most)]:
                    out.append((a[5], w["tag"], block[i][5], block[i][6], clipped(line[i])))
        return out

    columns = ["kind", "row", "vec_id", "label", "v", "windows"]
    dealt = entries.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, "kind")
    id_kind = entries.schema["vec_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"anchor_row long, tag long, row long, vec_id {id_kind}, score long")


def first_rows(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of every anchor and window, numbered from 1."""
    best = W.partitionBy("anchor_row", "tag").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def window(tag: Column, low: Column, high: Column) -> Column:
    return F.struct(tag.cast("bigint").alias("tag"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    points: int = POINTS,
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors(vec_id, embedding, label)``.

    Anchors are rows whose ``vec_id`` is divisible by ``every``. A score is the inner product of two rows' whole
    numbers ``floor(256 * x)``. An anchor's positives are the ``positives`` other rows of its label that score
    highest; for each, the ``negatives`` highest rows of other labels within 80 to 100 percent of its score are
    returned. Ties go to the smaller ``vec_id``; nulls come last and repeated rows are rows of their own. Rows with a
    null label, a null or empty vector or a null or non-finite component (also after scaling) take no part; rows
    of different numbers of components have no score. Scores beyond a long are shown as the nearest long.
    Every row is indexed and the result is exact. Other columns are not looked at.
    """
    rows = materialize(rows_of(vectors))
    trees = fitted(rows, sample_rows, leaf_rows, points)
    rows, ranges = placed(rows, trees)
    anchors = materialize(rows.filter(F.col("vec_id") % every == 0))

    def search(windows: DataFrame, most: int, same: bool) -> DataFrame:
        """Best rows within ``row, tag, low, high``: first in the anchor's own leaf, whose finds narrow the windows, then wherever they reach."""
        wanted = windows
        for everywhere in (False, True):
            listed = wanted.groupBy("row").agg(F.collect_list(window(F.col("tag"), F.col("low"), F.col("high"))).alias("windows"))
            asking = anchors.join(listed, "row")
            asking = materialize(routed(asking, trees, ranges) if everywhere else asking)
            found = materialize(first_rows(searched(blocks(rows, asking, block_rows, block_anchors), most, same), most))
            if not everywhere:
                last = found.filter(F.col("rank") == most).select(F.col("anchor_row").alias("row"), "tag", "score")
                low = F.greatest("low", "score")  # passes nulls over
                wanted = windows.join(last, ["row", "tag"], "left").select("row", "tag", low.alias("low"), "high")
        return found

    open_ended = F.lit(None).cast("bigint")
    whole = anchors.select("row", F.lit(0).cast("bigint").alias("tag"), open_ended.alias("low"), open_ended.alias("high"))
    near = search(whole, positives, True).select(
        "anchor_row", F.col("rank").cast("bigint").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # Of a score below zero 80 percent are more than all of it: no window.
    least = F.expr(f"positive_score - positive_score div {HIGH_PERCENT // (HIGH_PERCENT - LOW_PERCENT)}")
    rings = near.filter("positive_score >= 0").select(
        F.col("anchor_row").alias("row"), "tag", least.alias("low"), F.col("positive_score").alias("high")
    )
    hard = search(rings, negatives, False).select(
        "anchor_row", "tag", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    joined = near.join(hard, ["anchor_row", "tag"]).join(named, "anchor_row")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
