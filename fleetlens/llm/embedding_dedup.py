"""Near-duplicate embeddings: sign hashes of random hyperplanes in several tables.

Equal vectors are one class. A class has a row per table, keyed by its label and the
signs of that table's hyperplanes. Rows of a bucket are compared by exact cosine in
blocks; a bucket of more rows than a block is spread over one task per pair of its
blocks. What leaves a task are counts per class and the links of a spanning forest,
never all pairs. A pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm import common
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

#: Two vectors of cosine 0.93 share a table's 12 signs with a chance of 0.216, and one
#: of 24 tables with a chance of 0.997; closer vectors more often.
TABLES, SIGNS, SEED = 24, 12, 20_240_229
#: Rows of a bucket that a task holds of each of the two blocks that it compares.
BLOCK_ROWS = 1024


def hyperplanes(dims: int, tables: int = TABLES, signs: int = SIGNS) -> np.ndarray:
    """The same normals for every batch, task and run."""
    return np.random.default_rng([SEED, dims]).standard_normal((dims, tables * signs))


def signatures(vectors: np.ndarray, tables: int = TABLES, signs: int = SIGNS) -> np.ndarray:
    """A number per vector and table, made of the signs of its sides of the table's hyperplanes."""
    sides = vectors @ hyperplanes(vectors.shape[1], tables, signs) >= 0
    return sides.reshape(len(vectors), tables, signs) @ (1 << np.arange(signs))


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for those that can't have a cosine."""
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = None if not x or None in x else np.array(x, dtype=np.float64)
        out.append(v if v is not None and np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0 else None)
    return out


def digested(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, digest, unit`` of every row; no digest where a row links with nothing.

    ``unit`` is the vector in double precision, divided by its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, units = [], []
            labels = batch.column(2).to_pylist()
            for label, v in zip(labels, vectors_of(batch.column(3))):
                if label is None or v is None:
                    digests.append(None)
                    units.append(None)
                else:
                    head = f"{label}:{len(v)}:".encode()
                    digests.append(hashlib.blake2b(head + (v + 0.0).tobytes(), digest_size=16).digest())
                    units.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.binary()), pa.array(units, pa.binary())],
                ["row", "vec_id", "label", "digest", "unit"],
            )

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(
        run, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, digest binary, unit binary"
    )


def signed(classes: DataFrame, tables: int, signs: int) -> DataFrame:
    """``class, n, label, dims, signs`` of every row of ``classes``: a number per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(u) for u in batch.column(3).to_pylist()]
            made: list[np.ndarray | None] = [None] * len(units)
            for dims in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dims]
                for i, s in zip(at, signatures(np.stack([units[i] for i in at]), tables, signs)):
                    made[i] = s
            sizes = pa.array([len(u) for u in units], pa.int32())
            listed = pa.array([s.tolist() for s in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], sizes, listed], ["class", "n", "label", "dims", "signs"]
            )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("class", "n", "label", "unit").mapInArrow(
        run, f"class long, n long, label {kind}, dims int, signs array<int>"
    )


def compare(batch_rows: list[tuple], cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of one pair of blocks: classes, how many vectors each is linked to, and spanning links.

    Rows are ``class, n, unit, signs, table, i, j, block``; a task of one block
    compares its rows with each other, another those of block i with those of j.
    """
    table, i, j = batch_rows[0][4:7]
    own = np.array([r[0] for r in batch_rows])
    n = np.array([r[1] for r in batch_rows])
    units = np.stack([np.frombuffer(r[2]) for r in batch_rows])
    signs = np.array([r[3] for r in batch_rows])
    left = np.arange(len(own)) if i == j else np.flatnonzero([r[7] == i for r in batch_rows])
    right = left if i == j else np.flatnonzero([r[7] == j for r in batch_rows])
    linked, root, joins = np.zeros(len(own), dtype=np.int64), list(range(len(own))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for low in range(0, len(left), 256):
        some = left[low : low + 256]
        near = units[some] @ units[right].T >= cosine
        if i == j:
            near &= some[:, None] < right[None, :]
        a, b = np.nonzero(near)
        a, b = some[a], right[b]
        if table:
            new = np.empty(len(a), dtype=bool)
            for at in range(0, len(a), 65_536):  # pairs may be many, their signs are not held at once
                x, y = a[at : at + 65_536], b[at : at + 65_536]
                new[at : at + 65_536] = (signs[x, :table] != signs[y, :table]).all(axis=1)
            a, b = a[new], b[new]
        np.add.at(linked, a, n[b])
        np.add.at(linked, b, n[a])
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[y] = x
                joins.append((int(own[x]), int(own[y])))
    some = linked > 0
    return own[some], linked[some], joins


def compared(entries: DataFrame, cosine: float) -> DataFrame:
    """``class, linked, other``: partial counts (no other), and spanning links (no count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for _, group in itertools.groupby(rows, key=lambda r: r[:6]):
            members = [(*r[6:10], r[3], r[4], r[5], r[10]) for r in group]
            if len(members) < 2:
                continue
            own, linked, joins = compare(members, cosine)
            a, b = ([x[i] for x in joins] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*own.tolist(), *a], pa.int64()),
                    pa.array([*linked.tolist(), *[None] * len(a)], pa.int64()),
                    pa.array([*[None] * len(own), *b], pa.int64()),
                ],
                ["class", "linked", "other"],
            )

    keys = ["label", "dims", "bits", "table", "i", "j"]
    rows = entries.select(*keys, "class", "n", "unit", "signs", "block")
    return (
        rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "class long, linked long, other long")
    )


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, tables: int = TABLES, signs: int = SIGNS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Rows of one label (not null) and number of dimensions are linked at a cosine
    of at least ``cosine`` in double precision. Null, empty or zero vectors, and
    those with null or non-finite components, link with nothing. Linked pairs
    are found with a chance that depends on their angle alone (see TABLES);
    equal vectors always. ``n_links`` counts the other rows linked directly,
    repeated rows included. ``component_id`` is the smallest ``vec_id`` that
    links reach, nulls passed over. Other columns are not looked at.
    """
    rows = materialize(digested(vectors))
    known = rows.filter("digest is not null")
    # One row of each class stands for it; a class is named by that row.
    classes = materialize(
        known.groupBy("digest").agg(
            F.min("row").alias("class"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")
        )
    )
    firsts = materialize(
        known.join(classes.select("class", "n"), F.col("row") == F.col("class")).select("class", "n", "label", "unit")
    )
    keys = ["label", "dims", "table", "bits"]
    keyed = materialize(signed(firsts, tables, signs)).select("class", "n", "label", "dims", "signs", F.posexplode("signs").alias("table", "bits"))
    sizes = materialize(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    placed = lookup_join(keyed, sizes, keys, spread=["class"], counts=sizes.withColumnRenamed("size", "n"))
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    placed = placed.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    entries = placed.drop("with", "size").join(firsts.select("class", "unit"), "class")
    found = materialize(compared(entries, cosine))
    linked = found.filter("linked is not null").groupBy("class").agg(F.sum("linked").alias("linked"))
    joined = common.components(
        found.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
    ).withColumnsRenamed({"node": "class", "component": "root"})
    named = classes.join(linked, "class", "left").join(joined, "class", "left")
    named = materialize(
        named.select(
            "digest",
            "least",
            F.coalesce("root", "class").alias("root"),
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            "n",
        )
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = materialize(named.join(least, "root").select("digest", "n_links", "component_id"))
    single = rows.filter("digest is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    grouped = lookup_join(known, lookup, "digest", spread=["row"], counts=named.select("digest", "n")).select(
        "vec_id", "n_links", "component_id"
    )
    return grouped.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
