"""What the operators share: their view of a documents table, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

#: Memoised results of a Python worker are dropped beyond so many entries.
MEMO_ENTRIES = 200_000
#: Longer keys are not memoised: entries times this many characters bound a memo's size.
MEMO_CHARS = 64
#: Texts of a batch are worked on in portions of about so many characters.
PORTION_CHARS = 2_000_000

#: A row's number is its file's number times this, plus its place in the file.
ROWS_PER_FILE = 2**40

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Two columns of any documents table; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def numbered(docs: DataFrame, mark: str, stored: bool = False) -> DataFrame:
    """``docs`` with a column ``mark`` that numbers its rows, the same at each reading.

    ``stored`` says that ``docs`` are rows of Parquet files, each at most once: the
    file and the place in it number a row, and no row is copied. Any other table
    is written once with its numbers.
    """
    file = f"{mark}file"
    try:
        if stored:
            own = docs.metadataColumn("_metadata")
            docs = docs.withColumns({file: own["file_path"], mark: own["row_index"]})
    except AnalysisException:  # not of Parquet files
        stored = False
    if not stored:
        return materialize(docs.withColumn(mark, F.monotonically_increasing_id()))
    number = F.row_number().over(Window.orderBy(file)).cast("long") - 1
    files = materialize(docs.select(file).distinct().select(file, number.alias(f"{file}s")))
    docs = lookup_join(docs, files, file, spread=[mark])
    return docs.withColumn(mark, F.col(f"{file}s") * ROWS_PER_FILE + F.col(mark)).drop(file, f"{file}s")


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where a slice of bounded length starts, and its texts; null as empty. A longer text ends its slice."""
    start, some, chars = 0, [], 0
    for i, text in enumerate(texts):
        some.append(text.as_py() or "")
        chars += len(some[-1])
        if chars >= PORTION_CHARS:
            yield start, some
            start, some, chars = i + 1, [], 0
    if some:
        yield start, some


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a task, slice by slice."""
    for batch in batches:
        for start, texts in slices(batch.column(1)):
            yield batch.column(0)[start : start + len(texts)], texts
    give_back()


def give_back() -> None:
    """Return freed Arrow memory to the system: the worker lives on, idle, while others need room."""
    pa.default_memory_pool().release_unused()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Large-star and small-star steps in turn, each a grouped minimum (with
    map-side combine) joined back to the links; the join's hot hub is split by
    adaptive execution. Each step is written to shared storage. The number of
    rounds grows with the logarithm of the longest path.

    Rows with a null end and links of a node to itself make no component.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: a node hands its larger neighbours to its smallest one.
        large = materialize(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small star: a node hands its smaller neighbours, and itself, to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Settled once every node with a smaller neighbour has just one, and that has none.
        wide = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
        if wide.unionByName(inner).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every node now has one smaller neighbour, and that is a component's root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
