"""Dropping lines that many documents share.

Lines are exploded with their position, keyed by a digest of their normalised text,
and counted by distinct documents (partial sums first, so a line that all documents
share is no hot key). Keys over the threshold give the positions to drop, and each
text is put together again from the lines at the other positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import lower_ascii
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

BLANK = " \t\n\v\f\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``key, keep_id`` of keys of ``lines(doc_id, key)`` found in at least ``min_docs`` documents.

    Rows without an id count as one document, smaller than any other.
    """
    absent = F.max(F.col("doc_id").isNull().cast("int"))
    return (
        lines.groupBy("key")
        .agg(F.max("doc_id").alias("keep_id"), (F.count_distinct("doc_id") + absent).alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("key", "keep_id")
    )


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row of ``docs``: whole texts without the lines that others share.

    Lines end at ``\\n``; a null or empty text is one empty line. Lines whose key
    has fewer than ``min_chars`` code points stay. A key in at least ``min_docs``
    documents stays in the document with the largest id only, at all its places
    there; rows that repeat an id are one document. ``kept`` joins what stays by
    ``\\n``: empty if nothing does. An empty table gives an empty one; columns
    other than ``doc_id`` and ``text`` are not looked at.
    """
    numbered = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
        )
    )
    found = numbered.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = materialize(
        found.withColumn("line", line_key(F.col("line")))
        .filter(F.length("line") >= min_chars)
        .select("row", "doc_id", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
    )
    shared = materialize(shared_lines(lines, min_docs))
    dropped = lookup_join(lines, shared, "key", spread=["row", "pos"]).filter(
        ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )
    # A row's positions: never more than its text has lines.
    places = materialize(dropped.groupBy("row").agg(F.collect_list("pos").alias("drop")))
    marked = lookup_join(numbered, places, "row", "left").select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not drop:
                    n_lines.append(text.count("\n") + 1)
                    kept.append(text)
                else:
                    lines, gone = text.split("\n"), set(drop)
                    n_lines.append(len(lines))
                    kept.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
                n_dropped.append(len(drop or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept string")


def line_digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    return drop_shared_lines(docs, min_chars, min_docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
