"""Exact duplicates, with the frequent texts split from the others.

A Misra-Gries sketch (``approx_top_k``) names the frequent digests. Their groups
are then counted exactly, and these winners, fewer than a fixed number, are
broadcast: rows of a frequent text are decided where they are. All others are
shuffled by digest; the sketch has taken the large groups from among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.llm.common import lower_ascii, numbered
from fleetlens.session import materialize, scratch_removed

#: Frequent digests that are broadcast at most, and counters that the sketch keeps.
#: A digest of more than 1/1000 of the rows is always among them.
FREQUENT, TRACKED = 1000, 16384


def digests(docs: DataFrame) -> DataFrame:
    """``row, doc_id, digest`` of every row: SHA-256 of the text with A-Z in lower case, null as empty.

    ``row`` tells rows apart that share their id. The table is stored, so the
    texts are read once and ``row`` stays.
    """
    text = lower_ascii(F.coalesce("text", F.lit("")))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        )
    )


def frequent_winners(rows: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """``digest, keep_id, keep_row, group_size`` of frequent digests; at most ``frequent`` of them.

    The sketch works on 64-bit hashes of digests; sizes and winners come from the
    rows themselves, grouped by the whole digest.
    """
    sketch = rows.select(F.xxhash64("digest").alias("hash")).agg(
        F.expr(f"approx_top_k(hash, {frequent}, {tracked})").alias("top")
    )
    named = sketch.select(F.explode("top").alias("top")).filter("top.count > 1").select(F.col("top.item").alias("hash"))
    own = materialize(
        rows.withColumn("hash", F.xxhash64("digest"))
        .join(F.broadcast(named), "hash")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    first = (
        rows.join(F.broadcast(own), "digest")
        .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.min("row").alias("keep_row"))
    )
    return materialize(own.join(first, "digest"))


def decide(rows: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """``row, doc_id, keep_id, group_size, kept, digest`` of every row of ``digests``.

    Of equal texts the row with the largest ``doc_id`` is kept; if several rows
    have that id, the first of them; a null id is smaller than any other.
    """
    winners = frequent_winners(rows, frequent, tracked)
    marked = rows.join(F.broadcast(winners), "digest", "left")
    common = marked.filter("keep_row is not null").withColumn("kept", F.col("row") == F.col("keep_row"))
    group = Window.partitionBy("digest")
    ranked = group.orderBy(F.col("doc_id").desc_nulls_last(), "row")
    others = (
        marked.filter("keep_row is null")
        .select("row", "doc_id", "digest")
        .withColumn("place", F.row_number().over(ranked))
        .withColumn("keep_id", F.first("doc_id").over(ranked))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("kept", F.col("place") == 1)
    )
    columns = ["row", "doc_id", "keep_id", "group_size", "kept", "digest"]
    return common.select(columns).unionByName(others.select(columns))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text equals an
    empty one. Rows that repeat both id and text are a group like any other: one
    of them is kept. An empty table gives an empty one; columns other than
    ``doc_id`` and ``text`` are not looked at, whatever their names.
    """
    return decide(digests(docs)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, stored: bool = False) -> DataFrame:
    """``docs`` with one row of each text, the one that ``exact_duplicates`` keeps, and the same columns.

    ``stored`` as in ``common.numbered``: the documents are then read again, not copied.
    """
    mark = "_kept_row"
    while mark in docs.columns:
        mark += "_"
    marked = numbered(docs, mark, stored)
    with scratch_removed(docs.sparkSession) as keep:
        rows = materialize(
            marked.select(
                F.col(mark).alias("row"),
                "doc_id",
                F.unhex(F.sha2(lower_ascii(F.coalesce("text", F.lit(""))).cast("binary"), 256)).alias("digest"),
            )
        )
        gone = keep(decide(rows).filter("not kept").select(F.col("row").alias(mark)))
    return marked.join(gone, mark, "left_anti").drop(mark)
