"""Exact duplicates by content hash.

A *listing* has ``path`` (any unique id), ``size`` and, once hashed, ``hash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.skew import MAX_BROADCAST_ROWS, group_members, lookup_join
from fleetlens.session import materialize

# Fixed value: length of the short form of a hash. For display only: groups need the whole hash.
SHORT_HASH = 10


def content_hash(content: Column | str, trunc: int | None = None) -> Column:
    """SHA-1 hex of the bytes (UTF-8 for text); ``trunc`` keeps the first characters."""
    content = F.col(content) if isinstance(content, str) else content
    digest = F.sha1(content.cast("binary"))
    return F.substring(digest, 1, trunc) if trunc else digest


def content_listing(df: DataFrame, path: str, content: str) -> DataFrame:
    """Listing of a table that carries its content.

    Size and hash come from one read of the content; from here on rows are
    narrow. Reading the content twice, to hash only rows whose size repeats,
    costs more than hashing everything in the one scan.
    """
    return df.select(
        content_hash(content).alias("hash"),
        F.octet_length(content).cast("bigint").alias("size"),
        F.col(path).alias("path"),
    )


def size_histogram(listing: DataFrame, size: str = "size") -> DataFrame:
    """``size, n``."""
    return listing.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def size_candidates(listing: DataFrame, size: str = "size") -> DataFrame:
    """Sizes above zero that at least two rows share: ``size, n``."""
    return size_histogram(listing.filter(F.col(size) > 0), size).filter(F.col("n") > 1)


def candidate_count(candidates: DataFrame) -> DataFrame:
    """One row ``n``: rows whose size is a candidate."""
    return candidates.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def join_candidates(
    listing: DataFrame, candidates: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Listing rows whose size is a candidate."""
    return lookup_join(
        listing,
        candidates.select("size"),
        "size",
        "left_semi",
        spread=["path"],
        counts=candidates,
        max_broadcast_rows=max_broadcast_rows,
    )


def hash_counts(listing: DataFrame) -> DataFrame:
    """``hash, n, size`` over non-empty content."""
    return (
        listing.filter(F.col("size") > 0)
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    )


def duplicate_hashes(listing: DataFrame) -> DataFrame:
    """Hashes that at least two rows share: ``hash, n, size``."""
    return hash_counts(listing).filter(F.col("n") > 1)


def duplicate_rows(listing: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Listing rows whose content occurs more than once: ``hash, size, path``.

    ``listing`` is read twice (once the hash column only), so hand in a table or
    a ``materialize``d listing.
    """
    repeated = materialize(duplicate_hashes(listing).select("hash", "n"))
    return lookup_join(
        listing.filter(F.col("size") > 0),
        repeated.select("hash"),
        "hash",
        "left_semi",
        spread=["path"],
        counts=repeated,
        max_broadcast_rows=max_broadcast_rows,
    ).select("hash", "size", "path")


def duplicate_summary(repeated: DataFrame) -> DataFrame:
    """One row ``groups, rows`` over ``duplicate_hashes``."""
    return repeated.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows")
    )


def duplicate_groups(listing: DataFrame) -> DataFrame:
    """``hash, n, path``: the paths that share a hash with others."""
    return group_members(listing.filter(F.col("size") > 0), ["hash"], "path", min_n=2)


def size_groups(listing: DataFrame) -> DataFrame:
    """``size, n, path``: the paths that share a size with others."""
    return group_members(listing.filter(F.col("size") > 0), ["size"], "path", min_n=2)


def shortened(rows: DataFrame) -> DataFrame:
    """Rows with the short form of their hash."""
    return rows.withColumn("hash", F.substring("hash", 1, SHORT_HASH))


def hash_sizes(repeated: DataFrame) -> DataFrame:
    """``hash, size`` of every duplicate hash."""
    return repeated.select("hash", "size")


def largest_duplicate(repeated: DataFrame) -> DataFrame:
    """The duplicate content of the greatest size."""
    return repeated.select("size", "hash").orderBy(F.desc("size"), "hash").limit(1)


def sort_duplicates(rows: DataFrame) -> DataFrame:
    """Largest first. The path is part of the range key, so one hash can span tasks."""
    return rows.orderBy(F.desc("size"), "hash", "path")
