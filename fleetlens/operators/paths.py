"""Path hierarchies and extension rollups over ``path, size`` listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.paths import basename, components, extname, parent

# Fixed value: files of the shallow report before it stops.
SHALLOW_FILES = 150


def extension_stats(files: DataFrame) -> DataFrame:
    """``ext, n, bytes``."""
    return files.groupBy(extname("path").alias("ext")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("bytes")
    )


def path_nodes(files: DataFrame, key: str | None = None) -> DataFrame:
    """One row per path prefix: ``path, parent, name, depth, is_dir, size``.

    A leaf carries its size, a directory 0. A path that is both counts as a
    directory; of equal paths the row with the smallest ``key`` (default: the
    smallest size) gives the size. The top directories repeat once per file
    below them, which map-side aggregation collapses before the shuffle.
    """
    parts = files.select(components("path").alias("parts"), "size", F.col(key or "size").alias("key"))
    levels = parts.select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")).filter(
        F.size("parts") > 0
    )
    leaf = F.col("depth") == F.size("parts")
    nodes = levels.select(
        full_path(F.slice("parts", F.lit(1), F.col("depth"))).alias("path"),
        "depth",
        (~leaf).alias("is_dir"),
        F.when(leaf, F.col("size")).alias("size"),
        F.when(leaf, F.col("key")).alias("key"),
    )
    merged = nodes.groupBy("path", "depth").agg(F.max("is_dir").alias("is_dir"), F.min_by("size", "key").alias("size"))
    return merged.select(
        "path",
        parent("path").alias("parent"),
        basename("path").alias("name"),
        F.col("depth").cast("int").alias("depth"),
        "is_dir",
        F.when(F.col("is_dir"), F.lit(0)).otherwise(F.coalesce("size", F.lit(0))).cast("bigint").alias("size"),
    )


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """``path, size`` of nodes without children.

    ``path_nodes`` marks exactly the nodes that some other path runs through, so
    no anti-join against the parents is needed.
    """
    return nodes.filter(~F.col("is_dir")).select("path", "size")


def childless(nodes: DataFrame) -> DataFrame:
    """``path, size`` of nodes without children, for node tables that also list empty directories."""
    parents = nodes.select(F.col("parent").alias("path")).distinct()
    return nodes.join(parents, "path", "left_anti").select("path", "size")


def full_path(parts: Column | str) -> Column:
    """Path text of an array of names."""
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def shallowest_files(nodes: DataFrame, cap: int = SHALLOW_FILES) -> DataFrame:
    """Files level by level from the root until there are more than ``cap``: ``cap + 1`` rows."""
    return nodes.filter(~F.col("is_dir")).select("depth", "path", "size").orderBy("depth", "path").limit(cap + 1)
