"""Operators on file inventories: ``path, is_dir, is_symlink, size``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.paths import parent


def matches(path: Column, terms: Sequence[str], whole_component: bool = False) -> Column:
    """Whether the path contains a term; by default a term may start or end inside a name."""
    if whole_component:
        path, terms = F.concat(F.lit("/"), path, F.lit("/")), [f"/{t.strip('/')}/" for t in terms]
    return reduce(lambda hit, term: hit | F.contains(path, F.lit(term)), terms, F.lit(False))


def visible(
    df: DataFrame,
    exclude: Sequence[str] = (),
    find_dirs: Sequence[str] = (),
    roots: Sequence[str] = (),
    whole_component: bool = False,
) -> DataFrame:
    """What a scan with these terms lists.

    An excluded or found directory is listed but nothing below it. A term that
    an ancestor's path contains is contained in every path below, so looking at
    the parent replaces walking the tree. With ``find_dirs`` only found
    directories are listed, while files elsewhere still are.
    """
    path, is_dir = F.col("path"), F.col("is_dir")

    def hit(p: Column, terms: Sequence[str]) -> Column:
        return matches(p, terms, whole_component)

    reached = ~(hit(parent(path), exclude) | hit(parent(path), find_dirs))
    if roots:
        reached = path.isin(*roots) | reached
    listed_dir = is_dir & (hit(path, find_dirs) if find_dirs else F.lit(True))
    listed_file = ~is_dir & ~hit(path, exclude)
    return df.filter(reached & (listed_dir | listed_file))


def exclude_paths(
    df: DataFrame, terms: Sequence[str], roots: Sequence[str] = (), whole_component: bool = False
) -> DataFrame:
    """Drop files that match and everything below directories that match."""
    return visible(df, exclude=terms, roots=roots, whole_component=whole_component)


def outermost_matches(
    df: DataFrame, terms: Sequence[str], roots: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Directories that match, without those below another match."""
    return visible(df, exclude=exclude, find_dirs=terms, roots=roots).filter("is_dir")


def split_entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(dirs, files)``: symlinks in neither; a file whose size is unknown counts as 0 bytes."""
    dirs = df.filter("is_dir").select("path")
    files = df.filter(~F.col("is_dir") & ~F.col("is_symlink"))
    return dirs, files.select(F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "path")


def scan_counts(df: DataFrame) -> DataFrame:
    """One row ``files, dirs``."""
    return df.agg(
        F.count_if(~F.col("is_dir") & ~F.col("is_symlink")).alias("files"),
        F.count_if("is_dir").alias("dirs"),
    )


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` by the ``error`` column the quarantining readers add."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())
