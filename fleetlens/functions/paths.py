"""Path text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def components(path: Column | str) -> Column:
    """Non-empty path components."""
    return F.filter(F.split(_col(path), "/"), lambda part: F.length(part) > 0)


def basename(path: Column | str) -> Column:
    """Last component; trailing slashes do not count."""
    return F.regexp_extract(_col(path), r"(?s)([^/]*)/*$", 1)


def parent(path: Column | str) -> Column:
    """Path without its last component; the parent of a top-level entry is ``/``."""
    up = F.regexp_replace(_col(path), r"(?s)/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def extname(path: Column | str) -> Column:
    """Last ``.suffix`` of the base name, case kept.

    Empty for dotfiles and for ``..``; ``.`` alone when the name ends in a dot.
    """
    name = basename(path)
    return F.when(name == "..", F.lit("")).otherwise(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))
