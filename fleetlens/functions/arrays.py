"""Array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def chunk(items: Column | str, size: int) -> Column:
    """Split an array into arrays of ``size`` elements; the last may be shorter."""
    items = F.col(items) if isinstance(items, str) else items
    pieces = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(items) / F.lit(size)).cast("int") - 1),
        lambda i: F.slice(items, i * size + 1, size),
    )
    return F.when(F.size(items) > 0, pieces).otherwise(F.slice(F.array(items), 1, 0))
