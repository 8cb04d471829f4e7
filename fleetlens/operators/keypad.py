"""Digit-prefix index over words and frequency-ranked lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetlens.functions.keypad_text import to_digits
from fleetlens.operators.ordered import numbered
from fleetlens.operators.skew import MAX_BROADCAST_ROWS, lookup_join
from fleetlens.session import materialize

# Fixed value: words shown for a prefix.
TOP_WORDS = 10

#: Queried prefixes that a stored index is filtered by while it is read.
PUSHED_PREFIXES = 500

#: Words of a prefix that one task ranks, and pieces that a larger prefix is cut into.
RANK_ROWS, RANK_CELLS = 1_000_000, 64


def word_frequencies(
    words: DataFrame, frequencies: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Words that have a known frequency: ``word, n``."""
    return lookup_join(
        words.select("word").distinct(), frequencies, "word", max_broadcast_rows=max_broadcast_rows
    )


def with_frequency(
    words: DataFrame, frequencies: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Every word row with its frequency ``n``, 0 where unknown."""
    joined = lookup_join(words, frequencies, "word", "left", max_broadcast_rows=max_broadcast_rows)
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def prefix_index(words: DataFrame, word: str = "word") -> DataFrame:
    """One row per digit prefix of every row, other columns kept: ``prefix, ...``.

    Rows are independent, so this is a map without a shuffle.
    """
    n = F.length("_digits")
    lengths = F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))
    return (
        words.withColumn("_digits", to_digits(word))
        .withColumn("_k", lengths)
        .select(F.substring("_digits", F.lit(1), F.col("_k")).alias("prefix"), *words.columns)
    )


def prefix_lookup(
    queries: DataFrame, index: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Index rows of each queried ``prefix``; one-digit prefixes are hot and get salted.

    Of an index stored by prefix length (``digits``) only the folders of queried
    lengths are read, and of these, for up to ``PUSHED_PREFIXES`` prefixes, the row groups that can hold one.
    """
    wanted = materialize(queries.select("prefix").distinct())
    keys = ["prefix"]
    if "digits" in index.columns:
        wanted = wanted.withColumn("digits", F.length("prefix"))
        keys = ["digits", "prefix"]
        some = [r["prefix"] for r in wanted.orderBy("prefix").limit(PUSHED_PREFIXES + 1).collect()]
        if some and len(some) <= PUSHED_PREFIXES:
            # Lists longer than ten reach Parquet as the range that they span.
            tens = [F.col("prefix").isin(some[i : i + 10]) for i in range(0, len(some), 10)]
            index = index.filter(reduce(or_, tens) & F.col("digits").isin(sorted({len(p) for p in some})))
    return lookup_join(index, wanted, keys, max_broadcast_rows=max_broadcast_rows)


def _place(tie: str, text: bool) -> Column:
    """A whole number that never falls from a word to the next of the ranking: its frequency, then its leading bytes."""
    n = F.least(F.greatest(F.floor(F.col("n")).cast("bigint"), F.lit(-(2**38))), F.lit(2**38))
    if not text:
        return -n
    lead = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(tie), "UTF-8"), 1, 3)), 6, "0"), 16, 10).cast("bigint")
    return -n * 2**24 + F.coalesce(lead, F.lit(0))


def rank_words(
    matches: DataFrame,
    keys: Sequence[str] = ("prefix",),
    tie: str = "word",
    chunk: Column | None = None,
    chunk_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add ``rn``: position by falling frequency, then ``tie``, among a prefix's words.

    A prefix of up to ``chunk_rows`` words is ordered in one task. Larger ones are cut at approximate quantiles
    of their own order (frequency, then leading letters) into at most ``RANK_CELLS`` pieces, so
    what is known about the pieces does not grow with the vocabulary. For a numeric tie (an insertion
    position) pieces of one frequency can be cut further by ``chunk``, a column that rises with it.
    ``matches`` is read up to three times: hand in a table.
    """
    keys = list(keys)
    counts = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk_rows)
    large = materialize(counts)
    if large.isEmpty():
        order = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc(tie))
        return matches.withColumn("rn", F.row_number().over(order).cast("bigint"))
    text = dict(matches.dtypes)[tie] == "string"
    ordered = matches.withColumn("_down", -F.col("n")).withColumn("_place", _place(tie, text))
    at = F.array(*[F.lit(i / RANK_CELLS) for i in range(1, RANK_CELLS)])
    cut = lookup_join(ordered.select(*keys, "_place"), large.drop("n"), keys, spread=["_place"], counts=large, null_safe=True)
    cuts = materialize(cut.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_place", at)).alias("_cuts")))
    placed = lookup_join(ordered, cuts, keys, "left", spread=["_place"], counts=large, null_safe=True)
    cell = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_place"))), F.lit(0))
    placed = placed.withColumn("_cell", cell).drop("_cuts", "_place")
    cell = F.struct("_cell", "_down", chunk.alias("piece")) if chunk is not None else F.col("_cell")
    return numbered(placed, keys, ["_down", tie], cell).drop("_down", "_cell")


def top_words(
    matches: DataFrame, k: int = TOP_WORDS, keys: Sequence[str] = ("prefix",), tie: str = "word"
) -> DataFrame:
    """The first ``k`` of ``rank_words``; each task keeps only its own best ``k`` before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc(tie))
    return matches.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
