"""Line-oriented listings and word files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Line formats.
SIZE_LINE = r"(?s)^([0-9]+) (.*?)\r?$"
HASH_LINE = r"(?s)^([A-Fa-f0-9]+) ([0-9]+) (.*?)\r?$"
LATIN_LETTER = "[a-zA-Z]"


#: Row groups of a stored prefix index.
PREFIX_GROUP_BYTES = 4 * 1024**2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as the file has them: only LF ends a line, a CR is kept."""
    return spark.read.option("lineSep", "\n").text(path)


def _require(df: DataFrame, good: Column, message: str, mode: str) -> DataFrame:
    """Raise on rows that are not ``good``, or mark them in ``error``."""
    if mode == "quarantine":
        return df.withColumn("error", F.when(~good, F.col("value")))
    if mode != "failfast":
        raise ValueError(f"mode is failfast or quarantine, not {mode!r}")
    fail = F.raise_error(F.concat(F.lit(f"{message}: "), F.col("value"))).cast("boolean")
    return df.filter(F.when(good, True).otherwise(fail))


def _listing(spark: SparkSession, path: str, pattern: str, columns: list[Column], mode: str) -> DataFrame:
    checked = _require(_lines(spark, path), F.col("value").rlike(pattern), "not a listing line", mode)
    kept = [F.col("error")] if mode == "quarantine" else []
    return checked.select(*columns, *kept)


def read_size_listing(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """``size, path`` from ``<size> <path>`` lines; a CR at the end of a line is removed."""
    columns = [
        F.regexp_extract("value", SIZE_LINE, 1).try_cast("bigint").alias("size"),
        F.regexp_extract("value", SIZE_LINE, 2).alias("path"),
    ]
    return _listing(spark, path, SIZE_LINE, columns, mode)


def write_size_listing(files: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.coalesce("size", F.lit(0)).cast("string"), F.col("path"))
    files.select(line.alias("value")).write.option("lineSep", "\n").text(path)


def read_hash_listing(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """``hash, size, path`` from ``<hash> <size> <path>`` lines."""
    columns = [
        F.regexp_extract("value", HASH_LINE, 1).alias("hash"),
        F.regexp_extract("value", HASH_LINE, 2).try_cast("bigint").alias("size"),
        F.regexp_extract("value", HASH_LINE, 3).alias("path"),
    ]
    return _listing(spark, path, HASH_LINE, columns, mode)


def write_hash_listing(listing: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("hash"), F.col("size").cast("string"), F.col("path").cast("string"))
    listing.select(line.alias("value")).write.option("lineSep", "\n").text(path)


def read_lines(spark: SparkSession, path: str, col: str = "word") -> DataFrame:
    """Trimmed lines that are not empty."""
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    return _lines(spark, path).select(trimmed.alias(col)).filter(F.length(col) > 0)


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """``word, n`` from ``<word> <count>`` lines.

    A line of other than two parts, or with a count that is no number, is an
    error; words without a latin letter are skipped; of equal words the last
    line wins.
    """
    lines = _lines(spark, path).select(
        F.regexp_replace("value", "\r$", "").alias("value"),
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("id"),
        ).alias("pos"),
    )
    parts = F.split("value", " ")
    pairs = _require(lines, F.size(parts) == 2, "not a word and a count", "failfast").select(
        "value", "pos", parts[0].alias("word"), parts[1].try_cast("double").alias("n")
    )
    latin = pairs.filter(F.col("word").rlike(LATIN_LETTER))
    numbers = _require(latin, F.col("n").isNotNull() & ~F.isnan("n"), "count is not a number", "failfast")
    return numbers.groupBy("word").agg(F.max_by("n", "pos").alias("n"))


def write_prefix_index(index: DataFrame, path: str, group_bytes: int = PREFIX_GROUP_BYTES) -> None:
    """Store a prefix index for lookups that read little of it.

    One folder per prefix length. The files of a folder hold ranges of prefixes, in order and in small row groups, so that
    the statistics of the row groups show which of them a queried prefix can be in.
    """
    sized = index.withColumn("digits", F.length("prefix"))
    order = ["digits", "prefix", *[c for c in index.columns if c == "word"]]  # a hot prefix is split by its words
    dealt = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("digits").parquet(path)


def read_prefix_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
