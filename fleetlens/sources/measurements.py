"""Stored latency measurements and bucket stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: where measurements of no known network go.
NO_NETWORK = "default"

#: Files that an append may add to a day at most.
FILES_PER_DAY = 32

_RESPONSE = (
    "result array<struct<time_bucket: string, count: string, avg: double, max: double, median: double>>"
)


def append_measurements(df: DataFrame, path: str) -> None:
    """Append to the measurement table, partitioned by day for ``since`` to prune.

    A day's rows go to a few tasks, so that not every task writes a file per day.
    """
    dated = df.withColumn("day", F.to_date("ts"))
    piece = F.pmod(F.xxhash64("ts"), F.lit(FILES_PER_DAY))
    dated.repartition("day", piece).write.mode("append").partitionBy("day").parquet(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_bucket_stats(spark: SparkSession, path: str) -> DataFrame:
    """Bucket stats from ``{"result": [...]}`` documents, one per file.

    Times are ISO text or epoch milliseconds, counts numbers or text; a document
    whose ``result`` is no array has no rows.
    """
    rows = spark.read.schema(_RESPONSE).option("multiLine", "true").json(path).select(F.inline("result"))
    is_ms = F.col("time_bucket").rlike("^-?[0-9]+$")
    from_ms = F.timestamp_millis(F.col("time_bucket").try_cast("bigint"))
    when = F.when(is_ms, from_ms).otherwise(F.col("time_bucket").cast("timestamp"))
    return rows.select(
        when.alias("time_bucket"),
        F.col("count").cast("double").cast("bigint").alias("count"),
        "avg",
        "max",
        "median",
    )


def write_by_network(df: DataFrame, path: str) -> None:
    """One folder per network; rows without one go to ``network=default``.

    Only the folders of networks that ``df`` has are replaced.
    """
    named = df.withColumn("network", F.coalesce("network", F.lit(NO_NETWORK)))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("network").parquet(path)
