"""Every operator as a query over the given tables."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions import arrays, formatting, keypad_text
from fleetlens.functions.secrets import encrypt_column
from fleetlens.operators import (
    accounts,
    codebook,
    dedup,
    gaps,
    inventory,
    keypad,
    latency,
    metrics,
    paths,
    runs,
)
from fleetlens.plans import reports, tables
from fleetlens.session import ROCKSDB_PROVIDER, materialize, scratch_dir
from fleetlens.sources import files, listings, measurements
from fleetlens.streaming import latency as latency_streams
from fleetlens.streaming import metrics as metric_streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Test key of the encryption queries, and the clock of the token queries.
SECRET = b"fleetlens-16byte"
TOKEN_NOW = 900_000_000
EXCLUDED = ["blog.", "/es"]
FOUND = ["www.", "/de"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def _joined(items: str) -> Column:
    return F.array_join(F.col(items).cast("array<string>"), ",")


# --- duplicates -----------------------------------------------------------


@query
def dup_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.duplicates(tables.document_listing(spark, sf))
    return rows.withColumnRenamed("path", "doc_id")


@query
def dup_documents_short_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup.duplicate_rows(materialize(tables.document_listing(spark, sf)))
    return dedup.shortened(rows).withColumnRenamed("path", "doc_id")


@query
def hash_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.hash_counts(tables.document_listing(spark, sf))


@query
def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = dedup.duplicate_groups(materialize(tables.document_listing(spark, sf)))
    return groups.withColumnRenamed("path", "doc_id")


@query
def dup_group_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The members of a group add up to it."""
    groups = dedup.duplicate_groups(materialize(tables.document_listing(spark, sf)))
    return groups.groupBy("hash", "n").agg(F.count(F.lit(1)).alias("listed"), F.sum("path").alias("id_sum"))


@query
def dup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_summary(dedup.duplicate_hashes(tables.document_listing(spark, sf)))


@query
def hash_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.hash_sizes(dedup.duplicate_hashes(tables.document_listing(spark, sf)))


@query
def largest_dup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.largest_duplicate(dedup.duplicate_hashes(tables.document_listing(spark, sf)))


@query
def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.size_histogram(tables.document_sizes(spark, sf))


@query
def quantity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.size_histogram(tables.table(spark, sf, "lineitem"), "l_quantity")


@query
def size_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.size_candidates(tables.document_sizes(spark, sf))


@query
def candidate_count(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.candidate_count(dedup.size_candidates(tables.document_sizes(spark, sf)))


@query
def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    sizes = materialize(tables.document_sizes(spark, sf))
    rows = dedup.join_candidates(sizes, materialize(dedup.size_candidates(sizes)))
    return rows.select("size", F.col("path").alias("doc_id"))


@query
def size_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = dedup.size_groups(materialize(tables.document_sizes(spark, sf)))
    return groups.withColumnRenamed("path", "doc_id")


# --- paths and inventory --------------------------------------------------


@query
def extension_stats(spark: SparkSession, sf: str) -> DataFrame:
    return paths.extension_stats(tables.page_files(spark, sf))


@query
def path_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_nodes(tables.page_files(spark, sf), "page_id")


@query
def leaf_paths(spark: SparkSession, sf: str) -> DataFrame:
    return paths.leaf_paths(paths.path_nodes(tables.page_files(spark, sf), "page_id"))


@query
def childless_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return paths.childless(materialize(paths.path_nodes(tables.page_files(spark, sf), "page_id")))


@query
def shallowest_files(spark: SparkSession, sf: str) -> DataFrame:
    return paths.shallowest_files(paths.path_nodes(tables.page_files(spark, sf), "page_id"))


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    nodes = paths.path_nodes(tables.page_files(spark, sf), "page_id")
    return nodes.select("path", "is_dir", F.lit(False).alias("is_symlink"), "size")


@query
def exclude_paths(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.exclude_paths(_inventory(spark, sf), EXCLUDED).select("path", "is_dir", "size")


@query
def outermost_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.outermost_matches(_inventory(spark, sf), FOUND, exclude=EXCLUDED).select("path")


@query
def find_and_exclude(spark: SparkSession, sf: str) -> DataFrame:
    listed = inventory.visible(_inventory(spark, sf), exclude=EXCLUDED, find_dirs=FOUND)
    return listed.select("path", "is_dir")


@query
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.split_entries(_inventory(spark, sf))[1]


@query
def split_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.split_entries(_inventory(spark, sf))[0]


@query
def scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.scan_counts(_inventory(spark, sf))


@query
def size_listing_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    listings.write_size_listing(tables.page_files(spark, sf), path)
    return listings.read_size_listing(spark, path)


@query
def hash_listing_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    listings.write_hash_listing(tables.document_listing(spark, sf), path)
    return listings.read_hash_listing(spark, path)


#: Documents of a folder of ``_document_files``.
FOLDER_FILES = 10_000
#: Characters that a folder's name has by their code, as Spark's own writers put them.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _document_files(spark: SparkSession, sf: str) -> str:
    """Every document as a file that the tasks can open, in folders of bounded size by language.

    Each task writes files of its own folders. A writer of Spark's with one record per file would have the driver rename
    them one after the other when it commits.
    """
    root = scratch_dir(spark).removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made, n = f"{root}/{TaskContext.get().partitionId():05d}", set(), 0
        for batch in batches:
            for text, lang in zip(*batch.columns):
                name = _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", lang.as_py() or "__HIVE_DEFAULT_PARTITION__")
                folder = f"{own}-{n // FOLDER_FILES:05d}/lang={name}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(f"{folder}/part-{n:09d}.txt", "wb") as f:
                    f.write((text.as_py() or "").encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    os.makedirs(root)
    docs = tables.table(spark, sf, "documents").select("text", "lang")
    docs.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return root


_TEXT_FILE = r"/lang=([a-z]+)/part-[^/]*\.txt$"


@query
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    found = files.scan_inventory(spark, [_document_files(spark, sf)])
    texts = found.filter(F.col("path").rlike(_TEXT_FILE))
    return texts.select(F.regexp_extract("path", _TEXT_FILE, 1).alias("lang"), "size", "is_dir")


@query
def scan_objects(spark: SparkSession, sf: str) -> DataFrame:
    found = files.scan_objects(spark, [_document_files(spark, sf)])
    return found.select(F.regexp_extract("path", _TEXT_FILE, 1).alias("lang"), "size")


@query
def dup_files(spark: SparkSession, sf: str) -> DataFrame:
    found = files.scan_inventory(spark, [_document_files(spark, sf)])
    dupes, _ = files.duplicate_files(found.filter(F.col("path").rlike(_TEXT_FILE)))
    return dupes.select("hash", "size", F.regexp_extract("path", _TEXT_FILE, 1).alias("lang"))


#: Of documents with this remainder of their id by three the files go away.
GONE = 2


def _document_store(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, path`` of the documents, each written by a task as a file below ``path``, a URI, in folders by language.

    Two thirds of the names begin with a point or an underscore, as do those of their folders, and all
    have what looks like a code for a blank.
    """
    root = scratch_dir(spark).removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            paths = []
            for doc_id, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                folder, mark = [(lang, ""), (f".{lang}", "."), (f"_{lang}", "_ ")][doc_id % 3]
                if folder not in made:
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    made.add(folder)
                path = f"{root}/{folder}/{mark}{doc_id}%20.txt"
                with open(path, "wb") as f:
                    f.write((text.as_py() or "").encode())
                paths.append(f"file://{path}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["doc_id", "path"])

    docs = tables.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return materialize(docs.mapInArrow(write, "doc_id bigint, path string"))


def _store_root(stored: DataFrame) -> str:
    return stored.select(F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1)).first()[0]


_DOC_NAME = r"/[._ ]*([0-9]+)%20\.txt$"


def _doc_id(path: str = "path") -> Column:
    return F.regexp_extract(path, _DOC_NAME, 1).cast("bigint").alias("doc_id")


@query
def dup_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Equal documents in a store, named by URIs."""
    root = _store_root(_document_store(spark, sf))
    dupes, _ = files.duplicate_files(files.scan_inventory(spark, [root]))
    return dupes.select("hash", "size", _doc_id())


@query
def scan_two_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Folders and files below two roots, of which one lies in the other."""
    root = _store_root(_document_store(spark, sf))
    found = files.scan_inventory(spark, [root, f"{root}/.en"])
    names = found.select(F.substring("path", len(root) + 2, 1000).alias("name"), "is_dir", F.when(~F.col("is_dir"), F.col("size")).alias("size"))
    return names.filter("name <> ''")


@query
def unreadable_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that went between listing and hashing have an error and no hash; the others are hashed."""
    stored = _document_store(spark, sf)
    listed = materialize(files.scan_inventory(spark, [_store_root(stored)]).filter("not is_dir"))

    def unlink(batches):
        for batch in batches:
            for path in batch["path"]:
                if os.path.exists(path.removeprefix("file://")):  # a repeated task
                    os.unlink(path.removeprefix("file://"))
            yield batch

    materialize(stored.filter(F.col("doc_id") % 3 == GONE).mapInPandas(unlink, "doc_id bigint, path string"))
    hashed = files.hash_files(listed)
    error = F.regexp_extract("error", "^([A-Z]+): ", 1)
    return hashed.select(_doc_id(), "hash", "size", F.when(F.col("error").isNotNull(), error).alias("error"))


# --- latency --------------------------------------------------------------


@query
def ping_parse(spark: SparkSession, sf: str) -> DataFrame:
    return latency.parse_ping_lines(tables.reply_lines(spark, sf))


def _stats(stats: DataFrame) -> DataFrame:
    others = [c for c in stats.columns if c not in ("avg", "max", "median")]
    return stats.select(*others, _r("avg", 9).alias("avg"), _r("max").alias("max"), _r("median").alias("median"))


@query
def bucket_stats_6h(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(latency.time_bucket_stats(tables.latencies(spark, sf), "6h"))


@query
def bucket_stats_1d(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(latency.time_bucket_stats(tables.latencies(spark, sf), "1d"))


@query
def bucket_stats_1w(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(latency.time_bucket_stats(tables.latencies(spark, sf), "1w"))


@query
def bucket_stats_by_addr(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(latency.time_bucket_stats(tables.latencies(spark, sf), "1w", keys=["addr"]))


@query
def bucket_stats_null_addr(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh address unknown: these rows are a group too."""
    known = F.when(F.col("addr").cast("bigint") % 7 > 0, F.col("addr"))
    rows = tables.latencies(spark, sf).withColumn("addr", known)
    return _stats(latency.time_bucket_stats(rows, "1w", keys=["addr"]))


def _quarter_days(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(latency.time_bucket_stats(tables.latencies(spark, sf), "6h"))


@query
def agg_stats(spark: SparkSession, sf: str) -> DataFrame:
    row = latency.aggregate_stats(_quarter_days(spark, sf))
    return row.select(*[_r(c).alias(c) if c != "total_pings" else F.col(c) for c in row.columns])


@query
def outliers(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(latency.high_outliers(_quarter_days(spark, sf))).select("time_bucket", "count", "avg", "max", "median")


@query
def weekly_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered_stats = latency.sort_weekly(_quarter_days(spark, sf))
    weekday, clock, day = latency.weekly_key(F.col("time_bucket"))
    return ordered_stats.select("time_bucket", weekday.alias("weekday"), clock.alias("clock"), day.alias("day"))


@query
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latency_report(_quarter_days(spark, sf)).lines.select("time_bucket", "line")


@query
def report_header(spark: SparkSession, sf: str) -> DataFrame:
    row = latency.aggregate_stats(_quarter_days(spark, sf))
    return latency.report_header(row.select(*[_r(c, 4).alias(c) for c in row.columns]))


@query
def by_network(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(latency.time_bucket_stats(latency.by_network(tables.latencies(spark, sf), "local"), "1d"))


@query
def since_7d(spark: SparkSession, sf: str) -> DataFrame:
    recent = latency.since(tables.latencies(spark, sf), "7d", F.lit("2024-01-30").cast("timestamp_ntz"))
    return _stats(latency.time_bucket_stats(recent, "1d"))


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses with an id; every tenth user is unknown."""
    users = tables.users(spark, sf).filter(F.col("user_id") % 10 != 3)
    return users.select(F.col("user_id").cast("string").alias("addr"), (F.col("user_id") + 1000).alias("addr_id"))


@query
def resolve_address(spark: SparkSession, sf: str) -> DataFrame:
    known = latency.resolve_address(tables.latencies(spark, sf), _addresses(spark, sf))
    return known.select("event_id", "addr", "addr_id")


@query
def stats_for_addr(spark: SparkSession, sf: str) -> DataFrame:
    stats = latency.stats_for(
        tables.latencies(spark, sf), _addresses(spark, sf), "4", duration="1d", network="local"
    )
    return _stats(stats)


@query
def stats_for_unknown_addr_compat(spark: SparkSession, sf: str) -> DataFrame:
    stats = latency.stats_for(
        tables.latencies(spark, sf), _addresses(spark, sf), "13", duration="1d", network="global", compat=True
    )
    return _stats(stats)


@query
def sample_every(spark: SparkSession, sf: str) -> DataFrame:
    rows = latency.sample_every(tables.latencies(spark, sf), "1h", ["addr"], tie=["event_id"])
    return rows.select("slot", "event_id", "ts", "addr", "time")


@query
def measurements_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    rows = latency.parse_ping_lines(tables.reply_lines(spark, sf))
    stamps = tables.table(spark, sf, "events").select("event_id", "ts")
    measurements.append_measurements(rows.join(stamps, "event_id"), path)
    stored = measurements.read_measurements(spark, path)
    return stored.select("event_id", "ts", "addr", "seq", "time", F.col("day").cast("string").alias("day"))


@query
def network_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    rows = tables.latencies(spark, sf)
    routed = rows.withColumn("network", F.when(F.col("event_id") % 7 > 0, F.col("network")))
    measurements.write_by_network(routed, path)
    return spark.read.parquet(path).groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query
def bucket_stats_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Daily responses of a stats server, written as JSON and read back."""
    path = scratch_dir(spark)
    stats = latency.time_bucket_stats(tables.latencies(spark, sf), "6h")
    record = F.struct(
        F.date_format("time_bucket", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time_bucket"),
        F.col("count").cast("string").alias("count"),
        _r("avg", 9).alias("avg"),
        _r("max").alias("max"),
        _r("median").alias("median"),
    )
    daily = stats.groupBy(F.to_date("time_bucket").alias("day")).agg(F.collect_list(record).alias("result"))
    daily.repartition(4, "day").select("result").write.option("maxRecordsPerFile", 1).json(path)
    back = measurements.read_bucket_stats(spark, path)
    return back.withColumn("time_bucket", F.col("time_bucket").cast("timestamp_ntz"))


# --- metrics --------------------------------------------------------------


@query
def cpu_totals(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("user"),
        F.lit(0).cast("bigint").alias("nice"),
        F.col("l_suppkey").alias("sys"),
        F.col("l_quantity").cast("bigint").alias("idle"),
        F.col("l_linenumber").cast("bigint").alias("irq"),
    )
    totals = metrics.cpu_totals(lines)
    return totals.groupBy("l_orderkey").agg(F.sum("total").alias("total"), F.sum("idle").alias("idle"))


@query
def cpu_deltas(spark: SparkSession, sf: str) -> DataFrame:
    counters = materialize(tables.cpu_counters(spark, sf))
    deltas = metrics.counter_deltas(counters, tie=["event_id"])
    return deltas.select("event_id", "cpu", "total", "idle", "d_total", "d_idle")


@query
def lookback_mean(spark: SparkSession, sf: str) -> DataFrame:
    means = metrics.lookback_mean(
        tables.cpu_samples(spark, sf), ms=6 * 3_600_000, tie=["event_id"]
    )
    return means.select("event_id", "cpu", _r("mean_total").alias("mean_total"), _r("mean_idle").alias("mean_idle"))


@query
def lookback_mean_no_edge(spark: SparkSession, sf: str) -> DataFrame:
    means = metrics.lookback_mean(
        tables.cpu_samples(spark, sf), ms=6 * 3_600_000, tie=["event_id"], include_edge=False
    )
    return means.select("event_id", "cpu", _r("mean_total").alias("mean_total"), _r("mean_idle").alias("mean_idle"))


@query
def utilization(spark: SparkSession, sf: str) -> DataFrame:
    daily = tables.cpu_samples(spark, sf).groupBy("cpu", F.to_date("ts").alias("day"))
    used = daily.agg(F.sum("total").alias("total"), F.sum("idle").alias("idle"))
    return used.select(
        "cpu",
        F.col("day").cast("string").alias("day"),
        metrics.utilization("total", "idle").alias("utilization"),
        F.split(metrics.utilization_bar("total", "idle"), r"\|")[0].alias("bar"),
    )


@query
def cpu_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.cpu_report(
        tables.cpu_samples(spark, sf), ms=12 * 3_600_000, tie=["event_id"]
    )
    return rows.select("event_id", "utilization")


@query
def running_extrema(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.running_extrema(tables.gauges(spark, sf), tie=["event_id"])
    return rows.select("event_id", "gauge", "value", "min_so_far", "max_so_far")


@query
def gauge_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gauge_extrema(tables.gauges(spark, sf), tie=["event_id"])


@query
def running_total(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cpu_counters(spark, sf).select("event_id", "total", "idle")


@query
def keep_newest(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.keep_newest_half(tables.gauges(spark, sf)).select("event_id")


@query
def keep_newest_by_cpu(spark: SparkSession, sf: str) -> DataFrame:
    kept = metrics.keep_newest_half(tables.cpu_samples(spark, sf), ["cpu"], max_samples=60)
    return kept.select("event_id", "cpu")


@query
def keep_newest_null_cpu(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh core unknown: these samples are a series too."""
    samples = tables.cpu_samples(spark, sf).withColumn("cpu", F.when(F.col("cpu") % 7 > 0, F.col("cpu")))
    return metrics.keep_newest_half(samples, ["cpu"], max_samples=60).select("event_id", "cpu")


@query
def network_two_writes(spark: SparkSession, sf: str) -> DataFrame:
    """The second network's write leaves the first one's rows."""
    path, rows = scratch_dir(spark), tables.latencies(spark, sf)
    for network in ("global", "local"):
        measurements.write_by_network(latency.by_network(rows, network), path)
    return spark.read.parquet(path).groupBy("network").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    big = F.col("value") > 50
    return metrics.sample_counts(tables.gauges(spark, sf), ["gauge"], kept=big, drawn=F.col("event_id") % 2 == 0)


# --- keypad ---------------------------------------------------------------


@query
def corpus_words(spark: SparkSession, sf: str) -> DataFrame:
    return tables.corpus_words(spark, sf)


@query
def word_digits(spark: SparkSession, sf: str) -> DataFrame:
    return tables.corpus_words(spark, sf).select("word", keypad_text.to_digits("word").alias("digits"))


@query
def key_digits(spark: SparkSession, sf: str) -> DataFrame:
    """Keys typed: the customer number, each digit as the key that gives it."""
    customer = tables.table(spark, sf, "customer")
    typed = F.translate(F.col("c_custkey").cast("string"), "1234567890", "qweasdzxc ")
    return customer.select("c_custkey", typed.alias("typed")).withColumn("digits", keypad_text.keys_to_digits("typed"))


@query
def word_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return keypad.word_frequencies(tables.turn_words(spark, sf), materialize(tables.corpus_words(spark, sf)))


@query
def words_with_frequency(spark: SparkSession, sf: str) -> DataFrame:
    occurrences = keypad.with_frequency(tables.turn_words(spark, sf), materialize(tables.corpus_words(spark, sf)))
    return occurrences.groupBy("word", "n").agg(F.count(F.lit(1)).alias("occurrences"))


@query
def prefix_index(spark: SparkSession, sf: str) -> DataFrame:
    return keypad.prefix_index(tables.corpus_words(spark, sf)).select("prefix", "word")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """First three letters of the event types, typed on the keypad."""
    kinds = tables.table(spark, sf, "events").select(F.substring("event_type", 1, 3).alias("word")).distinct()
    return materialize(kinds.select(keypad_text.to_digits("word").alias("prefix")))


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    return keypad.prefix_lookup(_queries(spark, sf), keypad.prefix_index(tables.corpus_words(spark, sf)))


@query
def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _lookup(spark, sf).select("prefix", "word", "n")


@query
def stored_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    listings.write_prefix_index(keypad.prefix_index(tables.corpus_words(spark, sf)), path)
    return keypad.prefix_lookup(_queries(spark, sf), listings.read_prefix_index(spark, path)).drop("digits")


@query
def rank_words(spark: SparkSession, sf: str) -> DataFrame:
    index = materialize(keypad.prefix_index(tables.corpus_words(spark, sf)))
    return keypad.rank_words(index).select("prefix", "word", "n", "rn")


@query
def top_words(spark: SparkSession, sf: str) -> DataFrame:
    return keypad.top_words(keypad.prefix_index(tables.corpus_words(spark, sf))).select("prefix", "word", "n", "rn")


@query
def keypad_report(spark: SparkSession, sf: str) -> DataFrame:
    """Typed keys to ranked words, in one go."""
    digits = _queries(spark, sf).select(F.translate("prefix", "1234567890", "qweasdzxc ").alias("keys"))
    words = tables.turn_words(spark, sf).distinct()
    found = reports.keypad_report(words, materialize(tables.corpus_words(spark, sf)), materialize(digits))
    return found.select("prefix", "word", "n", "rn")


@query
def word_count_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    counts = tables.corpus_words(spark, sf)
    counts.select(F.concat_ws(" ", "word", F.col("n").cast("string"))).write.text(path)
    return listings.read_word_counts(spark, path)


@query
def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines, trimmed, without empty ones."""
    path = scratch_dir(spark)
    tables.table(spark, sf, "documents").select("text").write.option("lineSep", "\n").text(path)
    return listings.read_lines(spark, path, "line").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# --- codebook -------------------------------------------------------------


def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(codebook.symbol_histogram(tables.documents(spark, sf), "text"))


def _book(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(codebook.codebook(_histogram(spark, sf)))


@query
def symbol_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return codebook.symbol_histogram(tables.documents(spark, sf), "text")


@query
def codebook_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codebook.codebook(_histogram(spark, sf))


@query
def codebook_kraft(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols in the codebook, and the sum of two to the minus bits, which is 1 for a full code."""
    book = codebook.codebook(_histogram(spark, sf))
    return book.agg(F.count(F.lit(1)).alias("symbols"), _r(F.sum(F.pow(F.lit(0.5), F.col("bits"))), 9).alias("kraft"))


@query
def encode_corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    packed = codebook.encode_corpus(docs, _book(spark, sf), "text")
    return packed.select("doc_id", F.length("data").alias("bytes"), "pad", F.sha1("data").alias("digest"))


@query
def encode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    book = _book(spark, sf)
    docs = tables.documents(spark, sf)
    packed = codebook.encode_corpus(docs, book, "text").drop("text")
    return codebook.decode_corpus(packed, book, "text").select("doc_id", "text")


@query
def size_report(spark: SparkSession, sf: str) -> DataFrame:
    histogram = _histogram(spark, sf)
    return codebook.size_report(histogram, codebook.codebook(histogram))


@query
def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn in arrays of at most eight."""
    turns = tables.table(spark, sf, "conversations")
    pieces = arrays.chunk(F.split("text", " "), 8)
    rows = turns.select("conv_id", "turn", F.posexplode(pieces).alias("pos", "words"))
    return rows.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), _joined("words").alias("words"))


# --- accounts -------------------------------------------------------------


@query
def user_keys(spark: SparkSession, sf: str) -> DataFrame:
    keychain = accounts.user_keychain(tables.keychain_keys(spark, sf), tables.users(spark, sf))
    return keychain.select("user_id", "user_name", "key_idx", "key_id", "key_text")


@query
def decrypt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    sealed = tables.keychain_keys(spark, sf).withColumn("_sealed", encrypt_column("key_text", F.lit(SECRET)))
    keys = sealed.select("key_id", "user_id", F.col("_sealed.text").alias("key_text"), F.col("_sealed.iv").alias("iv"))
    keychain = accounts.user_keychain(materialize(keys), tables.users(spark, sf))
    opened = accounts.open_keychain(keychain, F.lit(SECRET))
    return opened.select("key_id", "user_name", "line")


@query
def token_status(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.token_report(tables.tokens(spark, sf), F.lit(TOKEN_NOW)).drop("token")


@query
def token_renewals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.renewals(tables.tokens(spark, sf), F.lit(TOKEN_NOW)).select("o_orderkey", "exp")


# --- runs -----------------------------------------------------------------


@query
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = runs.status_rollup(tables.task_runs(spark, sf), ["project"])
    return rolled.withColumn("sum_duration", _r("sum_duration", 2))


@query
def error_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = runs.error_groups(materialize(tables.task_runs(spark, sf)))
    return groups.withColumnRenamed("task", "run_id")


@query
def suite_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Phases of suites, as multiples of their time; every third suite has no file."""
    shares = dict(zip(runs.PHASES, (3, 2, 5, 1, 4)))
    timed = tables.task_runs(spark, sf).select(
        "project", "type", F.nullif("suite", F.lit("")).alias("file_path"), *[(F.col("duration") * w).alias(p) for p, w in shares.items()]
    )
    rolled = runs.suite_durations(timed, ["project"])
    return rolled.select("project", "files", *[_r(c, 2).alias(c) for c in rolled.columns if c not in ("project", "files")])


@query
def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    return runs.error_messages(tables.task_runs(spark, sf)).withColumnRenamed("task", "run_id")


@query
def failure_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runs.failure_summary(tables.task_runs(spark, sf))


@query
def skipped_first(spark: SparkSession, sf: str) -> DataFrame:
    ranked = runs.skipped_first(tables.task_runs(spark, sf), "run_id")
    return ranked.select("run_id", F.col("mode").isin(*runs.SKIP_MODES).alias("skipped"))


@query
def full_name(spark: SparkSession, sf: str) -> DataFrame:
    return tables.task_runs(spark, sf).select("run_id", runs.full_name("project", "suite", "name").alias("full_name"))


# --- text -----------------------------------------------------------------


@query
def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents")
    scaled = F.col("n_chars") * F.pow(F.lit(64), F.col("doc_id") % 4).cast("bigint")
    return docs.select("doc_id", formatting.human_bytes(scaled).alias("size_text"))


@query
def human_time(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.table(spark, sf, "events")
    ms = F.col("value") * F.pow(F.lit(30), F.col("event_id") % 5) / 50
    return events.select("event_id", formatting.human_time(ms).alias("time_text"), formatting.human_time(ms, 1).alias("short"))


@query
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.table(spark, sf, "events")
    return events.select("event_id", *[formatting.format_date("ts", s).alias(s) for s in formatting.DATE_FORMATS])


# --- streams --------------------------------------------------------------


def _in_steps(rows: DataFrame, parts: int = 4, ts: str = "ts") -> DataFrame:
    """A table as a stream of as many micro-batches: one file after the other, in the order of ``ts``."""
    path, spark = scratch_dir(rows.sparkSession), rows.sparkSession
    rows = materialize(rows)
    span = rows.select(F.unix_micros(F.min(F.col(ts).cast("timestamp"))), F.unix_micros(F.max(F.col(ts).cast("timestamp")))).first()
    low, high = (v or 0 for v in span)
    part = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - low) * parts / (high - low + 1))
    for i in range(parts):
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _in_steps(tables.table(spark, sf, "events"))


def _drain(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is there now and store it; a repeated batch overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write)
    run.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query
def stream_bucket_stats(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    stream = _event_stream(spark, sf)
    run = latency_streams.stream_bucket_stats(
        stream, "6h", "1 hour", f"{path}/data", f"{path}/checkpoint", value="value"
    )
    run.awaitTermination()
    return _stats(_ntz(spark.read.parquet(f"{path}/data").drop("batch"), "time_bucket"))


@query
def stream_bucket_stats_7d(spark: SparkSession, sf: str) -> DataFrame:
    """Whole weeks, from Monday on."""
    path = scratch_dir(spark)
    run = latency_streams.stream_bucket_stats(
        _event_stream(spark, sf), "7d", "1 hour", f"{path}/data", f"{path}/checkpoint", value="value"
    )
    run.awaitTermination()
    return _stats(_ntz(spark.read.parquet(f"{path}/data").drop("batch"), "time_bucket"))


@query
def stream_sample_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each closed week, from Monday on, however the week is written."""
    path = scratch_dir(spark)
    rows = _event_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    _drain(latency_streams.stream_sample_every(rows, "7 days", "1 hour", keys=["user_id"], tie=["event_id"]), path)
    return _ntz(spark.read.parquet(f"{path}/data"), "slot", "ts").select("slot", "event_id", "ts", "user_id", "value")


@query
def stream_sample_every(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    rows = _event_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    _drain(latency_streams.stream_sample_every(rows, "1 hour", "1 hour", keys=["user_id"], tie=["event_id"]), path)
    return _ntz(spark.read.parquet(f"{path}/data"), "slot", "ts").select("slot", "event_id", "ts", "user_id", "value")


@query
def stream_running_extrema(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    gauges = _event_stream(spark, sf).withColumnRenamed("event_type", "gauge")
    _drain(metric_streams.stream_running_extrema(gauges, tie=["event_id"]), path, "update")
    return metric_streams.latest(spark.read.parquet(f"{path}/data"), ["gauge"])


@query
def stream_sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    _drain(metric_streams.stream_sample_counts(_event_stream(spark, sf), ["event_type"]), path, "update")
    return metric_streams.latest(spark.read.parquet(f"{path}/data"), ["event_type"])


def _counter_stream(spark: SparkSession, sf: str, ms_only: bool) -> DataFrame:
    """Counters or samples per core, written as a table and read as a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    rows = tables.cpu_samples(spark, sf) if ms_only else tables.cpu_counters(spark, sf)
    return _in_steps(rows.select("cpu", "ts", "total", "idle"))


@query
def stream_counter_deltas(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    _drain(metric_streams.stream_counter_deltas(_counter_stream(spark, sf, False)), path)
    return _doubles(spark.read.parquet(f"{path}/data").drop("batch"))


def _doubles(deltas: DataFrame) -> DataFrame:
    return deltas.withColumns({c: F.col(c).cast("double") for c in ("total", "idle", "d_total", "d_idle")})


@query
def stream_deltas_over(spark: SparkSession, sf: str) -> DataFrame:
    """Series are over after a day without a sample; then they start anew."""
    path = scratch_dir(spark)
    _drain(metric_streams.stream_counter_deltas(_counter_stream(spark, sf, False), forget="1d", unit="us"), path)
    return spark.read.parquet(f"{path}/data").drop("batch")


@query
def stream_lookback_over(spark: SparkSession, sf: str) -> DataFrame:
    """The same for means over six hours."""
    path = scratch_dir(spark)
    samples = _counter_stream(spark, sf, True)
    _drain(metric_streams.stream_lookback(samples, ms=6 * 3_600_000, forget="1d", unit="us"), path)
    means = spark.read.parquet(f"{path}/data").drop("batch")
    return means.select("cpu", "t", _r("mean_total").alias("mean_total"), _r("mean_idle").alias("mean_idle"))


@query
def stream_lookback(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    samples = _counter_stream(spark, sf, True)
    _drain(metric_streams.stream_lookback(samples, ms=6 * 3_600_000), path)
    means = spark.read.parquet(f"{path}/data").drop("batch")
    return means.select("cpu", "t", _r("mean_total").alias("mean_total"), _r("mean_idle").alias("mean_idle"))


@query
def append_counter_deltas(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    counters = _counter_stream(spark, sf, False)
    run = metric_streams.append_counter_deltas(counters, path, f"{path}/checkpoint")
    run.awaitTermination()
    return _doubles(spark.read.parquet(f"{path}/data").drop("batch"))


@query
def append_lookback(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    run = metric_streams.append_lookback(
        _counter_stream(spark, sf, True), path, f"{path}/checkpoint", ms=6 * 3_600_000
    )
    run.awaitTermination()
    means = spark.read.parquet(f"{path}/data").drop("batch")
    return means.select("cpu", "t", _r("mean_total").alias("mean_total"), _r("mean_idle").alias("mean_idle"))


@query
def stream_sample_gap(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    rows = _event_stream(spark, sf).select("user_id", "ts")
    _drain(metric_streams.stream_sample_gap(rows, ["user_id"], 6 * 3_600_000), path)
    kept = spark.read.parquet(f"{path}/data")
    return kept.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))


@query
def sample_gap(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from a table."""
    rows = tables.table(spark, sf, "events").select("user_id", "ts", "event_id")
    kept = gaps.sample_gap(rows, ["user_id"], 6 * 3_600_000, tie=["event_id"])
    return kept.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))


@query
def sample_gap_all(spark: SparkSession, sf: str) -> DataFrame:
    """One series of all events."""
    rows = tables.table(spark, sf, "events").withColumn("all", F.lit(0))
    kept = gaps.sample_gap(rows, ["all"], 1_800_000, tie=["event_id"], chunk_seconds=86_400)
    return kept.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))


@query
def stream_measurements_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Both halves: replies of the resolved address, and the others with what is wrong."""
    path = scratch_dir(spark)
    rows = tables.reply_lines(spark, sf).withColumn("ts", F.timestamp_seconds("event_id"))
    lines = _in_steps(rows.select("ts", "value", _resolved().alias("resolved")))
    run = latency_streams.stream_measurements_checked(lines, path, f"{path}/checkpoint", F.col("resolved"))
    run.awaitTermination()
    good = spark.read.parquet(f"{path}/data").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(spark.read.parquet(f"{path}/errors")).select("seq", "addr", "time", "error")


def _resolved() -> Column:
    """The address that was asked: the one that replied, but for every tenth line."""
    addr = F.regexp_extract("value", r"from ([0-9.]+)", 1)
    return F.when(F.col("event_id") % 10 == 0, "10.9.9.9").otherwise(addr)


@query
def stream_measurements(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    tables.reply_lines(spark, sf).select("value").write.text(f"{path}/lines")
    lines = spark.readStream.text(f"{path}/lines")
    run = latency_streams.stream_measurements(lines, f"{path}/data", f"{path}/checkpoint", src_addr="10.1.0.1")
    run.awaitTermination()
    stored = spark.read.parquet(f"{path}/data")
    return stored.select("src_addr", "bytes", "addr", "seq", "ttl", "time", "time_unit")
