"""The given tables seen as the engine's record types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators.dedup import content_listing
from fleetlens.operators.ordered import running, time_chunk

PING_HOST = "10.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the id is the path, the text the content."""
    return content_listing(table(spark, sf_dir, "documents"), "doc_id", "text")


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.octet_length("text").cast("bigint").alias("size"), F.col("doc_id").alias("path"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: ``/host/path`` of the URL without query and fragment."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return pages.select(
        F.concat(F.lit("/"), bare).alias("path"), F.octet_length("html").cast("bigint").alias("size"), "page_id"
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies: the user is the address, even users are local."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("addr"),
        F.when(F.col("user_id") % 2 == 0, "local").otherwise("global").alias("network"),
        F.col("value").alias("time"),
    )


def reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines a ping run prints; a signup stands for a header line."""
    events = table(spark, sf_dir, "events")
    addr = F.format_string(f"{PING_HOST}.%d.%d", F.floor(F.col("user_id") / 256), F.col("user_id") % 256)
    reply = F.format_string(
        "%d bytes from %s: icmp_seq=%d ttl=%d time=%.3f ms",
        F.col("user_id") % 64 + 56,
        addr,
        F.col("event_id"),
        F.col("event_id") % 200 + 30,
        F.col("value"),
    )
    header = F.concat(F.lit("PING host ("), addr, F.lit("): 56 data bytes"))
    return events.select("event_id", F.when(F.col("event_type") == "signup", header).otherwise(reply).alias("value"))


def cpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what one core did since its last sample, in hundredths; views are idle time."""
    events = table(spark, sf_dir, "events")
    spent = F.round(F.col("value") * 100).cast("bigint")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("cpu"),
        spent.alias("total"),
        F.when(F.col("event_type") == "view", spent).otherwise(0).cast("bigint").alias("idle"),
    )


def cpu_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as counters that only grow, per core."""
    samples = cpu_samples(spark, sf_dir).withColumnsRenamed({"total": "used", "idle": "rested"})
    grown = running(
        samples,
        ["cpu"],
        ["ts", "event_id"],
        time_chunk(samples, ["cpu"], "ts", 86400),
        {"total": ("sum", "used"), "idle": ("sum", "rested")},
    )
    return grown.select("event_id", "ts", "cpu", "total", "idle")


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "ts", F.col("event_type").alias("gauge"), "value")


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case words of the documents with how often they occur."""
    docs = documents(spark, sf_dir)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations, one row per occurrence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    return turns.select(F.explode(words).alias("word"))


def keychain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as keys of their customer."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return orders.select(F.col("o_orderkey").alias("key_id"), text.alias("key_text"), F.col("o_custkey").alias("user_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as session tokens issued on the order date."""
    orders = table(spark, sf_dir, "orders")
    iat = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    payload = F.to_json(
        F.struct(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.concat(F.lit("ünïcode?>~"), F.col("o_orderpriority")).alias("user_name"),
            F.col("o_orderkey").alias("jwt_session_id"),
            iat.alias("iat"),
            (iat + (F.col("o_orderkey") % 12 + 1) * 2_592_000).alias("exp"),
            F.col("o_orderstatus").alias("extra"),
        )
    )
    part = F.regexp_replace(F.translate(F.base64(F.encode(payload, "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    return orders.select("o_orderkey", F.concat_ws(".", F.lit("e30"), part, F.lit("c2ln")).alias("token"))


def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test runs: F failed, O passed, P was skipped or is to do."""
    orders = table(spark, sf_dir, "orders")
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    stack = F.when(F.col("o_custkey") % 40 == 0, "").otherwise(F.concat(F.lit("at line "), F.col("o_custkey") % 40))
    error = F.struct(stack.alias("stack"), F.col("o_orderpriority").alias("message"))
    return orders.select(
        key.alias("run_id"),
        F.col("o_orderpriority").alias("project"),
        F.when(key % 3 > 0, F.concat(F.lit("suite "), F.col("o_custkey"))).otherwise("").alias("suite"),
        F.concat(F.lit("test "), key).alias("name"),
        F.when(key % 5 == 0, "suite").otherwise("test").alias("type"),
        F.when(status != "P", "run").when(key % 2 == 0, "skip").otherwise("todo").alias("mode"),
        F.when(status == "F", "fail").when(status == "O", "pass").alias("state"),
        F.col("o_totalprice").alias("duration"),
        F.when(status == "F", F.array(error)).alias("errors"),
    )
