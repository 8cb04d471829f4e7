"""Keychains: keys joined to their users, decrypted and listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.secrets import decrypt_column, jwt_payload, token_status
from fleetlens.operators.ordered import numbered
from fleetlens.operators.skew import MAX_BROADCAST_ROWS, lookup_join

KEY_RANGE = 100_000


def join_users(keys: DataFrame, users: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Keychain keys with the columns of their user."""
    return lookup_join(keys, users, "user_id", spread=["key_id"], max_broadcast_rows=max_broadcast_rows)


def user_keychain(
    keys: DataFrame, users: DataFrame, chunk: Column | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Every key with its user and its 0-based position ``key_idx`` in the user's list.

    The list is a numbered table rather than an array, so a user may own any
    number of keys. ``chunk`` defaults to ranges of the numeric ``key_id``. Keys
    are numbered before the join, which keeps or drops a user's keys together.
    """
    cell = chunk if chunk is not None else F.floor(F.col("key_id") / KEY_RANGE)
    placed = numbered(keys, ["user_id"], ["key_id"], cell, "key_idx")
    return join_users(placed.withColumn("key_idx", F.col("key_idx") - 1), users, max_broadcast_rows)


def open_keychain(keychain: DataFrame, key: Column) -> DataFrame:
    """Add ``key_plain`` and the ``line`` that lists it."""
    plain = keychain.withColumn("key_plain", decrypt_column("key_text", "iv", key))
    return plain.withColumn("line", F.concat(F.col("key_idx").cast("string"), F.lit(": "), F.col("key_plain")))


def token_report(tokens: DataFrame, now: Column, token: str = "token", mode: str = "failfast") -> DataFrame:
    """Payload columns and ``status`` of each token."""
    read = tokens.withColumn("_payload", jwt_payload(token, mode))
    return read.withColumn("status", token_status("_payload", now)).select(*tokens.columns, "_payload.*", "status")
