"""Columns parsed from the reply lines of a ping run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The shape of a reply line, and per field its pattern, group and type.
REPLY_LINE = r"^[0-9]+ bytes"
_TIME = r"((?<=time=)[0-9]+(?:\.[0-9]+)?|[0-9]+\.[0-9]+) ([a-z]+)"
REPLY_FIELDS = {
    "bytes": (r"([0-9]+) bytes", 1, "int"),
    "addr": (r"from (\S+):", 1, "string"),
    "seq": (r"(?:icmp_seq|seq)=([0-9]+) ", 1, "bigint"),
    "ttl": (r"ttl=([0-9]+) ", 1, "int"),
    "time": (_TIME, 1, "double"),
    "time_unit": (_TIME, 2, "string"),
}


def reply_field(line: Column, name: str) -> Column:
    """One field of a reply line, NULL where the line lacks it."""
    pattern, group, dtype = REPLY_FIELDS[name]
    text = F.get(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), F.lit(0))
    return text if dtype == "string" else text.try_cast(dtype)
