"""Short interval text such as ``5m``, ``2h``, ``7d``, ``1w``."""

from __future__ import annotations

import re

# Unit letters.
UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}

_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}
_SHAPE = re.compile(r"([0-9]+)([mhdw])")


def _parts(text: str) -> tuple[int, str]:
    match = _SHAPE.fullmatch(text) if isinstance(text, str) else None
    if match is None:
        raise ValueError(f"not an interval: {text!r} (use 5m, 2h, 7d or 1w)")
    return int(match[1]), match[2]


def spark_interval(text: str) -> str:
    """``"5m"`` as the duration text Spark's ``window`` and ``INTERVAL`` take."""
    count, unit = _parts(text)
    return f"{count} {UNITS[unit]}"


def interval_seconds(text: str) -> int:
    count, unit = _parts(text)
    return count * _SECONDS[unit]
