"""Human-readable sizes, times, dates and bars, as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Unit limits and labels, date formats, bar widths.
BYTE_UNITS = [(1024**3, "gb"), (1024**2, "mb"), (1024, "kb")]
TIME_UNITS = [(3_600_000, "h"), (60_000, "m"), (1000, "s"), (1, "ms")]
DATE_FORMATS = {
    "report": "'['MM-dd-y']' hh:mm a",
    "file": "MMddy_kkmm",
    "lexical": "y-MM-dd_HH-mm-ss",
    "debug": "'['MM-dd-y']' HH:mm:ss.SSS",
    "day": "E",
    "clock": "HH:mm:ss",
}
LATENCY_BAR_WIDTH = 50
CPU_BAR_WIDTH = 30


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_up(value: Column | str, digits: int = 0) -> Column:
    """Round with ties towards plus infinity, also below zero."""
    scale = 10**digits
    scaled = F.floor(_col(value) * F.lit(scale) + F.lit(0.5))
    return scaled if digits == 0 else scaled / F.lit(scale)


def fixed(value: Column | str, digits: int) -> Column:
    """Decimal text of the double's exact value, ties away from zero.

    ``%.nf`` rounds the shortest decimal form instead (1.2345 is a little below
    that), and ``format_number`` rounds ties to even and does not round up values
    below one last place. A tie is a value with exactly ``digits + 1`` binary
    places.
    """
    value = _col(value).cast("double")
    scaled = F.abs(value * F.lit(float(2 ** (digits + 1))))
    is_tie = (scaled % 2) == 1
    exact = F.regexp_replace(F.format_number(value, digits), ",", "")
    half = Decimal(5).scaleb(-digits - 1)
    above_half = value >= float(half) if Decimal(float(half)) >= half else value > float(half)
    one = f"{Decimal(1).scaleb(-digits):f}"
    return (
        F.when(is_tie, F.format_string(f"%.{digits}f", value))
        .when(above_half & (value < float(one)), one)
        .otherwise(exact)
    )


def human_bytes(size: Column | str, digits: int = 3) -> Column:
    """``4096`` as ``4.000 kb``; a unit starts strictly above its limit."""
    size = _col(size).cast("double")
    shown = size
    label = F.lit("b")
    for limit, unit in reversed(BYTE_UNITS):
        shown = F.when(size > limit, size / limit).otherwise(shown)
        label = F.when(size > limit, unit).otherwise(label)
    return F.concat_ws(" ", fixed(shown, digits), label)


def human_time(ms: Column | str, digits: int | None = None) -> Column:
    """``255000`` as ``4.250 m``; whole numbers get decimals only when ``digits`` is given."""
    ms = _col(ms).cast("double")
    shown, label = ms * 1000, F.lit("µs")
    for limit, unit in reversed(TIME_UNITS):
        shown = F.when(ms >= limit, ms / limit).otherwise(shown)
        label = F.when(ms >= limit, unit).otherwise(label)
    if digits is not None:
        text = fixed(shown, digits)
    else:
        text = F.when(shown == F.floor(shown), F.format_string("%.0f", shown)).otherwise(fixed(shown, 3))
    return F.concat_ws(" ", text, label)


def format_date(ts: Column | str, style: str) -> Column:
    """One of the ``DATE_FORMATS``, in the session time zone."""
    return F.date_format(_col(ts), DATE_FORMATS[style])


def bar(value: Column | str, lo: Column, hi: Column, width: int = LATENCY_BAR_WIDTH, pad: bool = False) -> Column:
    """``=`` repeated in proportion to where ``value`` lies between ``lo`` and ``hi``."""
    share = (_col(value) - lo) / F.nullif(hi - lo, F.lit(0.0))
    drawn = F.repeat(F.lit("="), F.coalesce(half_up(share * width), F.lit(0)).cast("int"))
    return F.rpad(drawn, width, " ") if pad else drawn
