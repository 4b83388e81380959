"""Numbers, durations and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _tenths(value: Column) -> Column:
    """Nearest whole number of tenths of a non-negative double, ties to even.

    Ten times the value is held as an exact sum (8x + 2x = total + rest), so the
    choice depends on the stored value and not on a rounded product: 0.25 gives
    2 and 0.35, stored a little below, gives 3.
    """
    eight, two = value * F.lit(8.0), value * F.lit(2.0)
    total = eight + two
    moved = total - eight
    rest = (eight - (total - moved)) + (two - moved)
    whole = F.floor(total)
    part = total - whole
    odd = whole % 2 == 1
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & odd)))
    return F.when(up, whole + 1).otherwise(whole)


def one_decimal(value: Column | str, thousands: bool = False) -> Column:
    """Text with one decimal, as in `12.3`; with `thousands`, as in `1,234.5`."""
    value = _col(value).cast("double")
    tenths = _tenths(F.abs(value))
    whole = F.call_function("div", tenths, F.lit(10))
    whole = F.format_number(whole, 0) if thousands else whole.cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, whole, F.lit("."), (tenths % 10).cast("string"))


def format_duration(seconds: Column | str) -> Column:
    """`59.9s` below a minute, `1.5m` below an hour, else `6.9h`."""
    seconds = _col(seconds).cast("double")
    short, middle = seconds < 60, seconds < 3600
    amount = F.when(short, seconds).when(middle, seconds / 60).otherwise(seconds / 3600)
    unit = F.when(short, "s").when(middle, "m").otherwise("h")
    return F.concat(one_decimal(amount), unit)


def rate_text(value: Column | str, missing: str = "-") -> Column:
    """One decimal, thousands separated; `missing` for null."""
    return F.coalesce(one_decimal(value, thousands=True), F.lit(missing))


def percent_text(value: Column | str, missing: str = "-") -> Column:
    return F.coalesce(F.concat(one_decimal(value), F.lit("%")), F.lit(missing))


def count_text(value: Column | str, missing: str = "-") -> Column:
    """Whole number, thousands separated."""
    return F.coalesce(F.format_number(_col(value), 0), F.lit(missing))


def or_missing(value: Column | str, missing: str = "N/A") -> Column:
    value = _col(value)
    return F.when(value.isNull() | (value == ""), F.lit(missing)).otherwise(value)


def epoch_timestamp(seconds: Column | str) -> Column:
    """Epoch seconds, whole or fractional, as a timestamp."""
    return F.timestamp_seconds(_col(seconds))


def timestamp_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def bar(value: Column | str, largest: Column | str, width: int = 50) -> Column:
    """A bar of full blocks, `width` long at `largest`."""
    share = F.try_divide(_col(value), _col(largest))
    return F.repeat(F.lit("█"), F.floor(F.coalesce(share, F.lit(0.0)) * width).cast("int"))
