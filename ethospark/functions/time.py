"""Time arithmetic on naive timestamps, as microseconds. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def stamp(us: Column) -> Column:
    """The naive timestamp of microseconds since the epoch."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_to(us: Column, width: int, origin: int = 0) -> Column:
    """The start of the bin of ``width`` microseconds that holds ``us``; bins begin at ``origin``."""
    return us - F.pmod(us - F.lit(origin), F.lit(width))


def ceil_to(us: Column, width: int) -> Column:
    return floor_to(us + F.lit(width - 1), width)


def bin_start(ts: Column, width: int, origin: int = 0) -> Column:
    return stamp(floor_to(micros(ts), width, origin))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(SECOND))


def time_of_day(us: Column) -> Column:
    """Microseconds since midnight."""
    return F.pmod(us, F.lit(DAY))


def in_clock_window(us: Column, start: int, end: int) -> Column:
    """Whether a time of day is in [start, end], which may wrap midnight."""
    t = time_of_day(us)
    return (t >= start) | (t <= end) if start > end else t.between(start, end)


def night_of(us: Column, begins: int = 18 * HOUR) -> Column:
    """The date on which the night of ``us`` began."""
    return F.to_date(stamp(us - F.lit(begins)))


def night_bounds(night: Column, last: Column, begins: int = 18 * HOUR) -> tuple[Column, Column]:
    """Start (18:00) and end (07:00, or 08:00 if anything was seen after seven) of a night, in microseconds."""
    day = micros(night.cast("timestamp_ntz"))
    seven = day + F.lit(DAY + 7 * HOUR)
    return day + F.lit(begins), F.when(last > seven, seven + F.lit(HOUR)).otherwise(seven)


def clock_text(text: Column) -> Column:
    """18, 1800, 180000 and 18:00:00 as HH:mm:ss; null if it isn't a time of day."""
    digits = F.regexp_replace(F.trim(text), "[^0-9]", "")
    padded = F.rpad(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits), 6, "0")
    out = F.concat_ws(":", F.substring(padded, 1, 2), F.substring(padded, 3, 2), F.substring(padded, 5, 2))
    return F.when(F.length(digits).between(1, 6) & out.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), out)


def zone_time(text: Column, zone: str) -> Column:
    """A moment as a naive time of ``zone``: a number is seconds since 1970 in UTC, a time with a zone or offset is converted, one without is that zone's already. Null if it is none of these."""
    number = text.try_cast("double")
    plain = F.replace(F.trim(text), F.lit("T"), F.lit(" "))
    zoned = plain.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2}| [A-Za-z]+/[A-Za-z_]+)$")
    at_utc = F.when(number.isNotNull(), F.timestamp_micros((number * SECOND).cast("bigint"))).when(zoned, plain.try_cast("timestamp"))
    return F.when(number.isNotNull() | zoned, F.from_utc_timestamp(at_utc, zone).cast("timestamp_ntz")).otherwise(plain.try_cast("timestamp_ntz"))


def date_dash(text: Column) -> Column:
    """20250103 as 2025-01-03; other texts stay."""
    return F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)


def date_key(text: Column) -> Column:
    """A date without its dashes, as keys of folders have it; ``unknown-date`` where there is none."""
    return F.coalesce(F.nullif(F.replace(F.trim(text), F.lit("-"), F.lit("")), F.lit("")), F.lit("unknown-date"))
