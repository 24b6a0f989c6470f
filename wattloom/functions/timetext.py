"""Times written as text, read into their parts with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
ZONE = r"(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?"

#: Shapes of a written time. Each replacement gives year|month|day|hour|minute|second|half|zone.
ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[Tt ]\s*{CLOCK}\s*{ZONE}$"
DOTS = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{CLOCK}$"
SLASHES = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{CLOCK}\s*([AaPp]?)\.?[Mm]?\.?$"
MONTH_FIRST = rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{CLOCK}\s*([AaPp]?)\.?[Mm]?\.?$"
DAY_FIRST = rf"^(?:[A-Za-z]{{3}}[a-z]*,\s*)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{4}}),?\s+{CLOCK}\s*{ZONE}$"
NUMBER = r"^-?\d{1,18}(?:\.\d+)?$"

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Seconds between the Unix epoch and 1989-12-31T00:00:00Z, from which devices count. Fixed value.
DEVICE_EPOCH = 631065600


@lru_cache(1)
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(z for z in available_timezones() if "/" in z or z == "UTC"))


def zone_name(text: Column) -> Column:
    """The IANA name within a decorated zone such as ``(GMT+01:00) Europe/Berlin``; else null."""
    name = F.regexp_extract(text, r"([A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|UTC)", 1)
    # two literals; one per zone would take longer to build than the rows to read
    return F.when(F.array_contains(F.split(F.lit(",".join(known_zones())), ","), name), name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _zone_seconds(zone: Column) -> Column:
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    return (
        F.when(zone == "", F.lit(None))
        .when(F.upper(zone).isin("Z", "UTC", "GMT"), F.lit(0))
        .otherwise(sign * (hours * 3600 + F.coalesce(minutes, F.lit(0)) * 60))
        .cast("int")
    )


def read_time(text: Column, slash_day_first: Column) -> Column:
    """struct(wall timestamp_ntz, offset_s int, number double) of a written time.

    ``wall`` is the clock reading cut to seconds with ``offset_s`` where a zone is written;
    ``number`` is the value of a bare number (seconds or finer, of whichever epoch). All three are
    null for null, blank or unreadable text and for dates that do not exist.
    """
    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda t: _read(t, slash_day_first))


def _read(t: Column, slash_day_first: Column) -> Column:
    parts = (
        F.when(t.rlike(ISO), F.regexp_replace(t, ISO, "$1|$2|$3|$4|$5|$6||$7"))
        .when(t.rlike(DOTS), F.regexp_replace(t, DOTS, "$3|$2|$1|$4|$5|$6||"))
        .when(t.rlike(SLASHES) & slash_day_first, F.regexp_replace(t, SLASHES, "$3|$2|$1|$4|$5|$6|$7|"))
        .when(t.rlike(SLASHES), F.regexp_replace(t, SLASHES, "$3|$1|$2|$4|$5|$6|$7|"))
        .when(t.rlike(MONTH_FIRST), F.regexp_replace(t, MONTH_FIRST, "$3|$1|$2|$4|$5|$6|$7|"))
        .when(t.rlike(DAY_FIRST), F.regexp_replace(t, DAY_FIRST, "$3|$2|$1|$4|$5|$6||$7"))
    )
    number = F.when(t.rlike(NUMBER), t.try_cast("double")).alias("number")
    return let(F.split(parts, r"\|", -1), lambda p: F.struct(_wall(p).alias("wall"), _zone_seconds(F.get(p, F.lit(7))).alias("offset_s"), number))


def _wall(p: Column) -> Column:
    at = lambda i: F.get(p, F.lit(i))
    month = F.coalesce(at(1).try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(at(1))), F.lit(0)))
    half, hour = F.lower(at(6)), at(3).try_cast("int")
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    return F.call_function(
        "try_make_timestamp_ntz", at(0).try_cast("int"), month.cast("int"), at(2).try_cast("int"), hour, at(4).try_cast("int"),
        F.coalesce(at(5).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)")),
    )


def slash_parts(text: Column, group: int) -> Column:
    """First or second number of a date with slashes, else null."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t.rlike(SLASHES), F.regexp_extract(t, SLASHES, group).try_cast("int"))


def wall_seconds(wall: Column) -> Column:
    """Seconds from 1970-01-01T00:00 on the wall clock's own scale, whatever the session's zone."""
    since = wall - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return since.cast("interval second").cast("bigint")


def wall_of(seconds: Column) -> Column:
    """timestamp_ntz that stands so many seconds after 1970-01-01T00:00."""
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def zoned_seconds(wall: Column, zone: Column) -> Column:
    """Unix seconds of a wall-clock time in a zone: the earlier instant of a time that occurs twice;
    a skipped time is moved on by the length of the change."""
    return wall_seconds(F.convert_timezone(zone, F.lit("UTC"), wall))


def zone_offset(utc_s: Column, zone: Column) -> Column:
    """Seconds that the zone is ahead of UTC at an instant."""
    return let(utc_s, lambda s: wall_seconds(F.convert_timezone(F.lit("UTC"), zone, wall_of(s))) - s)
