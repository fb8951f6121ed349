"""Times: parsing, the three printed forms, frame name stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds from SS, MM:SS or HH:MM:SS with optional decimals; null where not readable."""
    parts = F.split(F.trim(text), ":")
    lead = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    whole = F.aggregate(lead, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p.try_cast("bigint"))
    return F.when(F.size(parts) <= 3, whole * 60 + F.element_at(parts, -1).try_cast("double"))


def strict_seconds(text: Column) -> Column:
    """As above, but digits only and every lower field under 60."""
    parts = F.split(text, ":")
    shape = text.rlike(r"^(?:\d+:){0,2}\d+(?:\.\d+)?$")
    low = F.slice(parts, 2, 2)
    ok = ~F.exists(low, lambda p: p.try_cast("double") >= 60)
    return F.when(shape & ok, parse_time(text))


def parse_times(text: Column) -> Column:
    """Sorted distinct times of a comma list; blanks skipped, null when an item is bad."""
    items = F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")
    times = F.transform(items, parse_time)
    return F.when(~F.exists(times, lambda x: x.isNull()), F.array_sort(F.array_distinct(times)))


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _padded(value: Column) -> Column:
    """At least two digits, never cut."""
    return F.when(value < 10, _two(value)).otherwise(value.cast("string"))


def minutes_stamp(seconds: Column) -> Column:
    """MM:SS, truncated, minutes unbounded."""
    whole = F.floor(seconds)
    return F.concat(_padded(F.floor(whole / 60)), F.lit(":"), _two(whole % 60))


def clock(seconds: Column) -> Column:
    """[H:]MM:SS of the nearest second, halves to even."""
    return _hours(F.rint(seconds).cast("bigint"))


def transcript_stamp(seconds: Column) -> Column:
    """[H:]MM:SS, truncated."""
    return _hours(F.floor(seconds))


def _hours(whole: Column) -> Column:
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    short = F.concat(_two(minutes), F.lit(":"), _two(rest))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), short)).otherwise(short)


def stamped_name(name: Column, seconds: Column) -> Column:
    """``frame_0007.jpg`` to ``frame_0007_t04m12s.jpg``; a stamped name stays as it is."""
    whole = F.rint(seconds).cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    tail = F.concat(_two(minutes), F.lit("m"), _two(rest), F.lit("s"))
    stamp = F.when(hours > 0, F.concat(F.lit("_t"), hours.cast("string"), F.lit("h"), tail)).otherwise(
        F.concat(F.lit("_t"), tail))
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(name.rlike(r"_t\d+[hm]"), name).otherwise(F.concat(stem, stamp, suffix))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(frame_\d+)_t\d+(?:h\d{2}m|m)\d{2}s(\.[A-Za-z0-9]+)", "$1$2")
