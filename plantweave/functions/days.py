"""Calendar days of events whose clocks differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped


def written_moment(date: Column, time: Column, pattern: str = "dd.MM.yyyy HH:mm") -> Column:
    """The wall clock that two texts tell; null if they don't fit the pattern."""
    text = F.concat_ws(" ", date, time)
    return F.when(date.isNotNull() & time.isNotNull(), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))


def clock_change(wall: Column, zone: str) -> Column:
    """skipped or repeated if a change of the zone's clock makes a wall clock void or double, else null."""
    utc = lambda w: F.convert_timezone(F.lit(zone), F.lit("UTC"), w)
    back = lambda u: F.convert_timezone(F.lit("UTC"), F.lit(zone), u)
    hour = F.expr("INTERVAL '1' HOUR")
    skipped = back(utc(wall)) != wall
    repeated = back(utc(wall) + hour) == wall  # of two instants the earlier one is taken
    return F.when(skipped, "skipped").when(repeated, "repeated")


def local_day(wall: Column, zone_label: Column, zone: str = "Europe/Berlin") -> Column:
    """The day in zone: of UTC clocks converted, of all others as written unless a clock change makes them unclear."""
    is_utc = F.upper(stripped(F.coalesce(zone_label, F.lit("")))) == "UTC"
    converted = F.convert_timezone(F.lit("UTC"), F.lit(zone), wall)
    return F.to_date(F.when(is_utc, converted).when(clock_change(wall, zone).isNull(), wall))


def written_year(date: Column) -> Column:
    return F.year(F.try_to_timestamp(date, F.lit("dd.MM.yyyy")))


def day_label(day: Column) -> Column:
    """5 Jan 2024."""
    return F.date_format(day, "d MMM yyyy")


def month_label(day: Column) -> Column:
    """Jan 2024."""
    return F.date_format(day, "MMM yyyy")
