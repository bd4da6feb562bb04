"""Dates and times. Photo times are camera wall clocks (timestamp_ntz), so no function here
depends on the session time zone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000
UNIT_MICROS = {
    "hour": 3_600 * _SECOND,
    "day": 86_400 * _SECOND,
    "week": 7 * 86_400 * _SECOND,
}


def parse_photo_time(text: Column) -> Column:
    """Wall clock of `YYYY:MM:DD HH:MM:SS` text, null where it is no such time."""
    date_mark, time_mark = (":", "-", "/"), (":",)
    marks = {5: date_mark, 8: date_mark, 11: (" ", "T"), 14: time_mark, 17: time_mark}
    well_formed = F.char_length(text) == 19
    for place, allowed in marks.items():
        well_formed = well_formed & F.substring(text, place, 1).isin(*allowed)
    year, month, day, time = (F.substring(text, start, n) for start, n in ((1, 4), (6, 2), (9, 2), (12, 8)))
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), time)
    return F.when(well_formed, iso.try_cast("timestamp_ntz"))


def parse_set_date(text: Column) -> Column:
    """Date of `18-Aug-15` text; years 69..99 belong to the last century."""
    parts = F.split(text, "-")
    tidy = F.concat_ws("-", F.get(parts, F.lit(0)), F.initcap(F.get(parts, F.lit(1))), F.get(parts, F.lit(2)))
    date = F.when(text.isNotNull(), F.try_to_date(tidy, "d-MMM-yy"))
    return F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)


def parse_slash_date(text: Column) -> Column:
    """Date of `8/18/2015` text."""
    return F.try_to_date(text, "M/d/yyyy")


def parse_iso_date(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def to_utc(wall: Column, zone: Column | str) -> Column:
    """Wall clock of `zone` as a UTC wall clock."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(zone, F.lit("UTC"), wall)


def week_of_year(when: Column) -> Column:
    """Full 7-day periods since 1 January, plus 1."""
    return (F.floor((F.dayofyear(when) - 1) / 7) + 1).cast("int")


def calendar_parts(wall: Column) -> dict[str, Column]:
    """year, week, day (of month), yday, hour and month of a wall clock."""
    return {
        "year": F.year(wall),
        "week": week_of_year(wall),
        "day": F.dayofmonth(wall),
        "yday": F.dayofyear(wall),
        "hour": F.hour(wall),
        "month": F.month(wall),
    }


def epoch_micros(wall: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a wall clock or date."""
    wall = wall.cast("timestamp_ntz")
    days = F.datediff(F.to_date(wall), F.lit("1970-01-01").cast("date")).cast("long")
    in_minute = (F.date_part(F.lit("SECOND"), wall) * _SECOND).cast("long")
    in_day = (F.hour(wall) * 3_600 + F.minute(wall) * 60).cast("long") * _SECOND + in_minute
    return days * 86_400 * _SECOND + in_day


def elapsed(later: Column, earlier: Column, unit: str) -> Column:
    """later − earlier as a real number of `unit`s."""
    return (epoch_micros(later) - epoch_micros(earlier)).cast("double") / F.lit(float(UNIT_MICROS[unit]))


@dataclass(frozen=True)
class Grain:
    """How a time falls into the intervals of its year."""

    name: str
    first: int
    last: int

    def interval(self, when: Column) -> Column:
        if self.name == "week":
            return week_of_year(when)
        if self.name == "day":
            return F.dayofyear(when)
        if self.name == "month":
            return F.month(when)
        return (F.dayofyear(when) - 1) * 24 + F.hour(when.cast("timestamp_ntz"))

    def code(self, when: Column) -> Column:
        """year * 10000 + interval: one int that sorts in calendar order."""
        return (F.year(when) * 10_000 + self.interval(when)).cast("int")


# Interval numbers that every full year has.
GRAINS = {
    "month": Grain("month", 1, 12),
    "week": Grain("week", 1, 52),
    "day": Grain("day", 1, 365),
    "hour": Grain("hour", 0, 8_759),
}


def grain(name: str, allowed: tuple[str, ...]) -> Grain:
    if name not in allowed:
        raise ValueError(f"time_int must be one of {', '.join(allowed)}, not {name!r}")
    return GRAINS[name]
