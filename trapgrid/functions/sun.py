"""Sun times from the published low-precision solar position, as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapgrid.functions.clock import epoch_micros

# Fixed values of the solar position formula (degrees, days).
_MEAN_ANOMALY = (357.5291, 0.98560028)
_CENTER = (1.9148, 0.02, 0.0003)
_PERIHELION = 102.9372
_OBLIQUITY = 23.4397
_TRANSIT = 0.0009
_EQUATION = (0.0053, -0.0069)
_HORIZON = -0.3  # whole disc above the horizon: end of sunrise, start of sunset

_RAD = math.pi / 180
_J2000_MICROS = 946_728_000_000_000  # 2000-01-01 12:00 UTC
_DAY_MICROS = 86_400_000_000.0


def sun_times(date: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(end of sunrise, start of sunset) of a local date in epoch microseconds, to the millisecond.

    Both are null where the sun does not cross the horizon that day.
    """
    west = lon * (-_RAD)
    phi = lat * _RAD
    days = F.datediff(date, F.lit("2000-01-01").cast("date")).cast("double")
    turn = west / (2 * math.pi)
    cycle = F.round(days - _TRANSIT - turn)
    approx = cycle + _TRANSIT + turn
    anomaly = (approx * _MEAN_ANOMALY[1] + _MEAN_ANOMALY[0]) * _RAD
    center = (
        F.sin(anomaly) * _CENTER[0] + F.sin(anomaly * 2) * _CENTER[1] + F.sin(anomaly * 3) * _CENTER[2]
    ) * _RAD
    longitude = anomaly + center + (_RAD * _PERIHELION + math.pi)
    declination = F.asin(F.sin(longitude) * math.sin(_RAD * _OBLIQUITY))
    shift = F.sin(anomaly) * _EQUATION[0] + F.sin(longitude * 2) * _EQUATION[1]
    noon = approx + shift
    cosine = (F.lit(math.sin(_RAD * _HORIZON)) - F.sin(phi) * F.sin(declination)) / (
        F.cos(phi) * F.cos(declination)
    )
    half_day = F.when(F.abs(cosine) <= 1, F.acos(cosine))
    sunset = (half_day + west) / (2 * math.pi) + cycle + _TRANSIT + shift
    sunrise = noon - (sunset - noon)

    def micros(days_since_epoch: Column) -> Column:
        return F.round(days_since_epoch * _DAY_MICROS / 1000).cast("long") * 1000 + _J2000_MICROS

    return micros(sunrise), micros(sunset)


def day_or_night(utc: Column, date: Column, lat: Column, lon: Column) -> Column:
    """day, night, flag (exactly on a limit), or null for an undated photo."""
    rise, sink = sun_times(date, lat, lon)
    at = epoch_micros(utc)
    return (
        F.when((at > rise) & (at < sink), "day").when((at < rise) | (at > sink), "night").when(at.isNotNull() & rise.isNotNull(), "flag")
    )
