"""Angles in degrees: headings, circular means, cardinal names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Sectors of 45 degrees centred on north, clockwise (fixed values).
CARDINALS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
LONG_CARDINALS = ["North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest"]


def turn(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def bearing(d_east: Column, d_north: Column) -> Column:
    """Heading of a step: clockwise from north, 0 to 360."""
    return turn(F.degrees(F.atan2(d_east, d_north)))


def difference(a: Column, b: Column) -> Column:
    """Unsigned difference of two headings, at most 180."""
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def circular_mean(degrees: Column) -> Column:
    """Aggregate: direction of the mean unit vector."""
    return turn(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))))


def cardinal(degrees: Column, names: list[str] = CARDINALS) -> Column:
    sector = F.floor(turn(degrees + 22.5) / 45).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, names)), sector)
