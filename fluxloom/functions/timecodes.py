"""Stamps: logger date vectors, serial days, epoch micros and period keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000
# serial day number of 1970-01-01
EPOCH_SERIAL_DAY = 719_529


def from_date_vector(year: Column, doy: Column, hhmm: Column, second: Column) -> Column:
    """Epoch micros of (year, 1-based day of year, 100*hour+minute, second rounded to 0.01)."""
    days = F.unix_date(F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (doy - 1).cast("int")))
    hm = hhmm.cast("long")
    minutes = F.floor(hm / 100) * 60 + F.pmod(hm, F.lit(100))
    return (days.cast("long") * DAY_US + minutes.cast("long") * 60_000_000
            + F.round(second * 100).cast("long") * 10_000)


def to_date_vector(us: Column) -> dict[str, Column]:
    """The inverse of :func:`from_date_vector`: year, doy, hhmm, second."""
    ts = F.timestamp_micros(us)
    return {
        "year": F.year(ts), "doy": F.dayofyear(ts),
        "hhmm": F.hour(ts) * 100 + F.minute(ts),
        # rounded as hundredths: decimal rounding to two places takes other ties up than from_date_vector and SQL
        "second": F.round(F.pmod(us, F.lit(60_000_000)) / 1e6 * 100) / 100,
    }


def to_serial_day(us: Column) -> Column:
    """Days since year 0 with fraction."""
    return EPOCH_SERIAL_DAY + us / float(DAY_US)


def from_serial_day(day: Column) -> Column:
    """Epoch micros of a serial day, rounded to the millisecond; missing stays missing."""
    return F.round((day - EPOCH_SERIAL_DAY) * 86_400_000.0).cast("long") * 1000


def epoch_seconds(us: Column) -> Column:
    return us / 1e6


def period_end(us: Column, period_us: int) -> Column:
    """End stamp of the right-closed period holding the stamp."""
    return us + F.pmod(-us, F.lit(period_us))


def period_start(us: Column, period_us: int) -> Column:
    """Start stamp of the left-closed period holding the stamp."""
    return us - F.pmod(us, F.lit(period_us))
