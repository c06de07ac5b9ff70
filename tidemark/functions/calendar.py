"""Calendar expressions: strata of the year, day-of-year rings, dekads and origin grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = 365


def _c(d: str | Column) -> Column:
    return F.col(d) if isinstance(d, str) else d


def month_day(d: str | Column) -> Column:
    return F.month(_c(d)) * 100 + F.dayofmonth(_c(d))


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def season(d: str | Column) -> Column:
    m = F.month(_c(d))
    return F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "pre_monsoon").when(m <= 9, "monsoon").otherwise("post_monsoon")


def monsoon_phase(d: str | Column) -> Column:
    md = month_day(d)
    return (
        F.when(md.between(301, 531), "pre_monsoon").when(md.between(601, 615), "onset").when(md.between(616, 1015), "peak")
        .when(md.between(1016, 1115), "withdrawal").otherwise("dry")
    )


def ring_day(d: str | Column) -> Column:
    """Day of a 365-day year; in leap years the days from March on move up by one, so 29 February shares day 60 with 1 March."""
    d = _c(d)
    moved = (is_leap(F.year(d)) & (F.month(d) > 2)).cast("int")
    return F.least(F.dayofyear(d) - moved, F.lit(RING))


def dekad_of_year(d: str | Column) -> Column:
    """0 to 35: three a month, from days 1, 11 and 21."""
    d = _c(d)
    return (F.month(d) - 1) * 3 + F.least(F.floor((F.dayofmonth(d) - 1) / 10), F.lit(2)).cast("int")


def dekad_start(d: str | Column) -> Column:
    d = _c(d)
    return F.date_add(F.trunc(d, "month"), F.least(F.floor((F.dayofmonth(d) - 1) / 10), F.lit(2)).cast("int") * 10)


def day_of_year_date(year: str | Column, doy: str | Column) -> Column:
    """The date of a day of the year; a day outside 1 to 365 (366 in leap years) is an error."""
    year, doy = _c(year), _c(doy)
    last = F.when(is_leap(year), 366).otherwise(365)
    bad = F.raise_error(F.concat(F.lit("no day "), doy.cast("string"), F.lit(" in "), year.cast("string"))).cast("date")
    return F.when(doy.between(1, last), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))).otherwise(bad)


def local_day(instant: str | Column, hours: int = 6) -> Column:
    """The calendar day of a UTC instant at an offset."""
    return F.to_date(_c(instant) + F.expr(f"interval {hours} hours"))


def origins(start: str, end: str, horizon: int, stride: int) -> Column:
    """Array of forecast origins whose targets lie inside [start, end]."""
    return F.sequence(F.date_sub(F.lit(start).cast("date"), 1), F.date_sub(F.lit(end).cast("date"), horizon), F.expr(f"interval {stride} days"))
